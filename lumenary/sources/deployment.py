"""The deployment of a site as a template document, written from the services' public documentation.

Files lie in a private, versioned bucket. An edge network with an identity of its own is the one reader, over TLS of the site's name, by
IPv4 and IPv6. The identity may list the bucket, so a missing file is a plain 404. The bucket outlives its stack.
"""

from __future__ import annotations

from ..functions import fixed

#: The zone in which all aliases of the edge network stand.
EDGE_ZONE = "Z2FDTNDATAQYW2"
PARAMETERS = {
    "Label": ("First part of the site's name", "[a-z0-9]([a-z0-9-]{0,40}[a-z0-9])?"),
    "Domain": ("Domain of the zone", "[a-z0-9.-]+"),
    "Zone": ("Id of the public zone", "[A-Z0-9]+"),
}
SITE = {"Fn::Join": [".", [{"Ref": "Label"}, {"Ref": "Domain"}]]}


def storage(tool: str) -> dict:
    """The bucket: nothing public, one owner, old versions kept for a month."""
    closed = {f"{verb}Public{what}": True for verb, what in (("Block", "Acls"), ("Block", "Policy"), ("Ignore", "Acls"))} | {"RestrictPublicBuckets": True}
    old = {"Id": "old-versions", "Status": "Enabled", "NoncurrentVersionExpiration": {"NoncurrentDays": 30}, "AbortIncompleteMultipartUpload": {"DaysAfterInitiation": 2}}
    return {
        "Pages": {
            "Type": "AWS::S3::Bucket",
            "DeletionPolicy": "Retain",
            "UpdateReplacePolicy": "Retain",
            "Properties": {
                "BucketName": {"Fn::Join": ["-", [tool, {"Ref": "Label"}, {"Ref": "AWS::AccountId"}]]},
                "OwnershipControls": {"Rules": [{"ObjectOwnership": "BucketOwnerEnforced"}]},
                "PublicAccessBlockConfiguration": closed,
                "VersioningConfiguration": {"Status": "Enabled"},
                "LifecycleConfiguration": {"Rules": [old]},
            },
        },
        "PagesReaders": {
            "Type": "AWS::S3::BucketPolicy",
            "Properties": {"Bucket": {"Ref": "Pages"}, "PolicyDocument": {"Version": "2012-10-17", "Statement": [_reader("s3:GetObject", "/*"), _reader("s3:ListBucket", "")]}},
        },
    }


def _reader(action: str, below: str) -> dict:
    """What the edge network, and no other, may do with the bucket."""
    arn = {"Fn::GetAtt": ["Pages", "Arn"]}
    edge = {"Fn::Join": ["", ["arn:", {"Ref": "AWS::Partition"}, ":cloudfront::", {"Ref": "AWS::AccountId"}, ":distribution/", {"Ref": "Edge"}]]}
    return {
        "Sid": action.split(":")[1],
        "Effect": "Allow",
        "Principal": {"Service": ["cloudfront.amazonaws.com"]},
        "Action": [action],
        "Resource": [{"Fn::Join": ["", [arn, below]]} if below else arn],
        "Condition": {"ArnEquals": {"aws:SourceArn": edge}},
    }


def delivery(tool: str) -> dict:
    """The edge network with its identity, certificate and caching."""
    seconds = {"MinTTL": 0, "DefaultTTL": 24 * 3600, "MaxTTL": 365 * 24 * 3600}
    nothing = {"CookiesConfig": {"CookieBehavior": "none"}, "HeadersConfig": {"HeaderBehavior": "none"}, "QueryStringsConfig": {"QueryStringBehavior": "none"}}
    packed = {"EnableAcceptEncodingGzip": True, "EnableAcceptEncodingBrotli": True}
    named = lambda kind: {"Fn::Join": ["-", [tool, {"Ref": "Label"}, kind]]}
    return {
        "EdgeIdentity": {
            "Type": "AWS::CloudFront::OriginAccessControl",
            "Properties": {"OriginAccessControlConfig": {"Name": named("reader"), "Description": "Reads the pages", "OriginAccessControlOriginType": "s3", "SigningProtocol": "sigv4", "SigningBehavior": "always"}},
        },
        "EdgeCaching": {
            "Type": "AWS::CloudFront::CachePolicy",
            "Properties": {"CachePolicyConfig": {"Name": named("caching"), **seconds, "ParametersInCacheKeyAndForwardedToOrigin": {**nothing, **packed}}},
        },
        "EdgeTls": {
            "Type": "AWS::CertificateManager::Certificate",
            "Properties": {"DomainName": SITE, "ValidationMethod": "DNS", "DomainValidationOptions": [{"DomainName": SITE, "HostedZoneId": {"Ref": "Zone"}}], "KeyAlgorithm": "EC_prime256v1"},
        },
        "Edge": {
            "Type": "AWS::CloudFront::Distribution",
            "Properties": {
                "DistributionConfig": {
                    "Comment": SITE,
                    "Enabled": True,
                    "HttpVersion": "http2and3",
                    "IPV6Enabled": True,
                    "Aliases": [SITE],
                    "DefaultRootObject": "index.html",
                    "ViewerCertificate": {"AcmCertificateArn": {"Ref": "EdgeTls"}, "MinimumProtocolVersion": "TLSv1.2_2021", "SslSupportMethod": "sni-only"},
                    "Origins": [{"Id": "pages", "DomainName": {"Fn::GetAtt": ["Pages", "RegionalDomainName"]}, "OriginAccessControlId": {"Fn::GetAtt": ["EdgeIdentity", "Id"]}, "S3OriginConfig": {}}],
                    "DefaultCacheBehavior": {"TargetOriginId": "pages", "CachePolicyId": {"Ref": "EdgeCaching"}, "AllowedMethods": ["GET", "HEAD", "OPTIONS"], "Compress": True, "ViewerProtocolPolicy": "redirect-to-https"},
                    "CustomErrorResponses": [{"ErrorCode": 404, "ErrorCachingMinTTL": 60}],
                }
            },
        },
    }


def naming() -> dict:
    """The site's name, for both versions of the protocol."""
    target = {"HostedZoneId": EDGE_ZONE, "DNSName": {"Fn::GetAtt": ["Edge", "DomainName"]}, "EvaluateTargetHealth": False}
    both = [{"Name": SITE, "Type": kind, "AliasTarget": target} for kind in ("A", "AAAA")]
    return {"Names": {"Type": "AWS::Route53::RecordSetGroup", "Properties": {"HostedZoneId": {"Ref": "Zone"}, "RecordSets": both}}}


def template(tool: str = "site") -> dict:
    """The document. The names of its outputs are those that plans read (functions.fixed.OUTPUTS)."""
    values = ({"Ref": "Pages"}, {"Ref": "Edge"}, {"Fn::GetAtt": ["Edge", "DomainName"]}, {"Fn::Join": ["", ["https://", SITE]]})
    return {
        "AWSTemplateFormatVersion": "2010-09-09",
        "Description": f"A static site of {tool}",
        "Parameters": {name: {"Type": "String", "Description": about, "AllowedPattern": pattern} for name, (about, pattern) in PARAMETERS.items()},
        "Resources": storage(tool) | delivery(tool) | naming(),
        "Outputs": {name: {"Value": value} for name, value in zip(fixed.OUTPUTS, values, strict=True)},
    }
