"""The command line: process images, or print what a publication would do."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import process as P, publish as U
from .sources import deployment, files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lumenary")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process", help="resize, frame and caption images")
    p.add_argument("--size", required=True)
    p.add_argument("--filter", default="mks2021")
    p.add_argument("--fit", default="expand")
    p.add_argument("--frame", type=float, default=5.0)
    p.add_argument("--color", default="#fff")
    p.add_argument("--quality", type=int, default=92)
    p.add_argument("-o", "--outdir", default="")
    p.add_argument("--label", action="store_true")
    p.add_argument("--label-font", default="sans")
    p.add_argument("--label-size", type=float, default=1.5)
    p.add_argument("--label-padding", type=float, default=1.0)
    p.add_argument("--linear-light", action="store_true")
    p.add_argument("--format", default=".jpg", help="extension of the output: .jpg, .png or .tiff")
    p.add_argument("images", nargs="+")
    u = commands.add_parser("publish", help="plan a publication from manifests of the cloud's state")
    u.add_argument("--subdomain", default="")
    u.add_argument("--build-dir", default="./build")
    u.add_argument("--profile", default="", help="accepted, unused: nothing is called")
    u.add_argument("--region", default="", help="accepted, unused: nothing is called")
    u.add_argument("--zones", help="JSON lines: ordinal, id, name, private")
    u.add_argument("--objects", help="JSON lines: ordinal, key, etag")
    u.add_argument("--exists", action="store_true", help="the stack exists")
    u.add_argument("--update-error", help="what the service said to the update")
    u.add_argument("--polls", help="JSON lines: ordinal (from 1, every 15 s), status of the stack")
    u.add_argument("--events", help="JSON lines: ordinal, status, reason")
    u.add_argument("--outputs", help="JSON lines: ordinal, output_key, output_value")
    u.add_argument("--clears", help="JSON lines: ordinal (from 1, every 5 s), status of the invalidation")
    u.add_argument("--deadline", type=int, default=U.DEADLINE, help="seconds of the whole publication")
    u.add_argument("--template", action="store_true", help="print the deployment template and end")
    u.add_argument("--pick", type=int, help="number of the zone, if there are several")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenary").getOrCreate()
    files.apply_log_level(spark)
    try:
        if a.command == "process":
            known = {k: v for k, v in vars(a).items() if k not in ("command", "images")}
            for r in P.process(spark, a.images, P.Settings(**known)).orderBy("ordinal").toLocalIterator():
                print(f"{r['path']}: {r['error']}" if r["error"] else f"{r['path']}: {r['in_w']}x{r['in_h']} -> {r['output']} ({r['out_w']}x{r['out_h']})", file=sys.stderr)
            return 0
        if a.template:
            print(json.dumps(deployment.template(U.TOOL), indent=2))
            return 0
        listed = lambda path, schema: files.manifest(spark, path, schema) if path else None
        zones = listed(a.zones, "ordinal long, id string, name string, private boolean")
        schema = "ordinal long, key string, etag string"
        objects = listed(a.objects, schema) or spark.createDataFrame([], schema)
        polls, clears = (listed(x, "ordinal long, status string") for x in (a.polls, a.clears))
        events, outputs = listed(a.events, "ordinal long, status string, reason string"), listed(a.outputs, "ordinal long, output_key string, output_value string")
        decision = U.decide(files.load_config(), zones, a.subdomain, a.pick)
        state = U.State(a.exists, a.update_error, polls, events, outputs, clears)
        stack, steps, cleared = U.publication(spark, decision, state, a.build_dir, objects, a.deadline)
        if decision.changed:
            files.save_config({"subdomain": decision.subdomain, "hosted_zone_id": decision.zone_id, "domain_name": decision.domain})
        print(json.dumps({"stack": decision.stack, "url": decision.url, **stack, "invalidation": cleared}))
        for r in steps.orderBy("action", "key").toLocalIterator() if steps is not None else ():
            print(json.dumps(r.asDict()))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
