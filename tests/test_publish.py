"""Deployment relations, small cases; the registry's queries against their SQL; streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenary.functions import fixed
from lumenary.operators import relational as R
from lumenary.plans import publish as U, registry
from lumenary.sources import deployment, files
from lumenary.streaming import ingest


def test_sync(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("index.html", "a"), ("sub/x.CSS", "b"), ("new", "c")):
        (tmp_path / name).write_text(text)
    local = files.directory(spark, str(tmp_path))
    md5 = {r["key"]: r["md5"] for r in local.collect()}
    assert list(md5) == ["index.html", "new", "sub/x.CSS"]
    listed = [(1, "index.html", '"old"'), (2, "index.html", f'"{md5["index.html"]}"'), (3, "sub/x.CSS", f'"{md5["sub/x.CSS"]}-2"'), (4, None, "x"), (5, "gone", None), (6, "stale", "z")]
    objects = spark.createDataFrame(listed, "ordinal long, key string, etag string")
    remote = R.remote_index(objects)
    plan = {r["key"]: (r["action"], r["content_type"]) for r in R.sync_plan(local, remote).collect()}
    assert plan == {"index.html": ("skip", "text/html; charset=utf-8"), "sub/x.CSS": ("upload", "text/css; charset=utf-8"), "new": ("upload", "application/octet-stream")}
    assert {r["key"] for r in R.changed_files(local, remote).collect()} == {"sub/x.CSS", "new"}
    assert {r["key"] for r in R.stale_objects(local, remote).collect()} == {"stale"}
    assert tuple(R.sync_counts(R.sync_plan(local, remote)).first()) == (2, 1)
    steps = U.publish_plan(spark, str(tmp_path), objects).collect()
    assert [r["key"] for r in steps if r["action"] == "invalidate"] == ["/*"]
    with pytest.raises(FileNotFoundError):
        U.publish_plan(spark, str(tmp_path / "no"), objects)


def test_empty_manifests(spark):
    objects = spark.createDataFrame([], "ordinal long, key string, etag string")
    assert R.remote_index(objects).count() == 0
    assert tuple(R.sync_counts(R.sync_plan(spark.createDataFrame([], "key string, md5 string"), R.remote_index(objects))).first()) == (0, 0)
    assert R.failure_reason(spark.createDataFrame([], "ordinal long, status string, reason string")).first()["reason"] == "unknown reason"
    assert R.select_zone(spark.createDataFrame([], "ordinal long, id string, name string, private boolean")).first()["error"] == "no hosted zones"
    assert set(R.stack_outputs(spark.createDataFrame([], "ordinal long, output_key string, output_value string")).first()) == {""}


def test_zones_and_decisions(spark):
    zones = spark.createDataFrame([(1, "/hostedzone/A", "a.org.", None), (2, "B", "b.org", False), (3, "C", "c.org", True)], "ordinal long, id string, name string, private boolean")
    assert [(r["id"], r["name"]) for r in R.public_zones(zones).orderBy("ordinal").collect()] == [("A", "a.org"), ("B", "b.org")]
    with pytest.raises(ValueError, match="several"):
        U.decide({}, zones)
    assert U.decide({}, zones, "s", pick=2).zone_id == "B"
    with pytest.raises(ValueError, match="range"):
        U.decide({}, zones, "s", pick=3)
    saved = U.decide({"subdomain": "x", "hosted_zone_id": "Z", "domain_name": "d.org"}, None)
    assert (saved.subdomain, saved.url, saved.changed) == ("x", "https://x.d.org", False)
    made = U.decide({"hosted_zone_id": "Z", "domain_name": "d.org"}, None)
    assert len(made.subdomain) == 8 and made.changed
    row = U.stack_plan(saved, True, "No updates are to be performed.", spark).first()
    assert (row["action"], row["needs_wait"]) == ("update", False)
    assert U.stack_plan(saved, False, None, spark).first()["needs_wait"]


def test_first_reason_and_outputs(spark):
    events = spark.createDataFrame([(3, "CREATE_FAILED", "late"), (1, "CREATE_FAILED", None), (2, "UPDATE_FAILED", "early"), (0, "DELETE_FAILED", "no")], "ordinal long, status string, reason string")
    assert R.failure_reason(events).first()["reason"] == "early"
    outs = spark.createDataFrame([(1, "SiteURL", "a"), (2, "SiteURL", "b"), (3, "X", "c"), (4, None, "d"), (5, "BucketName", None)], "ordinal long, output_key string, output_value string")
    assert R.stack_outputs(outs).first().asDict() == {"BucketName": "", "DistributionId": "", "DistributionDomain": "", "SiteURL": "b"}


def test_config_and_template(tmp_path):
    assert files.load_config(str(tmp_path)) == dict.fromkeys(("subdomain", "hosted_zone_id", "domain_name"), "")
    files.save_config({"subdomain": 'a"b', "hosted_zone_id": "Z", "domain_name": "é.org"}, str(tmp_path))
    assert files.load_config(str(tmp_path)) == {"subdomain": 'a"b', "hosted_zone_id": "Z", "domain_name": "é.org"}
    (tmp_path / files.CONFIG).write_text("[publish")
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path))
    made = deployment.template("t")
    assert set(made["Outputs"]) == set(fixed.OUTPUTS) and json.loads(json.dumps(made)) == made

    def named(x):
        if isinstance(x, dict):
            yield from [x["Ref"]] if "Ref" in x else [x["Fn::GetAtt"][0]] if "Fn::GetAtt" in x else (y for v in x.values() for y in named(v))
        elif isinstance(x, list):
            yield from (y for v in x for y in named(v))

    used = {n for n in named(made) if not n.startswith("AWS::")}
    assert used <= set(made["Parameters"]) | set(made["Resources"]) and set(made["Parameters"]) <= used


def test_publication_follows_the_stack(spark, tmp_path):
    (tmp_path / "index.html").write_text("a")
    objects = spark.createDataFrame([], "ordinal long, key string, etag string")
    decision = U.decide({"subdomain": "x", "hosted_zone_id": "Z", "domain_name": "d.org"}, None)
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    polls = lambda *s: rows("ordinal long, status string", *enumerate(s, 1))
    outputs = rows("ordinal long, output_key string, output_value string", (1, "DistributionId", "E1"), (2, "SiteURL", "u"))
    run = lambda deadline=1800, **state: U.publication(spark, decision, U.State(**state), str(tmp_path), objects, deadline)
    stack, steps, cleared = run(polls=polls("CREATE_IN_PROGRESS", "CREATE_COMPLETE"), outputs=outputs)
    assert (stack["action"], stack["result"], stack["DistributionId"], cleared) == ("create", "done", "E1", "waiting")
    assert {(r["action"], r["key"], r["distribution_id"]) for r in steps.collect()} == {("upload", "index.html", None), ("invalidate", "/*", "E1")}
    assert (run()[0]["result"], run()[2]) == ("planned", "waiting") and run(polls=polls("CREATE_IN_PROGRESS"))[1:] == (None, "none")
    assert run(exists=True, update_error="No updates are to be performed.")[0]["result"] == "done"
    assert run(exists=True, update_error="No updates are to be performed.", clears=polls("InProgress", "Completed"))[2] == "done"
    for message, state in (
        ("first", {"polls": polls("ROLLBACK_COMPLETE"), "events": rows("ordinal long, status string, reason string", (1, "CREATE_FAILED", "first"), (2, "CREATE_FAILED", "second"))}),
        ("unknown reason", {"polls": polls("CREATE_FAILED")}), ("denied", {"exists": True, "update_error": "denied"}),
        ("took more", {"polls": polls(*["CREATE_IN_PROGRESS"] * 3, "CREATE_COMPLETE"), "deadline": 45}),
        ("invalidation took more", {"polls": polls("CREATE_COMPLETE"), "clears": polls(*["InProgress"] * 7), "deadline": 45}),
    ):
        with pytest.raises(ValueError, match=message):
            run(**state)


def test_broadcast_only_if_small(spark):
    assert "BroadcastHashJoin" in R.join_dimension(spark.range(10), spark.range(5), "id")._jdf.queryExecution().toString()


def canonical(rows, columns):
    say = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == math.floor(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(say(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got or name == "stale_objects"
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for table in "nation customer supplier part orders lineitem events documents embeddings pages labels".split():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        found = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(got, df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    from lumenary.operators import codecs
    from lumenary.plans.process import Settings
    import numpy as np

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(codecs.png(np.full((4, 6, 3), 9, np.uint8)))
    seen = []
    query = ingest.render_arrivals(spark, str(tmp_path / "in"), Settings("20x20", outdir=str(tmp_path / "out")), lambda rows: seen.extend(rows.collect()))
    query.awaitTermination(120)
    assert [r["error"] for r in seen] == [None] and (tmp_path / "out" / "a_v0.jpg").exists()
    polls = [("s", 1, "CREATE_IN_PROGRESS"), ("s", 2, "CREATE_COMPLETE"), ("s", 3, "DELETE_FAILED"), ("t", 1, "ROLLBACK_COMPLETE"), ("u", 1, "CREATE_IN_PROGRESS")]
    spark.createDataFrame(polls, "stack string, ordinal long, status string").write.parquet(str(tmp_path / "polls"))
    stream = spark.readStream.schema("stack string, ordinal long, status string").parquet(str(tmp_path / "polls"))
    query = ingest.waits(stream).writeStream.format("memory").queryName("waits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM waits").collect()} == {("s", "CREATE_COMPLETE", "done"), ("t", "ROLLBACK_COMPLETE", "failed")}
    assert ingest.statuses(spark.createDataFrame(polls, "stack string, ordinal long, status string")).filter("kind = 'waiting'").count() == 2
