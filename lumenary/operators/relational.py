"""Deployment state as relations: diffs, pivots, first matching rows, waits. DataFrame in, DataFrame out.

Listed order matters for several of these, so rows carry an explicit `ordinal`; ties on it are broken by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as C, fixed

#: A dimension under this many rows may be broadcast.
SMALL = 10_000


def join_dimension(rows: DataFrame, dimension: DataFrame, on: str | list[str]) -> DataFrame:
    """Left lookup join. The dimension is broadcast if a count shows that it is small; else the planner chooses."""
    small = dimension.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(dimension) if small else dimension, on, "left")


def public_zones(zones: DataFrame) -> DataFrame:
    """Zones (id, name, private) that aren't private (null counts as public), normalised."""
    return zones.filter(F.coalesce(~F.col("private"), F.lit(True))).withColumn("id", C.zone_id(F.col("id"))).withColumn("name", C.zone_name(F.col("name")))


def select_zone(zones: DataFrame, by: Sequence[str] = (), pick: int | None = None) -> DataFrame:
    """One row for each group: its zone if there is one, or the pick (from 1, in listed order); else an error."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "id", "name")))
    found = zones.groupBy(*by).agg(F.count("*").alias("zones"), F.min_by(F.struct("id", "name"), F.struct("ordinal", "id")).alias("one"), *([listed.alias("listed")] if pick is not None else []))
    if pick is None:
        return found.select(*by, "zones", F.when(F.col("zones") == 1, F.col("one.id")).alias("zone_id"), F.when(F.col("zones") == 1, F.col("one.name")).alias("zone_name"), F.when(F.col("zones") == 0, "no hosted zones").when(F.col("zones") > 1, "several hosted zones").alias("error"))
    nth = F.when(F.col("zones") == 1, 1).otherwise(pick)
    chosen = F.when((nth >= 1) & (nth <= F.col("zones")), F.try_element_at("listed", nth.cast("int")))
    return found.select(*by, "zones", chosen["id"].alias("zone_id"), chosen["name"].alias("zone_name"), F.when(F.col("zones") == 0, "no hosted zones").when(chosen.isNull(), "choice out of range").alias("error"))


def remote_index(objects: DataFrame) -> DataFrame:
    """(key, etag) of a listing (ordinal, key, etag): rows with a null are dropped, the last of a key wins, quotes go."""
    last = objects.dropna(subset=["key", "etag"]).groupBy("key").agg(F.max_by("etag", F.struct("ordinal", "etag")).alias("etag"))
    return last.withColumn("etag", C.bare_etag(F.col("etag")))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files (key, md5) -> key, md5, content_type, action: upload unless the remote object has this MD5."""
    same = remote.select("key", F.col("etag").alias("md5"), F.lit(True).alias("_same"))
    return local.select("key", "md5").join(same, ["key", "md5"], "left").select("key", "md5", C.content_type(F.col("key")).alias("content_type"), F.when(F.col("_same"), "skip").otherwise("upload").alias("action"))


def changed_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local files to upload, as an anti-join."""
    return local.join(remote.select("key", F.col("etag").alias("md5")), ["key", "md5"], "left_anti")


def stale_objects(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote keys without a local file. A report: nothing is deleted."""
    return remote.join(local.select("key"), "key", "left_anti").select("key", "etag")


def sync_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "upload").alias("uploaded"), F.count_if(F.col("action") == "skip").alias("skipped"))


def tag_summary(tags: DataFrame, by: Sequence[str], name: str = "Headline") -> DataFrame:
    """Tags (ordinal, tag, value) -> their number, and the last value of the named tag ('' if none)."""
    last = F.max_by(F.when(F.col("tag") == name, F.col("value")), F.when((F.col("tag") == name) & F.col("value").isNotNull(), F.col("ordinal")))
    return tags.groupBy(*by).agg(F.count("*").alias("tags"), F.coalesce(last, F.lit("")).alias("value"))


def failure_reason(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The reason of the first failed event (ordinal, status, reason) that has one."""
    hit = F.col("status").isin(*fixed.FAILED_EVENTS) & F.col("reason").isNotNull()
    first = F.min_by(F.when(hit, F.col("reason")), F.when(hit, F.struct("ordinal", "reason")))
    return events.groupBy(*by).agg(F.coalesce(first, F.lit("unknown reason")).alias("reason"))


def stack_outputs(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(ordinal, output_key, output_value) -> a column for each known output; the last wins, '' if it is missing."""
    known = rows.filter(F.col("output_key").isNotNull() & F.col("output_value").isNotNull())
    value = lambda key: F.coalesce(F.max_by("output_value", F.when(F.col("output_key") == key, F.struct("ordinal", "output_value"))), F.lit(""))
    if not by:
        return known.agg(*[value(k).alias(k) for k in fixed.OUTPUTS])
    all_ = rows.groupBy(*by).agg(*[F.coalesce(F.max_by(F.when(F.col("output_value").isNotNull(), F.col("output_value")), F.when((F.col("output_key") == k) & F.col("output_value").isNotNull(), F.struct("ordinal", "output_value"))), F.lit("")).alias(k) for k in fixed.OUTPUTS])
    return all_


def first_of(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def saved_zone(zone: Column, domain: Column) -> Column:
    """The configured zone id, which counts only if its name is there too."""
    return F.when((F.coalesce(zone, F.lit("")) != "") & (F.coalesce(domain, F.lit("")) != ""), zone)


def config_changed(was: Sequence[Column], now: Sequence[Column]) -> Column:
    """Whether any value differs from the configuration as it was loaded (null and '' are the same)."""
    out = F.lit(False)
    for a, b in zip(was, now):
        out = out | (F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
    return out


def last_writer(rows: DataFrame, target: str = "output", ordinal: str = "ordinal") -> DataFrame:
    """Of rows with one target, the last in input order."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(target).orderBy(F.desc(ordinal)))).filter("_nth = 1").drop("_nth")


def existing(rows: DataFrame, others: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(others, on, "left_semi")


def upsert_action(exists: Column, update_error: Column) -> Column:
    """struct(action, needs_wait, error): create what is missing, update the rest; no change needs no wait."""
    idle = exists & C.is_no_update(update_error)
    failed = exists & update_error.isNotNull() & ~C.is_no_update(update_error)
    return F.struct(F.when(exists, "update").otherwise("create").alias("action"), (~idle & ~failed).alias("needs_wait"), F.when(failed, F.concat(F.lit("failed to update stack: "), update_error)).alias("error"))


def status_kind(status: Column) -> Column:
    return F.when(status.isin(*fixed.DONE), "done").when(status.isin(*fixed.FAILED), "failed").otherwise("waiting")


def wait_result(polls: DataFrame, by: Sequence[str], most: int | None = None) -> DataFrame:
    """Polls (ordinal, status) -> the first state that ends the wait, and what it means (`waiting` if none does; `timeout` if none of the first
    `most` polls does and there were so many)."""
    within = F.lit(True) if most is None else F.col("ordinal") <= most
    ends = within & (status_kind(F.col("status")) != "waiting")
    first = F.min_by(F.when(ends, F.col("status")), F.when(ends, F.struct("ordinal", "status")))
    found = polls.groupBy(*by).agg(first.alias("status"), F.max("ordinal").alias("_polls"), F.min(F.when(ends, F.col("ordinal"))).alias("polls"))
    late = F.lit(False) if most is None else F.col("_polls") >= most
    return found.withColumn("result", F.when(F.col("status").isNotNull(), status_kind(F.col("status"))).when(late, "timeout").otherwise("waiting")).drop("_polls")


def invalidation_plan(counts: DataFrame, distribution: Column) -> DataFrame:
    """A row that says to invalidate all paths, if anything was uploaded."""
    return counts.filter("uploaded > 0").select(distribution.alias("distribution_id"), F.lit("/*").alias("path"))


def invalidation_kind(status: Column) -> Column:
    return F.when(status == "Completed", "done").otherwise("waiting")
