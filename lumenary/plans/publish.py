"""Publishing as a plan: what a deployment would do, as rows. Nothing is created, uploaded or invalidated.

The state of the cloud comes in as manifests (zones, objects, polls, events, outputs); the plan says which zone and name
are taken, whether the stack is created or updated and how its wait ends, what is uploaded, and whether caches are invalidated, all within
one deadline.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, fixed
from ..operators import relational as R
from ..sources import files
from ..sources.stores import exists, whole_path

TOOL = "lumenary"


def generate_id() -> str:
    return "".join(fixed.ID_LETTERS[b % len(fixed.ID_LETTERS)] for b in secrets.token_bytes(8))


@dataclass(frozen=True)
class Decision:
    subdomain: str
    zone_id: str
    domain: str
    changed: bool
    stack: str
    url: str


def decide(config: dict[str, str], zones: DataFrame | None, subdomain: str = "", pick: int | None = None) -> Decision:
    """Zone (configured, else the only or the picked one) and subdomain (flag, else configured, else made up)."""
    if config.get("hosted_zone_id") and config.get("domain_name"):
        zone, domain = config["hosted_zone_id"], config["domain_name"]
    else:
        rows = R.select_zone(R.public_zones(zones), pick=pick).collect() if zones is not None else []
        if not rows or rows[0]["zone_id"] is None:
            raise ValueError(rows[0]["error"] if rows else "no hosted zones")
        zone, domain = rows[0]["zone_id"], rows[0]["zone_name"]
    name = subdomain or config.get("subdomain") or generate_id()
    changed = (config.get("subdomain", ""), config.get("hosted_zone_id", ""), config.get("domain_name", "")) != (name, zone, domain)
    return Decision(name, zone, domain, changed, f"{TOOL}-{name}", f"https://{name}.{domain}")


def publish_plan(spark: SparkSession, build_dir: str, objects: DataFrame, distribution: str | None = None) -> DataFrame:
    """A row for each step: uploads and skips of files, then the invalidation (of a distribution, if it is known) if anything is uploaded."""
    if not exists(spark, whole_path(build_dir)):
        raise FileNotFoundError(f"build directory not found: {build_dir}")
    steps = R.sync_plan(files.directory(spark, build_dir), R.remote_index(objects)).select("action", "key", "content_type", "md5", F.lit(None).cast("string").alias("distribution_id"))
    clear = R.invalidation_plan(R.sync_counts(steps), F.lit(distribution).cast("string")).select(F.lit("invalidate").alias("action"), F.col("path").alias("key"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("md5"), F.col("distribution_id"))
    return steps.unionByName(clear)


#: Seconds of a whole publication, and between two polls of a stack and of an invalidation.
DEADLINE, STACK_EVERY, CLEAR_EVERY = 30 * 60, 15, 5


@dataclass(frozen=True)
class State:
    """What is known of the cloud, as manifests; what is None is not known yet. polls: ordinal (from 1), status of the stack; events: ordinal,
    status, reason; outputs: ordinal, output_key, output_value; clears: ordinal, status of the invalidation."""

    exists: bool = False
    update_error: str | None = None
    polls: DataFrame | None = None
    events: DataFrame | None = None
    outputs: DataFrame | None = None
    clears: DataFrame | None = None


def follow(spark: SparkSession, decision: Decision, state: State, deadline: int = DEADLINE) -> tuple[dict, int]:
    """The stack's step: (action, needs_wait, result and the outputs, if it has come to an end; seconds left). Without polls the wait is 'planned'. A stack that failed or took
    too long raises ValueError with the first reason that its events give."""
    row = stack_plan(decision, state.exists, state.update_error, spark).first().asDict()
    if row["error"]:
        raise ValueError(row["error"])
    out, left = {"action": row["action"], "needs_wait": row["needs_wait"], "result": "done"}, deadline
    if row["needs_wait"]:
        found = R.wait_result(state.polls, [], left // STACK_EVERY).first() if state.polls is not None else None
        out["result"] = found["result"] if found else "planned" if state.polls is None else "waiting"
        if out["result"] == "failed":
            why = R.failure_reason(state.events).first()["reason"] if state.events is not None else "unknown reason"
            raise ValueError(f"stack {decision.stack} ended as {found['status']}: {why}")
        if out["result"] == "timeout":
            raise ValueError(f"stack {decision.stack} took more than {deadline} seconds")
        left -= (found["polls"] or 0) * STACK_EVERY if found else 0
    if out["result"] == "done" and state.outputs is not None:
        out |= R.stack_outputs(state.outputs).first().asDict()
    return out, left


def publication(spark: SparkSession, decision: Decision, state: State, build_dir: str, objects: DataFrame, deadline: int = DEADLINE) -> tuple[dict, DataFrame | None, str]:
    """(the stack's step, the steps of files and caches, what became of the invalidation). While the stack is waited for there are no further
    steps; the invalidation is 'none' without uploads, else 'waiting' or 'done'; past the deadline it raises ValueError."""
    stack, left = follow(spark, decision, state, deadline)
    if stack["result"] == "waiting":
        return stack, None, "none"
    steps = publish_plan(spark, build_dir, objects, stack.get("DistributionId"))
    if steps.filter("action = 'invalidate'").isEmpty():
        return stack, steps, "none"
    if state.clears is None:
        return stack, steps, "waiting"
    ends = state.clears.agg(F.min(F.when(R.invalidation_kind(F.col("status")) == "done", F.col("ordinal"))).alias("at"), F.max("ordinal").alias("polls")).first()
    if ends["at"] is not None and ends["at"] * CLEAR_EVERY <= left:
        return stack, steps, "done"
    if max(ends["at"] or 0, ends["polls"] or 0) * CLEAR_EVERY >= left:
        raise ValueError(f"the invalidation took more than the {left} seconds left")
    return stack, steps, "waiting"


def stack_plan(decision: Decision, exists: bool, update_error: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or SparkSession.getActiveSession()
    row = spark.createDataFrame([(decision.stack, exists, update_error)], "stack string, there boolean, err string")
    return row.select("stack", R.upsert_action(F.col("there"), F.col("err")).alias("u")).select("stack", "u.*", C.is_missing_stack(F.lit(update_error)).alias("missing"))
