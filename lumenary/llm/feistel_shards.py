"""Operator 4: sharding by a Feistel permutation of global row numbers. Law: rows.

Rows are numbered by (doc_id, hash of the text); a balanced Feistel network over the smallest even
number of bits that holds all row numbers, with cycle walking back into the range, permutes them. Place p
of the permutation is shard p mod shards, slot p div shards: shards differ by one row at most, slots have
no gaps, and `place_of` / `row_of` compute either way without a table.

Nulls: a null text has size 1 and CRC 0; a null doc_id is numbered as the smallest id. Empty table: empty
result. Repeated rows (equal id and text) get numbers next to each other, and are interchangeable. Extra
columns are ignored.

Scale: row numbers come from counts of ranges, not from one sorted partition. There are RANGES, or one for every RANGE_ROWS rows, up to
10,000. Range bounds are quantiles of doc_id; an id so frequent that it fills a range is split further by text hash. Only the bounds and the
ranges' counts (a few thousand numbers, whatever the input) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

SHARDS, SEED, ROUNDS, RANGES = 16, "shards", 6, 256
#: Rows of a range, from which on there are more ranges.
RANGE_ROWS = 500_000


class Feistel:
    """A permutation of 0 .. n-1, for n up to 2**58."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.frombuffer(hashlib.sha256(f"{seed}|{k}".encode()).digest()[:8], "<u8")[0] for k in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        if back:
            for key in reversed(self.keys):
                left, right = right ^ self._mix(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._mix(right, key)
        return (left << h) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._pass(np.asarray(x, np.uint64), back)
            while (out := x >= np.uint64(self.n)).any():  # the domain is under 4 n, so few steps on average
                x[out] = self._pass(x[out], back)
        return x.astype(np.int64)

    def place_of(self, row) -> np.ndarray:
        return self._walk(row, False)

    def row_of(self, place) -> np.ndarray:
        return self._walk(place, True)


def number_rows(rows: DataFrame, ranges: int | None = None) -> tuple[DataFrame, int]:
    """Rows with doc_id and a text hash `key` get `row`, their place in (doc_id, key) order; and their number."""
    ranges = ranges or min(10_000, max(RANGES, rows.count() // RANGE_ROWS))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    found = rows.agg(F.percentile_approx("_id", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000))).first()[0] or []
    often = F.lit([a for a, b in zip(found, found[1:]) if a == b]).cast("array<long>")
    cuts = np.array(found, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy()).astype(np.int32))

    rows = rows.withColumn("_range", range_of("_id"))
    rows = rows.withColumn("_part", F.when(F.array_contains(often, F.col("_id")), F.substring("key", 1, 2)).otherwise(""))
    counts = sorted((r["_range"], r["_part"], r["count"]) for r in rows.groupBy("_range", "_part").count().collect())
    starts, total = {}, 0
    for a, b, count in counts:
        starts[a, b] = total
        total += count
    if not total:
        return rows.withColumn("row", F.lit(0).cast("long")).drop("_id", "_range", "_part"), 0
    known = rows.sparkSession.createDataFrame([(a, b, v) for (a, b), v in starts.items()], "_range int, _part string, _start long")
    rows = rows.join(F.broadcast(known), ["_range", "_part"])  # a row for each range, or 256 of a frequent id's
    order = W.partitionBy("_range", "_part").orderBy("_id", "key")
    return rows.withColumn("row", F.col("_start") + F.row_number().over(order) - 1).drop("_id", "_range", "_part", "_start"), total


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row (the global number), shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))
    numbered, n = number_rows(materialize(slim, "shard-keys"))

    @F.pandas_udf("long")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Feistel(n, seed)
        for r in rows:
            yield pd.Series(net.place_of(r.to_numpy()))

    placed = numbered.withColumn("place", place("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def op4_feistel_shards(spark, sf_dir: str) -> DataFrame:
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
