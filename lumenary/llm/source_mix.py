"""Operator 8: mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Sizes are word counts. Sources (by code point, null last) take the weights in turn; a target is its
weight's share of all words, held at max_epochs times the source's size with the excess reshared.
Blocks have equally many words: at most 1 / BLOCKS of all, and so few that the smallest target takes FINEST (one
word at least). They go to the sources by highest quotient target / (2 k + 1). Seats in quotient order are dealt to
the shards in equal runs; as the first m seats are the apportionment of m, a shard's quotas are the differences of
apportionments at its ends. Each of these needs only the seats near its last one (about five for each source), so the
number of blocks does not matter.

Each source's documents stand in a seeded order, end to end, and are cut into blocks. A quota is whole passes over
these, and seeded blocks beyond: the stream is parted into up to RUNS equal segments (one for every RUN_DOCS documents), and each
gives its share of the blocks as one run from a seeded place. A shard has the blocks of a source from its first seat to its last, in this order. So
at most two documents a run are cut by its edges.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is kept. Empty table:
empty result. A document without words takes 0. Repeated rows are rows of their own, and equal ones are
interchangeable. Extra columns are ignored unless named in `carry`.

Scale: texts are read once (once more if columns are carried); sizes and keys are written and used from there. The prefix sums have two
levels, (source, 3 hex digits of the row's key) and within it, so that a source with a third of all rows spreads over 4096 groups.
What is gathered in one task is a row for each source (for targets), about five for each source (for a shard's end),
or each of a source's 4096 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, word_count

BLOCKS, SHARDS, SEED, EPOCHS, WEIGHTS = 8192, 16, "mix", 3, (1, 2, 3)
#: Blocks of the smallest target, runs of a source at most, and documents of a source for each run at least.
FINEST, RUNS, RUN_DOCS = 16, 64, 64
#: The step of seeded places from run to run.
STEP = 40_503


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _keyed(docs: DataFrame, seed: str, carry: tuple[str, ...]) -> DataFrame:
    text, source = F.col("text"), F.col("source")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return docs.select(
        F.col("doc_id"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("sk"),
        word_count(text).alias("size"),
        key.alias("key"),
        F.substring(key, 1, 3).alias("part"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(sk, source_size) -> also weight, total, sources, target. Level filling in closed form: in the order of
    cap / weight, the level is the largest of (total - caps before) / (weights from here on)."""
    order, all_ = W.orderBy("sk"), W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "sk")
    pattern = F.array(*[_long(w) for w in weights])
    rows = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", F.element_at(pattern, (F.col("nth") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * epochs).withColumn("total", F.sum("source_size").over(all_)).withColumn("sources", F.count("*").over(all_))
    before, behind = F.sum("cap").over(by_ratio) - F.col("cap"), F.sum("weight").over(all_) - F.sum("weight").over(by_ratio) + F.col("weight")
    rows = rows.withColumn("level_here", (F.col("total") - before).cast("double") / behind.cast("double")).withColumn("level", F.max("level_here").over(all_))
    share = F.col("weight").cast("double") * F.col("level")
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), share)).drop("nth", "cap", "level_here", "level")


def block_words(targets: DataFrame, blocks: int = BLOCKS, finest: int = FINEST) -> DataFrame:
    """Adds block (its words) and blocks (the number to be dealt)."""
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy())
    block = F.greatest(_long(1), F.least(F.floor(F.col("total") / blocks), F.floor(least / finest)))
    return targets.withColumn("block", F.coalesce(block, _long(1))).withColumn("blocks", F.expr("total div block"))


def shard_quotas(targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, sk, upto, quota): the blocks of a source up to a shard's end, and in it; from rows with sk, target, total,
    sources and blocks. The sums over shards differ by one block at most."""
    ends = targets.filter("target > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("end", F.expr(f"(shard + 1) * blocks div {shards}"))
    at = lambda seats: F.floor(F.col("target") * seats / F.col("total")).cast("long")
    # with `end` seats in all, a source has as many as its share of end - sources / 2 to end + sources / 2, rounded
    ends = ends.withColumn("sure", F.greatest(_long(0), at(F.col("end") - F.col("sources")) - 1)).withColumn("open", F.col("end") - F.sum("sure").over(W.partitionBy("shard")))
    tries = ends.withColumn("k", F.explode(F.sequence("sure", F.greatest(F.col("sure"), at(F.col("end") + F.col("sources")) + 1))))
    ranked = tries.withColumn("seat", F.row_number().over(W.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "sk", "k")))
    upto = ranked.groupBy("shard", "sk").agg((F.max("sure") + F.sum(F.when(F.col("seat") <= F.col("open"), 1).otherwise(0))).alias("upto"))
    return upto.withColumn("quota", F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("sk").orderBy("shard")), _long(0)))


def _plan(targets: DataFrame, epochs: int, shards: int, seed: str) -> DataFrame:
    """A row for each source: its passes, and where its runs lie (stream: its blocks; more: the blocks beyond whole passes)."""
    ends = shard_quotas(targets, shards).groupBy("sk").agg(F.max("upto").alias("seats"), F.sort_array(F.collect_list("upto")).alias("ends"))
    plan = targets.join(ends, "sk", "left").withColumn("stream", F.expr("(source_size + block - 1) div block"))
    plan = plan.withColumn("seats", F.least(F.coalesce("seats", _long(0)), F.col("stream") * epochs))
    plan = plan.withColumn("passes", F.expr("if(stream = 0, 0L, seats div stream)")).withColumn("more", F.col("seats") - F.col("passes") * F.col("stream"))
    plan = plan.withColumn("runs", F.least(_long(RUNS), F.greatest(_long(1), F.expr(f"docs div {RUN_DOCS}")), "more", F.col("stream") - F.col("more")))
    return plan.withColumn("seeded", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("sk"))), 1, 7), 16, 10).cast("long"))


def _taken_before(rows: DataFrame, place: str, name: str) -> DataFrame:
    """Adds the words of the seeded runs before a place of a source's stream. Segment j has the blocks from j * stream div runs on; its run
    is (j + 1) * more div runs - j * more div runs blocks long."""
    rows = rows.withColumn("_j", F.expr(f"least(runs - 1, if(runs > 0, ((({place} div block) + 1) * runs - 1) div stream, 0L))"))
    rows = rows.withColumn("_first", F.expr("if(runs > 0, _j * stream div runs, 0L)")).withColumn("_done", F.expr("if(runs > 0, _j * more div runs, 0L)"))
    rows = rows.withColumn("_own", F.expr("if(runs > 0, (_j + 1) * more div runs, 0L) - _done")).withColumn("_spare", F.expr("if(runs > 0, (_j + 1) * stream div runs, 0L) - _first - _own"))
    rows = rows.withColumn("_run", F.expr(f"_first + (seeded + _j * {STEP}L) % (_spare + 1)"))
    return rows.withColumn(name, F.expr(f"if(runs > 0, _done * block + greatest(0L, least({place} - _run * block, _own * block)), 0L)"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, blocks: int = BLOCKS, shards: int = SHARDS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, extra (words of the runs beyond whole passes), shard (that of the first block
    with a word of it; null if none is taken), and the carried columns as struct _row."""
    slim = materialize(_keyed(docs, seed, ()), "mix-sizes")
    keyed = _keyed(docs, seed, carry) if carry else slim
    parts = slim.groupBy("sk", "part").agg(F.sum("size").alias("part_size"), F.count("*").alias("docs"))
    parts = parts.withColumn("part_start", F.sum("part_size").over(W.partitionBy("sk").orderBy("part")) - F.col("part_size"))
    sources = parts.groupBy("sk").agg(F.sum("part_size").alias("source_size"), F.sum("docs").alias("docs"))
    targets = block_words(source_targets(sources, weights, epochs), blocks)
    places = parts.drop("part_size", "docs").join(_plan(targets, epochs, shards, seed), "sk").drop("docs", "weight", "total", "sources", "blocks")
    placed = keyed.join(places, ["sk", "part"])
    upto = F.col("part_start") + F.sum("size").over(W.partitionBy("sk", "part").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = placed.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("size"))
    placed = _taken_before(_taken_before(placed, "start", "before"), "upto", "after").withColumn("extra", F.col("after") - F.col("before"))
    taken = F.col("passes") * F.col("size") + F.col("extra")
    seat = F.expr("if(passes > 0, start, before) div block")
    shard = F.when(taken > 0, F.size(F.filter("ends", lambda e: e <= seat)))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "extra", shard.alias("shard"), *(["_row"] if carry else []))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, whole: a row for each pass, and one more where the runs take half of the document or more."""
    mixed = mix_sources(docs, carry=tuple(docs.columns), **settings)
    copies = F.col("passes") + F.when((F.col("extra") * 2 >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return mixed.filter(copies > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("_row.*")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def oracle(blocks: int = BLOCKS, shards: int = SHARDS, epochs: int = EPOCHS, seed: str = SEED) -> str:
    """The same by other means: all seats are ranked, all blocks of the runs are listed, and each document's overlaps with them are summed."""
    return f"""
WITH keyed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')) AS key
  FROM documents),
sized AS (SELECT sk, sum(size)::BIGINT AS source_size, count(*) AS docs FROM keyed GROUP BY sk),
weighed AS (SELECT sk, source_size, docs, source_size * {epochs} AS cap, ((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::BIGINT AS weight,
  (sum(source_size) OVER ())::BIGINT AS total FROM sized),
levels AS (SELECT *, (total - ((sum(cap) OVER r)::BIGINT - cap))::DOUBLE / ((sum(weight) OVER ())::BIGINT - (sum(weight) OVER r)::BIGINT + weight)::DOUBLE AS level_here
  FROM weighed WINDOW r AS (ORDER BY cap / weight, sk)),
targets AS (SELECT *, least(cap::DOUBLE, weight::DOUBLE * max(level_here) OVER ()) AS target FROM levels),
cut AS (SELECT *, coalesce(greatest(1, least(total // {blocks}, floor(min(target) FILTER (target > 0) OVER () / {float(FINEST)}::DOUBLE)::BIGINT)), 1)::BIGINT AS block FROM targets),
seats AS (SELECT sk, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sk, k) - 1 AS seat
  FROM (SELECT sk, target, unnest(range(0, (target / block * 1.1::DOUBLE)::BIGINT + 40)) AS k FROM cut WHERE target > 0)),
won AS (SELECT sk, seat, row_number() OVER (PARTITION BY sk ORDER BY seat) - 1 AS nth FROM seats WHERE seat < (SELECT max(total // block) FROM cut)),
dealt AS (SELECT sk, nth, (SELECT count(*) FROM range({shards}) s(j) WHERE (s.j + 1) * (SELECT max(total // block) FROM cut) // {shards} <= seat) AS shard FROM won),
plan AS (SELECT c.*, (source_size + block - 1) // block AS stream, least(coalesce(w.seats, 0), (source_size + block - 1) // block * {epochs})::BIGINT AS seats,
  ('0x' || substr(md5('{seed}|' || c.sk), 1, 7))::BIGINT AS seeded FROM cut c LEFT JOIN (SELECT sk, count(*) AS seats FROM won GROUP BY sk) w USING (sk)),
passed AS (SELECT *, CASE WHEN stream = 0 THEN 0 ELSE seats // stream END AS passes, CASE WHEN stream = 0 THEN 0 ELSE seats % stream END AS more FROM plan),
parted AS (SELECT *, least({RUNS}, greatest(1, docs // {RUN_DOCS}), more, stream - more) AS runs FROM passed),
segments AS (SELECT *, j * stream // runs AS first, (j + 1) * stream // runs - j * stream // runs AS room, (j + 1) * more // runs - j * more // runs AS own
  FROM (SELECT *, unnest(range(0, runs)) AS j FROM parted WHERE runs > 0)),
picked AS (SELECT sk, block, source_size, first + (seeded + j * {STEP}) % (room - own + 1) + o AS b FROM (SELECT *, unnest(range(0, own)) AS o FROM segments)),
chosen AS (SELECT sk, b * block AS lo, least((b + 1) * block, source_size) AS hi, row_number() OVER (PARTITION BY sk ORDER BY b) - 1 AS nth FROM picked),
placed AS (SELECT *, row_number() OVER () AS n, (sum(size) OVER (PARTITION BY sk ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM keyed JOIN parted USING (sk)),
met AS (SELECT p.n, sum(least(upto, hi) - greatest(upto - size, lo))::BIGINT AS extra, min(nth) AS nth
  FROM placed p JOIN chosen c ON p.sk = c.sk AND c.lo < p.upto AND c.hi > p.upto - p.size GROUP BY p.n),
found AS (SELECT p.*, coalesce(extra, 0) AS extra, CASE WHEN passes > 0 THEN (upto - size) // block ELSE nth END AS first FROM placed p LEFT JOIN met USING (n))
SELECT doc_id, size, source_size, target, (passes * size + extra)::BIGINT AS taken, passes::BIGINT AS passes, extra::BIGINT AS extra,
  CASE WHEN passes * size + extra > 0 THEN d.shard::INTEGER END AS shard
FROM found f LEFT JOIN dealt d ON f.sk = d.sk AND f.first = d.nth
"""
