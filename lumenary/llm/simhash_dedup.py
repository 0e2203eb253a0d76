"""Operator 10: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. At most `bits` = 4 differing bits touch at most 4 of them, so a link
shares at least 4. Postings of single bytes would be quadratic, so the index is on triples of positions:
a covering design of 20 triples has one inside every set of 4 positions, so every link meets in a posting.
Inside a posting the shared bytes of each pair are tallied, pairs under the guaranteed minimum are
dropped, and the rest verified by their differing bits. Equal fingerprints are one entry. A posting
returns a spanning star for each of its connected parts, never all its pairs: a part is grown from a seed against what is still
unvisited. Postings of over `long` entries are split by every further byte that a link may share, again and again; links that share none
of the bytes left are looked up by their few possible differences. So no search is quadratic in a posting.

`near_unique` keeps one document of each group of similar texts (Jaccard similarity 0.8 of the sets of five-word shingles). At
that similarity 15% of the bits differ, more than shared bytes can be guaranteed for, so it takes 256 bits, and works in three steps.
The byte-position index above, with its tally, joins all whose first 64 bits differ in `bits` = 4 at most: these near copies are one
entry of what follows. For the rest, which no count of shared bytes can promise, entries meet in postings of shingles: sets that
similar share a shingle among the first fifth of each in any one order (prefix filter; hash order, with shingles frequent in a sample
last); an entry is posted once under each of its members' shingles, and there the bits of members are compared with a cut far above
those expected; two entries meet where they begin to share postings, not under each that they share, and the links of a bucket are a forest,
so they are fewer than its entries. Postings move as blocks of numbers, dealt by shingle. The components of both steps' candidates are then split by the
exact similarity of their sets. A component of over BLOCK_SETS sets is cut into blocks, each pair of
blocks is one task's, and what their links join are the parts; so a task holds two blocks at most, and no pair goes uncompared.

Components of the links are found by alternating large-star and small-star steps over distributed edges.

Nulls: a null or wordless text has fingerprint 0, linked like any other; null doc_ids are kept, and the
smallest non-null id names a component. Empty table: empty result. Repeated rows each return a row. Extra
columns are ignored (`near_unique` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import drop_shared, materialize, shared_path, words

SHINGLE, BITS, LONG = 4, 4, 4096
#: For near_unique: words of a shingle, similarity, 64-bit words of a fingerprint.
STAGE_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 4
#: Standard deviations by which the bits of candidates may exceed those expected at the similarity.
CANDIDATE = 4.5
#: Sets of a component that one task holds; larger ones are compared block by block.
BLOCK_SETS = 4096
#: Documents sampled for frequent shingles, the count from which they are, the longest list: they order postings, no result depends on them.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 20, 100_000
#: Texts that are hashed at once; sets and postings in a block of postings; sets of an entry. They bound memory and work, no result depends on them.
TEXTS, BLOCK_ROWS, BLOCK_POSTINGS, ENTRY = 512, 4096, 1 << 19, 8
#: Links that a task joins at once.
LINKS = 1 << 20


def _shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 of each shingle of n lower-case words, repeats included; of the whole sequence if it is shorter."""
    found = words(text, lower=True)
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-n])]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[n - 1 :])), repeat(42)), np.uint64, len(found) - n + 1)


def _majority(hashes: np.ndarray) -> bytes:
    """From rows of hash bytes: the bits set in over half of the rows. Bytes hold sums of up to 255 rows."""
    n = len(hashes)
    sums = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64], axis=1)
        for k in range(0, len(bits), 255):
            sums += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(sums * 2 > n).tobytes()


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    hashes = _shingle_hashes(text, n)
    return int.from_bytes(_majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)), "big") if len(hashes) else 0


def wide_fingerprint(text: bytes | None, n: int) -> bytes:
    """WIDE words of 64 bits, each from its own mix of the hashes of the text's distinct shingles."""
    return _wide_majority(np.unique(_shingle_hashes(text, n)))


def _wide_majority(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(8 * WIDE)
    mixed = np.empty((len(hashes), WIDE), np.uint64)
    for k in range(WIDE):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = x ^ (x >> np.uint64(31))
    return _majority(mixed.view(np.uint8))


def fingerprints(docs: DataFrame, n: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns as struct _row, doc_id, fp (the 64 bits as a long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64))

    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("_text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []))
    return rows.withColumn("fp", fp("_text")).drop("_text")


def covering(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples such that every 4 positions hold one: three groups in a ring, triples within a group, or two of a group and one of the next."""
    groups = [list(range(k, positions, 3)) for k in range(3)]
    return [t for k, g in enumerate(groups) for t in [*combinations(g, 3), *((*two, one) for two in combinations(g, 2) for one in groups[(k + 1) % 3])]]


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    """From the differences of pairs: those that share the guaranteed bytes and differ in few enough bits."""
    tally = np.zeros(x.shape, np.uint8)
    for k in range(8):
        tally += (x >> np.uint64(8 * k)) & np.uint64(255) == 0
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def _masks(free: tuple[int, ...], bits: int) -> list[int]:
    """Differences of up to `bits` bits with one at least in every one of the free bytes."""
    if not free:
        return [0]
    own = [(v.bit_count(), v << 8 * free[0]) for v in range(1, 256)]
    return [v | rest for n, v in own if n <= bits - len(free) + 1 for rest in _masks(free[1:], bits - n)]


def _by_masks(fps: np.ndarray, free: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints that differ in each of the free bytes: the partner of each difference is looked up, so work is in proportion
    to their number. Links within what is joined already are mostly left out."""
    fps, out = np.sort(fps), []
    part, size = np.arange(len(fps)), min(26, (64 * len(fps)).bit_length())
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)
    there = np.zeros(1 << size, bool)  # rules out nearly all differences before the search
    there[slot(fps)] = True
    for mask in _masks(free, bits):
        other = fps ^ np.uint64(mask)
        some = np.flatnonzero(there[slot(other)] & (fps < other))
        at = np.minimum(np.searchsorted(fps, other[some]), len(fps) - 1)
        good = (fps[at] == other[some]) & (part[some] != part[at])
        some, at = some[good], at[good]
        if len(some):
            out.append((fps[at], fps[some]))
            part[at] = part[some] = np.minimum(part[some], part[at])
    return out


def posting_links(fps: np.ndarray, bits: int = BITS, long: int = LONG) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints of one posting, as (member, root) arrays, that join all its links join. Long ones are split by each
    byte in which they differ: a link shares one of these, and is met in that part, or differs in all, and is looked up by its difference."""
    free = tuple(k for k in range(8) if len(fps) and (((fps ^ fps[0]) >> np.uint64(8 * k)) & np.uint64(255)).any())
    if len(fps) > long and free:
        out = []
        for k in free:
            byte = (fps >> np.uint64(8 * k)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(byte[order])) + 1):
                out += posting_links(part, bits, long) if len(part) > 1 else []
        return out + (_by_masks(fps, free, bits) if len(free) <= bits else [])
    if len(fps) <= 512:  # few links are taken as they are
        a, b = np.nonzero(np.triu(_linked(fps[:, None] ^ fps[None, :], bits), 1))
        if len(a) <= 2 * len(fps):
            return [(fps[b], fps[a])] if len(a) else []
    out, rest = [], fps
    while len(rest) > 1:
        seed, rest, front = rest[0], rest[1:], rest[:1]
        joined = []
        while len(front) and len(rest):
            step = max(1, 2_000_000 // len(rest))
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), step):
                left = np.flatnonzero(~near)
                near[left] = _linked(front[at : at + step, None] ^ rest[None, left], bits).any(0)
            front, rest = rest[near], rest[~near]
            joined.append(front)
        if joined and len(all_ := np.concatenate(joined)):
            out.append((all_, np.full(len(all_), seed)))
    return out


def _run_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int, long: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of postings: short runs by their offsets, all at once; others one by one."""
    out, short = [], sizes <= 32
    of = np.repeat(np.where(short, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for d in range(1, int(sizes[short].max(initial=1))):
        at = np.flatnonzero((of[:-d] == of[d:]) & (of[:-d] >= 0))
        at = at[_linked(fps[at] ^ fps[at + d], bits)]
        if len(at):
            out.append((fps[at], fps[at + d]))
    for s, n in zip(starts[~short], sizes[~short]):
        out += posting_links(fps[s : s + n], bits, long)
    return out


def links(distinct: DataFrame, bits: int = BITS, long: int = LONG) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` that connect all links of up to `bits` differing bits."""
    triples = covering()
    byte = lambda k: F.shiftrightunsigned(F.col("fp"), 8 * k).bitwiseAND(F.lit(255).cast("long"))
    keys = [F.lit(n).cast("long") * (1 << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for n, (a, b, c) in enumerate(triples)]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("posting"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_p, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def send(found):
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def work(p, f):
            cuts = np.flatnonzero(np.diff(p)) + 1
            starts = np.concatenate([[0], cuts])
            return _run_links(f, starts, np.diff(np.concatenate([starts, [len(p)]])), bits, long)

        for batch in batches:
            p = np.concatenate([kept_p, batch.column(0).to_numpy()])
            f = np.concatenate([kept_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(p):
                continue
            last = int(np.searchsorted(p, p[-1]))  # the last posting may go on in the next batch
            if last:
                yield from send(work(p[:last], f[:last]))
            kept_p, kept_f = p[last:], f[last:]
        if len(kept_p):
            yield from send(work(kept_p, kept_f))

    many = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return postings.repartition(many, "posting").sortWithinPartitions("posting", "fp").select("posting", "fp").mapInArrow(meet, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root): fewer links than members, which join what the links (a, b) join."""
    nodes, of = np.unique(np.stack([a, b]), return_inverse=True)
    (a, b), root, new = of.reshape(2, -1), None, np.arange(len(nodes))
    while root is None or (new != root).any():
        root, new = new, new.copy()
        for x in (a, b):
            np.minimum.at(new, root[x], np.minimum(root[a], root[b]))
        while (new[new] != new).any():
            new = new[new]
    member = np.flatnonzero(new != np.arange(len(nodes)))
    return nodes[member], nodes[new[member]]


def _contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join what these join: what each task reads, up to LINKS at once, becomes stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars():
            a, b = _forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n >= LINKS:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the smallest node of its component.

    Large star: each node's larger neighbours are tied to its smallest neighbour (or itself); small star:
    likewise its smaller neighbours. Both steps keep components; they end in stars after O(log^2 n) rounds,
    of few where tasks join much beforehand: each round's plan takes memory of the driver, however few its edges.
    """
    spark = edges.sparkSession

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return tidy(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        return tidy(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def write(e: DataFrame) -> tuple[str, DataFrame]:
        path = shared_path(spark, "components")
        e.write.parquet(path)
        return path, spark.read.schema("a long, b long").parquet(path)

    path, now = write(_contract(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))))
    was = state(now)
    while was[0]:
        new_path, new = write(small(large(now)))
        drop_shared(spark, path)
        path, now, is_ = new_path, new, state(new)
        if is_ == was:
            break
        was = is_
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """From rows with doc_id and fp: fp, component_id, root (a fingerprint that names the component)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs, n), "prints")
    groups = near_groups(prints, bits)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def most_bits(similarity: float, deviations: float = 0.5) -> int:
    """The differing bits of wide fingerprints expected at this Jaccard similarity of sets of like size
    (cosine 2 J / (1 + J)), and some standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * WIDE * p + deviations * math.sqrt(64 * WIDE * p * (1 - p)))


def _prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set of sorted hashes, frequent ones last: similar sets share one of them."""
    if len(frequent) and len(hashes):
        late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _dealt(keys: np.ndarray, many: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in the order of keys) of the buckets that have some."""
    to = (keys % np.uint64(many)).astype(np.uint16 if many < 65536 else np.int64)  # two bytes are sorted by radix
    by = np.argsort(to, kind="stable")
    used, cut = np.unique(to[by], return_index=True)
    return zip(used.tolist(), np.split(by, cut[1:])) if len(by) else iter(())


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the shingles in FREQUENT or more of about SAMPLE texts."""
    many = _partitions(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            found = np.concatenate([np.unique(_shingle_hashes(t.as_py(), n)) for t in batch.column(0)])
            rows = [(k, found[at].tobytes()) for k, at in _dealt(found, many)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

    def count(table: pa.Table) -> pa.Table:
        s, c = np.unique(np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint64), return_counts=True)
        return pa.table([pa.array(s[c >= FREQUENT].view(np.int64)), pa.array(c[c >= FREQUENT].astype(np.int64))], names=["s", "count"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col("text").cast("binary").alias("text"))
    counts = some.mapInArrow(deal, "bucket long, data binary").groupBy("bucket").applyInArrow(count, "s long, count long")
    found = counts.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in found], np.int64).view(np.uint64))


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """From differences (..., WIDE): few enough bits differ."""
    return np.bitwise_count(x).sum(-1, dtype=np.int64) <= bits


def _wide_run(prints: np.ndarray, bits: int, entry: np.ndarray | None = None, name: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one long posting: a part grows from a seed against what is left. What is of one entry is joined already.
    Links are of names, by default the prints."""
    out, rest, label, name = [], prints, np.arange(len(prints)) if entry is None else entry, prints if name is None else name
    while len(rest) > 1:
        own = label == label[0]
        seed, front, rest, label, name, joined = name[:1], rest[own], rest[~own], label[~own], name[~own], []
        while len(front) and len(rest):
            near, step = np.zeros(len(rest), bool), max(1, 300_000 // len(rest))
            for at in range(0, len(front), step):
                left = np.flatnonzero(~near)
                if not len(left):
                    break
                near[left] = _near(front[at : at + step, None] ^ rest[None, left], bits).any(0)
            near |= np.isin(label, label[near])
            joined.append(name[near])
            front, rest, label, name = rest[near], rest[~near], label[~near], name[~near]
        if joined and len(found := np.concatenate(joined)):
            out.append((found, np.repeat(seed, len(found), 0)))
    return out


def _print_ids(prints: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), 42) for r in prints], np.uint64).view(np.int64)


def posting_block(near: np.ndarray, prints: np.ndarray, sizes: np.ndarray, postings: np.ndarray, many: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Sets side by side by `near`, with `sizes` postings each -> (bucket, postings, entries, data): each entry once under each posting, with the
    posting before among its own (the first: itself), its `near`, and the prints of its members."""
    new = np.ones(len(near), bool)
    new[1:] = near[1:] != near[:-1]
    new[::ENTRY] = True
    start = np.flatnonzero(new)
    members = np.diff(np.append(start, len(near)))
    entry = np.repeat(np.cumsum(new) - 1, sizes)
    order = np.argsort(postings, kind="stable")
    order = order[np.argsort(entry[order].astype(np.uint16), kind="stable")]
    p, e = postings[order], entry[order]
    first = np.ones(len(p), bool)
    first[1:] = e[1:] != e[:-1]
    once = first.copy()
    once[1:] |= p[1:] != p[:-1]
    p, e, first = p[once], e[once], first[once]
    before = np.where(first, p, np.roll(p, 1))
    for bucket, at in _dealt(p, many):
        used, local = np.unique(e[at], return_inverse=True)
        own = members[used]
        rows = np.repeat(start[used] - np.cumsum(own) + own, own) + np.arange(own.sum())
        data = (p[at], before[at], local.astype(np.uint16), own.astype(np.uint16), near[start[used]].astype(np.int64), prints[rows])
        yield bucket, len(at), len(used), b"".join(x.tobytes() for x in data)


def bucket_links(blocks: list[tuple[int, int, bytes]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): ids of prints that join what meets in a posting of these blocks (postings, entries, data) and differs in few bits; what has one
    `near` is joined already. Entries that share a posting share the one before, too, or begin to share there: only there they
    meet, so that a pair is not found again under all it shares."""
    posting, before, of, size, label, prints, entries = [], [], [], [], [], [], 0
    for n, k, data in blocks:
        posting.append(np.frombuffer(data, np.uint64, n))
        before.append(np.frombuffer(data, np.uint64, n, 8 * n))
        of.append(np.frombuffer(data, np.uint16, n, 16 * n).astype(np.int32) + entries)
        size.append(np.frombuffer(data, np.uint16, k, 18 * n).astype(np.int32))
        label.append(np.frombuffer(data, np.int64, k, 18 * n + 2 * k))
        prints.append(np.frombuffer(data, np.uint64, -1, 18 * n + 10 * k).reshape(-1, WIDE))
        entries += k
    posting, before, of, size, label, prints = (np.concatenate(x) for x in (posting, before, of, size, label, prints))
    order = np.argsort(posting, kind="stable")
    posting, before, of = posting[order], before[order], of[order]
    shared = np.zeros(len(posting) + 1, bool)  # what is alone in its posting meets nothing
    shared[1:-1] = posting[1:] == posting[:-1]
    kept = shared[1:] | shared[:-1]
    posting, before, of = posting[kept], before[kept], of[kept]
    first, own = np.cumsum(size) - size, size[of]
    row = np.repeat(first[of] - np.cumsum(own) + own, own) + np.arange(own.sum())
    posting, before, near = np.repeat(posting, own), np.repeat(before, own), np.repeat(label[of], own)
    if not len(posting):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(posting)) + 1])
    sizes = np.diff(np.append(starts, len(posting)))
    label = np.repeat(label, size)  # from here on of each print
    at, found, d = np.flatnonzero(np.repeat(sizes <= 32, sizes)), [np.empty(0, np.uint64)], 0
    while len(at):
        d += 1
        at = at[at + d < len(posting)]
        at = at[posting[at] == posting[at + d]]
        meet = (near[at] != near[at + d]) & ((before[at] != before[at + d]) | (before[at] == posting[at]))
        pair = np.stack([row[at], row[at + d]])[:, meet]
        pair = np.unique(pair.min(0).astype(np.uint64) << np.uint64(32) | pair.max(0).astype(np.uint64))
        a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(pair[_near(prints[a] ^ prints[b], bits)])
    pair = np.unique(np.concatenate(found))
    out = [(label[(pair >> np.uint64(32)).astype(np.int64)], label[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)])]
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        if before[s] == posting[s] or (before[s : s + n] != before[s]).any():  # else all meet in the posting before
            out += _wide_run(prints[row[s : s + n]], bits, near[s : s + n], near[s : s + n])
    a, b = _forest(*(np.concatenate(x) for x in zip(*out)))
    rows = np.flatnonzero(np.isin(label, np.concatenate([a, b])))  # of each `near` the least print stands for it
    rows = rows[np.lexsort((*prints[rows].T, label[rows]))]
    names, at = np.unique(label[rows], return_index=True)
    ids = _print_ids(prints[rows[at]])
    return ids[np.searchsorted(names, a)], ids[np.searchsorted(names, b)]


def wide_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): edges between the ids of wide fingerprints (near, id, w0, w1, ..., prefix) of different entries that meet in a posting and differ
    in few bits. Sets of one `near` are dealt side by side, in ranges, so that many of them are more than one task's."""
    names, many = [f"w{k}" for k in range(WIDE)], _partitions(distinct)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0

        def send():
            near, *words_, sizes, prefix = (np.concatenate(x) for x in zip(*held))
            found = list(zip(*posting_block(near, np.stack(words_, 1), sizes, prefix, many)))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found or [[]] * 4, types)], names=["bucket", "n", "entries", "data"])

        for batch in _texts(batches):
            prefix = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(WIDE + 1)]
            sizes = np.array([len(x) for x in prefix], np.int64)
            held.append((batch.column(0).to_numpy(), *(batch.column(k + 1).to_numpy().view(np.uint64) for k in range(WIDE)), sizes, np.concatenate(prefix)))
            rows, postings = rows + len(sizes), postings + int(sizes.sum())
            if rows + TEXTS > BLOCK_ROWS or postings > BLOCK_POSTINGS:
                yield send()
                held, rows, postings = [], 0, 0
        if held:
            yield send()

    def meet(table: pa.Table) -> pa.Table:
        a, b = bucket_links(list(zip(*(table.column(c).to_pylist() for c in ("n", "entries", "data")))), bits)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    side = distinct.select("near", "id", *names, "prefix").repartitionByRange(many, "near", "id").sortWithinPartitions("near", "id").select("near", *names, "prefix")
    blocks = side.mapInArrow(pack, "bucket long, n int, entries int, data binary")
    return blocks.groupBy("bucket").applyInArrow(meet, "a long, b long")


class _Sets:
    """Sets of shingle hashes as numbers of one vocabulary, to count what one set shares with all others in one pass over them."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.size = np.array([len(x) for x in sets], np.int64)
        vocabulary, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = self.flat.astype(np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.flags, self.similarity = np.zeros(len(vocabulary), bool), similarity

    def own(self, k: int) -> np.ndarray:
        return self.flat[self.start[k] : self.start[k] + self.size[k]]

    def part(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members (ascending) with their shingles side by side, to be searched."""
        sizes = self.size[members]
        there = np.zeros(len(self.size), bool)
        there[members] = True
        return members, self.flat[np.repeat(there, self.size)], np.cumsum(sizes) - sizes

    def linked(self, k: int, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which members of a part are as similar to set k as asked."""
        members, flat, start = part
        own = self.own(k)
        if not len(own):
            return self.size[members] == 0
        self.flags[own] = True
        hits = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(self.flags[flat], out=hits[1:], dtype=np.int32)
        both = hits[start + self.size[members]] - hits[start]
        self.flags[own] = False
        return both >= self.similarity * (len(own) + self.size[members] - both) - 1e-9


def _similar_parts(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set: the first set of its part over links of the given similarity."""
    all_, part = _Sets(sets, similarity), np.arange(len(sets))
    rest = np.ones(len(sets), bool)
    held = all_.part(np.arange(len(sets)))
    for seed in range(len(sets)):
        if not rest[seed]:
            continue
        rest[seed], front = False, [seed]
        while front:
            if 2 * int(rest.sum()) < len(held[0]):
                held = all_.part(np.flatnonzero(rest))
            if not len(held[0]):
                break
            found = held[0][all_.linked(front.pop(), held)]
            found = found[rest[found]]
            rest[found] = False
            part[found] = seed
            front += found.tolist()
    return part


def _similar_pairs(sets: list[np.ndarray], first: int, similarity: float) -> list[tuple[int, int]]:
    """Links between the first sets and the others, but for those that join what is joined already."""
    all_, root, out = _Sets(sets, similarity), list(range(len(sets))), []
    others = all_.part(np.arange(first, len(sets)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for one in range(first):
        for other in others[0][all_.linked(one, others)].tolist():
            a, b = top(one), top(other)
            if a != b:
                root[b] = a
                out.append((one, other))
    return out


def exact_links(rows: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b): links of the given similarity, enough to join all that they join, from rows with root, lo, hi, block, sid and text: the
    blocks lo and hi (or the one block lo = hi) of a component of candidates, one row for each distinct set. A block is joined to itself by a star."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def whole():
            lo, hi = now[1:]
            held.sort(key=lambda x: x[:2])
            sids, sets = [x[1] for x in held], [x[2] for x in held]
            if lo == hi:
                pairs = list(enumerate(_similar_parts(sets, similarity).tolist()))
            else:
                first = sum(x[0] == lo for x in held)
                pairs = _similar_pairs(sets, first, similarity) if 0 < first < len(sets) else []
            return pa.RecordBatch.from_arrays([pa.array([sids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for root, lo, hi, block, sid, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (root, lo, hi) != now and held:
                    yield whole()
                    held.clear()
                now = root, lo, hi
                held.append((block, sid, np.unique(_shingle_hashes(text, n))))
        if held:
            yield whole()

    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("root", "lo", "hi", "block", "sid", "text")
    return rows.repartition(many, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(split, "a long, b long")


def exact_parts(docs: DataFrame, several: DataFrame, n: int, similarity: float, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(sid, part) of the sets of candidates (key, sid, root, sets: how many the component has)."""
    texts = docs.select(F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.col("text").cast("binary").alias("text")).join(several, "key").dropDuplicates(["sid"])
    blocks = F.expr(f"cast((sets + {block_sets - 1}) div {block_sets} as int)")
    rows = texts.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("lo"), F.greatest(j, "block").alias("hi")))
    links = materialize(exact_links(rows.withColumn("pair", F.explode(pairs)).select("root", "pair.*", "block", "sid", "text"), n, similarity), "links")
    if several.filter(F.col("sets") > block_sets).isEmpty():
        return links.select(F.col("a").alias("sid"), F.col("b").alias("part"))
    joined = components(links)
    alone = links.select(F.col("a").alias("sid")).distinct().join(joined.select(F.col("node").alias("sid"), F.col("root").alias("part")), "sid", "left")
    return alone.withColumn("part", F.coalesce("part", "sid"))


def near_unique(docs: DataFrame, n: int = STAGE_SHINGLE, similarity: float = SIMILARITY, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One document of each group of similar ones, with all its columns: of those with the group's smallest
    doc_id, the first by text hash. Texts without words are one group."""
    names, bits, frequent = [f"w{k}" for k in range(WIDE)], most_bits(similarity, CANDIDATE), frequent_shingles(docs, n)

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            sets = [np.unique(_shingle_hashes(t.as_py(), n)) for t in batch.column(2)]
            found = [_wide_majority(x) for x in sets]
            words_ = np.frombuffer(b"".join(found), np.int64).reshape(-1, WIDE)
            ids, sids = (np.array([xxhash.xxh64_intdigest(x, 42) for x in xs], np.uint64).view(np.int64) for xs in (found, map(np.ndarray.tobytes, sets)))
            prefixes = pa.array([_prefix(x, similarity, frequent).tobytes() for x in sets], pa.binary())
            columns = [batch.column(0), batch.column(1), pa.array(ids), pa.array(sids), *(pa.array(words_[:, k]) for k in range(WIDE)), prefixes]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "id", "sid", *names, "prefix"])

    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "key string, id long, sid long", *(f"{w} long" for w in names), "prefix binary"])
    prints = materialize(docs.select("doc_id", key.alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(prints_of, schema), "prints")
    sets = prints.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first(F.struct("id", *names, "prefix")).alias("p"))
    distinct = materialize(sets.select("sid", "least", "key", "p.*"), "fingerprints")
    # near copies by the byte-position index; then the links that shared bytes can't promise, between these groups
    groups = near_groups(distinct.select(F.col("least").alias("doc_id"), F.col("w0").alias("fp"))).select(F.col("fp").alias("w0"), F.col("root").alias("near"))
    grouped = distinct.join(materialize(groups, "near"), "w0")
    heads = grouped.groupBy("near").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    near = grouped.select("near", F.col("id").alias("a")).join(heads, "near").select("a", "b")
    roots = components(wide_links(grouped, bits).union(near)).withColumnRenamed("node", "id")
    named = distinct.select("sid", "key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = materialize(named.join(named.groupBy("root").agg(F.count("*").alias("sets")).filter("sets > 1"), "root").select("key", "sid", "root", "sets"), "candidates")
    parts = exact_parts(docs, several, n, similarity, block_sets)
    named = distinct.select("sid", "least").join(parts, "sid", "left").withColumn("root", F.coalesce("part", "sid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = named.join(least, "root").filter(F.col("least").eqNullSafe(F.col("component_id"))).select("sid", "root", "component_id")
    chosen = prints.select("doc_id", "key", "sid").join(groups, "sid").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # what is kept is known by a hash of id and text, before whole rows move; they move once, spread by this hash
    row_key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col("key"))).alias("_key")
    chosen = chosen.groupBy("root").agg(F.min(F.struct("key", "doc_id")).alias("c")).select("c.*").select(row_key)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", key.alias("key")).select("_row", row_key).join(chosen, "_key", "left_semi")
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(1)))).filter("_nth = 1").select("_row.*")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
