"""Operator 7: conflict-constrained best-fit packing.

Documents are cut into pieces of at most `capacity` words (one more for the end of the document) and the
pieces of a window packed by best fit in decreasing order. Open bins are ordered by residual room. Each
carries two bitmaps: sources (`slots` bits for each source: that many pieces of a source fit in a bin) and
duplicate clusters (one bit: no two pieces of a cluster share a bin). From the piece's size on, the
successor search goes to the next larger residual until it meets the tightest compatible bin; if there is
none, a bin is opened.

Bins of one residual are kept by what they hold of sources and of the HOT largest clusters, so a hot
source or a large group of copies is ruled out once for each such class and not bin by bin. The bitmap of other
clusters is sparse: the set of its bits, and clusters of one piece need none.

Windows: a task packs what it streams in windows of `window` words or MOST_DOCS documents, so memory is bounded, nothing is
shuffled, and only the last bins of a window are not full. A cluster's pieces in different windows can't
meet in a bin.

Nulls: a null text is a piece of one (its end), a null source is a source of its own; null doc_ids are
kept. Cluster: the column given, or equal texts. Repeated rows are pieces of one cluster. Empty table:
empty result. Texts longer than capacity are cut losslessly, and their pieces conflict. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import words

CAPACITY, SLOTS, WINDOW, MOST_DOCS, MANY, HOT = 2048, 2, 8_000_000, 200_000, 8, 64


class Bins:
    """Open bins ordered by residual room; place() puts a piece into the tightest compatible one."""

    def __init__(self, capacity: int, slots: int = SLOTS, hot: list = (), single: set = frozenset()):
        self.capacity, self.slots, self.hot, self.single = capacity, slots, {c: 1 << k for k, c in enumerate(hot)}, single
        self.filled = 0  # bit r: some bin has residual r
        self.at: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)  # residual -> (sources, hot clusters) -> bins
        self.source_bit: dict = {}
        self.clusters: list[set] = []  # of each bin, the bits of its clusters that aren't hot
        self.room: list[int] = []

    def place(self, size: int, source, cluster) -> int:
        first = self.source_bit.setdefault(source, len(self.source_bit)) * self.slots
        full = ((1 << self.slots) - 1) << first
        warm = self.hot.get(cluster, 0)
        cold = None if warm or cluster in self.single else cluster
        larger = self.filled >> size << size
        while larger:
            residual = (larger & -larger).bit_length() - 1  # the successor
            kinds = self.at[residual]
            for (sources, held), bins in kinds.items():
                if sources & full == full or held & warm:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if cold is None or cold not in self.clusters[bins[k]]:
                        found = bins.pop(k)
                        if not bins:
                            del kinds[sources, held]
                            if not kinds:
                                self.filled &= ~(1 << residual)
                        return self._keep(found, residual - size, sources, held, first, warm, cold)
            larger &= larger - 1
        self.clusters.append(set())
        self.room.append(self.capacity)
        return self._keep(len(self.room) - 1, self.capacity - size, 0, 0, first, warm, cold)

    def _keep(self, bin_: int, residual: int, sources: int, held: int, first: int, warm: int, cold) -> int:
        used = sources >> first & ((1 << self.slots) - 1)
        sources |= (used + 1 & ~used) << first  # the lowest free bit of the source
        self.room[bin_] = residual
        if cold is not None:
            self.clusters[bin_].add(cold)
        if residual:
            self.at[residual].setdefault((sources, held | warm), []).append(bin_)
            self.filled |= 1 << residual
        return bin_


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n units; the last is the shortest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pack_window(docs: list[tuple], capacity: int = CAPACITY, slots: int = SLOTS) -> list[tuple]:
    """From (doc_id, units, source, cluster): a row for each piece:
    (doc_id, piece, pieces, start, units, source, cluster, bin, offset), bins numbered from 0."""
    cut = [(doc_id, k, s, n, source, cluster, len(own)) for doc_id, units, source, cluster in docs for own in [pieces(units, capacity)] for k, (s, n) in enumerate(own)]
    times = Counter(x[5] for x in cut)
    bins = Bins(capacity, slots, [c for c, n in times.most_common(HOT) if n >= MANY], {c for c, n in times.items() if n == 1})
    fill, out = Counter(), []
    for doc_id, k, start, units, source, cluster, n in sorted(cut, key=lambda x: -x[3]):
        b = bins.place(units, source, cluster)
        out.append((doc_id, k, n, start, units, source, cluster, b, fill[b]))
        fill[b] += units
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, slots: int = SLOTS, window: int = WINDOW, cluster: str | None = None) -> DataFrame:
    """Rows with doc_id, text, source (and a cluster column) -> a row for each piece, with its bin and place in it."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", "piece", "pieces", "start_unit", "units", "source", "cluster", "bin_id", "bin_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, total = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            rows = pack_window(held, capacity, slots)
            for at in range(0, len(rows), 50_000):
                cols = list(zip(*rows[at : at + 50_000]))
                cols[7] = [f"{part}-{nth}-{b}" for b in cols[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for doc_id, text, source, group in zip(*(c.to_pylist() for c in batch.columns)):
                units = len(words(text)) + 1
                group = group if group is not None else hashlib.md5(text or b"").hexdigest()
                if held and (total + units > window or len(held) >= MOST_DOCS):
                    yield from packed()
                    held, total, nth = [], 0, nth + 1
                held.append((doc_id, units, source, group))
                total += units
        if held:
            yield from packed()

    group = F.col(f"`{cluster}`").cast("string") if cluster else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("source").cast("string").alias("source"), group.alias("cluster"))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "int", "int", "long", "long", "string", "string", "string", "long"))))


def op7_conflict_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
