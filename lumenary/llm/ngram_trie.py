"""Operator 1: language-model scoring with an Elias-Fano n-gram trie.

Tokens are lower-case words and one end; the model is a trigram over all training words with absolute
discounting, interpolated down to unigrams (c + 1) / (N + V + 1). Every word has its own id, bigrams and
trigrams, and every count is over all training documents.

Ids are a number for each listed word, and for others bytes of XXH64, as many as the number of distinct words needs.
The list holds the VOCABULARY most frequent words, all words of over `spread` training tokens, and of words with one hash
all (so ids never clash). It makes n-grams short and says which words are hot; no result depends on it.

A trie holds the n-grams of the middle words that a shard owns. Levels: middle words; their successors;
contexts (the word before); and trigrams, each stored as the rank of its last word among the middle word's
successors, so that a small number stands for the word. All are Elias-Fano sequences with monotone pointers
between levels; probabilities and back-off weights are 16-bit codes of STEP of a decade. A trie is one file
that is memory-mapped; a query is a successor search in the middle word's range, then one for the rank in
the context's range.

Scale: one pass sends each token's n-gram to the shard of its middle word, in sorted and compressed blocks.
A middle word of over `spread` training tokens is hot: its n-grams are dealt by classes of the last word.
So are hot bigrams (found in a sample of the documents, which decides on the layout only), by classes of the
word before. An n-gram that a block has HEAVY times or more is sent once and its documents stay with the
block. What then is known only in parts (counts of rare words, totals of hot words, of their contexts, of hot
bigrams) is summed by a second, small shuffle: each shard sends its partial counts by hash of the key and
gets the totals back. A shard builds its trie and scores its tokens; sums go back to the block they came from.
`spread` is SPREAD or a millionth of all tokens, so the list is at most VOCABULARY and 2 ** 20 words, and no
corpus-sized table reaches the driver. Results do not depend on the number of shards, save for the order of
sums of doubles.

Tries are written to a folder that is given and stay there; else each task maps its trie in the shared folder and
deletes it, or holds it in memory, where that folder is a store without files to map.

Nulls: a null or empty text is the end alone; a null doc_id is hashed as an empty string for the hold-out.
Empty table: empty result; no training documents: counts are 0. Repeated rows are counted and scored each. Texts of any
length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.stores import local_path, open_store
from .common import materialize, shared_path, words
from .elias_fano import EliasFano

VOCABULARY, DISCOUNT, STEP, SHARD_TOKENS, SPREAD, BLOCK_TOKENS, BLOCK_DOCS = 65_533, 0.75, 1024, 600_000, 250_000, 800_000, 30_000
START, END, FIRST = 0, 1, 2
#: Ids of words outside the list have the top bit; an id of the list that stands for "not listed"; marks of questions.
RARE, ESCAPE, HOT_PAIR, WORD, MIDDLE = np.uint64(1 << 63), 0xFFFFFFFF, np.uint64(1 << 62), np.uint64((1 << 62) - 1), np.uint64((1 << 62) - 2)
#: Occurrences in a block from which an n-gram is sent once; one of so many documents is searched for hot bigrams.
HEAVY, SAMPLE = 32, 64
FOLDS, HELD = 7, 2


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def code(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes: -log10 in units of 1 / STEP."""
    return np.minimum(np.rint(-np.log10(p) * STEP), 65535).astype(np.uint16)


def hash_bytes(n_distinct: int) -> int:
    """So many bytes of a hash that about a thousand of n words, or fewer, share theirs with another."""
    return min(7, max(4, -(-(2 * max(1, n_distinct).bit_length() - 10) // 8)))


def _numbers(columns: list[np.ndarray], listed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ids of columns, ascending, and each column as numbers of them."""
    there = np.zeros(listed, bool)
    rare = [c >= RARE for c in columns]
    for c, r in zip(columns, rare):
        there[c[~r].astype(np.int64)] = True
    strange, number = np.unique(np.concatenate([c[r] for c, r in zip(columns, rare)]), return_inverse=True)
    place, known, out, at = np.cumsum(there, dtype=np.int32) - 1, np.flatnonzero(there), [], 0
    for c, r in zip(columns, rare):
        own = np.empty(len(c), np.int32)
        own[~r] = place[c[~r].astype(np.int64)]
        many = int(r.sum())
        own[r] = len(known) + number[at : at + many]
        at += many
        out.append(own)
    return np.concatenate([known.astype(np.uint64), strange]), out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack3(v: np.ndarray, u: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """One sortable number for (v, u, w), all below size; sorted, what shares v, then u, is side by side."""
    if size <= 1 << 21:
        return v.astype(np.uint64) << np.uint64(42) | u.astype(np.uint64) << np.uint64(21) | w.astype(np.uint64)
    pair = np.unique(v.astype(np.uint64) << np.uint64(32) | u.astype(np.uint64), return_inverse=True)[1]
    return pair.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _at(starts: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n rows."""
    marks = np.zeros(n, np.int8)
    marks[starts[1:]] = 1
    return np.cumsum(marks, dtype=np.int64)


class Trie:
    """Levels of a trigram trie over local ids below `size`; see the module's note."""

    SEQUENCES, CODES = ("middle", "next_start", "next", "context", "third_start", "third_base", "third"), ("p2", "b2", "p3", "b3", "p1", "ids")

    def __init__(self, levels: dict):
        self.__dict__.update(levels)
        self.size = max(1, len(self.ids))

    @classmethod
    def build(cls, grams: Grams, p1: np.ndarray) -> Trie:
        """From the trained n-grams of a shard with their totals. p1: probabilities of the local ids."""
        g, make, size = grams, EliasFano.build, max(1, len(grams.ids))
        node2, total2, kinds2 = g.pair_middle, g.total_middle, g.kinds_middle
        with np.errstate(divide="ignore", invalid="ignore"):
            back2 = DISCOUNT * kinds2 / total2
            prob2 = (g.count_pair - DISCOUNT) / total2[node2] + back2[node2] * p1[g.pair_word]
            back3 = DISCOUNT * g.kinds_context / g.total_context
            prob3 = (g.count - DISCOUNT) / g.total_context[g.context_of] + back3[g.context_of] * prob2[g.pair_of]
        start2 = np.concatenate([np.searchsorted(node2, np.arange(len(g.middles))), [len(node2)]])
        held = start2[1:] - start2[:-1]  # successors that this trie holds
        base = np.concatenate([[0], np.cumsum(held[g.context_middle])]).astype(np.int64)
        return cls({
            "middle": make(g.middles, size),
            "next_start": make(start2, len(node2) + 1),
            "next": make(node2 * size + g.pair_word, len(g.middles) * size),
            "context": make(g.context_middle * size + g.context_before, len(g.middles) * size),
            "third_start": make(np.concatenate([g.context_start, [len(g.count)]]), len(g.count) + 1),
            "third_base": make(base, int(base[-1]) + 1),
            "third": make(base[g.context_of] + g.pair_of - start2[g.context_middle][g.context_of], int(base[-1])),
            "p2": code(prob2), "b2": code(back2), "p3": code(prob3), "b3": code(back3), "p1": code(p1), "ids": grams.ids,
        })

    def save(self, out) -> None:
        """Writes one file: a line that says where each array is, and the arrays."""
        arrays = {f"{n}.{k}": a for n in self.SEQUENCES for k, a in getattr(self, n).arrays().items()} | {n: getattr(self, n) for n in self.CODES}
        at, where = 0, {}
        for name, a in arrays.items():
            where[name] = (at, str(a.dtype), len(a))
            at += -(-a.nbytes // 64) * 64
        out.write(json.dumps(where).encode() + b"\n")
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 64))

    @classmethod
    def load(cls, uri: str) -> Trie:
        """Maps the file, so that only pages that queries touch are read; of a store without files to map the bytes are read."""
        if path := local_path(uri):
            return cls.of(np.memmap(path, np.uint8, "r"))
        store, path = open_store(uri)
        with store.open_input_file(path) as f:
            return cls.of(np.frombuffer(f.read(), np.uint8))

    @classmethod
    def of(cls, held: np.ndarray) -> Trie:
        """From the bytes of a file."""
        line = held[:4096].tobytes()  # the line is far shorter
        start = line.index(b"\n") + 1
        where = json.loads(line[:start])
        take = lambda n: np.frombuffer(held, np.dtype(where[n][1]), where[n][2], start + where[n][0])
        return cls({n: EliasFano.of({k: take(f"{n}.{k}") for k in ("meta", "low", "high", "ones")}) for n in cls.SEQUENCES} | {n: take(n) for n in cls.CODES})

    def query(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes (negative logs, as int64) of n-grams of local ids, sorted by v, then u."""
        mid = _runs(v)
        pair = _runs(v, u)
        of_mid, of_pair = _at(mid, len(v)), _at(pair, len(v))
        node_of = self.middle.find(v[mid])
        start = np.where(node_of >= 0, self.next_start.access(np.maximum(node_of, 0)), 0) if len(mid) else mid
        node = node_of[of_mid]
        pair_node = node[pair]
        context = np.where(pair_node >= 0, self.context.find(np.maximum(pair_node, 0) * self.size + u[pair]), -1) if len(pair) else pair
        base = self.third_base.access(np.maximum(context, 0)) if self.third_base.n > 1 else np.zeros(len(pair), np.int64)
        out = self.p1[w].astype(np.int64)
        known = np.flatnonzero(node >= 0)
        place = self.next.find(node[known] * self.size + w[known])
        seen = place >= 0
        out[known[seen]] = self.p2[place[seen]]
        out[known[~seen]] += self.b2[node[known[~seen]]]
        rank = np.full(len(v), -1, np.int64)
        rank[known[seen]] = place[seen] - start[of_mid[known[seen]]]
        of_context = context[of_pair] if len(pair) else of_pair
        in_context = np.flatnonzero(of_context >= 0)
        third = np.full(len(in_context), -1, np.int64)
        try_ = rank[in_context] >= 0
        third[try_] = self.third.find(base[of_pair[in_context[try_]]] + rank[in_context[try_]])
        seen = third >= 0
        out[in_context[seen]] = self.p3[third[seen]]
        out[in_context[~seen]] += self.b3[of_context[in_context[~seen]]]
        return out


def count_words(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(word, c) over training documents; the row without a word counts documents; rows of two words with a space between
    count bigrams of the documents whose text's hash is 0 modulo `sample`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0

        def send():
            for at in range(0, len(keys := list(counts)), 200_000):
                some = keys[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([counts[k] for k in some], pa.int64())], names=["word", "c"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not held_out(doc_id):
                    raw = text.as_py() or b""
                    found = words(raw, lower=True)
                    counts.update(found)
                    n += 1
                    if found and xxhash.xxh64_intdigest(raw, 7) % sample == 0:
                        flow = [b"", *found]
                        counts.update(map(b" ".join, zip(flow, found)))
            if len(counts) > 400_000:
                yield from send()
                counts.clear()
        yield from send()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([n], pa.int64())], names=["word", "c"])

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The listed words, their counts, the corpus totals, and what is hot."""

    def __init__(self, top: list[tuple[bytes, int]], pairs: list[tuple[bytes, int]], n_docs: int, n_words: int, n_distinct: int, spread: int):
        self.words = [w for w, _ in top]
        self.counts = np.array([n_docs, n_docs, *(c for _, c in top)], np.int64)  # of the start as a middle word, the end, words
        self.tokens, self.distinct = n_words + n_docs, n_distinct + (n_docs > 0)
        self.bytes = hash_bytes(n_distinct)
        self.classes = np.maximum(1, -(-self.counts // spread))
        self.classes[END] = 1
        number = {w: k for k, w in enumerate(self.words, FIRST)} | {b"": START}
        found = []
        for pair, c in pairs:
            first, last = pair.split(b" ")
            a, b = number.get(first), number.get(last)
            if a is not None and b is not None and self.classes[a] > 1:
                found.append((a << 32 | b, max(2, -(-c // spread))))
        found.sort()
        self.pairs, self.pair_classes = np.array([k for k, _ in found], np.uint64), np.array([c for _, c in found], np.uint64)
        self.pairs_of = np.bincount((self.pairs >> np.uint64(32)).astype(np.int64), minlength=len(self.counts))

    def id_of(self, word: bytes) -> int:
        """Of a word that isn't listed."""
        return xxhash.xxh64_intdigest(word, 42) & ((1 << 8 * self.bytes) - 1) | 1 << 63

    @classmethod
    def of(cls, counts: DataFrame, size: int, spread: int, sample: int = SAMPLE) -> Vocabulary:
        """A histogram of the counts (at most about a thousand rows) says from which on a word can be among the `size` most
        frequent, so that hardly more rows than those reach the driver."""
        space = F.position(F.lit(b" "), F.col("word")) > 0
        found = counts.filter("word IS NOT NULL").withColumn("pair", space)
        words_ = found.filter("not pair")
        n_docs = counts.filter("word IS NULL").agg(F.sum("c")).first()[0] or 0
        n_words, n_distinct = words_.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word")).first()
        spread = max(spread, n_words >> 20)
        level = F.when(F.col("c") < 64, F.col("c")).otherwise(64 + F.floor((F.log2("c") - 6) * 16)).cast("long")
        found_ = words_.withColumn("level", level)
        lowest, total = 0, 0
        for r in sorted(found_.groupBy("level").count().collect(), key=lambda r: -r["level"]):
            lowest, total = r["level"], total + r["count"]
            if total >= size:
                break
        top = found_.filter(F.col("level") >= lowest).orderBy(F.desc("c"), "word").limit(size).collect()
        listed = {bytes(r["word"]): r["c"] for r in top}
        more = words_.filter(F.col("c") > spread) if len(top) == size and size and top[-1]["c"] > spread else None
        own = F.xxhash64("word").bitwiseAND(F.lit((1 << 8 * hash_bytes(n_distinct)) - 1).cast("long"))
        twin = words_.groupBy(own.alias("id")).agg(F.count("*").alias("n"), F.collect_list(F.struct("word", "c")).alias("twins")).filter("n > 1")
        twins = twin.select(F.inline("twins"))
        for r in [*(more.collect() if more is not None else []), *twins.collect()]:
            listed[bytes(r["word"])] = r["c"]
        pairs = [(bytes(r["word"]), r["c"] * sample) for r in found.filter(F.col("pair") & (F.col("c") * sample > spread)).select("word", "c").collect()] if n_words > spread else []
        return cls(sorted(listed.items(), key=lambda x: (-x[1], x[0])), pairs, n_docs, n_words, n_distinct, spread)

    def hot(self, middle: np.ndarray) -> np.ndarray:
        """Whether a middle word's n-grams are dealt over shards."""
        out = middle < np.uint64(len(self.counts))
        out[out] = self.classes[middle[out].astype(np.int64)] > 1
        return out

    def hot_pair(self, middle: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of (middle, word) among the hot bigrams, or -1."""
        out = np.full(len(middle), -1, np.int64)
        if len(self.pairs):
            at = np.flatnonzero((middle < RARE) & (word < RARE))
            key = middle[at] << np.uint64(32) | word[at]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            same = self.pairs[place] == key
            out[at[same]] = place[same]
        return out

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
        """By the middle word; by classes of the last word if it is hot, and of the word before if the two are."""
        cell = _mixed(v)
        hot = np.flatnonzero(self.hot(v))
        if len(hot):
            classes = self.classes[v[hot].astype(np.int64)].astype(np.uint64)
            cell[hot] = _mixed(cell[hot] + _mixed(w[hot] + np.uint64(1)) % classes)
            pair = self.hot_pair(v[hot], w[hot])
            own = pair >= 0
            at = hot[own]
            cell[at] = _mixed(_mixed(v[at]) ^ _mixed(w[at] + np.uint64(2)) + _mixed(u[at] + np.uint64(3)) % self.pair_classes[pair[own]])
        return (cell % np.uint64(shards)).astype(np.int64)


# --- blocks: sorted and compressed columns


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: like bytes side by side compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _unplanes(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).reshape(-1)


def _bytes(ids: np.ndarray, many: int) -> np.ndarray:
    return np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8)[:, :many]


def _short(ids: np.ndarray) -> np.ndarray:
    return np.where(ids >= RARE, np.uint64(ESCAPE), ids)


def encode(u: np.ndarray, v: np.ndarray, w: np.ndarray, extra: np.ndarray, many: int) -> bytes:
    """N-grams sorted by v, then u, and a number for each. Listed ids are short; the others follow in order, with `many` bytes."""
    context = _short(v) << np.uint64(32) | _short(u)
    steps = np.diff(v[v >= RARE] ^ RARE, prepend=np.uint64(0))
    return _squeeze(_planes(np.diff(context, prepend=np.uint64(0))), _planes(_short(w).astype(np.uint32)), _planes(extra), _bytes(steps, many).T, *(_bytes(x[x >= RARE], many) for x in (u, w)))


def decode(data: bytes, n: int, kind, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w and the numbers."""
    raw, size = _expand(data), np.dtype(kind).itemsize
    context = np.cumsum(_unplanes(raw, np.uint64, n, 0), dtype=np.uint64)
    v, u, w = context >> np.uint64(32), context & np.uint64(ESCAPE), _unplanes(raw, np.uint32, n, 8 * n).astype(np.uint64)
    extra, at = _unplanes(raw, kind, n, 12 * n), (12 + size) * n
    for k, x in enumerate((v, u, w)):
        rare = x == ESCAPE
        m = int(rare.sum())
        ids, held = np.zeros((m, 8), np.uint8), np.frombuffer(raw, np.uint8, many * m, at)
        ids[:, :many] = held.reshape(m, many) if k else held.reshape(many, m).T
        ids = ids.view(np.uint64).reshape(-1)
        x[rare] = (ids if k else np.cumsum(ids, dtype=np.uint64)) | RARE
        at += many * m
    return u, v, w, extra


BLOCK = "shard long, kind int, block long, n int, extra int, data binary"
DOCS, GRAMS, HEAVIES = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=["shard", "kind", "block", "n", "extra", "data"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def block_rows(block: int, ids: list, held: list[bool], sequences: list[np.ndarray], vocabulary: Vocabulary, shards: int, heavy: int = HEAVY) -> list[tuple]:
    """The rows (BLOCK) of a block of documents: its n-grams by shard, and what stays with the block."""
    counts, log_count = vocabulary.counts, np.log10(vocabulary.counts + 1.0)
    sizes = np.array([len(x) for x in sequences])  # with two starts each
    flow = np.concatenate(sequences)
    listed, (number,) = _numbers([flow], len(vocabulary.counts))
    real = np.ones(len(flow), bool)
    begin = np.cumsum(sizes) - sizes
    real[begin] = real[begin + 1] = False
    third = real[2:]
    d = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes - 2)
    out = np.array(held, bool)
    # what the list knows of the base score; shards add the rest
    w = flow[2:][third]
    own = w < RARE
    place = np.where(own, w, np.uint64(0)).astype(np.int64)
    base = np.bincount(d, np.where(own, log_count[place], 0.0), len(ids))
    n_known = np.bincount(d, own & (counts[place] > 0), len(ids)).astype(np.int64)
    del w, own, place
    key = pack3(number[1:-1][third], number[:-2][third], number[2:][third], len(listed))
    order = np.argsort(key)
    first = _runs(key[order])
    times = np.diff(np.append(first, len(order)))
    at = order[first]
    v, u, w = (listed[x[third][at]] for x in (number[1:-1], number[:-2], number[2:]))
    del key, number, flow
    to = vocabulary.shard(u, v, w, shards)
    rows, many = [], times >= heavy
    # n-grams sent once, in the order of shards: where they occur stays here
    often = np.flatnonzero(many)
    often = often[np.argsort(to[often], kind="stable")]
    spots = np.concatenate([order[first[k] : first[k] + times[k]] for k in often]) if len(often) else np.zeros(0, np.int64)
    whose = np.repeat(np.arange(len(often), dtype=np.uint64), times[often]) << np.uint64(16) | d[spots].astype(np.uint64)
    where, copies = np.unique(whose, return_counts=True)
    trained = np.bincount(np.repeat(np.arange(len(often)), times[often]), ~out[d[spots]], len(often)).astype(np.uint32)
    used, cut = np.unique(to[often], return_index=True)
    for s, part, n_train in zip(used.tolist(), np.split(often, cut[1:]), np.split(trained, cut[1:])):
        rows.append((s, HEAVIES, block, len(part), 0, encode(u[part], v[part], w[part], n_train, vocabulary.bytes)))
    id_null = np.array([i is None for i in ids], np.uint8)
    id_value = np.array([0 if i is None else i for i in ids], np.int64)
    rows.append((-1 - block, DOCS, block, len(ids), len(where), _squeeze(id_value, base, (sizes - 2).astype(np.int64), n_known, where, copies.astype(np.int64), id_null, out.astype(np.uint8))))
    # the others, each occurrence with its document
    few = np.repeat(~many, times)
    gram, mark = np.repeat(np.arange(len(first)), times)[few], d[order[few]]
    mark = mark | out[mark].astype(np.uint16) << np.uint16(15)
    by = np.argsort(to[gram].astype(np.uint16) if shards < 65536 else to[gram], kind="stable")  # two bytes are sorted by radix
    gram, mark = gram[by], mark[by]
    used, cut = np.unique(to[gram], return_index=True)
    for s, part, m in zip(used.tolist(), np.split(gram, cut[1:]), np.split(mark, cut[1:])):
        rows.append((s, GRAMS, block, len(part), 0, encode(u[part], v[part], w[part], m, vocabulary.bytes)))
    return rows


def route(docs: DataFrame, vocabulary: Vocabulary, shards: int, heavy: int = HEAVY) -> DataFrame:
    """Blocks of n-grams for the shards; and each block's documents, under a shard of their own."""
    listed, id_of = vocabulary.words, vocabulary.id_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = dict(zip(listed, range(FIRST, FIRST + len(listed))))
        part, nth = TaskContext.get().partitionId(), 0
        ids, tokens, held, sequences = [], 0, [], []

        def send():
            rows = block_rows(part << 32 | nth, ids, held, sequences, vocabulary, shards, heavy)
            for k in range(0, len(rows), 256):
                yield _batch(rows[k : k + 256])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py(), lower=True)
                flow = np.empty(len(found) + 3, np.uint64)
                flow[:2], flow[-1] = START, END
                flow[2:-1] = np.fromiter(map(known.get, found, repeat(0)), np.uint64, len(found))
                strange = np.flatnonzero(flow[2:-1] == 0)
                flow[strange + 2] = np.fromiter(map(id_of, map(found.__getitem__, strange.tolist())), np.uint64, len(strange))
                ids.append(doc_id)
                held.append(held_out(doc_id))
                sequences.append(flow)
                tokens += len(flow)
                if tokens >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield from send()
                    ids, tokens, held, sequences, nth = [], 0, [], [], nth + 1
        if ids:
            yield from send()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCK)


# --- shards


class Grams:
    """The n-grams of a shard: all distinct ones in the order of (middle, before, last), their training counts, and of the
    trained ones the levels of a trie with what this shard knows of their totals."""

    def __init__(self, rows: list[tuple], vocabulary: Vocabulary):
        parts = [decode(r[4], r[2], np.uint16 if r[0] == GRAMS else np.uint32, vocabulary.bytes) for r in rows]
        u, v, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        light = np.concatenate([np.full(len(p[0]), r[0] == GRAMS) for r, p in zip(rows, parts)])
        self.mark = np.concatenate([p[3].astype(np.uint32) for p in parts])
        self.sizes = [len(p[0]) for p in parts]
        del parts
        self.ids, (u, v, w) = _numbers([u, v, w], len(vocabulary.counts))
        n = len(u)
        key = pack3(v, u, w, len(self.ids))
        order = np.argsort(key)
        first = _runs(key[order])
        del key
        at = order[first]
        self.of = np.empty(n, np.int32)
        self.of[order] = _at(first, n)
        del order
        self.u, self.v, self.w = (x[at].astype(np.int64) for x in (u, v, w))
        trained = np.bincount(self.of, np.where(light, self.mark < 32768, self.mark), len(at)).astype(np.int64)
        self.rare = np.flatnonzero(self.ids >= RARE)
        counts = np.bincount(self.w, trained, len(self.ids)).astype(np.int64)
        self.count_rare = counts[self.rare]
        # levels of what is trained here, or may be elsewhere
        own = trained > 0
        own |= vocabulary.hot(self.ids)[self.v]
        u, v, w, self.count = self.u[own], self.v[own], self.w[own], trained[own]
        self.context_start = _runs(v, u)
        self.context_of = _at(self.context_start, len(v))
        self.middles = v[_runs(v)]
        middle_of = np.searchsorted(self.middles, v)
        self.context_middle, self.context_before = middle_of[self.context_start], u[self.context_start]
        pair, self.pair_of = np.unique(middle_of.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64), return_inverse=True)
        self.pair_middle, self.pair_word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(ESCAPE)).astype(np.int64)
        many = len(self.context_start)
        self.total_context = np.bincount(self.context_of, self.count, many)
        self.kinds_context = np.bincount(self.context_of, self.count > 0, many)
        self.count_pair = np.bincount(self.pair_of, self.count, len(pair))
        self.hot_pair = vocabulary.hot_pair(self.ids[self.middles][self.pair_middle], self.ids[self.pair_word])
        self.total_middle = np.bincount(middle_of, self.count, len(self.middles))
        self.kinds_middle = np.bincount(self.pair_middle, (self.hot_pair < 0) & (self.count_pair > 0), len(self.middles))
        self.hot_middle = vocabulary.hot(self.ids[self.middles]) if len(self.middles) else np.zeros(0, bool)

    def questions(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What other shards may know parts of: keys (a, b), own counts and kinds, and the shard that sums them.
        In order: rare words, hot middle words, their contexts, hot bigrams."""
        hot_context, hot_pair = np.flatnonzero(self.hot_middle[self.context_middle]), np.flatnonzero(self.hot_pair >= 0)
        hot, ids = np.flatnonzero(self.hot_middle), self.ids
        middle = ids[self.middles]
        a = np.concatenate([ids[self.rare], middle[hot], ids[self.context_before[hot_context]], ids[self.pair_word[hot_pair]] | HOT_PAIR])
        b = np.concatenate([np.full(len(self.rare), WORD), np.full(len(hot), MIDDLE), middle[self.context_middle[hot_context]], middle[self.pair_middle[hot_pair]]])
        c = np.concatenate([self.count_rare, self.total_middle[hot], self.total_context[hot_context], self.count_pair[hot_pair]]).astype(np.int64)
        kinds = np.concatenate([np.zeros(len(self.rare)), self.kinds_middle[hot], self.kinds_context[hot_context], np.zeros(len(hot_pair))]).astype(np.int64)
        self.asked = np.cumsum([len(self.rare), len(hot), len(hot_context), len(hot_pair)])
        self.places = hot, hot_context, hot_pair
        return a, b, c, kinds, (_mixed(a ^ _mixed(b)) % np.uint64(shards)).astype(np.int64)

    def answer(self, c: np.ndarray, kinds: np.ndarray, vocabulary: Vocabulary) -> None:
        """Takes the totals, in the order of the questions, and leaves out what is trained nowhere."""
        hot, hot_context, hot_pair = self.places
        (rare, middle, context, pair), (_, k_middle, k_context, _) = (np.split(x, self.asked[:-1]) for x in (c, kinds))
        self.count_rare = rare
        self.total_middle[hot] = middle
        self.kinds_middle[hot] = k_middle + vocabulary.pairs_of[self.ids[self.middles[hot]].astype(np.int64)]
        self.total_context[hot_context], self.kinds_context[hot_context] = context, k_context
        self.count_pair[hot_pair] = pair
        middle, context, pair, gram = self.total_middle > 0, self.total_context > 0, self.count_pair > 0, self.count > 0
        new = lambda kept: np.cumsum(kept) - 1
        self.middles, self.total_middle, self.kinds_middle = self.middles[middle], self.total_middle[middle], self.kinds_middle[middle]
        self.pair_middle, self.pair_word, self.count_pair = new(middle)[self.pair_middle[pair]], self.pair_word[pair], self.count_pair[pair]
        self.context_middle, self.context_before = new(middle)[self.context_middle[context]], self.context_before[context]
        self.total_context, self.kinds_context = self.total_context[context], self.kinds_context[context]
        self.context_of, self.pair_of, self.count = new(context)[self.context_of[gram]], new(pair)[self.pair_of[gram]], self.count[gram]
        self.context_start = np.searchsorted(self.context_of, np.arange(len(self.total_context)))


QUESTION = "shard long, asker long, n int, data binary"


def _questions(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["shard", "asker", "n", "data"])


def _by_shard(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    by = np.argsort(to, kind="stable")
    used, cut = np.unique(to[by], return_index=True)
    return list(zip(used.tolist(), np.split(by, cut[1:]))) if len(by) else []


def _gram_rows(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "block", "n", "extra", "data"))))


def ask(table: pa.Table, vocabulary: Vocabulary, shards: int) -> pa.Table:
    """A shard's blocks -> its questions, by the shard that sums them."""
    shard = table.column("shard")[0].as_py()
    if shard < 0:
        return _questions([])
    a, b, c, kinds, to = Grams(_gram_rows(table), vocabulary).questions(shards)
    short = lambda x: (x.astype(np.int64)).astype(np.uint32)
    rows = []
    for s, own in _by_shard(to):
        own = own[np.lexsort((a[own], b[own]))]
        rows.append((s, shard, len(own), _squeeze(_planes(np.diff(b[own], prepend=np.uint64(0))), _planes(np.diff(a[own], prepend=np.uint64(0))), _planes(short(c[own])), _planes(short(kinds[own])))))
    return _questions(rows)


def sum_up(table: pa.Table) -> pa.Table:
    """Questions of all shards to one -> the totals, to the askers, in the order in which each asked."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("asker", "n", "data"))))
    shard, parts = table.column("shard")[0].as_py(), []
    for _, n, data in rows:
        raw = _expand(data)
        b, a = (np.cumsum(_unplanes(raw, np.uint64, n, 8 * n * k), dtype=np.uint64) for k in (0, 1))
        parts.append((a, b, *(_unplanes(raw, np.uint32, n, 16 * n + 4 * n * k).astype(np.int64) for k in (0, 1))))
    a, b, c, kinds = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((a, b))
    first = _runs(a[order], b[order])
    of = np.empty(len(a), np.int64)
    of[order] = _at(first, len(a))
    c, kinds = (np.bincount(of, x, len(first))[of].astype(np.uint64) for x in (c, kinds))
    out, at = [], 0
    for asker, n, _ in rows:
        out.append((asker, shard, n, _squeeze(_planes(c[at : at + n]), _planes(kinds[at : at + n]))))
        at += n
    return _questions(out)


#: Sums of codes, log counts, known flags.
SUMS = (np.int64, np.float64, np.int64)


def _sums(doc: np.ndarray, *values: np.ndarray) -> bytes:
    """Sums by document, of those that occur."""
    own = np.flatnonzero(np.bincount(doc))
    return len(own).to_bytes(4, "little") + _squeeze(own.astype(np.uint16), *(_planes(np.bincount(doc, v)[own].astype(kind)) for v, kind in zip(values, SUMS)))


def score_shard(table: pa.Table, answers: pa.Table, vocabulary: Vocabulary, shards: int, folder: str, keep: bool) -> pa.Table:
    """A shard's blocks and answers -> for each block the sums of its tokens' codes, log counts and known flags
    (GRAMS; the last two of rare words), or these for each n-gram that was sent once (HEAVIES)."""
    rows = _gram_rows(table)
    shard = table.column("shard")[0].as_py()
    if shard < 0:
        return _table([(0, *r) for r in rows])
    g = Grams(rows, vocabulary)
    *_, to = a, b, *_ = g.questions(shards)
    c, kinds = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
    told = {s: (n, data) for s, n, data in zip(*(answers.column(x).to_pylist() for x in ("asker", "n", "data")))}
    for s, own in _by_shard(to):
        own = own[np.lexsort((a[own], b[own]))]
        n, data = told[s]
        raw = _expand(data)
        c[own], kinds[own] = (_unplanes(raw, np.uint64, n, 8 * n * k).astype(np.int64) for k in (0, 1))
    g.answer(c, kinds, vocabulary)
    count = np.zeros(len(g.ids), np.int64)
    listed = g.ids < RARE
    count[listed] = vocabulary.counts[g.ids[listed].astype(np.int64)]
    count[g.rare] = g.count_rare
    trie = Trie.build(g, (count + 1) / (vocabulary.tokens + vocabulary.distinct + 1))
    if keep or local_path(folder):
        uri = f"{folder}/trie-{shard:08d}" + ("" if keep else f"-{uuid.uuid4().hex}")
        store, path = open_store(uri)
        with store.open_output_stream(path) as f:
            trie.save(f)
        trie = Trie.load(uri)
        if not keep and store.type_name == "local":
            store.delete_file(path)  # what is mapped stays until it is closed
    codes = trie.query(g.u, g.v, g.w)[g.of]
    del trie
    rare = ~listed
    logs, known = np.where(rare, np.log10(count + 1), 0.0)[g.w][g.of], (rare & (count > 0))[g.w][g.of]
    out, at = [], 0
    for (kind, block, *_), n in zip(rows, g.sizes):
        own = slice(at, at + n)
        if kind == GRAMS:
            out.append((0, GRAMS, block, n, 0, _sums((g.mark[own] & 32767).astype(np.int64), codes[own], logs[own], known[own])))
        else:
            out.append((0, HEAVIES, block, n, shard, _squeeze(codes[own].astype(float), logs[own], known[own].astype(float))))
        at += n
    return _table(out)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish_block(table: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "extra", "n", "data"))))
    _, m, n, data = rows[0]
    raw = _expand(data)
    ids, base, n_tokens, n_known = (np.frombuffer(raw, t, n, 8 * n * k).copy() for k, t in enumerate((np.int64, np.float64, np.int64, np.int64)))
    where, copies = (np.frombuffer(raw, t, m, 32 * n + 8 * m * k) for k, t in enumerate((np.uint64, np.int64)))
    id_null, out = (np.frombuffer(raw, np.uint8, n, 32 * n + 16 * m + n * k).astype(bool) for k in (0, 1))
    codes = np.zeros(n)

    def add(doc, own, logs, known):
        codes[doc] += own
        base[doc] += logs
        n_known[doc] += known.astype(np.int64)

    heavy = []
    for kind, _, k, data in rows[1:]:
        if kind == HEAVIES:  # in the order of shards, as the block numbers them
            heavy.append(np.frombuffer(_expand(data), np.float64).reshape(3, k))
            continue
        k, raw = int.from_bytes(data[:4], "little"), _expand(data[4:])
        add(np.frombuffer(raw, np.uint16, k).astype(np.int64), *(_unplanes(raw, kind, k, 2 * k + 8 * k * j) for j, kind in enumerate(SUMS)))
    if heavy:
        found, doc = np.concatenate(heavy, 1)[:, (where >> np.uint64(16)).astype(np.int64)], (where & np.uint64(65535)).astype(np.int64)
        add(np.arange(n), *(np.bincount(doc, x * copies, n) for x in found))
    base -= n_tokens * math.log10(vocabulary.tokens + vocabulary.distinct + 1)
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.table([pa.array(ids, mask=id_null), pa.array(out), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(n, vocabulary.tokens)), pa.array(base), pa.array(-codes / STEP)], names=names)


def score_texts(docs: DataFrame, vocabulary_size: int = VOCABULARY, shard_tokens: int = SHARD_TOKENS, spread: int = SPREAD, heavy: int = HEAVY, sample: int = SAMPLE, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row with doc_id and text. The tries stay in
    `folder`, if it is given."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.of(materialize(count_words(docs, sample), "word-counts"), vocabulary_size, spread, sample)
    shards, keep, at = 1 + vocabulary.tokens // shard_tokens, folder is not None, folder or shared_path(spark, "tries")
    if keep or local_path(at):
        store, path = open_store(at)
        store.create_dir(path, recursive=True)
    blocks = route(docs, vocabulary, shards, heavy)
    questions = blocks.groupBy("shard").applyInArrow(lambda t: ask(t, vocabulary, shards), QUESTION)
    answers = questions.groupBy("shard").applyInArrow(sum_up, QUESTION)
    sums = blocks.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda t, a: score_shard(t, a, vocabulary, shards, at, keep), BLOCK)
    return sums.groupBy("block").applyInArrow(lambda t: finish_block(t, vocabulary), RESULT)


def op1_ngram_trie(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
