"""Operator 2: token ids in packed rows. Best-fit-decreasing with segment-tree capacity search.

Texts become ids of a public byte-level BPE vocabulary (its folder is a parameter), each document ended by
the end-of-text id. Documents over the row length are split losslessly into whole rows and a rest; pieces
of a window are packed in decreasing length, each into the row with the least room that holds it. A
segment tree over the room values (how many open rows have that room) finds the least sufficient room in
log(length) steps. A packed row is a fixed-length vector of ids, padded at its end; `cu_seqlens` holds
where its segments end (with 0 first) and `resets` the places where positions start again from 0.
Each segment names its document by a number of the row it came from (`doc_rows`: the task's number and the row's within it), since
ids may repeat or be null; `unpack` gives every row's ids back. Each task writes its id matrix, the cumulative
segment lengths and the position resets as raw little-endian files, under names that no other attempt has, and each row says where it
stands; `read_matrices` reads them.

The vocabulary is read on the driver and goes with the tasks (about a megabyte), so executors need no copy of its folder.

Windows: a task packs what it streams in windows of `window` tokens or MOST_DOCS documents, so memory is bounded and nothing is
shuffled; only a window's last rows are not full.

Nulls: a null or empty text is the end token alone; null doc_ids are kept as nulls. Empty table: empty
result. Repeated rows are packed again. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.stores import open_store
from .common import shared_path

FOLDER, VOCABULARY, LENGTH, WINDOW, MOST_DOCS, END = "/opt/tokenizers", "byte_bpe_50k.tiktoken", 2048, 8_000_000, 200_000, 50256
#: The vocabulary's own splitting rule.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "row_id string, doc_rows array<long>, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, resets array<int>, n_tokens int, ids binary"


def vocabulary_file(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    store, path = open_store(os.path.join(folder, vocabulary))
    with store.open_input_file(path) as f:
        return f.read()


class Encoder:
    """Texts to ids. Pieces never reach over the space before a word, so what follows each space is encoded once
    and kept; texts with two spaces in a row are encoded whole."""

    def __init__(self, data: bytes | None = None, keep: int = 400_000):
        import tiktoken

        lines = (vocabulary_file() if data is None else data).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.keep, self.known = keep, {}

    def encode(self, text: str) -> np.ndarray:
        if "  " in text:
            return np.array(self.whole(text), np.uint16)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for part in set(rest).difference(known):
            known[part] = np.array(self.whole(" " + part), np.uint16).tobytes()
        return np.frombuffer(np.array(self.whole(first), np.uint16).tobytes() + b"".join(map(known.__getitem__, rest)), np.uint16)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class RoomTree:
    """A segment tree over room 0 .. length: counts of open rows, with search for the least room that suffices."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, room: int) -> int | None:
        """The least room from `room` on that an open row has."""
        at = self.leaves + room
        if self.count[at]:
            return room
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # nothing at or right of it below; the right sibling's least
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def fit_decreasing(sizes: list[int], length: int) -> list[int]:
    """The row of each piece, in best-fit-decreasing order of sizes (ties by place)."""
    tree, open_, rows, n = RoomTree(length), defaultdict(list), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        room = tree.least(sizes[k])
        if room is None:
            row, room, n = n, length, n + 1
        else:
            row = open_[room].pop()
            tree.add(room, -1)
        rows[k] = row
        if room > sizes[k]:
            open_[room - sizes[k]].append(row)
            tree.add(room - sizes[k], 1)
    return rows


def pack_ids(docs: list[tuple[int, int | None, np.ndarray]], length: int = LENGTH, pad: int = END) -> list[tuple]:
    """From (row number, doc_id, ids): rows (doc_rows, doc_ids, doc_starts, cu_seqlens, resets, n_tokens, ids as bytes); doc_starts
    says where in its document each segment begins."""
    cut = [(row, doc_id, s, ids[s : s + length]) for row, doc_id, ids in docs for s in range(0, len(ids), length)]
    held = defaultdict(list)
    for piece, row in zip(cut, fit_decreasing([len(x[3]) for x in cut], length)):
        held[row].append(piece)
    out = []
    for _, own in sorted(held.items()):
        ends = np.cumsum([0, *(len(x[3]) for x in own)])
        ids = np.full(length, pad, np.uint16)
        ids[: ends[-1]] = np.concatenate([x[3] for x in own])
        out.append(([x[0] for x in own], [x[1] for x in own], [x[2] for x in own], ends.tolist(), ends[:-1].tolist(), int(ends[-1]), ids.tobytes()))
    return out


def unpack(rows) -> dict:
    """row number -> (doc_id, ids), from packed rows (doc_rows, doc_ids, doc_starts, cu_seqlens, resets, n_tokens, ids)."""
    found, names = defaultdict(list), {}
    for doc_rows, doc_ids, starts, ends, _, _, data in rows:
        ids = np.frombuffer(data, np.uint16)
        for row, doc_id, s, a, b in zip(doc_rows, doc_ids, starts, ends, ends[1:]):
            found[row].append((s, ids[a:b]))
            names[row] = doc_id
    return {r: (names[r], np.concatenate([x for _, x in sorted(own, key=lambda x: x[0])])) for r, own in found.items()}


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, and in the padding."""
    at = np.arange(length)
    starts = np.array([s for s in cu_seqlens if s < length])
    return at - starts[np.searchsorted(starts, at, side="right") - 1]


#: The files of a task: ids (rows x length), cumulative lengths and resets of all rows one after the other, and where each row's lengths begin.
FILES = {"ids": "u2", "cu_seqlens": "i4", "resets": "i4", "rows": "i8"}


class MatrixWriter:
    """Appends packed rows to a task's files, whose names no other attempt has."""

    def __init__(self, folder: str, part: int):
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.stem, self.rows, self.at = f"{folder}/{name}", 0, 0
        self.out = {k: store.open_output_stream(f"{path}/{name}.{k}") for k in FILES}

    def add(self, rows: list[tuple]) -> tuple[list[str], list[int]]:
        """Where each row stands: (stem, number)."""
        for *_, ends, resets, _, ids in rows:
            for k, x in (("ids", ids), ("cu_seqlens", np.array(ends, "<i4").tobytes()), ("resets", np.array(resets, "<i4").tobytes()), ("rows", np.array([self.at], "<i8").tobytes())):
                self.out[k].write(x)
            self.at += len(ends)
        self.rows += len(rows)
        return [self.stem] * len(rows), list(range(self.rows - len(rows), self.rows))

    def close(self) -> None:
        for f in self.out.values():
            f.close()


def pack_tokens(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY, length: int = LENGTH, window: int = WINDOW, end: int = END, matrices: str | None = None) -> DataFrame:
    """Rows with doc_id and text -> packed rows (SCHEMA); ids are little-endian uint16. With a folder for matrices also file (the stem of
    the task's files) and file_row; lazy, each attempt writes files of its own."""
    data = vocabulary_file(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, nth, held, total, seen = TaskContext.get().partitionId(), Encoder(data), 0, [], 0, 0
        last, writer = np.array([end], np.uint16), MatrixWriter(matrices, part) if matrices else None
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        types, names = [pa.string(), longs, longs, longs, ints, ints, pa.int32(), pa.binary()], list(NAMES)
        if writer:
            types, names = [*types, pa.string(), pa.int64()], [*names, "file", "file_row"]

        def packed():
            rows = pack_ids(held, length, end)
            for at in range(0, len(rows), 1000):
                some = rows[at : at + 1000]
                cols = [[f"{part}-{nth}-{at + k}" for k in range(len(some))], *zip(*some), *(writer.add(some) if writer else ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py() or ""), last])
                if held and (total + len(ids) > window or len(held) >= MOST_DOCS):
                    yield from packed()
                    held, total, nth = [], 0, nth + 1
                held.append((part << 40 | seen, doc_id, ids))
                total, seen = total + len(ids), seen + 1
        if held:
            yield from packed()
        if writer:
            writer.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", file string, file_row long" if matrices else ""))


def read_matrices(stem: str, length: int = LENGTH) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The id matrix of a task's files, and each row's cumulative lengths and resets."""
    found = {}
    for kind, dtype in FILES.items():
        store, path = open_store(f"{stem}.{kind}")
        with store.open_input_file(path) as f:
            found[kind] = np.frombuffer(f.read(), f"<{dtype}")
    starts = found["rows"]
    own = lambda x, cuts: np.split(x, cuts[1:]) if len(cuts) else []
    return found["ids"].reshape(-1, length), own(found["cu_seqlens"], starts), own(found["resets"], starts - np.arange(len(starts)))


def op2_token_pack(spark, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), matrices=shared_path(spark, "packed-ids"))
