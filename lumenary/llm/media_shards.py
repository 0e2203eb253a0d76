"""Operator 9: media columns. Payloads, content-addressed, in tar shards; rows carry digest, offset and length.

A payload becomes an 8-bit grey PNG (rows of 192 samples, filter 0, zlib), which is lossless. Each task
appends the pictures it makes to tar shards in the shared folder, once for each digest, and returns index
rows. Metadata columns are filled by range reads of the picture's first 33 bytes (signature and IHDR)
alone; `read_back` reads whole members for digests and features.

Shards are written by tasks through Arrow's file systems (local, object stores, HDFS) under names that no other attempt has, and the
index says which: a task that runs again writes shards of its own, and those of the lost attempt are not referred to. Nothing is
moved. Payloads are not shuffled: equal payloads of different tasks are stored once per task, under one digest; a task holds the
places of what it stored (some 200 bytes for each different payload).

Nulls: a null payload is empty (media_columns leaves its pointers null). Empty table: no shard, empty
result. Repeated rows point at one member. A payload of any length goes in whole. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.stores import open_store
from .common import materialize, shared_path

WIDTH, LEVEL, SHARD_BYTES, SHARD_ROWS = 192, 5, 256 << 20, 200_000
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """8-bit grey picture of samples, whose number is a positive multiple of width."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture that to_png made."""
    (width, height, depth), at, packed = png_header(data), 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("not 8-bit grey with filter 0")
    return rows[:, 1:].tobytes()


def pad(text: bytes | None, to: int = WIDTH) -> bytes:
    text = text or b""
    return text + b" " * (max(to, -(-len(text) // to) * to) - len(text))


class ShardWriter:
    """Appends members to tar shards in a folder; a member is stored once. Offsets are of the member's bytes."""

    def __init__(self, folder: str, name: str, limit: int = SHARD_BYTES):
        self.store, self.path = open_store(folder)
        self.uri, self.name, self.limit, self.known, self.nth, self.out = folder.rstrip("/"), f"{name}-{uuid.uuid4().hex}", limit, {}, 0, None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        key = bytes.fromhex(digest)
        if key in self.known:
            nth, offset = self.known[key]
            return f"{self.uri}/{self.name}-{nth:05d}.tar", offset, len(data)
        if self.out is None:
            self.out, self.at = self.store.open_output_stream(f"{self.path}/{self.name}-{self.nth:05d}.tar"), 0
        head = tarfile.TarInfo(digest)
        head.size = len(data)
        head = head.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        self.known[key] = self.nth, self.at + len(head)
        place = f"{self.uri}/{self.name}-{self.nth:05d}.tar", self.at + len(head), len(data)
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.nth = None, self.nth + 1


class ShardReader:
    """Range reads of members; keeps one shard open."""

    def __init__(self):
        self.uri = self.file = None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            store, path = open_store(uri)
            self.uri, self.file = uri, store.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def store_payloads(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Rows with doc_id and binary `payload` -> doc_id, n_bytes and the index columns; lazy, each run writes its shards."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        writer, rows = ShardWriter(folder, f"part-{TaskContext.get().partitionId():06d}", limit), []

        def send():
            """Rows go out when the shards that they point at are complete."""
            writer.close()
            for at in range(0, len(rows), 10_000):
                cols = list(zip(*rows[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            rows.clear()

        for batch in batches:
            for doc_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = payload.as_py() or b""
                data = to_png(pad(raw))
                digest = hashlib.sha256(data).hexdigest()
                rows.append((doc_id, len(raw), digest, *writer.add(digest, data)))
                if len(rows) >= SHARD_ROWS:
                    yield from send()
        yield from send()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "payload").mapInArrow(write, f"doc_id long, n_bytes long, {INDEX}")


def _mapped(index: DataFrame, add: dict[str, pa.DataType], schema: str, of) -> DataFrame:
    """Index rows with columns added by of(reader, shard, offset, length); equal members are read once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader()
        try:
            for batch in batches:
                place = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "length")]
                found = list(zip(*(of(reader, *x) for x in zip(*place)))) or [[] for _ in add]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(found, add.values()))], names=[*batch.schema.names, *add])
        finally:
            reader.close()

    known = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return index.mapInArrow(run, f"{known}, {schema}")


def media_columns(index: DataFrame) -> DataFrame:
    """Adds width, height, depth from header-only range reads."""
    of = lambda reader, shard, offset, length: png_header(reader.read(shard, offset, HEADER)) if shard else (None, None, None)
    return _mapped(index, {"width": pa.int32(), "height": pa.int32(), "depth": pa.int32()}, "width int, height int, depth int", of)


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy (bits) of the samples, in thousandths."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share, level = counts / len(samples), np.arange(256)
    mean = float((share * level).sum())
    spread = float((share * (level - mean) ** 2).sum()) ** 0.5
    share = share[share > 0]
    return f"mean={round(mean * 1000)};dev={round(spread * 1000)};entropy={round(float(-(share * np.log2(share)).sum()) * 1000)}"


def read_back(index: DataFrame) -> DataFrame:
    """Adds what whole reads of the members give: payload size and digest, checksum of the tail, media digest, feature."""

    def of(reader, shard, offset, length):
        data = reader.read(shard, offset, length)
        samples = from_png(data)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    long, text = pa.int64(), pa.string()
    return _mapped(index, {"payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text, "picture_feature": text}, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, picture_feature string", of)


def op9_media_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("payload"))
    index = materialize(store_payloads(docs, shared_path(spark, "tar-shards")), "media-index")
    found = read_back(media_columns(index))
    told = F.concat(F.lit("png;"), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("x"), F.col("depth").cast("string"), F.lit(";"), F.col("picture_feature"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", told.alias("feature"), "digest", F.regexp_extract("shard", "[^/]+$", 0).alias("shard"), "offset", "length")
