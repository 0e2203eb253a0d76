"""Sources and sinks: images, directories, sidecars, manifests, project configuration."""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from .stores import local_path, open_store, whole_path

CONFIG = ".lumenary.toml"
LOG_VARIABLE = "LUMENARY_LOG_LEVEL"


def bare(path):
    """A path without scheme, of any number of slashes."""
    return F.regexp_replace(path, r"^file:/+", "/")


def arguments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ordinal, path) in the order given; at least one is needed."""
    if not paths:
        raise ValueError("at least one input is needed")
    return spark.createDataFrame(list(enumerate(paths)), "ordinal long, path string")


def binaries(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length, content); columns that aren't used aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(paths).select(bare(F.col("path")).alias("path"), "length", "content")


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, image) with 8-bit BGR(A) data; what can't be decoded has height -1."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(paths)
    origin = F.url_decode(F.regexp_replace(F.col("image.origin"), r"\+", "%2B"))
    return rows.select(bare(origin).alias("path"), "image")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """All files below a root: (key, md5, length), in order of their paths."""
    root = whole_path(root)
    rows = binaries(spark, root)
    return rows.select(C.object_key(F.col("path"), local_path(root) or root).alias("key"), F.md5("content").alias("md5"), "length").orderBy("key")


def sidecars(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path of the image, sidecar text) from .dop files."""
    rows = binaries(spark, folders, "*.dop")
    return rows.select(F.regexp_replace("path", r"\.dop\z", "").alias("path"), F.decode("content", "UTF-8").alias("sidecar"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A listing (objects, zones, events, outputs) as JSON lines of a declared schema."""
    return spark.read.schema(schema).json(path)


def load_config(folder: str = ".") -> dict[str, str]:
    """The project's configuration; a missing file is an empty one, a damaged one an error."""
    try:
        with open(os.path.join(folder, CONFIG), "rb") as f:
            found = tomllib.load(f).get("publish", {})
    except FileNotFoundError:
        found = {}
    return {k: found.get(k, "") for k in ("subdomain", "hosted_zone_id", "domain_name")}


def save_config(config: dict[str, str], folder: str = ".") -> None:
    with open(os.path.join(folder, CONFIG), "w") as f:
        f.write("[publish]\n" + "".join(f"{k} = {json.dumps(config.get(k, ''))}\n" for k in ("subdomain", "hosted_zone_id", "domain_name")))
    os.chmod(os.path.join(folder, CONFIG), 0o644)


def log_level() -> str:
    """The session's log level, from the environment."""
    from ..functions import fixed

    return fixed.LOG_LEVELS.get(os.environ.get(LOG_VARIABLE, "").lower(), "error")


def apply_log_level(spark: SparkSession) -> None:
    spark.sparkContext.setLogLevel({"warning": "WARN"}.get(level := log_level(), level.upper()))


def write_files(rows: DataFrame, path: str = "output", data: str = "data") -> DataFrame:
    """Write each row's bytes to its path (whole, under a temporary name, then moved); returns the rows without the bytes. Lazy: a task that
    runs again writes the same."""
    import pyarrow as pa

    keep = [c for c in rows.columns if c != data]

    def run(batches):
        from pyspark import TaskContext

        for batch in batches:
            at, what = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (path, data))
            for name, content in zip(at, what):
                if name is not None and content is not None:
                    store, place = open_store(name)
                    store.create_dir(os.path.dirname(place), recursive=True)
                    with store.open_output_stream(part := f"{place}.{TaskContext.get().taskAttemptId()}.part") as out:
                        out.write(content)
                    store.move(part, place)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep], names=keep)

    return rows.mapInArrow(run, rows.select(*keep).schema)


def settle_files(rows: DataFrame, part: str, path: str, chosen: str) -> DataFrame:
    """Moves the files `part` of chosen rows to `path` and deletes those of others; returns the rows without part and chosen. A
    task that runs again finds what it has done."""
    import pyarrow as pa

    keep = [c for c in rows.columns if c not in (part, chosen)]

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            for name, to, wanted in zip(*(column(c).to_pylist() for c in (part, path, chosen))):
                if name is not None:
                    store, place = open_store(name)
                    if store.get_file_info(place).type == fs.FileType.File:
                        store.move(place, open_store(to)[1]) if wanted else store.delete_file(place)
            yield pa.RecordBatch.from_arrays([column(c) for c in keep], names=keep)

    return rows.mapInArrow(run, rows.select(*keep).schema)
