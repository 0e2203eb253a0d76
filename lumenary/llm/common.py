"""Helpers that the operators share: tokens, the shared folder, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What the contracts call a word, as a regular expression for the JVM.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """The words of UTF-8 text; bytes.split and bytes.lower are ASCII-only, as the contracts ask."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def word_count(text: Column) -> Column:
    """Words of a string column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a new local folder if all
    run on this machine, else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lumenary-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; Spark deletes it when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(target)
    return store.makeQualified(target).toString()  # with its scheme, so that tasks need not know the default one


def drop_shared(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns' names can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
