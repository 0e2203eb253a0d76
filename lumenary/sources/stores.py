"""Paths of Spark's as Arrow's file systems see them."""

from __future__ import annotations

import os

from pyarrow import fs

#: Names of stores in Spark's paths that Arrow's file systems call otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def local_path(uri: str) -> str | None:
    """The path of a file that this machine can open as it is (a local or mounted folder), else None."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if "://" not in uri else None


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path := local_path(uri):
        return fs.LocalFileSystem(), path
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def whole_path(path: str) -> str:
    """A local path made absolute; one with a scheme stays as it is."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def exists(spark, path: str) -> bool:
    """Whether there is a file, in whatever store Spark can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
