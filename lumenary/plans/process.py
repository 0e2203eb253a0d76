"""Image batches: inputs -> headline -> scan -> fit -> frame -> caption -> JPEG, as one lazy plan.

Run parameters are checked on the driver and raise; a bad file becomes an error on its own row. Files are spread over
tasks, pixels run on numpy in Arrow batches, and the only shuffles are the joins on the input path and the one of rows without
pictures that finds, among inputs with one output path, the last. Each picture is rendered once: it is written under the name of its input's
number, and moved or deleted when the last is known.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import columns as C, fixed
from ..operators import codecs, metadata, pixels, relational as R
from ..sources import files
from ..sources.stores import exists, open_store, whole_path

LOG = logging.getLogger("lumenary")


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, as text where the command line has text."""

    size: str
    filter: str = "mks2021"
    fit: str = "expand"
    frame: float = 5.0
    color: str = "#fff"
    quality: int = 92
    outdir: str = ""
    label: bool = False
    label_font: str = "sans"
    label_size: float = 1.5
    label_padding: float = 1.0
    linear_light: bool = False
    format: str = ".jpg"


def parse_size(text: str) -> tuple[int, int]:
    """The driver's version of functions.columns.size; raises ValueError."""
    t = text.strip().lower()
    if t in fixed.SIZES:
        return fixed.SIZES[t]
    for mark in "x,":
        halves = t.split(mark)
        if len(halves) == 2:
            out = []
            for name, half in zip(("width", "height"), halves):
                digits = half.strip().removeprefix("-").removeprefix("+") if half.strip()[:2] not in ("+-", "-+") else ""
                if not (digits.isascii() and digits.isdigit()) or not -(2**63) <= int(half) < 2**63:
                    raise ValueError(f"invalid {name}: {half}")
                out.append(int(half))
            return out[0], out[1]
    raise ValueError(f"invalid size: {t}; known are {', '.join(sorted(fixed.SIZES))}")


def parse_filter(text: str) -> str:
    for name, spellings in fixed.FILTERS.items():
        if text in spellings:
            return name
    raise ValueError(f"unknown filter: {text}")


def parse_color(text: str) -> tuple[int, int, int, int]:
    t = text.strip()
    if t.lower() in fixed.COLOURS:
        return *fixed.COLOURS[t.lower()], 255
    digits = t.removeprefix("#")
    if len(digits) == 3:
        digits = "".join(2 * d for d in digits)
    if len(digits) not in (6, 8) or not set(digits) <= set("0123456789abcdefABCDEF"):
        raise ValueError(f"invalid color: {text}")
    r, g, b, a = bytes.fromhex(digits.ljust(8, "f"))
    return r, g, b, a


@dataclass(frozen=True)
class Job:
    """Checked parameters."""

    width: int
    height: int
    frame: int
    filter: str
    colour: tuple[int, int, int]
    font: int
    padding: int
    settings: Settings


def check(s: Settings) -> Job:
    """Raises ValueError for what no file can make good: size, filter, colour, quality, format."""
    width, height = parse_size(s.size)
    if not 1 <= s.quality <= 100:
        raise ValueError(f"quality out of range: {s.quality}")
    if s.format.lower() not in codecs.FORMATS:
        raise ValueError(f"unsupported output format: {s.format}")
    short = min(width, height)
    percent = lambda x: int(float(short) * x / 100.0)
    return Job(width, height, percent(s.frame), parse_filter(s.filter), parse_color(s.color)[:3], max(8, percent(s.label_size)), percent(s.label_padding), s)


def render(image: np.ndarray, job: Job, caption: str) -> np.ndarray:
    """One RGB array through resize, frame and caption. Raises ValueError for a box without room or an unknown fit."""
    s = job.settings
    if s.fit == "expand":
        box = job.width - 2 * job.frame, job.height - 2 * job.frame
        if min(box) <= 0:
            raise ValueError("frame too large for output size")
        small = pixels.resize_to_fit(image, *box, job.filter, s.linear_light)
        h, w = small.shape[:2]
        left, top = (job.width - w) // 2, (job.height - h) // 2
        out = pixels.add_frame(small, top, job.width - w - left, job.height - h - top, left, job.colour)
    elif s.fit == "wrap":
        if min(job.width, job.height) <= 0:
            raise ValueError("output size is not positive")
        small = pixels.resize_to_fit(image, job.width, job.height, job.filter, s.linear_light)
        h, left, top = small.shape[0], job.frame, job.frame
        out = pixels.add_frame(small, top, left, top, left, job.colour)
    else:
        raise ValueError(f"unknown fit: {s.fit}")
    return pixels.add_label(out, caption, job.font, left, top + h, job.padding) if caption else out


def headlines(spark: SparkSession, inputs: DataFrame, folders: list[str]) -> DataFrame:
    """(path, headline): the sidecar's, else the one in the image; the images of the first kind aren't read."""
    side = files.sidecars(spark, folders).select("path", C.headline(F.col("sidecar")).alias("side"))
    known = inputs.select("path").distinct().join(side, "path", "left")

    trace = files.log_level() == "debug"

    @F.pandas_udf("string")
    def embedded(path: pd.Series, data: pd.Series, kind: pd.Series) -> pd.Series:
        found = [metadata.embedded_headline(d, k) for d, k in zip(data, kind)]
        if trace:  # to the task's log
            logging.basicConfig(level=logging.DEBUG)
            for p, k, h in zip(path, kind, found):
                LOG.debug("%s: %s, headline %r", p, k, h)
        return pd.Series(found, dtype=object)

    lacking = known.filter("side IS NULL").select("path").join(files.binaries(spark, folders), "path").select("path", embedded("path", "content", C.image_format(F.col("path"))).alias("inside"))
    return known.join(lacking, "path", "left").select("path", R.first_of(F.col("side"), F.col("inside")).alias("headline"))


RESULT = "ordinal long, path string, output string, in_w int, in_h int, out_w int, out_h int, error string, data binary"


def render_rows(rows: DataFrame, job: Job) -> DataFrame:
    """Rows with ordinal, path, output, headline, error and image -> RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.binary()]
        for batch in batches:
            for r in batch.to_pylist():  # one picture at a time in memory
                image, error, data, size = r["image"], r["error"], None, (None, None)
                if error is None and (image is None or image["height"] <= 0):
                    error = f"failed to load: {r['path']}"
                if error is None:
                    try:
                        n = image["nChannels"]
                        bgr = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
                        rgb = bgr[..., 2::-1] if n >= 3 else np.repeat(bgr, 3, axis=2)
                        out = render(np.ascontiguousarray(rgb), job, r["headline"] or "")
                        data, size = codecs.encode(out, job.settings.format, job.settings.quality), (out.shape[1], out.shape[0])
                    except ValueError as e:
                        error = str(e)
                known = image is not None and image["height"] > 0
                row = (r["ordinal"], r["path"], r["output"], image["width"] if known else None, image["height"] if known else None, *size, error, data)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return rows.select("ordinal", "path", "output", "headline", "error", "image").mapInArrow(run, RESULT)


def named(inputs: DataFrame, settings: Settings) -> DataFrame:
    """(ordinal, path, output, error): where each input's picture goes. A store's name stays in front."""
    folder = whole_path(settings.outdir) if settings.outdir else ""
    store, below = F.regexp_extract("path", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)?(.*)\z", 1), F.regexp_extract("path", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)?(.*)\z", 2)
    if folder:
        root, own = (folder[: folder.index("/", folder.index("://") + 3)], folder[folder.index("/", folder.index("://") + 3) :]) if "://" in folder else ("", folder)
        store, own = F.lit(root), F.lit(own)
    rows = inputs.select("ordinal", "path", store.alias("store"), C.output_path(below, own if folder else None).alias("o"))
    output = F.concat("store", F.regexp_replace("o.path", r"\.jpg\z", settings.format.lower()))
    return rows.select("ordinal", "path", output.alias("output"), F.col("o.error").alias("error"))


def plan(spark: SparkSession, paths: list[str], settings: Settings) -> DataFrame:
    """RESULT for each input, with the encoded picture; nothing is written."""
    job = check(settings)
    paths = [whole_path(p) for p in paths]
    inputs = files.arguments(spark, paths)
    rows = named(inputs, settings)
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return rows.select("ordinal", "path", "output", *[F.lit(None).cast("int").alias(c) for c in ("in_w", "in_h", "out_w", "out_h")], F.coalesce("error", F.concat(F.lit("failed to load: "), "path")).alias("error"), F.lit(None).cast("binary").alias("data"))
    captions = headlines(spark, inputs, sorted({os.path.dirname(p) for p in there})) if settings.label else None
    rows = rows.join(captions, "path", "left") if captions is not None else rows.withColumn("headline", F.lit(None).cast("string"))
    return render_rows(rows.join(files.images(spark, sorted(set(there))), "path", "left"), job)


def process(spark: SparkSession, paths: list[str], settings: Settings) -> DataFrame:
    """Render and write; of inputs with one output the last good one wins. Returns a row for each winner and each failure, without the pictures."""
    if settings.outdir:
        store, folder = open_store(whole_path(settings.outdir))
        store.create_dir(folder, recursive=True)
    good = F.col("error").isNull()
    rendered = plan(spark, paths, settings).withColumn("_part", F.when(good, F.concat("output", F.lit("."), F.col("ordinal"), F.lit(".part"))))
    written = files.write_files(rendered, "_part")
    last = F.row_number().over(W.partitionBy("output", F.col("_part").isNull()).orderBy(F.desc("ordinal"))) == 1
    settled = files.settle_files(written.withColumn("_last", good & last).withColumn("_shown", F.col("_last") | ~good), "_part", "output", "_last")
    return settled.filter("_shown").drop("_shown")
