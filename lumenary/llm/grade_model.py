"""Operator 5: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features, shared by all
grades, and ordered thresholds. The ratings come from `labels`: 0 toxic, 1 poor, 2 good. A document's
expected grade and its tail probability P(grade >= 2) follow; the tail decides what is kept.

Features: the set of lower-case words stripped of marks and of their first BEGIN bytes, hashed into WORDS, and the buckets of the shares of
symbols, capitals, table rules, repeats of the word before, and words said before, and of the length. The fit takes at most SAMPLE labelled documents of at most SAMPLE_FEATURES features
(a documented bound, chosen by hash of the id; one row of each) to the driver, as feature ids; AdaGrad steps with an L1 shrinkage leave words that carry no signal at 0, so
long texts gather no noise. Scoring covers every document.

Nulls: a null or empty text is scored by its one feature (no words); null ratings are skipped; a document
rated twice takes its lowest grade. No usable label: every tail is 1 and all is kept. Empty table: empty
result. Repeated rows are scored alike. Extra columns are ignored (`good_documents` keeps them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import pick, words

WORDS, SAMPLE, SAMPLE_FEATURES, GRADES, KEEP = 1 << 18, 12_000, 10_000, 3, 0.4
SIZE, STAT_VALUE, BEGIN = WORDS + 128, 4.0, 4
#: Bytes that are stripped off words; symbols; letters.
MARKS = b".,;:!?\"'()[]{}#*$%&|<>-_"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + CAPITALS.lower()
STATS = ("marked", "upper", "rules", "repeats", "copied", "length")


def _bucket(share: float) -> int:
    return 0 if share <= 0 else 1 + sum(share > x for x in (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6))


def statistics(text: bytes, found: list[bytes]) -> tuple[int, ...]:
    """A bucket for each of STATS."""
    n = len(found)
    if not n:
        return (0,) * len(STATS)
    size = len(text)
    letters = size - len(text.translate(None, LETTERS))
    return (
        _bucket((size - len(text.translate(None, SYMBOLS + b"!"))) / size),
        _bucket((size - len(text.translate(None, CAPITALS))) / max(1, letters)),
        _bucket(text.count(b" | ") / n),
        _bucket(sum(map(eq, found, found[1:])) / n),
        int(8 * (1 - len(set(found)) / n)),
        min(12, n.bit_length()),
    )


def _word_features(word: bytes) -> tuple[int, ...]:
    """The features of a word as it stands: the word without marks, and how it begins."""
    word = word.strip(MARKS).lower()
    if len(word) <= BEGIN:
        return (zlib.crc32(word) & (WORDS - 1),) if word else ()
    return zlib.crc32(word) & (WORDS - 1), zlib.crc32(b"\0" + word[:BEGIN]) & (WORDS - 1)


def _stat_features(stats: tuple[int, ...]) -> list[int]:
    return [WORDS + 16 * k + v for k, v in enumerate(stats)]


def features(text: bytes | None) -> np.ndarray:
    found = words(text)
    own = set(chain.from_iterable(map(_word_features, set(found))))
    return np.array([*sorted(own), *_stat_features(statistics(text or b"", found))], np.int32)


class _Known(dict):
    """Word -> those of its features that have a weight."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        own = self[word] = tuple(k for k in _word_features(word) if self.weights[k])
        return own


class GradeModel:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds, self.known = weights, thresholds, _Known(weights)

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: list[int], n_grades: int = GRADES, steps: int = 1000, batch: int = 256, rate: float = 0.3, l1: float = 5e-4, seed: int = 7) -> GradeModel:
        """Minibatch AdaGrad on the cumulative-link likelihood, L1-shrunk, for so many steps whatever the sample;
        thresholds stay in order by way of log gaps. Features of one document alone are left at 0."""
        y = np.asarray(grades, np.int64)
        if not len(y) or len(set(grades)) < 2:
            return cls(np.zeros(SIZE), np.full(n_grades - 1, -np.inf))
        in_docs = np.bincount(np.concatenate(rows), minlength=SIZE)
        used = np.flatnonzero(in_docs > 1)
        local = np.full(SIZE, -1, np.int32)
        local[used] = np.arange(len(used))
        rows = [x[x >= 0] for x in (local[r] for r in rows)]
        scale = np.where(used < WORDS, 1.0, STAT_VALUE)
        w, w2 = np.zeros(len(used)), np.full(len(used), 1e-2)
        share = np.clip(np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / len(y), 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # first threshold, log gaps
        t2 = np.full(len(t), 1e-8)
        rng = np.random.default_rng(seed)
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -35, 35)))
        order = np.empty(0, np.int64)
        for _ in range(steps):
            if len(order) < min(batch, len(y)):
                order = np.concatenate([order, rng.permutation(len(y))])
            own, order = order[:batch], order[batch:]
            sizes = np.array([len(rows[k]) for k in own])
            ids = np.concatenate([rows[k] for k in own])
            row = np.repeat(np.arange(len(own)), sizes)
            value = scale[ids]
            z = np.bincount(row, w[ids] * value, len(own))
            theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), [np.inf]])
            hi, lo = theta[y[own] + 1], theta[y[own]]
            s_hi, s_lo = np.where(np.isinf(hi), 1.0, sigmoid(hi - z)), np.where(np.isinf(lo), 0.0, sigmoid(lo - z))
            p = np.maximum(s_hi - s_lo, 1e-9)
            d_hi, d_lo = s_hi * (1 - s_hi) / p, s_lo * (1 - s_lo) / p
            gz = (d_hi - d_lo) / len(own)  # of -log p by z
            g = np.bincount(ids, gz[row] * value, len(used))
            hit = np.flatnonzero(np.bincount(ids, minlength=len(used)))
            w2[hit] += g[hit] ** 2
            step = rate / np.sqrt(w2[hit])
            moved = w[hit] - step * g[hit]
            w[hit] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            by_theta = np.bincount(y[own], -d_hi / len(own), n_grades)[:-1] + np.bincount(y[own], d_lo / len(own), n_grades)[1:]
            gt = np.array([by_theta.sum(), *(by_theta[k:].sum() * np.exp(t[k]) for k in range(1, len(t)))])
            t2 += gt**2
            t -= 0.05 / np.sqrt(t2) * gt
        weights = np.zeros(SIZE)
        weights[used] = w
        return cls(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))

    def latent(self, text: bytes | None) -> float:
        found = words(text)
        own = sorted(set(chain.from_iterable(map(self.known.__getitem__, set(found)))))
        stats = _stat_features(statistics(text or b"", found))
        return float(self.weights[own].sum() + STAT_VALUE * self.weights[stats].sum())

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k: an array (n, n_grades - 1)."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(z)[:, None] - self.thresholds[None, :], -500, 500)))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good; the lowest where there are several."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") >= 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GradeModel:
    """Fit on at most `sample` rated documents of at most SAMPLE_FEATURES features, taken by hash of the id."""
    chosen = rated(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        found = map(features, texts)
        return pd.Series([x.tobytes() if len(x) <= SAMPLE_FEATURES else None for x in found], dtype=object)

    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    one = rows.select("doc_id", "grade", ids(F.col("text").cast("binary")).alias("ids")).groupBy("doc_id", "grade").agg(F.min("ids").alias("ids"))
    got = one.filter("ids IS NOT NULL").toArrow().sort_by("doc_id")  # in Arrow's blocks, so the driver's JVM holds no rows
    return GradeModel.fit([np.frombuffer(x.as_buffer(), np.int32) for x in got["ids"]], got["grade"].to_pylist())


def grade_documents(docs: DataFrame, model: GradeModel, keep: float = KEEP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, expected_grade, tail_good, kept, and the carried columns as struct _row."""

    @F.pandas_udf("struct<expected_grade: double, tail_good: double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tails = model.tails(np.array([model.latent(t) for t in texts]))
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail_good": tails[:, -1]})

    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []
    scored = docs.select("doc_id", score(F.col("text").cast("binary")).alias("_s"), *row)
    return scored.select("doc_id", F.col("_s.expected_grade"), F.col("_s.tail_good"), (F.col("_s.tail_good") >= keep).alias("kept"), *(["_row"] if carry else []))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose tail probability suffices, with all their columns."""
    return grade_documents(docs, fit_model(docs, labels), carry=tuple(docs.columns)).filter("kept").select("_row.*")


def op5_grade_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grade_documents(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
