"""Operator 3: quality rules and line sequence labelling by a linear-chain conditional random field.

Each line with a word is described by buckets of its length, marks, capitals, table rules, repeats, digits,
end, place, by being a copy of an earlier line, and the share of words of notices. A two-label chain (content, boilerplate)
over these is decoded by Viterbi; the share of words in content lines decides retention, beside the two
base rules (fewer than 50 words, or over half of the words in repeated 3-word windows).

Training: at most SAMPLE rated documents of at most SAMPLE_LINES lines (a documented bound, by hash of the id; one row of each) reach the driver as line
features; sequences are whole, in batches of like length. Ratings are of documents, not of lines, so a first fit without transitions takes each line's
label from its document; then lines of poor documents that this fit still takes for content, and lines of
good ones that it takes for boilerplate with confidence, are labelled anew, and the chain is fitted to
those sequences by gradient ascent on the conditional likelihood (forward-backward).

Nulls: a null text has no words, fails the base rule and is not kept; null ratings are skipped. Without
usable ratings all lines are content. Empty table: empty result. Repeated rows are decided alike. Texts of
any length are read whole. Extra columns are ignored (`kept_documents` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import pick, words

SAMPLE, SAMPLE_LINES, MIN_WORDS, MAX_REPEAT, MIN_CONTENT = 6_000, 2_000, 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
SPACE_OR_TAIL = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space, and bytes that begin no code point
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = CAPITALS + CAPITALS.lower()
#: What notices say, in lower case.
NOTICES = (b"licens", b"licenc", b"copyright", b"rights reserved", b"cookie", b"subscribe", b"newsletter", b"sign in", b"log in", b"privacy", b"terms of", b"click here", b"share this", b"read more")
BUCKETS = 10
FEATURES = 12


def _share(part: int, whole: int) -> int:
    return 0 if part <= 0 or whole <= 0 else min(9, 1 + sum(part > x * whole for x in (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.8)))


def repeated_words(found: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(found)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    for w in set(found):
        numbers[w] = len(numbers)
    ids, v = np.fromiter(map(numbers.__getitem__, found), np.int64, n), len(numbers)
    if v == n:
        return 0
    key = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:  # else three numbers fit in 64 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    found = words(text)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(found), len(text.translate(None, SPACE_OR_TAIL)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(found)


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: its number of words; a bucket for each feature (lines x FEATURES)."""
    lines = [x for x in (text or b"").split(b"\n") if x and not x.isspace()]
    counts, rows, seen = [], [], set()
    for k, line in enumerate(lines):
        own = line.split()
        n, size = len(own), len(line)
        letters = size - len(line.translate(None, LETTERS))
        last = line.rstrip()[-1:]
        rows.append((
            min(9, n.bit_length()),
            _share(size - len(line.translate(None, SYMBOLS)), size),
            _share(size - len(line.translate(None, CAPITALS)), letters),
            _share(line.count(b"!"), n),
            _share(line.count(b"|"), n),
            _share(size - len(line.translate(None, DIGITS)), size),
            _share(sum(map(eq, own, own[1:])), n),
            _share(n - len(set(own)), n),
            int(line in seen),
            _share(sum(map(line.lower().count, NOTICES)), n),
            1 if last in b".?" else 2 if last == b"!" else 3 if last in SYMBOLS else 0,
            0 if k == 0 else 1 if k == len(lines) - 1 else 2,
        ))
        seen.add(line)
        counts.append(n)
    return np.array(counts, np.int64), np.array(rows, np.int64).reshape(-1, FEATURES)


class LineChain:
    """Weights of the chain: for each feature bucket and label, and for each pair of labels. Label 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES * BUCKETS, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    @staticmethod
    def columns(rows: np.ndarray) -> np.ndarray:
        return rows + np.arange(FEATURES) * BUCKETS

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.emit[self.columns(rows)].sum(1)

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The best label sequence; content wins ties."""
        if not len(rows):
            return np.zeros(0, np.int64)
        s, ((m00, m01), (m10, m11)) = self.scores(rows).tolist(), self.move.tolist()
        a0, a1 = s[0]
        back = []
        for e0, e1 in s[1:]:
            f0, f1 = a1 + m10 >= a0 + m00, a1 + m11 >= a0 + m01
            a0, a1 = e0 + (a1 + m10 if f0 else a0 + m00), e1 + (a1 + m11 if f1 else a0 + m01)
            back.append((f0, f1))
        label = int(a1 >= a0)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return np.array(out[::-1], np.int64)

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], chain: bool, steps: int = 60, rate: float = 0.5, l2: float = 1e-4) -> LineChain:
        """Full-batch AdaGrad ascent of the mean conditional log-likelihood. With chain, sequences are whole, padded to the power of two above."""
        rows, marks = np.concatenate(sequences), np.concatenate(labels)
        kinds, kind = np.unique(rows, axis=0, return_inverse=True)  # few lines differ in all their buckets
        cols, kind, total = self.columns(kinds), kind.reshape(-1), len(rows)
        sizes = np.array([len(x) for x in sequences]) if chain else np.ones(total, np.int64)
        starts = np.cumsum(sizes) - sizes
        batches, gold_move = [], np.zeros((2, 2))
        for width in sorted({1 << int(n - 1).bit_length() for n in sizes.tolist()}):
            own = np.flatnonzero((sizes <= width) & (2 * sizes > width))
            real = np.arange(width) < sizes[own, None]
            at = np.where(real, starts[own, None] + np.arange(width), 0)
            gold, pairs = marks[at], real[:, 1:]
            np.add.at(gold_move, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            batches.append((real, kind[at], pairs))

        def spread(by_kind: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(cols.ravel(), np.repeat(by_kind[:, lab], FEATURES), len(self.emit)) for lab in (0, 1)], 1)

        gold_emit = spread(np.stack([np.bincount(kind[marks == lab], minlength=len(kinds)) for lab in (0, 1)], 1))
        e2, m2 = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(steps):
            scores, hoped, moved = self.emit[cols].sum(1), np.zeros((len(kinds), 2)), np.zeros((2, 2))
            for real, at, pairs in batches:
                p, both = self._expected(scores[at] * real[..., None], real)
                for lab in (0, 1):
                    hoped[:, lab] += np.bincount(at[real], p[real][:, lab], len(kinds))
                moved += both[pairs].sum(0)
            g = (gold_emit - spread(hoped)) / total - l2 * self.emit
            e2 += g**2
            self.emit += rate * g / np.sqrt(e2)
            if chain:
                g = (gold_move - moved) / total - l2 * self.move
                m2 += g**2
                self.move += rate * g / np.sqrt(m2)
        return self

    def _expected(self, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over a batch of padded sequences: probabilities of labels (n, t, 2) and of pairs (n, t - 1, 2, 2)."""
        n, t, _ = s.shape
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = s[:, 0]
        for k in range(1, t):
            step = np.logaddexp(forward[:, k - 1, 0, None] + self.move[0], forward[:, k - 1, 1, None] + self.move[1]) + s[:, k]
            forward[:, k] = np.where(real[:, k, None], step, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            on = s[:, k + 1] + backward[:, k + 1]
            step = np.logaddexp(self.move[:, 0] + on[:, 0, None], self.move[:, 1] + on[:, 1, None])
            backward[:, k] = np.where(real[:, k + 1, None], step, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        both = np.exp(forward[:, :-1, :, None] + self.move + (s + backward)[:, 1:, None, :] - z[:, None, None, None])
        return np.exp(forward + backward - z[:, None, None]), both


def train(sequences: list[np.ndarray], good: list[bool]) -> LineChain:
    """From documents' line features and whether each document is good; see the module's note."""
    kept = [(x, g) for x, g in zip(sequences, good) if len(x)]
    if len({g for _, g in kept}) < 2:
        return LineChain()
    rows = [x for x, _ in kept]
    marks = [np.full(len(x), int(g)) for x, g in kept]
    first = LineChain().fit(rows, marks, chain=False)
    anew = []
    for x, y in zip(rows, marks):
        lean = np.diff(first.scores(x), axis=1)[:, 0]  # log odds of content
        anew.append(np.where(y == 1, lean > -2.2, lean > 0).astype(np.int64))
    return LineChain().fit(rows, anew, chain=True)


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineChain:
    """Fit on at most `sample` rated documents of at most SAMPLE_LINES lines, taken by hash of the id."""
    rated = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def rows(texts: pd.Series) -> pd.Series:
        found = (line_features(t)[1] for t in texts)
        return pd.Series([x.astype(np.uint8).tobytes() if len(x) <= SAMPLE_LINES else None for x in found], dtype=object)

    found = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    one = found.select("doc_id", "quality", rows(F.col("text").cast("binary")).alias("rows")).groupBy("doc_id", "quality").agg(F.min("rows").alias("rows"))
    got = one.filter("rows IS NOT NULL").toArrow().sort_by("doc_id")  # in Arrow's blocks, so the driver's JVM holds no rows
    return train([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, FEATURES).astype(np.int64) for x in got["rows"]], [q >= 1 for q in got["quality"].to_pylist()])


def judge(text: bytes | None, chain: LineChain) -> tuple:
    """The base counts, base_failed, lines, content lines, content share, kept."""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]
    n, rows = line_features(text)
    label = chain.decode(rows)
    share = float(n[label == 1].sum() / n.sum()) if len(n) else 0.0
    return *counts, failed, len(n), int(label.sum()), share, bool(not failed and share >= MIN_CONTENT)


def judge_documents(docs: DataFrame, chain: LineChain, carry: tuple[str, ...] = ()) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "content_lines", "content_share", "kept")
    kinds = ("long",) * 5 + ("boolean", "long", "long", "double", "boolean")

    @F.pandas_udf(", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, chain) for t in texts], columns=list(names))

    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []
    judged = docs.select("doc_id", run(F.col("text").cast("binary")).alias("_j"), *row)
    return judged.select("doc_id", "_j.*", *(["_row"] if carry else []))


def kept_documents(docs: DataFrame, labels: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """The documents that pass, with all their columns; the chain is fitted on `rated` documents, by default these."""
    return judge_documents(docs, fit_chain(docs if rated is None else rated, labels), tuple(docs.columns)).filter("kept").select("_row.*")


def op3_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_documents(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
