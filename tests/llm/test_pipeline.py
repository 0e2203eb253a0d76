import collections
import zlib

import numpy as np

import corpus_pipeline
from lumenary.llm import grade_model, line_crf, queries
from lumenary.llm.conflict_pack import CAPACITY, SLOTS

from .test_near_and_shards import similar_roots
from .test_quality_and_mix import base


def tail_of(text, model):
    """The chance of the best grade, by code of its own: words without marks, their beginnings, and buckets of six shares."""
    raw, marks = text.encode(), b".,;:!?\"'()[]{}#*$%&|<>-_"
    found, hashed = raw.split(), set()
    for w in found:
        if w := w.strip(marks).lower():
            hashed.add(zlib.crc32(w) % 2**18)
            if len(w) > 4:
                hashed.add(zlib.crc32(b"\0" + w[:4]) % 2**18)
    step = lambda x: 0 if x <= 0 else 1 + sum(x > y for y in (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6))
    letters = sum(chr(c).isalpha() for c in raw if c < 128)
    n = len(found)
    shares = [0] * 6
    if n:
        shares = [
            step(sum(c in b"#*$%&|<>!" for c in raw) / len(raw)), step(sum(65 <= c <= 90 for c in raw) / max(1, letters)), step(raw.count(b" | ") / n),
            step(sum(a == b for a, b in zip(found, found[1:])) / n), int(8 * (1 - len(set(found)) / n)), min(12, n.bit_length()),
        ]
    z = sum(model.weights[k] for k in hashed) + 4 * sum(model.weights[2**18 + 16 * k + v] for k, v in enumerate(shares))
    return 1 / (1 + np.exp(model.thresholds[-1] - z))


def line_verdict(text, chain):
    """Base rules from the counts of the other test, and the share of words in content lines by the best path of all, found forwards with all paths' scores kept."""
    n_words, _, _, _, repeats = base(text)
    counts, rows = line_crf.line_features(text.encode())
    if n_words < 50 or 100 * repeats > 50 * n_words:
        return False
    paths = {(y,): chain.scores(rows[:1])[0, y] for y in (1, 0)}
    for k in range(1, len(rows)):
        s, best = chain.scores(rows[k : k + 1])[0], {}
        for y in (1, 0):
            value, path = max(((v + chain.move[p[-1], y] + s[y], p) for p, v in paths.items()), key=lambda x: x[0])
            best[*path, y] = value
        paths = best
    label = np.array(max(paths, key=paths.get))
    return counts[label == 1].sum() >= 0.5 * counts.sum()


def test_stages_on_odd_rows(spark, wide_docs, odd_docs, no_docs, tmp_path, labels, sf_dir):
    for name in ("odd", "none"):
        (odd_docs if name == "odd" else no_docs).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns, step
            assert name == "odd" or out.count() == 0
        assert name == "odd" or corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, wide_docs, sf_dir).columns == wide_docs.columns


def test_pipeline_against_brute_force(spark, sf_dir):
    """The stages again, one document at a time, on the small tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, chain = grade_model.fit_model(docs, labels), line_crf.fit_chain(docs, labels)
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    good = [r for r in rows if tail_of(r[1], model) >= 0.4]
    clean = [r for r in good if line_verdict(r[1], chain)]
    root = similar_roots([r[1] for r in clean])
    single = [r for k, r in enumerate(clean) if root[k] == k]
    assert 0 < len(single) < len(clean) < len(good) < len(rows)

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    # the mix: per source, whole documents near its target, none more than three times
    words = {r[0]: len(r[1].split()) for r in single}
    copies = collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert set(copies) <= set(words) and max(copies.values()) <= 3
    sizes, taken = collections.Counter(), collections.Counter()
    for d, _, s in single:
        sizes[s] += words[d]
        taken[s] += copies[d] * words[d]
    from .test_quality_and_mix import filled

    order = sorted(sizes)
    for s, want in zip(order, filled([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))])):
        longest = max(words[d] for d, _, x in single if x == s)
        assert abs(taken[s] - want) <= longest + sum(words.values()) / 1000, s
    # the packing: nothing is lost, bins hold, and no cluster or source is crowded
    units = collections.Counter()
    by = collections.defaultdict(list)
    for r in packed:
        units[r["doc_id"]] += r["units"]
        by[r["bin_id"]].append(r)
    assert all(units[d] == n * (words[d] + 1) for d, n in copies.items())
    for own in by.values():
        assert sum(r["units"] for r in own) <= CAPACITY and len({r["cluster"] for r in own}) == len(own)
        assert max(collections.Counter(r["source"] for r in own).values()) <= SLOTS


def test_registry():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and len(corpus_pipeline.STAGES) == 5
