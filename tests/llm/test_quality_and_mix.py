import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenary.llm import grade_model as Q, line_crf as L, source_mix as X

from .conftest import SCHEMA, prose


# --- op5


def graded(n=900, seed=2):
    """Good prose, marked-up junk, and prose with insults of two made-up roots."""
    rng, out = random.Random(seed), []
    for k in range(n):
        text, kind = prose(rng, rng.randint(30, 300)), k % 3
        if kind == 1:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        elif kind == 0:
            found = text.split()
            for _ in range(max(2, len(found) // 40)):
                found[rng.randrange(len(found))] = rng.choice(["zqinsult", "kxslur" + rng.choice("abc")])
            text = " ".join(found)
        out.append((text, kind))
    return out


def test_grades_are_learned_in_order():
    rows = graded()
    model = Q.GradeModel.fit([Q.features(t.encode()) for t, _ in rows[:600]], [g for _, g in rows[:600]])
    assert (np.diff(model.thresholds) > 0).all()
    z = np.array([model.latent(t.encode()) for t, _ in rows[600:]])
    grades, tails = np.array([g for _, g in rows[600:]]), model.tails(z)
    assert ((tails[:, -1] >= Q.KEEP) == (grades == 2)).mean() > 0.97
    means = [tails.sum(1)[grades == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2] and (tails[:, 0] >= tails[:, 1]).all()
    value = lambda ids: (model.weights[ids] * np.where(ids < Q.WORDS, 1, Q.STAT_VALUE)).sum()
    assert np.allclose(z, [value(Q.features(t.encode())) for t, _ in rows[600:]])


def test_fit_is_as_good_as_a_plain_one():
    """Against cumulative-link regression on whole words, fitted by full-batch gradient descent."""
    rows = graded(600, 5)
    names = {w: k for k, w in enumerate(sorted({w for t, _ in rows for w in t.split()}))}
    x = np.zeros((len(rows), len(names)))
    for k, (t, _) in enumerate(rows):
        x[k, [names[w] for w in set(t.split())]] = 1
    y, train = np.array([g for _, g in rows]), np.arange(len(rows)) < 400
    w, cuts = np.zeros(len(names)), np.array([-0.7, 0.7])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for _ in range(600):
        z = x[train] @ w
        upper, lower = sigmoid(np.append(cuts, 35)[y[train]] - z), sigmoid(np.insert(cuts, 0, -35)[y[train]] - z)
        g = -(upper * (1 - upper) - lower * (1 - lower)) / np.maximum(upper - lower, 1e-9)  # of the log-likelihood by z
        w += 0.02 * (x[train].T @ g - 0.05 * w)
    plain = ((x[~train] @ w >= cuts[1]) == (y[~train] == 2)).mean()
    model = Q.GradeModel.fit([Q.features(t.encode()) for t, _ in rows[:400]], [g for _, g in rows[:400]])
    own = ((model.tails([model.latent(t.encode()) for t, _ in rows[400:]])[:, -1] >= 0.5) == (y[~train] == 2)).mean()
    assert own >= plain - 0.02 and own > 0.9


def test_long_documents_are_not_sampled_but_scored(spark, odd_docs, odd_rows, labels, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_FEATURES", 60)
    monkeypatch.setattr(L, "SAMPLE_LINES", 2)
    assert Q.grade_documents(odd_docs, Q.fit_model(odd_docs, labels)).count() == len(odd_rows)
    assert L.judge_documents(odd_docs, L.fit_chain(odd_docs, labels)).count() == len(odd_rows)


def test_gradient_is_the_likelihoods(monkeypatch):
    """The first step from zero weights lowers the loss of each rating's own features."""
    model = Q.GradeModel.fit([np.array([1]), np.array([2]), np.array([3])] * 50, [0, 1, 2] * 50, l1=0.0)
    assert model.weights[1] < model.weights[2] < model.weights[3]


def test_ratings(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (4, None, 1), (None, 1, 0), (5, 1, None)]
    got = {r["doc_id"]: r["grade"] for r in Q.rated(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1, 2: 0, 4: 0, 5: 2}


def test_grade_odd_documents(spark, odd_docs, odd_rows, wide_docs, no_docs, labels):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.fit_model(odd_docs, labels)
    rows = Q.grade_documents(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["tail_good"] <= 1 and 0 <= r["expected_grade"] <= 2 and r["kept"] == (r["tail_good"] >= Q.KEEP) for r in rows)
    assert Q.good_documents(wide_docs, labels).columns == wide_docs.columns
    assert Q.good_documents(odd_docs, empty).count() == len(odd_rows)
    assert Q.good_documents(no_docs, labels).count() == 0 and Q.good_documents(no_docs, empty).count() == 0


def test_sample_is_bounded(spark, odd_docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.GradeModel, "fit", classmethod(lambda cls, rows, grades: seen.append(len(rows)) or cls(np.zeros(Q.SIZE), np.zeros(2))))
    Q.fit_model(odd_docs, labels, sample=10)
    assert seen[0] <= 10


# --- op3


def base(text):
    w, lines, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    found = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + d for k in range(len(w) - 2) if found[tuple(w[k : k + 3])] >= 2 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_base_counts(odd_rows):
    texts = [r[1] for r in odd_rows[:40]] + ["a b c a b c", "a a a a", "a\n\n \na\na ", "# * é x", "a b c d a b c", "one"]
    for t in texts:
        assert L.base_counts(None if t is None else t.encode()) == base(t), t


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        chain = L.LineChain(rng.normal(size=(L.FEATURES * L.BUCKETS, 2)), rng.normal(size=(2, 2)))
        rows = rng.integers(0, L.BUCKETS, (n, L.FEATURES))
        s = chain.scores(rows)
        value = lambda path: sum(s[k, y] for k, y in enumerate(path)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))
        paths = [tuple(m >> k & 1 for k in range(n)) for m in range(1 << n)]
        assert abs(value(tuple(chain.decode(rows))) - max(map(value, paths))) < 1e-9
    assert len(chain.decode(np.zeros((0, L.FEATURES), np.int64))) == 0


def test_chain_fit_raises_the_likelihood():
    rng = np.random.default_rng(2)
    xs, ys = [], []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 4), 3)
        x = rng.integers(0, L.BUCKETS, (12, L.FEATURES))
        x[:, 0] = np.where(rng.random(12) < 0.8, y, 1 - y)
        xs.append(x)
        ys.append(y)
    chain = L.LineChain().fit(xs, ys, chain=True)
    right = np.mean([np.mean(chain.decode(x) == y) for x, y in zip(xs, ys)])
    alone = np.mean([np.mean(x[:, 0] == y) for x, y in zip(xs, ys)])
    assert right > alone and chain.move[0, 0] + chain.move[1, 1] > chain.move[0, 1] + chain.move[1, 0]


def test_forward_backward_of_whole_sequences():
    """Probabilities of labels and of pairs against all paths, for sequences of several lengths in one batch; none is cut."""
    rng = np.random.default_rng(5)
    chain = L.LineChain(rng.normal(size=(L.FEATURES * L.BUCKETS, 2)), rng.normal(size=(2, 2)))
    sizes = (5, 7, 8)
    rows = [rng.integers(0, L.BUCKETS, (n, L.FEATURES)) for n in sizes]
    real = np.arange(8) < np.array(sizes)[:, None]
    scores = np.zeros((3, 8, 2))
    for k, x in enumerate(rows):
        scores[k, : len(x)] = chain.scores(x)
    p, both = chain._expected(scores, real)
    for k, n in enumerate(sizes):
        paths = [[m >> j & 1 for j in range(n)] for m in range(1 << n)]
        weight = np.array([np.exp(sum(scores[k, j, y] for j, y in enumerate(path)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        weight /= weight.sum()
        for j in range(n):
            assert abs(p[k, j, 1] - sum(w for w, path in zip(weight, paths) if path[j])) < 1e-9
            if j:
                assert abs(both[k, j - 1, 1, 0] - sum(w for w, path in zip(weight, paths) if path[j - 1] and not path[j])) < 1e-9


def test_long_sequences_teach_rare_moves():
    """A move that comes once in forty lines is seen wherever it falls."""
    y = np.repeat([1, 0, 1], [25, 40, 25])
    x = np.zeros((len(y), L.FEATURES), np.int64)
    x[:, 0] = y
    chain = L.LineChain().fit([x] * 8, [y] * 8, chain=True)
    assert chain.move[0, 0] + chain.move[1, 1] > chain.move[0, 1] + chain.move[1, 0] and (chain.decode(x) == y).all()


def test_notices_in_long_lines_count():
    text = ("word " * 200 + "copyright subscribe").encode()
    assert L.line_features(text)[1][0, 9] > 0 and L.line_features(b"word " * 200)[1][0, 9] == 0


def test_boilerplate_share_decides(spark):
    rng, rows, marks = random.Random(4), [], []
    for k in range(240):
        good = k % 3 > 0
        body = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(25)).capitalize() + "." for _ in range(4)]
        junk = [" | ".join(f"w{rng.randint(0, 900)}" for _ in range(12)) for _ in range(8)]
        rows.append((k, "\n".join(body if good else body[:1] + junk), "en", "s", 1))
        marks.append((k, int(good), 0))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks[:160], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in L.judge_documents(docs, L.fit_chain(docs, labels)).collect()}
    assert all(got[k]["kept"] == bool(g) for k, g, _ in marks)
    assert all(0 < got[k]["content_lines"] < got[k]["n_lines"] for k, g, _ in marks if not g)  # the line of prose is told from the rest


def test_judge_odd_documents(spark, odd_docs, odd_rows, wide_docs, no_docs, labels):
    rows = L.judge_documents(odd_docs, L.fit_chain(odd_docs, labels)).collect()
    want = sorted((str(r[0]), *base(r[1])) for r in odd_rows)
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    all_ = L.judge_documents(odd_docs, L.fit_chain(odd_docs, empty)).collect()
    assert all(r["kept"] != r["base_failed"] for r in all_)
    assert L.kept_documents(wide_docs, labels).columns == wide_docs.columns and L.kept_documents(no_docs, labels).count() == 0


# --- op8


def filled(sizes, weights):
    """Targets by repeated resharing."""
    total, open_, target = sum(sizes), dict(enumerate(sizes)), {}
    while open_:
        left = total - sum(target.values())
        share = sum(weights[k] for k in open_)
        over = [k for k in open_ if 3 * sizes[k] <= left * weights[k] / share + 1e-9]
        if not over:
            target |= {k: left * weights[k] / share for k in open_}
            break
        for k in over:
            target[k] = 3.0 * open_.pop(k)
    return [target[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 100, 1000, 3], [10_000, 1, 1, 1, 1], [7], [1, 0, 50], [3, 30, 300, 3000, 30_000]])
def test_targets(spark, sizes):
    rows = X.source_targets(spark.createDataFrame([(f"0{k}", n) for k, n in enumerate(sizes)], "sk string, source_size long")).orderBy("sk").collect()
    weights = [k % 3 + 1 for k in range(len(sizes))]
    assert [r["weight"] for r in rows] == weights
    assert [r["target"] for r in rows] == pytest.approx(filled(sizes, weights))
    assert sum(r["target"] for r in rows) == pytest.approx(sum(sizes))


@pytest.mark.parametrize("sizes,blocks", [((50, 400, 37, 1000, 8), 160), ((1, 1, 1, 1), 7), ((3, 30, 300, 3000, 30_000), 1000), (tuple(range(1, 60)), 333), ((10, 1_000_000), 4096)])
def test_quotas_are_sainte_lague(spark, sizes, blocks):
    targets = X.source_targets(spark.createDataFrame([(f"0{k:03}", n) for k, n in enumerate(sizes)], "sk string, source_size long")).withColumn("blocks", F.lit(blocks).cast("long"))
    t, won, dealt = {r["sk"]: r["target"] for r in targets.collect()}, collections.Counter(), collections.Counter()
    for seat in range(blocks):  # one seat after the other to the highest quotient
        best = max(t, key=lambda s: (t[s] / (2 * won[s] + 1), -int(s)))
        won[best] += 1
        dealt[sum((j + 1) * blocks // 8 <= seat for j in range(8)), best] += 1
    quotas = X.shard_quotas(targets, 8).collect()
    assert {(r["shard"], r["sk"]): r["quota"] for r in quotas if r["quota"]} == dict(dealt)
    assert all(r["upto"] == sum(dealt[j, r["sk"]] for j in range(r["shard"] + 1)) for r in quotas)


def test_mix(spark, odd_docs, odd_rows, wide_docs, no_docs):
    rows = X.mix_sources(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    sizes = collections.Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = dict(zip(order, filled([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))])))
    by_id = {r[0]: r[3] for r in odd_rows if r[0] is not None}
    taken, total = collections.Counter(), sum(sizes.values())
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[by_id[r["doc_id"]]] and r["target"] == pytest.approx(target[by_id[r["doc_id"]]])
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    want = collections.Counter()
    for s in order:
        want[round(target[s], 6), sizes[s]] += target[s]
    assert all(abs(taken[k] - want[k]) <= max(2, want[k] / 16) for k in want)
    say = lambda rows: sorted(map(str, rows))
    assert say(rows) == say(X.mix_sources(odd_docs.repartition(5)).collect())
    assert X.mix_sources(no_docs).count() == 0
    mixed = X.mixed_documents(wide_docs)
    assert mixed.columns == wide_docs.columns and mixed.count() > 0 and X.mixed_documents(no_docs).count() == 0


def test_mix_matches_sql(spark, odd_rows):
    con = duckdb.connect()
    frame = pd.DataFrame(odd_rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})
    con.register("documents", frame)
    found = con.execute(X.oracle())
    names = [c[0] for c in found.description]
    got = X.mix_sources(spark.createDataFrame(odd_rows, SCHEMA)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))
    few = pd.DataFrame({"doc_id": range(300), "text": ["w " * (k % 40) for k in range(300)], "source": [None if k % 7 == 0 else f"s{k % 5 ** (k % 3)}" for k in range(300)]})
    con.register("documents", few)
    for settings in ({"blocks": 50, "shards": 3}, {"blocks": 7, "shards": 5}, {"blocks": 10_000, "shards": 16}):
        got = X.mix_sources(spark.createDataFrame(few), **settings).select(*names).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(X.oracle(**settings)).fetchall()))


def test_small_sources_reach_their_targets(spark):
    small = [(k, "w " * 3, f"a{k}") for k in range(5)] + [(10, "w " * 30, "b")] + [(100 + k, "w " * 5000, f"c{k % 2}") for k in range(40)]
    tiny = [(1, "ten words " * 5, "a")] + [(100 + k, "w " * 10_000, "b") for k in range(100)]  # 10 words beside a million
    like = [(k, "w " * 10, f"s{k:05}") for k in range(9000)]
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["shard"]) for r in X.mix_sources(blank).collect()] == [(0, None)] * 2
    for rows in (small, tiny, like):
        taken, target = collections.Counter(), {}
        for r in X.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("source",)).collect():
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["_row"]["source"]] += r["taken"]
            target[r["_row"]["source"]] = r["target"]
        assert all(abs(taken[s] - t) <= max(1, t / 16) for s, t in target.items())
        assert abs(sum(taken.values()) - sum(target.values())) <= 0.01 * sum(target.values())
    assert target and taken


def test_runs_are_spread_and_seeded(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "abc"[k % 10 // 4]) for k in range(3000)], "doc_id long, text string, source string")
    one, two = ({r["doc_id"]: r["taken"] for r in X.mix_sources(docs, seed=s).collect()} for s in ("mix", "other"))
    assert one != two
    cut = [r for r in X.mix_sources(docs).collect() if r["extra"] not in (0, r["size"])]
    assert 0 < len(cut) <= 2 * 3000 // 64
    shards = collections.Counter(r["shard"] for r in X.mix_sources(docs).collect() if r["shard"] is not None)
    assert set(shards) == set(range(16))


def test_mix_runs_no_python(odd_docs):
    plan = X.mix_sources(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
