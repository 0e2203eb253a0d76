import collections
import math
import zlib

import numpy as np
import pytest
import xxhash

from lumenary.llm import ngram_trie as G
from lumenary.llm.elias_fano import EliasFano


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1, 100), (5, 5), (1000, 50), (1000, 10**6), (500, 500 * 65536), (300, 2**45)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n))
    e = EliasFano.of(EliasFano.build(v, universe).arrays())
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate([rng.integers(0, universe, 500), v, np.minimum(v + 1, universe - 1)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    at = np.searchsorted(v, q)
    there = at < n
    there[there] = v[at[there]] == q[there]
    assert (e.find(q) == np.where(there, at, -1)).all()
    if n >= 300:
        assert e.nbytes() * 8 / n < 8 + math.log2(max(2, universe / n))


def brute(rows):
    """Scores by dictionaries of n-gram counts, over all words."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [w for i, w in texts if not out_of(i)]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    flow = lambda w: ["<s>", "<s>", *w, "</s>"]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for w in train:
        s = flow(w)
        c1.update(s[2:])
        c2.update(zip(s[1:], s[2:]))
        c3.update(zip(s, s[1:], s[2:]))
    t2, s2, t3, s3 = (collections.Counter() for _ in range(4))
    for (a, _), k in c2.items():
        t2[a] += 1
        s2[a] += k
    for (a, b, _), k in c3.items():
        t3[a, b] += 1
        s3[a, b] += k
    q = lambda p: round(-math.log10(p) * G.STEP)
    d = G.DISCOUNT
    p1 = lambda x: (c1[x] + 1) / (n + v + 1)
    p2 = lambda b, x: (c2[b, x] - d) / s2[b] + d * t2[b] / s2[b] * p1(x)
    out = []
    for i, w in texts:
        s, total = flow(w), 0
        for a, b, x in zip(s, s[1:], s[2:]):
            if c3[a, b, x]:
                total += q((c3[a, b, x] - d) / s3[a, b] + d * t3[a, b] / s3[a, b] * p2(b, x))
                continue
            total += q(d * t3[a, b] / s3[a, b]) if s3[a, b] else 0
            total += q(p2(b, x)) if c2[b, x] else (q(d * t2[b] / s2[b]) if s2[b] else 0) + q(p1(x))
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in [*(c[x] for x in w), len(train)])
        out.append((i, out_of(i), len(w) + 1, sum(c[x] > 0 for x in w) + (len(train) > 0), n, base, -total / G.STEP))
    return out


def say(rows):
    return sorted((tuple("" if x is None else f"{x:.6f}" if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("size,shard_tokens,spread,heavy,sample", [(65_533, 2_000_000, 250_000, 32, 64), (40, 3_000, 500, 32, 1), (0, 500, 100, 2, 1), (300, 4_000, 20, 1, 1), (5, 200, 3, 10**9, 1)])
def test_scores_match_brute_force(odd_docs, odd_rows, size, shard_tokens, spread, heavy, sample):
    """Scores do not depend on the list of words, on shards, or on what counts as hot."""
    got = G.score_texts(odd_docs, size, shard_tokens, spread, heavy, sample).collect()
    assert say(map(tuple, got)) == say(brute([r[:2] for r in odd_rows]))


def test_small_blocks_and_hot_words(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_TOKENS", 700)
    got = G.score_texts(odd_docs.repartition(3), 200, 1_000, 300, 4, 1).collect()
    assert say(map(tuple, got)) == say(brute([r[:2] for r in odd_rows]))


def test_words_of_one_hash_are_listed(spark, monkeypatch):
    """Words whose hashes clash get numbers of the list, so scores are exact with hashes of one byte, too."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 700, 40))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(G, "hash_bytes", lambda n: 1)
    listed = set(G.Vocabulary.of(G.count_words(docs), 1, 1000).words)
    found = collections.defaultdict(set)
    for w in {w for k, t in rows for w in t.encode().split() if not G.held_out(k)}:
        found[xxhash.xxh64_intdigest(w, 42) & 255].add(w)
    assert all(own <= listed for own in found.values() if len(own) > 1) and any(len(own) == 1 and not own <= listed for own in found.values())
    seen = {w for k, t in rows for w in t.encode().split() if not G.held_out(k)}
    known = spark.createDataFrame([(k, " ".join(w for w in t.split() if w.encode() in seen)) for k, t in rows], "doc_id long, text string")
    assert say(map(tuple, G.score_texts(known, 1, 300, 20).collect())) == say(brute([tuple(r) for r in known.collect()]))


def test_tries_stay_in_a_given_folder(odd_docs, odd_rows, tmp_path):
    got = G.score_texts(odd_docs, 40, 3_000, 500, folder=f"file://{tmp_path}").collect()
    assert say(map(tuple, got)) == say(brute([r[:2] for r in odd_rows]))
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) > 3 and all(n.startswith("trie-") for n in names)
    trie = G.Trie.load(f"file://{tmp_path / names[0]}")
    assert trie.middle.n and G.Trie.load(str(tmp_path / names[0])).middle.n == trie.middle.n


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(50, dtype=np.uint64), rng.integers(0, 2**56, 30).astype(np.uint64) | G.RARE])
    v, u, w = (rng.choice(ids, 5000) for _ in range(3))
    order = np.lexsort((w, u, v))
    v, u, w, extra = v[order], u[order], w[order], rng.integers(0, 2**16, 5000).astype(np.uint16)
    for got, want in zip(G.decode(G.encode(u, v, w, extra, 7), 5000, np.uint16, 7), (u, v, w, extra)):
        assert (got == want).all()
    big = G.pack3(*(x % np.uint64(2**32) for x in (v, u, w)), 2**32)
    order = np.argsort(big, kind="stable")
    assert (order == np.lexsort((w % np.uint64(2**32), u % np.uint64(2**32), v % np.uint64(2**32)))).all()


def test_model_beats_the_base_on_held_out(spark, sf_dir):
    rows = [r for r in G.op1_ngram_trie(spark, sf_dir).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one(odd_rows):
    """The probabilities of all words and the rest after a context, before codes round them."""
    rows = [(0, t) for _, t, *_ in odd_rows if t and len(t) < 5000]
    flow = [x.encode().lower().split() for _, x in rows]
    names = {w: k + 2 for k, w in enumerate(sorted({x for f in flow for x in f}))}
    vocabulary = G.Vocabulary([(w, sum(f.count(w) for f in flow)) for w in names], [], len(rows), sum(map(len, flow)), len(names), 10**9)
    sequences = [np.array([0, 0, *(names[x] for x in f), 1], np.uint64) for f in flow]
    blocks = [(k, b, n, e, d) for s, k, b, n, e, d in G.block_rows(0, [0] * len(rows), [False] * len(rows), sequences, vocabulary, 1) if s >= 0]
    g = G.Grams(sorted(blocks), vocabulary)
    g.answer(*(np.zeros(len(g.questions(1)[0]), np.int64),) * 2, vocabulary)
    trie = G.Trie.build(g, (vocabulary.counts[g.ids.astype(np.int64)] + 1) / (vocabulary.tokens + vocabulary.distinct + 1))
    size = len(g.ids)
    for k in range(0, len(g.u), 997):
        p = 10.0 ** (-trie.query(np.full(size, g.u[k]), np.full(size, g.v[k]), np.arange(size)) / G.STEP)
        assert abs(p.sum() - 1) < 0.02


def test_empty_and_no_training(spark, no_docs, wide_docs, odd_rows):
    assert G.score_texts(no_docs).count() == 0
    held = next(k for k in range(1000) if G.held_out(k))
    row = G.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert G.score_texts(wide_docs).count() == len(odd_rows)


def test_tries_are_held_where_no_file_can_be_mapped(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(G, "local_path", lambda uri: None)
    monkeypatch.setattr(G, "open_store", lambda uri: pytest.fail("no store is needed"))
    assert say(map(tuple, G.score_texts(odd_docs, 40, 3_000, 500).collect())) == say(brute([r[:2] for r in odd_rows]))


@pytest.mark.parametrize(("universe", "many"), [(10, 5), (3, 4000), (1000, 3), (10**6, 5000), (2**40, 20_000), (2**62, 50), (2**61, 1), (1, 0)])
def test_sequences_against_a_sorted_array(universe, many):
    """Any width of low bits (over 57 they span nine bytes), repeated values, none at all."""
    rng = np.random.default_rng(universe % 1000 + many)
    values = np.sort(rng.integers(0, universe, many))
    asked = np.concatenate([values, rng.integers(0, universe, 2000), [0, universe - 1, universe]])
    held, place = EliasFano.build(values, universe), np.searchsorted(values, asked)
    assert (held.access(np.arange(many)) == values).all() and (held.successor(asked) == place).all()
    assert (held.find(asked) == np.where(np.isin(asked, values), place, -1)).all()


def test_a_search_reads_low_bits_once_where_runs_are_single(monkeypatch):
    values = np.arange(1000) * 64 + 5
    held, reads, low = EliasFano.build(values, 64_000), [], EliasFano._low
    assert held.bits >= 5
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: reads.append(len(i)) or low(self, i))
    assert (held.find(values) == np.arange(1000)).all() and sum(reads) == 1000
