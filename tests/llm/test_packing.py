import collections
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from lumenary.llm import conflict_pack as C, token_pack as T


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_fit_decreasing_is_best_fit(sizes):
    rows = T.fit_decreasing(sizes, 64)
    room, want = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in room if r >= sizes[k]]
        best = min(fits, default=64)
        if fits:
            room.remove(best)
        room.append(best - sizes[k])
        want[k] = best
    fill = collections.Counter()
    for k, r in enumerate(rows):
        fill[r] += sizes[k]
    assert max(fill.values(), default=0) <= 64 and sorted(64 - v for v in fill.values()) == sorted(room)


def test_segment_tree():
    rng, tree, held = random.Random(1), T.RoomTree(100), collections.Counter()
    for _ in range(2000):
        r = rng.randint(0, 100)
        if held[r] and rng.random() < 0.5:
            tree.add(r, -1)
            held[r] -= 1
        else:
            tree.add(r, 1)
            held[r] += 1
        q = rng.randint(0, 100)
        assert tree.least(q) == min((x for x, n in held.items() if n and x >= q), default=None)


def test_encoder_equals_the_library():
    e = T.Encoder()
    for text in ("", " ", "a  b", "a   b ", " a", "a \nb", "a \n b", "\n a\n", "it's 12 o'clock!! é à", "x  y", "tab\t z", "a \n", "<|endoftext|> z"):
        assert e.encode(text).tolist() == e.whole(text), text


def test_pieces_come_back(odd_docs, odd_rows, no_docs, wide_docs, tmp_path):
    """Every row of the table, with its repeated and null ids."""
    e, folder = T.Encoder(), f"file://{tmp_path}/ids"
    rows = T.pack_tokens(odd_docs.repartition(3), length=256, window=4000, matrices=folder).collect()
    names = T.NAMES[1:]
    found = T.unpack([[r[n] for n in names] for r in rows])
    say = lambda pairs: sorted((str(i), ids) for i, ids in pairs)
    assert say((i, v.tolist()) for i, v in found.values()) == say((r[0], [*e.whole(r[1] or ""), T.END]) for r in odd_rows)
    assert len(found) == len(odd_rows) and len({r["row_id"] for r in rows}) == len(rows)
    for r in rows:
        assert len(r["ids"]) == 512 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256 and r["resets"] == r["cu_seqlens"][:-1]
        at = T.positions(r["cu_seqlens"], 256)
        assert all(at[k] == 0 for k in r["resets"]) and (np.diff(at) <= 1).all()
    # the files say the same
    held = {stem: T.read_matrices(stem, 256) for stem in {r["file"] for r in rows}}
    for r in rows:
        ids, cu_seqlens, resets = held[r["file"]]
        k = r["file_row"]
        assert ids[k].astype("<u2").tobytes() == r["ids"] and cu_seqlens[k].tolist() == r["cu_seqlens"] and resets[k].tolist() == r["resets"]
    assert sum(len(ids) for ids, _, _ in held.values()) == len(rows)
    assert T.pack_tokens(no_docs, matrices=folder).count() == 0 and T.pack_tokens(wide_docs).count() > 0


def test_few_rows_are_wasted(spark, sf_dir):
    rows = T.op2_token_pack(spark, sf_dir).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert len(rows) <= total / T.LENGTH * 1.02 + 8


def tightest(cut, capacity, slots):
    """Best fit with conflicts, by looking at every bin."""
    bins = []
    for units, source, cluster in cut:
        ok = [b for b in bins if b[0] >= units and b[1][source] < slots and cluster not in b[2]]
        if not ok:
            bins.append(b := [capacity, collections.Counter(), set()])
        else:
            b = min(ok, key=lambda b: b[0])
        b[0] -= units
        b[1][source] += 1
        b[2].add(cluster)
    return sorted(b[0] for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3), st.integers(0, 6)), max_size=60), st.integers(1, 3))
def test_bins_respect_conflicts(items, slots):
    docs = [(k, *x) for k, x in enumerate(items)]
    rows = C.pack_window(docs, 32, slots)
    assert sum(r[4] for r in rows) == sum(x[0] for x in items)
    fill, sources, clusters = collections.Counter(), collections.Counter(), collections.Counter()
    for _, _, _, _, units, source, cluster, b, offset in rows:
        assert offset == fill[b]
        fill[b] += units
        sources[b, source] += 1
        clusters[b, cluster] += 1
    assert max(fill.values(), default=0) <= 32 and max(sources.values(), default=0) <= slots and max(clusters.values(), default=0) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
def test_without_conflicts_it_is_best_fit(sizes):
    rows = C.pack_window([(k, n, k, k) for k, n in enumerate(sizes)], 32)
    fill = collections.Counter()
    for r in rows:
        fill[r[7]] += r[4]
    assert sorted(32 - v for v in fill.values()) == tightest([(n, k, k) for k, n in enumerate(sorted(sizes, reverse=True))], 32, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(0, 2), st.integers(0, 5)), min_size=1, max_size=50), st.integers(1, 3))
def test_with_conflicts_it_is_the_tightest_compatible_bin(items, slots):
    """Each piece, in decreasing order: of all bins that can take it, one with the least room, or a new bin if none can."""
    rows = C.pack_window([(k, *x) for k, x in enumerate(items)], 32, slots)
    room, sources, clusters = {}, collections.Counter(), set()
    for _, _, _, _, units, source, cluster, b, _ in rows:
        fit = [room[x] for x in room if room[x] >= units and sources[x, source] < slots and (x, cluster) not in clusters]
        assert (b in room) == bool(fit) and (not fit or room[b] == min(fit))
        room[b] = room.get(b, 32) - units
        sources[b, source] += 1
        clusters.add((b, cluster))
    assert [r[4] for r in rows] == sorted((x[0] for x in items), reverse=True)


def test_hot_clusters_are_packed_like_others():
    """With groups of copies large enough for the dense bitmap, next to small ones."""
    rng = random.Random(6)
    items = [(rng.randint(1, 20), rng.choice("ab"), rng.choice(["hot", "warm", *map(str, range(40))])) for _ in range(400)]
    rows = C.pack_window([(k, *x) for k, x in enumerate(items)], 32, 2)
    cut = sorted(((u, s, c) for u, s, c in items), key=lambda x: -x[0])
    assert len({r[7] for r in rows}) <= len(tightest(cut, 32, 2)) * 1.03


def test_pack_odd_rows(odd_docs, odd_rows, no_docs, wide_docs):
    rows = C.pack(odd_docs, capacity=256).collect()
    assert sum(r["units"] for r in rows) == sum(len((r[1] or "").encode().split()) + 1 for r in odd_rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["bin_id"]].append(r)
    for own in by.values():
        assert sum(r["units"] for r in own) <= 256 and len({r["cluster"] for r in own}) == len(own)
        assert max(collections.Counter(r["source"] for r in own).values()) <= C.SLOTS
    assert C.pack(no_docs).count() == 0
    named = C.pack(wide_docs, capacity=256, cluster="cluster").collect()  # one cluster: a piece for each bin
    assert len({r["bin_id"] for r in named}) == len(named)


def test_large_group_of_copies_is_fast():
    rows = C.pack_window([(k, 5, "s", "copy") for k in range(20_000)] + [(20_000 + k, 3, f"t{k % 9}", k) for k in range(20_000)], 64)
    assert len({r[7] for r in rows if r[6] == "copy"}) == 20_000
