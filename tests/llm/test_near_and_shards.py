import collections
import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lumenary.llm import feistel_shards as S, media_shards as M, simhash_dedup as D


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, bits=4):
    """Smallest index reachable over links of fingerprints."""
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_cover():
    assert len(D.covering()) == 20 and all(any(set(t) <= set(four) for t in D.covering()) for four in combinations(range(8), 4))


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("é x"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("é x", 42)


def test_near_duplicates(odd_docs, odd_rows, no_docs, wide_docs):
    prints = [fingerprint(r[1]) for r in odd_rows]
    root = roots(prints)
    least = collections.defaultdict(list)
    for r, k in zip(odd_rows, root):
        least[k] += [r[0]] if r[0] is not None else []
    want = sorted((str(r[0]), f"{p:016x}", str(min(least[k], default=None))) for r, p, k in zip(odd_rows, prints, root))
    for docs in (odd_docs, wide_docs):
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in D.near_duplicates(docs).collect())
        assert got == want
    assert D.near_duplicates(no_docs).count() == 0


def shingles(text):
    """The five-word shingles of a text, the whole sequence if it has fewer words."""
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def similar_roots(texts, similarity=0.8):
    """Smallest index reachable over pairs of that Jaccard similarity, by looking at every pair."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("block_sets", [4096, 3])
def test_near_unique(odd_rows, no_docs, wide_docs, block_sets):
    root = similar_roots([r[1] for r in odd_rows])
    least = collections.defaultdict(list)
    for r, k in zip(odd_rows, root):
        least[k] += [r[0]] if r[0] is not None else []
    kept = D.near_unique(wide_docs, block_sets=block_sets)
    assert kept.columns == wide_docs.columns and D.near_unique(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(least[k], default=None)) for k in set(root))


@pytest.mark.parametrize("block_sets", [4096, 40, 7])
def test_large_groups_of_near_copies(spark, block_sets):
    """A group whose members are near some others only, and one line that all documents share: whole or cut into blocks, as brute force says."""
    rng, rows = random.Random(11), []
    base, line = [f"b{k}" for k in range(120)], [f"line{k}" for k in range(12)]
    for k in range(160):
        text = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            text[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(text + line)))
    rows += [(k, " ".join([f"o{rng.randint(0, 10**6)}" for _ in range(90)] + line)) for k in range(60)]
    rows += [(5000, rows[7][1]), (5001, rows[7][1])]
    root = similar_roots([t for _, t in rows])
    assert 3 < len({r for r, (i, _) in zip(root, rows) if i >= 1000}) < 160
    want = sorted(min(i for r, (i, _) in zip(root, rows) if r == x) for x in set(root))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.near_unique(docs, block_sets=block_sets).collect()) == want


def test_parts_and_pairs_of_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(70):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(own))
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    links = {(i, j) for i, j in combinations(range(70), 2) if near(sets[i], sets[j])}

    def joined(pairs):
        part = list(range(70))
        for _ in range(70):
            for i, j in pairs:
                part[i] = part[j] = min(part[i], part[j])
        return part

    assert D._similar_parts(sets, 0.8).tolist() == joined(links)
    assert joined(D._similar_pairs(sets, 30, 0.8)) == joined({(i, j) for i, j in links if i < 30 <= j})


def jaccard(a, b):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_are_caught_and_others_left(spark):
    rng, rows = random.Random(6), []
    for k in range(60):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(text)))
        for c in range(1, 4):  # c words changed: similarity 0.95, 0.9, 0.86
            other = list(text)
            for at in rng.sample(range(len(other)), c):
                other[at] = f"x{rng.randint(0, 5000)}"
            rows.append((10 * k + c, " ".join(other)))
        half = text[:100] + [f"y{rng.randint(0, 5000)}" for _ in range(100)]
        rows.append((10 * k + 9, " ".join(half)))
    kept = {r["doc_id"] for r in D.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert {10 * k for k in range(60)} | {10 * k + 9 for k in range(60)} <= kept
    assert not [d for d in kept if d % 10 in (1, 2, 3) and jaccard(texts[d], texts[d - d % 10]) >= 0.8]


def test_similarity_from_0_8_is_exact(spark):
    """Against brute-force Jaccard: pairs just above and below 0.8, with a repeated line and a line that all texts share."""
    rng, rows, shared = random.Random(7), [], [f"s{k}" for k in range(8)]
    word = lambda: f"w{rng.randint(0, 50000)}"
    for k in range(150):
        text = [*shared, *(word() for _ in range(200))]
        other = list(text)
        for at in rng.sample(range(10, 205), 1 + k % 6):
            other[at] = word()
        rows += [(2 * k, " ".join(text + text[20:40] * (k % 5 == 0) * 30)), (2 * k + 1, " ".join(other))]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    near = {2 * k + 1 for k in range(150) if len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= 0.8}
    assert 60 < len(near) < 130
    kept = {r["doc_id"] for r in D.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(300)) - near


def test_a_long_posting_gives_a_spanning_forest():
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, (3, D.WIDE)).astype(np.uint64)
    prints = np.concatenate([s ^ np.concatenate([np.zeros((1, D.WIDE), np.uint64), np.uint64(1) << rng.integers(0, 64, (200, D.WIDE)).astype(np.uint64)]) for s in seeds])
    edges = D._wide_run(prints, 41)
    assert sorted(len(a) for a, _ in edges) == [200, 200, 200] and all((b == b[0]).all() for _, b in edges)


def test_postings_that_share_bytes_are_split_to_the_pair():
    """Distinct fingerprints that share four bytes and more, in a posting far longer than is searched pair by pair."""
    rng = random.Random(12)
    fps = {rng.getrandbits(64) & 0xFFFFFFFF | 0xABCDEF01 << 32 for _ in range(300)}
    for x in sorted(fps)[:150]:
        for _ in range(2):
            y = x
            for b in range(4):  # one bit in each of the other bytes, or a few anywhere
                y ^= 1 << (8 * b + rng.randrange(8) if rng.random() < 0.7 else rng.randrange(32))
            fps.add(y)
    prints = sorted(fps)
    root = roots(prints)
    for long in (4096, 60, 16):
        part = list(range(len(prints)))
        place = {x: k for k, x in enumerate(prints)}
        pairs = [(place[int(a)], place[int(b)]) for x in D.posting_links(np.array(prints, np.uint64), long=long) for a, b in zip(*x)]
        for _ in range(12):
            for a, b in pairs:
                part[a] = part[b] = min(part[a], part[b])
        assert part == root and all((prints[a] ^ prints[b]).bit_count() <= 4 or root[a] == root[b] for a, b in pairs)
    assert len(D._masks((0, 1, 2, 3), 4)) == 4096 and len(D._masks((5,), 4)) == 8 + 28 + 56 + 70


def test_a_posting_of_many_is_searched_in_time():
    """All fingerprints share four bytes; most have no partner."""
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**32, 30_000).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:100] ^ np.uint64(0x01020408)]))
    found = {frozenset(p) for a, b in D.posting_links(fps) for p in zip(a.tolist(), b.tolist())}
    assert sum((a ^ b) == 0x01020408 for a, b in map(tuple, found)) >= 95


@pytest.mark.parametrize("long,count", [(4096, 300), (20, 300)])
def test_links_of_dense_and_far_groups(spark, long, count, monkeypatch):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(count // 12):
            x = seed
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    root = roots(prints)
    rows = spark.createDataFrame([(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(prints)], "doc_id long, fp long")
    edges = D.links(rows.select("fp"), long=long).collect()
    assert len(edges) <= 40 * len(prints)  # a forest for each posting, or each of its parts
    alike = collections.defaultdict(set)
    for k, x in zip(root, prints):
        alike[k].add(x)
    assert all(any({a % 2**64, b % 2**64} <= own for own in alike.values()) for a, b in edges)
    monkeypatch.setattr(D, "LONG", long)
    monkeypatch.setattr(D.links, "__defaults__", (D.BITS, long))
    got = {r["doc_id"]: r["component_id"] for r in rows.join(D.near_groups(rows), "fp").collect()}
    assert got == dict(enumerate(root))
    found = D.components(D.links(rows.select("fp"), long=long)).collect()
    part = collections.defaultdict(set)
    for r in found:
        part[r["root"]].add(r["node"] % 2**64)
    want = collections.defaultdict(set)
    for k, x in enumerate(prints):
        want[root[k]].add(x)
    assert sorted(map(sorted, part.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in D.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_components_take_few_rounds(spark, monkeypatch, at_once):
    """Paths in any order: tasks join what they read, so that few tables are written, and the parts are the same however much they join at once."""
    rng, paths, write = random.Random(3), [], D.shared_path
    monkeypatch.setattr(D, "LINKS", at_once)
    monkeypatch.setattr(D, "shared_path", lambda s, tag: paths.append(tag) or write(s, tag))
    chains = [rng.sample(range(1000 * k, 1000 * k + 1000), 60) for k in range(-3, 4)]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    rng.shuffle(edges)
    found = D.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: min(c) for c in chains for x in c} and len(found) == 420
    assert at_once == 40 or len(paths) <= 3



@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 65537])
def test_feistel(n):
    net = S.Feistel(n)
    place = net.place_of(np.arange(n))
    assert sorted(place) == list(range(n)) and (net.row_of(place) == np.arange(n)).all()
    assert n < 1000 or (place != np.arange(n)).mean() > 0.9
    assert n < 1000 or (S.Feistel(n, "other").place_of(np.arange(n)) != place).mean() > 0.9


def test_shards(odd_docs, odd_rows, no_docs, wide_docs):
    for docs in (odd_docs, wide_docs):
        rows = S.shard_rows(docs).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert sorted(r["row"] for r in rows) == list(range(len(odd_rows)))
        net = S.Feistel(len(rows))
        assert all(net.place_of([r["row"]])[0] == 16 * r["slot"] + r["shard"] for r in rows)
        want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
        ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row"])]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert S.shard_rows(no_docs).count() == 0
    assert sorted(map(tuple, S.shard_rows(odd_docs.repartition(7)).collect()), key=str) == sorted(map(tuple, S.shard_rows(odd_docs).collect()), key=str)


def test_ranges_grow_with_rows(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 3)
    few = sorted(map(tuple, S.shard_rows(odd_docs).collect()), key=str)
    monkeypatch.setattr(S, "RANGE_ROWS", 5)
    assert sorted(map(tuple, S.shard_rows(odd_docs).collect()), key=str) == few and len(few) == len(odd_rows)


def test_shards_of_one_frequent_id(spark):
    docs = spark.createDataFrame([(7, f"t{k}") for k in range(600)] + [(k, "x") for k in range(50)], "doc_id long, text string")
    rows = S.shard_rows(docs).collect()
    assert sorted(r["row"] for r in rows) == list(range(650)) and max(collections.Counter(r["shard"] for r in rows).values()) == 41


def test_media_round_trip(spark, odd_rows, no_docs, wide_docs, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, r[1]) for k, r in enumerate(odd_rows)], "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("payload"))
    index = M.materialize(M.store_payloads(docs.coalesce(2), str(tmp_path / "tar"), limit=20_000), "media")
    rows = M.read_back(M.media_columns(index)).collect()
    reader = M.ShardReader()
    for r in rows:
        raw = (odd_rows[r["doc_id"]][1] or "").encode()
        data = M.pad(raw)
        assert len(data) % 192 == 0 and len(data) >= max(192, len(raw)) and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(data) == 192 * r["height"]
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-16:]) and (r["width"], r["depth"]) == (192, 8)
        member = reader.read(r["shard"], r["offset"], r["length"])
        assert hashlib.sha256(member).hexdigest() == r["media_sha256"] == r["digest"] and M.from_png(member) == data and len(member) == r["media_bytes"]
    import tarfile

    members = collections.Counter()
    shards = list((tmp_path / "tar").glob("*.tar"))
    for shard in shards:
        with tarfile.open(shard) as t:
            for m in t:
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() == m.name
                members[m.name] += 1
    assert len(shards) > 2 and set(members) == {r["digest"] for r in rows} and max(members.values()) <= 2
    equal = collections.defaultdict(set)
    for r in rows:
        equal[odd_rows[r["doc_id"]][1] or ""].add((r["digest"], r["picture_feature"], r["length"]))
    assert all(len(v) == 1 for v in equal.values())
    none = M.store_payloads(no_docs.select("doc_id", F.col("text").cast("binary").alias("payload")), str(tmp_path / "none"))
    assert M.read_back(M.media_columns(none)).count() == 0
    wide = M.store_payloads(wide_docs.select("*", F.col("text").cast("binary").alias("payload")), str(tmp_path / "wide"))
    assert wide.count() == len(odd_rows)
    with pytest.raises(ValueError):
        M.png_header(b"x" * 33)
    with pytest.raises(ValueError):
        M.from_png(member[:45] + bytes([member[45] ^ 1]) + member[46:])


def test_a_task_may_run_twice(spark, tmp_path):
    """Both attempts write shards of their own; each index points into its own, and all is whole."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("payload")).coalesce(1)
    stored, reader = M.store_payloads(docs, f"file://{tmp_path}/tar"), M.ShardReader()
    one, two = stored.collect(), stored.collect()
    assert {r["shard"] for r in one}.isdisjoint(r["shard"] for r in two) and len(list((tmp_path / "tar").iterdir())) == 2
    for r in (*one, *two):
        assert M.from_png(reader.read(r["shard"], r["offset"], r["length"])) == M.pad(f"text {r['doc_id'] % 5}".encode())
    assert [r["digest"] for r in one] == [r["digest"] for r in two] and len({r["offset"] for r in one}) == 5


def test_the_shared_folder_must_be_set_on_a_cluster():
    from lumenary.llm import common

    class Session:
        conf = type("C", (), {"get": lambda self, k, d: d})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": lambda self: type("X", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_header_reads_touch_only_the_header(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("payload"))
    index = M.store_payloads(docs, str(tmp_path)).collect()[0]
    reader = M.ShardReader()
    read = reader.read
    monkeypatch.setattr(reader, "read", lambda s, o, n: seen.append(n) or read(s, o, n))
    assert M.png_header(reader.read(index["shard"], index["offset"], M.HEADER)) == (192, 1, 8) and seen == [33]


def test_near_copies_are_found_by_shared_bytes_and_posted_once(spark, monkeypatch):
    """The pipeline's stage asks the byte-position index for near copies, and what it joins is one entry of each posting of shingles."""
    rng = random.Random(21)
    text = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(k, " ".join([*text[:k], f"new{k}", *text[k + 1 :]])) for k in range(1, 200, 10)] + [(1000 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for k in range(20)]
    joined, packed, index, pack = [], [], D.links, D.wide_links
    monkeypatch.setattr(D, "links", lambda distinct, *more: joined.append(index(distinct, *more)) or joined[-1])
    monkeypatch.setattr(D, "wide_links", lambda distinct, *more: packed.append(distinct) or pack(distinct, *more))
    kept = D.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, *range(1000, 1020)]
    assert len(joined) == 1 and joined[0].count() > 0
    near = collections.Counter(r["near"] for r in packed[0].select("near").collect())
    assert max(near.values()) > 15 and sorted(near.values())[:-1].count(1) >= 20


@pytest.mark.parametrize("many", [1, 5])
def test_blocks_of_postings_against_every_pair(many):
    """Entries of several sets, repeated prints, postings of one to hundreds: what the blocks' links join is what all pairs in a posting do."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (60, D.WIDE)).astype(np.uint64)
    prints = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (6, D.WIDE)).astype(np.uint64)) * rng.integers(0, 2, (6, 1)).astype(np.uint64) for c in centres])
    near = np.sort(rng.integers(0, 3, (60, 6)) + 3 * np.arange(60)[:, None]).reshape(-1)
    own = [np.unique(np.concatenate([rng.integers(0, 400, rng.integers(0, 9)), np.full(int(k % 3 == 0), 7)])).astype(np.uint64) for k in range(len(prints))]
    blocks, cuts = collections.defaultdict(list), (0, 100, 101, len(prints))
    for a, b in zip(cuts, cuts[1:]):
        for bucket, *block in D.posting_block(near[a:b], prints[a:b], np.array([len(x) for x in own[a:b]]), np.concatenate(own[a:b]), many):
            blocks[bucket].append(block)
    ids = D._print_ids(prints).tolist()

    def parts(pairs):
        root = {x: x for x in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in [*pairs, *((x, y) for (x, p), (y, q) in combinations(zip(ids, near.tolist()), 2) if p == q)]:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(x) for x in ids]

    found = [(a, b) for x in blocks.values() for a, b in zip(*map(np.ndarray.tolist, D.bucket_links(x, 8)))]
    labels = [*zip(near.tolist(), np.searchsorted(cuts, np.arange(len(near)), "right").tolist())]
    held = collections.defaultdict(set)  # an entry is posted under all its members' shingles
    for label, x in zip(labels, own):
        held[label] |= set(x.tolist())
    want = [(ids[i], ids[j]) for i, j in combinations(range(len(ids)), 2) if held[labels[i]] & held[labels[j]] and D._near(prints[i] ^ prints[j], 8)]
    assert len(blocks) == many and parts(found) == parts(want) and 60 < len(set(parts(want))) < len(set(near.tolist()))


def test_links_of_blocks_do_not_multiply():
    """A pair is found where it begins to share postings, not in every bucket; a group gives links fewer than its sets, not all pairs; one `near` gives none."""
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 2**63, D.WIDE).astype(np.uint64)

    def found(near, own):
        prints = centre ^ np.arange(len(near), dtype=np.uint64)[:, None] * np.array([1, 0, 0, 0], np.uint64)
        blocks = collections.defaultdict(list)
        for bucket, *block in D.posting_block(np.array(near), prints, np.array([len(x) for x in own]), np.concatenate(own), 50):
            blocks[bucket].append(block)
        return [tuple(sorted(x)) for b in blocks.values() for x in zip(*map(np.ndarray.tolist, D.bucket_links(b, 8)))], D._print_ids(prints).tolist()

    same = np.sort(rng.integers(0, 2**63, 80).astype(np.uint64))
    links, ids = found([1, 2], [same, same])
    assert links == [tuple(sorted(ids))]
    links, ids = found([1, 2], [same, np.delete(same, 40)])  # two runs of shared postings
    assert set(links) == {tuple(sorted(ids))} and len(links) == 2
    for n in (30, 40):
        links, ids = found(list(range(n)), [same] * n)
        assert len(links) == n - 1 and {x for pair in links for x in pair} == set(ids)
    assert found([5] * 20, [same] * 20)[0] == []


def test_links_join_what_brute_force_joins():
    rng = np.random.default_rng(10)
    a, b = rng.integers(-(2**62), 2**62, 400)[rng.integers(0, 400, (2, 300))]
    root = {int(x): int(x) for x in [*a, *b]}
    for x, y in [*zip(a.tolist(), b.tolist())] * 400:
        root[x] = root[y] = min(root[x], root[y])
    member, top = D._forest(a, b)
    assert dict(zip(member.tolist(), top.tolist())) == {x: r for x, r in root.items() if x != r}


def test_frequent_shingles_are_counted_whole(spark):
    rows = [(k, f"a b c d e f own{k} x{k} y{k} z{k} v{k}") for k in range(30)]
    found = D.frequent_shingles(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert found.tolist() == sorted(D._shingle_hashes(b"a b c d e f", 5).tolist())
