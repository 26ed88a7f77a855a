import random

import numpy as np
import pytest
import xxhash

from inkspan.llm import simhash as sh


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def groups(values, radius):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    values = list(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    found = {}
    for v in values:
        found.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in found.values() if len(g) > 1}


def crowd(n, seed):
    rng, out = random.Random(seed), set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8])):
            v = base
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


def test_fingerprint():
    for t in ["", " \t", "one", "One two", "a b c d É é É", "x " * 9000, "a b", "A\x0bB c\xa0d e"]:
        assert int(sh.simhash(t)[0]) == brute(t) == int(sh.simhash(t, parts=3)[0]), t


def test_tree_finds_what_a_scan_finds():
    v = np.array(crowd(300, 1), np.uint64)[:, None]
    tree = sh.BKForest(v, np.zeros(len(v), np.int64))
    assert len(tree.kids) == len(v) - 1
    got = {(int(q), int(m)) for a, b in tree.search(v, np.zeros(len(v), np.int64), 3) for q, m in zip(a, b)}
    assert got == {(i, j) for i in range(len(v)) for j in range(len(v)) if (int(v[i, 0]) ^ int(v[j, 0])).bit_count() <= 3}


def check_links(spark, values, shard, tables=sh.exact_tables(1)):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v, [v]) for v in signed], "node long, fp array<long>")
    rows = sh.components(sh.links(df, 3, tables, shard)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.component, set()).add(r.node % (1 << 64))
    assert {frozenset(g) for g in found.values()} == groups(values, 3)


def test_links_equal_brute_force(spark, monkeypatch):
    values = crowd(250, 2)
    check_links(spark, values, 20000)
    # one block value shared by all: the shard is split, and batches cut its trees
    monkeypatch.setattr(sh, "BUFFER", 40)
    hot = sorted({(v & ~0xFFFF) | 0x1234 for v in values})
    check_links(spark, hot, 50)
    # a group of near copies of one value, and some strangers: what the pivot reaches is not compared again
    base = random.Random(4).getrandbits(64)
    close = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)} | set(hot[:40]))
    check_links(spark, close, 60)
    check_links(spark, values, 20000, sh.exact_tables(1 << 40))


def test_counts_of_bits():
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (0, 1, 71, 72, 73, 1000, 4097):
        h = rng.integers(0, 1 << 63, (3, n), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (3, n), dtype=np.uint64)
        want = [[sum(int(x) >> i & 1 for x in row) for i in range(64)] for row in h[:, :1000]]
        assert sh.bit_counts(h[:, :1000]).tolist() == want
        assert (sh.bit_counts(h) == np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1, bitorder="little").reshape(3, -1, 64).sum(axis=1, dtype=np.int64)).all()


def test_tables_are_exact_for_any_number_of_values():
    rng = random.Random(6)
    for n in (1, 10**8, 10**9, 10**11, 10**13):
        tables = sh.exact_tables(n)
        assert n <= (sh.SHARD // 8) << min(map(len, tables))
        for _ in range(200):
            apart = set(rng.sample(range(64), 3))
            assert any(not apart & set(t) for t in tables)


def jaccard_components(sets, least=0.8):
    """Components of the documents (id: set) whose sets have the similarity, every pair compared; and the similar pairs."""
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    order = sorted(sets)
    alike = lambda a, b: len(a & b) >= least * len(a | b) - 1e-9
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if alike(sets[a], sets[b])]
    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}, pairs


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def check_near(got, texts, recall):
    """Groups join only what exact links join, and hold nearly all exact links."""
    want, pairs = jaccard_components({d: shingles(t) for d, t in texts.items()})
    assert all(want[d] == want[c] and c <= d for d, c in got.items())  # no link below the similarity
    met = sum(got[a] == got[b] for a, b in pairs)
    assert met >= recall * len(pairs) and pairs, (met, len(pairs))


def edited(rng, words, base, share):
    own = list(base)
    for i in rng.sample(range(len(own)), max(1, int(share * len(own)))):
        own[i] = rng.choice(words)
    return own


def test_near_copies_by_similarity(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(60, 400))
        texts += [base, *(edited(rng, words, base, share) for share in (0.01, 0.02, 0.03, 0.04, 0.06, 0.12))]
    texts += [rng.choices(words[:9], k=400) for _ in range(6)] + [["la"] * n for n in (5, 6, 50)] + [["x"], ["x", "y"], ["X"], [], [" "]]
    texts = dict(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_groups(docs).collect()}
    check_near(got, texts, 0.95)
    assert {r.doc_id for r in sh.keep_one(docs).collect()} == {i for i in got if got[i] == i}


@pytest.mark.parametrize("shard", [sh.SHARD, 6])
def test_groups_around_the_threshold(spark, shard):
    """Copies of one text at distances around the threshold: candidates fail, and the groups meet through others."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    base = rng.choices(words, k=300)
    texts = {i: " ".join(edited(rng, words, base, 0.005 + 0.002 * (i % 12))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_near({r.doc_id: r.component_id for r in sh.similar_groups(docs, shard=shard).collect()}, texts, 0.97)


@pytest.mark.parametrize("every", [True, False])
def test_forest_pairs(every):
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    flips = lambda: (rng.random((12, 8)) < 0.5) * (np.uint64(1) << rng.integers(0, 63, (12, 8), dtype=np.uint64))
    values = np.concatenate([b ^ flips() for b in base])
    rng.shuffle(values)
    group, kind = np.repeat([3, 9], [50, 22]), np.arange(72) % 30
    a, b = sh.forest_pairs(values[:40], group[:40], kind[:40], values[40:50], group[40:50], kind[40:50], 8, every)
    c, d = sh.forest_pairs(values[50:], group[50:], kind[50:], values[:0], group[:0], kind[:0], 8, every)
    got = {(min(x, y), max(x, y)) for x, y in [*zip(a, b), *zip(c + 50, d + 50)]}
    far = lambda x, y: int(np.bitwise_count(values[x] ^ values[y]).sum())
    want = {(x, y) for x in range(72) for y in range(x + 1, 72) if group[x] == group[y] and kind[x] != kind[y] and far(x, y) <= 8 and not (40 <= x < 50 and 40 <= y < 50)}
    assert got <= want and want
    if every:
        assert got == want
    up = list(range(72))
    root = lambda x: x if up[x] == x else root(up[x])
    for x, y in got | {(x, y) for x in range(72) for y in range(x) if group[x] == group[y] and kind[x] == kind[y]}:
        up[root(x)] = root(y)
    assert all(root(x) == root(y) for x, y in want)


def test_pairs_come_once_and_connect(spark):
    """Of values that share many tables no pair is given twice, and what all pairs connect stays connected."""
    rng = random.Random(2)
    base = [rng.getrandbits(512) for _ in range(4)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(512), rng.choice([0, 3, 30, 70]))) for b in base for _ in range(40)})
    split = lambda v: [(x - (1 << 64) if x >> 63 else x) for x in ((v >> (64 * k)) & ((1 << 64) - 1) for k in range(8))]
    df = spark.createDataFrame([(i, i, split(v)) for i, v in enumerate(values)], "node long, class long, fp array<long>")
    tables = sh.drawn_tables(len(values))
    for shard, every in ((sh.SHARD, False), (sh.SHARD, True), (9, False), (9, True)):
        rows = sh._searched(sh._shards(df, sh.NEAR_RADIUS, tables, shard, every), lambda m, mg, mc, q, qg, qc, done, keep, every=every: sh.forest_pairs(m, mg, mc, q, qg, qc, sh.NEAR_RADIUS, every, done, keep), tables)
        got = [tuple(sorted(r)) for r in rows.collect()]
        assert every or shard == 9 or len(got) < 4 * len(values)
        near = {p for p in set(got) if (values[p[0]] ^ values[p[1]]).bit_count() <= sh.NEAR_RADIUS}
        assert near == set(got)
        found = {}
        for r in sh.components(sh.pairs_within(df, sh.NEAR_RADIUS, tables, shard, every)).collect():
            found.setdefault(r.component, set()).add(values[r.node])
        assert {frozenset(g) for g in found.values()} == groups(values, sh.NEAR_RADIUS)


def test_near_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, 1), (None, text + " more", 2), (None, text, 3), (4, "other words that stay here for now", 4), (4, "other words that stay here for now", 5), (7, None, 6), (6, "", 7)]
    kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark int")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(4, "other words that stay here for now"), (6, "")]
    assert len([r for r in kept if r.doc_id is None]) == 1
    assert sh.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_links_equal_brute_force(spark):
    rng = random.Random(12)
    values = []
    for _ in range(60):
        base = rng.getrandbits(512)
        for _ in range(rng.choice([1, 1, 2, 6])):
            v = base
            for i in rng.sample(range(512), rng.choice([0, 20, 60, 120])):
                v ^= 1 << i
            values.append(v)
    values = sorted(set(values))
    split = lambda v: [(x - (1 << 64) if x >> 63 else x) for x in ((v >> (64 * k)) & ((1 << 64) - 1) for k in range(8))]
    df = spark.createDataFrame([(i, split(v)) for i, v in enumerate(values)], "node long, fp array<long>")
    for shard in (20000, 5):
        found = {}
        for r in sh.components(sh.links(df, sh.NEAR_RADIUS, sh.drawn_tables(len(values)), shard)).collect():
            found.setdefault(r.component, set()).add(values[r.node])
        assert {frozenset(g) for g in found.values()} == groups(values, sh.NEAR_RADIUS)


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: brute(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for d, f in docs.items():
        by.setdefault(f, []).append(d)
    want = {d: min(by[f]) for d, f in docs.items()}
    for g in groups(list(by), 3):
        low = min(d for f in g for d in by[f])
        want.update({d: low for f in g for d in by[f]})
    got = sh.op2_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in docs.items()}


def test_defined_cases(spark):
    rows = [(3, None, 1), (1, " ", 1), (2, "a b c", 1), (2, "a b c", 1), (None, "q r s t", 1), (9, "Q R s T", 1)]
    got = {(r.doc_id, r.component_id) for r in sh.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    assert got == {(3, 1), (1, 1), (2, 2), (None, 9), (9, 9)}
    assert sh.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
