import random

import numpy as np

from inkspan.llm import suffix_dedup as sd


def run(spark, path):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op7_suffix_dedup(spark, path).collect()}


def test_trie_and_order_agree_with_equality():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 60)
        strings = ["".join(rng.choices("ab", k=rng.choice([3, 40]))).encode().ljust(40, rng.choice([b"a", b"b"])) for _ in range(n)]
        trie = sd.BlindTrie()
        for i, t in enumerate(strings):
            trie.insert(t, i)
        assert [[strings[i] for i in leaf] for leaf in trie.leaves()] == [[t] * strings.count(t) for t in sorted(set(strings))]
        data = np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8)
        group = np.array([rng.randrange(2) for _ in strings])
        got = sd.deep_shallow(np.arange(n) * 40, group, data, 40)
        rank = {k: i for i, k in enumerate(sorted(set(zip(group.tolist(), strings))))}
        assert got.tolist() == [rank[k] for k in zip(group.tolist(), strings)]


def test_suffix_order_of_a_text():
    rng = random.Random(4)
    for text in (rng.choices(range(256), k=3000), [*rng.choices(b"ab", k=700)] * 3, [7] * 500):
        text = bytes(text)
        data = np.frombuffer(text + b"\0" * 120, np.uint8)
        got = sd.deep_shallow(np.arange(len(text)), np.zeros(len(text), np.int64), data, 100)
        padded = text + b"\0" * 100
        rank = {k: i for i, k in enumerate(sorted({padded[i : i + 100] for i in range(len(text))}))}
        assert got.tolist() == [rank[padded[i : i + 100]] for i in range(len(text))]


def test_a_context_seen_before_is_marked_only_when_later(monkeypatch):
    monkeypatch.setattr(sd, "SEEN", 3)
    rng, seen = random.Random(6), {}
    items = [(bytes([rng.randrange(5)]), rng.randrange(30), rng.randrange(3)) for _ in range(400)]
    again = sd.seen_again(seen, (k for k, _, _ in items), np.array([d for _, d, _ in items]), np.array([p for _, _, p in items]))
    assert len(seen) <= 3 and again.any()
    for i, (k, d, p) in enumerate(items):
        if again[i]:
            assert any(items[j][0] == k and items[j][1:] < (d, p) and not again[j] for j in range(i))
    least = {k: min(x[1:] for x in items if x[0] == k) for k, _, _ in items}
    assert all(not again[i] for i, (k, *at) in enumerate(items) if tuple(at) == least[k])


def test_every_window_has_one_anchor_set_by_content():
    rng = random.Random(2)
    for text in (rng.randbytes(1000), b"ab" * 300, b"a" * 400, b"x y z " * 100 + rng.randbytes(50)):
        of = {}
        for h, p, lo, hi in zip(*(x.tolist() for x in sd.anchors(np.frombuffer(text, np.uint8)))):
            for s in range(p - hi, p - lo + 1):
                assert s not in of and s <= p <= s + sd.SPAN
                of[s] = (h, p - s)
        assert sorted(of) == list(range(len(text) - 99))
        by = {}
        for s, v in of.items():
            assert by.setdefault(text[s : s + 100], v) == v


def test_blocks_cover_every_window(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 300)
    for n in (100, 399, 400, 1000, 1234):
        text = random.Random(n).randbytes(n)
        got = {s for h, p, lo, hi in sd.document_anchors(text) for a, x, y in zip(p.tolist(), lo.tolist(), hi.tolist()) for s in range(a - y, a - x + 1)}
        assert got == set(range(n - 99))


def test_random_tables_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(15, 90))) for _ in range(12)]
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.5 or not rows:
            t = " ".join(" ".join(rng.choices(words, k=rng.randrange(60))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(5)))
        elif kind < 0.65:
            t = rng.choice(rows)[1]
        elif kind < 0.9:
            t = rng.choice(rows)[1] or ""
            j = rng.randrange(len(t) + 1)
            t = t[:j] + "#" + t[j + rng.randrange(3) :]
        else:
            t = rng.choice(["ab", "a", "ha ha la ", passages[0] + " "]) * rng.randrange(200)
        rows.append((i * 3 - 50, t if i % 20 else None, "x"))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sd.brute_force([r[:2] for r in rows])
    got = run(spark, str(tmp_path))
    assert {d for d in want if want[d] != got.get(d)} == set() and len(got) == len(want)


def test_an_anchor_of_many_contexts_is_done_by_offsets(monkeypatch):
    rng = random.Random(5)
    body, n = rng.randbytes(sd.GRAM), 60
    rows = [(b"" if rng.random() < 0.3 else rng.randbytes(30)) + rng.choice([b"left" * 15, b"LEFT" * 15]) + body + rng.choice([b"right" * 12, b"RIGHT" * 12]) + rng.randbytes(20) for _ in range(n)]
    found = [[x for x in zip(*(c.tolist() for c in sd.anchors(np.frombuffer(r, np.uint8)))) if r[x[1] : x[1] + sd.GRAM] == body] for r in rows]
    items = [(x[0], d, x[1], x[2], x[3], np.frombuffer((b"\0" * sd.SPAN + r + b"\0" * sd.WIDTH)[x[1] : x[1] + sd.WIDTH], np.uint8)) for d, (r, own) in enumerate(zip(rows, found)) for x in own]
    cols = [np.array([i[k] for i in items], t) for k, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint8))]
    whole = sd.covered(*cols)
    monkeypatch.setattr(sd, "CONTEXTS", 3)
    assert len(items) > 10 and len(whole[0]) and all((a == b).all() for a, b in zip(whole, sd.covered(*cols)))


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, want = run(spark, sf), sd.brute_force(rows)
    assert {d for d in want if want[d] != got.get(d)} == set() and len(got) == len(want)


def test_rows_that_share_an_id(spark, tmp_path):
    rng = random.Random(7)
    part = ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(5)]
    kinds = [part[0], part[0] + part[1], "x" * 7 + part[0], part[2] + part[0], part[1] + part[3], part[3], part[2] + part[2], part[4]]
    rows = [(d, rng.choice(kinds)) for d in (None, 1, 2, 2, 3, None, None, 1, 1, 4, 5, 5)] + [(6, part[4]), (6, part[4]), (7, part[4]), (7, part[4] + part[1]), (7, kinds[2]), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    least = {}
    texts = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 99):
            least[b[i : i + 100]] = min(least.get(b[i : i + 100], (d, i)), (d, i))
    want = []
    for (d, _), (k, b) in zip(rows, texts):
        gone = {j for i in range(len(b) - 99) if least[b[i : i + 100]] < (k, i) for j in range(i, i + 100)}
        want.append((d, len(b), len(gone), sum(j - 1 not in gone for j in gone), sd.hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    got = sd.op7_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_defined_cases(spark, tmp_path):
    t = "0123456789" * 10
    spark.createDataFrame([(None, t), (1, t + "x"), (1, t + "x"), (2, None), (3, "short"), (4, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in sd.op7_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == 6 and (None, 100, 0) in got and (2, 0, 0) in got and (4, 5, 0) in got
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(spark, f"{tmp_path}/none") == {}
