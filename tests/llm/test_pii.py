import hashlib
import random
import re
import time

from inkspan.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_equals_plain_patterns():
    rng = random.Random(4)
    texts = ["a@b@c.d", "a@b.c_d@e.f", "@x.y a.@b.c.", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4", "+1 (415) 555-0132x", "4111 1111 1111 1111", "4111-1111-1111-1111 4", "é😀 x@y.zz", "+1-2+3 4-5", "é@b.c"]
    texts += ["".join(rng.choices("a@.b +()-0123 4567é\n%_", k=rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choices(["1", "25", "255", ".", ".", "4111111111111111", " ", "-", "+", "7"], k=20)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), repr(t)


def test_time_is_linear():
    began = time.time()
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1-" * 150_000, "+1 (" * 80_000):
        pii.Model().spans(t)
        pii.candidates(t, pii.base_spans(t))
    assert time.time() - began < 20


def test_expectation_maximisation_finds_reliabilities():
    rng = random.Random(9)
    counts, right = {}, {}
    for _ in range(20000):
        true = rng.random() < 0.4
        votes = tuple((1 if true else -1) * (1 if rng.random() < r else -1) if rng.random() < 0.8 else 0 for r in (0.95, 0.9, 0.85, 0.6, 0.8))
        counts["secret", votes] = counts.get(("secret", votes), 0) + 1
        right["secret", votes] = right.get(("secret", votes), 0) + true
    p = pii.estimate(counts)
    hit = sum(right[k] if p[k] >= 0.5 else counts[k] - right[k] for k in counts)
    majority = sum(right[k] if sum(k[1]) > 0 else counts[k] - right[k] for k in counts)
    assert hit > majority and hit / 20000 > 0.93


def test_query_against_plain_patterns(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = pii.op10_pii(spark, d).collect()
    assert len(got) == len(docs)
    secrets = 0
    for r in got:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in spans][: len(want)] == want
        secrets += sum(k == "secret" and re.fullmatch("[0-9a-f]{40}", docs[r.doc_id][int(a) : int(b)]) is not None for k, a, b in spans)
    assert secrets == sum(len(re.findall('token = "[0-9a-f]{40}"', t)) for t in docs.values()) > 0


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x@y.zz und 10.0.0.1", "c"), (3, "x@y.zz und 10.0.0.1", "c"), (None, 'é token = "%s"' % ("0123456789abcdef" * 2), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.train(docs)
    out = {(r.doc_id, r.text) for r in pii.mask(docs, model).collect()}
    assert {(1, None), (2, ""), (3, "<EMAIL> und <IP>")} <= out and len(out) == 4
    assert pii.find(docs, model).count() == 5
    assert pii.train(docs.limit(0)).weights is None and pii.find(docs.limit(0), pii.Model()).count() == 0
