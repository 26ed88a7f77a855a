"""Personal data: base patterns, and more spans by weak supervision.

Base kinds (email, ip, card, phone) are exact patterns, found in time linear in the text. Further candidates (secrets,
accounts, government ids, long numbers, names after a title) are voted on by five labelers: a shape regex with check
digits, a gazetteer of cue words, the syntax around the span, the spread of its characters, and its repetition. Votes are
+1, -1 or 0 (abstains). Expectation-maximisation over the counts of vote patterns (all candidates of the corpus, at most
3**5 rows a kind reach the driver) estimates each labeler's reliability without labels. The posteriors train a logistic
span classifier on a bounded sample of candidates; candidates that it gives ``ACCEPT`` or more become spans.

Defined cases: a null text is empty; offsets are code points, ends exclusive; whole texts, of any length; added spans
never overlap base spans or one another (the earlier, then longer, wins); without candidates nothing is added; repeated
rows repeat their result; an empty table gives an empty result; ``mask`` keeps all columns, null texts stay null.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "government-id", "number", "name")
LABELERS = ("shape", "gazetteer", "context", "spread", "repetition")
#: Candidates to train the span classifier on (an expected number), and the probability that makes a span.
SAMPLE, ACCEPT = 20_000, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts where a run of digits does: what fails there fails at every later digit of the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed in ``BASE``, then start."""
    out: list[tuple[str, int, int]] = []
    if not _HINT.search(text):
        return out
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_TAIL.match(text, at)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= ch <= "9" for ch in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


_DIGITS = re.compile(r"[0-9]+")
_EDGE = frozenset(" \t\n\r\x0b\x0c\"'`=,;:<>(){}[]|!?")
_REST = re.compile(r"[^ \t\n\r\x0b\x0c\"'`=,;:<>(){}\[\]|!?]*")
_SECRET = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/-]{16,}\Z")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_GOVERNMENT = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")
_NUMBER = re.compile(r"[0-9](?:[./-]?[0-9]){8,}\Z")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora|Señor)\.?\x20((?:[^\W\d_]+\x20)?[^\W\d_]+)")
_CUES = {
    "secret": ("token", "secret", "password", "passwd", "key", "api", "apikey", "auth", "bearer", "credential"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "government-id": ("ssn", "social", "security", "identity", "passport", "ausweis"),
    "number": ("account", "customer", "patient", "phone", "tel", "card", "konto", "member", "id", "no", "nr"),
    "name": ("name", "dear", "by", "from", "contact", "patient"),
}
_AGAINST = ("version", "page", "isbn", "issn", "order", "line", "commit", "sha", "md5", "build", "figure", "table", "chapter", "doi")
_WORD = re.compile(r"[^\W\d_]+")


def _mod97(s: str) -> bool:
    moved = s[4:] + s[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _shape(kind: str, s: str) -> int:
    if kind == "secret":
        is_hex = all(ch in "0123456789abcdefABCDEF" for ch in s)
        return 1 if is_hex and len(s) in (32, 40, 64, 128) or re.match(r"(?:sk|pk|rk|gh[pousr]|AKIA|AIza|xox)", s) else -1 if len(s) > 400 else 0
    if kind == "account":
        return 1 if _mod97(s) else -1
    if kind == "government-id":
        a, b, c = s.split("-")
        return -1 if a in ("000", "666") or a >= "900" or b == "00" or c == "0000" else 1
    if kind == "number":
        d = _NOT_DIGIT.sub("", s)
        return 1 if 13 <= len(d) <= 15 and luhn(d) else -1 if len(d) > 20 else 0
    return 1 if all(w[0].isupper() for w in s.split()) else -1


class Candidate:
    __slots__ = ("kind", "start", "end", "votes", "x")

    def __init__(self, text: str, kind: str, start: int, end: int, times: int):
        self.kind, self.start, self.end = kind, start, end
        s, before = text[start:end], text[max(0, start - 32) : start]
        words = [w.lower() for w in _WORD.findall(before)][-3:]
        near, tail = before[-1:], before.rstrip(" \"'`")[-1:]
        variety = len(set(s)) / min(len(s), 16)
        self.votes = (
            _shape(kind, s),
            -1 if any(w in _AGAINST for w in words) else int(any(w in _CUES[kind] for w in words)),
            1 if tail in ("=", ":") or near in ("\"", "'", "`") or kind == "name" else -1 if tail.isdigit() or tail in ("|", "/", "-") else 0,
            1 if variety >= 0.5 else -1 if variety <= 0.25 else 0,
            -1 if times > 2 else 0,
        )
        digits = sum("0" <= ch <= "9" for ch in s)
        x = np.zeros(len(ADDED) + 8 + 32 + 1, np.float32)
        x[ADDED.index(kind)] = 1
        k = len(ADDED)
        x[k : k + 8] = min(len(s), 128) / 64, digits / len(s), sum(map(str.isupper, s)) / len(s), variety, tail == "=", tail == ":", near in ("\"", "'", "`"), min(times, 5) / 5
        if words:
            x[k + 8 + zlib.crc32(words[-1].encode()) % 32] = 1
        x[-1] = 1
        self.x = x


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """Spans that the labelers vote on, in order, free of overlaps with base spans and one another."""
    found, at = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and text[start - 1] not in _EDGE:
            start -= 1
        at = _REST.match(text, m.end()).end()
        end = start + len(text[start:at].rstrip(".-/"))
        if end - start < 9:
            continue
        s = text[start:end]
        kind = next((k for k, p in (("account", _ACCOUNT), ("government-id", _GOVERNMENT), ("number", _NUMBER), ("secret", _SECRET)) if p.match(s)), None)
        if kind:
            found.append((start, -end, kind))
    if any(t in text for t in _TITLES):
        found += [(m.start(1), -m.end(1), "name") for m in _NAME.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    times = Counter(text[a:-b] for a, b, _ in found)
    out, last, i = [], 0, 0
    for start, end, kind in sorted(found):
        end = -end
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and not any(a < end and start < b for a, b in taken[i : i + 4]):
            out.append(Candidate(text, kind, start, end, times[text[start:end]]))
            last = end
    return out


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """The posterior of each (kind, vote pattern) by expectation-maximisation: a prior for each kind; for each labeler
    the rates of its three votes on true and on false spans. Starts from the majority; smoothed, so it never divides by 0."""
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([k[1] for k in keys]) + 1
    kinds = np.array([ADDED.index(k[0]) for k in keys])
    p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    rows = np.arange(len(LABELERS))
    # a labeler is assumed to be better than chance: pseudo-counts on the diagonal
    lean = {1: np.array([1.0, 2.0, 4.0]), 0: np.array([4.0, 2.0, 1.0])}
    for _ in range(rounds):
        prior = np.array([((n * p)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(ADDED))])
        logs = []
        for truth, q in ((1, p), (0, 1 - p)):
            rate = np.array([np.bincount(votes[:, j], weights=n * q, minlength=3) + lean[truth] for j in rows])
            rate /= rate.sum(axis=1, keepdims=True)
            logs.append(np.log(rate[rows, votes]).sum(axis=1) + np.log(prior[kinds] if truth else 1 - prior[kinds]))
        p = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return dict(zip(keys, p.tolist(), strict=True))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic weights for soft labels."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    def __init__(self, weights: np.ndarray | None = None, posterior: dict | None = None):
        self.weights, self.posterior = weights, posterior or {}

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, base): base spans by kind and start, then added ones by kind and start."""
        base = base_spans(text)
        out = [(*s, True) for s in base]
        if self.weights is not None and (own := candidates(text, base)):
            odds = np.array([c.x for c in own]) @ self.weights
            line = np.log(ACCEPT / (1 - ACCEPT))
            out += sorted(((c.kind, c.start, c.end, False) for c, z in zip(own, odds, strict=True) if z >= line), key=lambda s: (ADDED.index(s[0]), s[1]))
        return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Votes of all candidates, then the classifier; the driver sees counts and about ``sample`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c.kind, ",".join(map(str, c.votes)), c.x.tobytes()) for t in b.column(0).to_pylist() for c in candidates(t, base_spans(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.binary()))], names=["kind", "votes", "x"])

    all_of = materialize(docs.select(whole_text().alias("text")).mapInArrow(run, "kind string, votes string, x binary").groupBy("kind", "votes", "x").count(), "candidates")
    counts = {(r.kind, tuple(map(int, r.votes.split(",")))): r.n for r in all_of.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()}
    posterior = estimate(counts)
    distinct = all_of.count()
    if not distinct:
        return Model()
    some = all_of.where(F.pmod(F.xxhash64("kind", "votes", "x"), F.lit(1 << 20)) < min(1.0, sample / distinct) * (1 << 20)).collect()
    rows = sorted((r.kind, r.votes, bytes(r.x), r["count"]) for r in some)
    if not rows:
        return Model()
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64)
    y = np.array([posterior[r[0], tuple(map(int, r[1].split(",")))] for r in rows])
    return Model(fit(x, y), posterior)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "base": z} for k, s, e, z in model.spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def mask_text(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span (merged where they overlap; the first one names it) replaced by <KIND>."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, with personal data masked in the text."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (t := x.as_py()) is None else mask_text(t, model.spans(t)) for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = find(docs, train(docs))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
