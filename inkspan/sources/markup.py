"""HTML, RTF, e-mail and mailboxes as text, in Arrow batches over the standard library's parsers."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are not shown, that end a line, and attributes with text of their own.
HIDDEN = frozenset("script style head title noscript template".split())
BLOCKS = frozenset("p div section article header footer ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre hr form main nav aside dl dt dd".split())
ATTRIBUTES = ("href", "src", "alt", "title", "value")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.cells, self.links = 0, 0, []
        self.attributes: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.attributes += [v for k, v in attrs if k in ATTRIBUTES and v]
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "| ")
            self.cells += 1
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            if self.links[-1]:
                self.out.append("[")
        elif tag in BLOCKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))
            if tag == "tr":
                self.cells = 0

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links:
            if href := self.links.pop():
                self.out.append(f"]({href})")
        elif tag in BLOCKS:
            self.out.append((" |" if tag == "tr" and self.cells else "") + "\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"[ \t\r\n\f]+", " ", data))


def html_text(source: str) -> tuple[str, list[str]]:
    """(visible text as light Markdown, values of attributes that carry text)."""
    p = _Visible()
    p.feed(source)
    p.close()
    text = re.sub(r" *\n *", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), p.attributes


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("attributes", T.ArrayType(T.StringType()))]))
def html_to_text(source: pd.Series) -> pd.DataFrame:
    rows = [html_text(s or "") for s in source]
    return pd.DataFrame({"text": [r[0] for r in rows], "attributes": [r[1] for r in rows]})


@F.pandas_udf(T.StringType())
def decode_entities(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else html.unescape(s))


def encode_entities(c):
    """Text as HTML: the five characters that mark-up gives a meaning."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_RTF = re.compile(r"\\([a-z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
# Destinations without visible text, and control words that stand for characters.
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore listtable listoverridetable generator xmlnstbl rsidtbl latentstyles".split())
RTF_SYMBOLS = {"par": "\n", "line": "\n", "tab": "\t", "row": "\n", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "page": "\n"}
RTF_DEPTH = 128


def rtf_text(source: str) -> str:
    """Visible text of an RTF document; groups deeper than 128 are refused."""
    out, stack, skip, unicode_skip, eat = [], [], False, 1, 0
    for word, number, code, symbol, brace, plain in _RTF.findall(source):
        if brace == "{":
            if len(stack) >= RTF_DEPTH:
                raise ValueError("groups are nested too deeply")
            stack.append((skip, unicode_skip))
        elif brace == "}":
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif word:
            if word in RTF_SKIPPED:
                skip = True
            elif word == "uc":
                unicode_skip = int(number or 1)
            elif word == "u" and number and not skip:
                out.append(chr(int(number) % 65536))
                eat = unicode_skip
            elif word in RTF_SYMBOLS and not skip:
                out.append(RTF_SYMBOLS[word])
        elif code and not skip:
            if eat:
                eat -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol:
            if symbol == "*":
                skip = True
            elif not skip and symbol in "{}\\~_-":
                out.append({"~": "\xa0", "_": "‑", "-": ""}.get(symbol, symbol))
        elif plain and not skip:
            out.append(plain[eat:])
            eat = max(0, eat - len(plain))
    text = "".join(out)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.pandas_udf(T.StringType())
def rtf_to_text(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else rtf_text(s))


# Headers that are read, in their order, and the limits of a message.
HEADERS = ("From", "Sender", "Reply-To", "To", "Cc", "Bcc", "Subject", "Date", "Message-ID", "In-Reply-To", "References", "Organization", "Return-Path", "Delivered-To", "X-Originating-IP")
MAX_DEPTH, MAX_PARTS, MAX_ATTACHMENTS, MAX_NESTED = 20, 1000, 200, 5


def eml_sections(raw: bytes, nested: int = 0) -> list[dict]:
    """Sections (kind, label, text, depth) of a message: headers, bodies, messages within it, attachment names."""
    import email
    import email.policy

    message = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{h}: {v}" for h in HEADERS for v in message.get_all(h, []))
    out, names, parts = [{"kind": "headers", "label": "Headers", "text": head, "depth": nested}], [], 0

    def walk(part, depth: int) -> None:
        nonlocal parts
        parts += 1
        if depth > MAX_DEPTH or parts > MAX_PARTS:
            raise ValueError("the message has too many parts")
        kind = part.get_content_type()
        if kind == "message/rfc822":
            if nested >= MAX_NESTED:
                raise ValueError("messages are nested too deeply")
            for inner in part.get_payload():
                out.extend(eml_sections(inner.as_bytes(), nested + 1))
        elif part.is_multipart():
            for inner in part.iter_parts():
                walk(inner, depth + 1)
        elif part.get_filename() or part.get_content_disposition() == "attachment":
            names.append(part.get_filename() or "unnamed")
        elif kind in ("text/plain", "text/html"):
            body = part.get_payload(decode=True) or b""
            charset = part.get_content_charset() or "utf-8"
            try:
                text = body.decode(charset, "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            out.append({"kind": "text", "label": "Text", "text": text, "depth": nested} if kind == "text/plain" else {"kind": "html", "label": "HTML", "text": html_text(text)[0], "depth": nested})

    walk(message, 0)
    if len(names) > MAX_ATTACHMENTS:
        raise ValueError("too many attachments")
    if names:
        out.append({"kind": "attachments", "label": "Attachments", "text": "\n".join(names), "depth": nested})
    return out


_SECTION = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType())]))


@F.pandas_udf(_SECTION)
def eml_to_sections(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: eml_sections(bytes(b or b"")))


def _outcome(run, *args):
    """(what a parser gives, null), or (null, why it refuses)."""
    try:
        return run(*args), None
    except ValueError as e:
        return None, str(e)


@F.pandas_udf(T.StructType([T.StructField("sections", _SECTION), T.StructField("reason", T.StringType())]))
def eml_outcome(raw: pd.Series) -> pd.DataFrame:
    """Sections of a message, or the reason of its refusal: the other messages go on."""
    return pd.DataFrame([_outcome(eml_sections, bytes(b or b"")) for b in raw], columns=["sections", "reason"], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]))
def rtf_outcome(source: pd.Series) -> pd.DataFrame:
    """Text of an RTF document, or the reason of its refusal; null for null."""
    return pd.DataFrame([(None, None) if s is None else _outcome(rtf_text, s) for s in source], columns=["text", "reason"], dtype=object)


def attachment_plan(attachments: DataFrame, most: int = 25 << 20, together: int = 64 << 20, depth: int = 3, children: int = 200) -> DataFrame:
    """attachments (parent_id, seq, name, kind, claimed_kind, size, depth) with decision: carry (unknown type), expand, or
    the reason of refusal; totals run in order within the parent."""
    from pyspark.sql.window import Window

    c = F.col
    w = Window.partitionBy("parent_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    alone = F.when(c("kind").isNull(), "carry").when(c("size") > most, "too-large").when(c("claimed_kind").isNotNull() & (c("claimed_kind") != c("kind")), "extension-mismatch").when(c("depth") >= depth, "too-deep")
    rows = attachments.withColumn("_a", alone).withColumn("_s", F.when(alone.isNull(), c("size")).otherwise(0)).withColumn("_n", F.when(alone.isNull(), 1).otherwise(0))
    total, number = F.sum("_s").over(w), F.sum("_n").over(w)
    return rows.withColumn("decision", F.coalesce("_a", F.when(total > together, "too-large-together").when(number > children, "too-many").otherwise("expand"))).drop("_a", "_s", "_n")


_SEPARATOR = re.compile(r"From (?:\S+ +)?(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}[0-9]{1,2} [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s.*)?\Z")
_FIELD = re.compile(r"[!-9;-~]+:")
MAX_MESSAGES = 1000


def split_mailbox(text: str, most: int = MAX_MESSAGES) -> list[str]:
    """The messages of a mailbox: a separator line starts one at the beginning or after a blank line, if a header follows;
    one ``>`` is taken off quoted From lines."""
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    starts = [i for i, x in enumerate(lines) if x.startswith("From ") and _SEPARATOR.match(x.rstrip("\r\n")) and (i == 0 or not lines[i - 1].strip("\r\n")) and i + 1 < len(lines) and _FIELD.match(lines[i + 1])]
    if len(starts) > most:
        raise ValueError(f"over {most} messages")
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=False):
        body = lines[a + 1 : b]
        if body and not body[-1].strip("\r\n"):
            body = body[:-1]
        out.append(re.sub(r"(?m)^>(>*From )", r"\1", "".join(body)))
    return out


def join_mailbox(messages: list[str], stamp: str = "Thu Jan  1 00:00:00 1970") -> str:
    """A mailbox of the messages, From lines quoted."""
    return "".join(f"From MAILER-DAEMON {stamp}\n" + re.sub(r"(?m)^(>*From )", r">\1", m) + ("" if m.endswith("\n") else "\n") + "\n" for m in messages)


@F.pandas_udf(T.ArrayType(T.StringType()))
def mailbox_messages(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_mailbox(t or ""))


@F.pandas_udf(T.StructType([T.StructField("messages", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]))
def mailbox_outcome(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_outcome(split_mailbox, t or "") for t in text], columns=["messages", "reason"], dtype=object)


def refused_mailboxes(boxes: DataFrame) -> DataFrame:
    """parent_id, reason of mailboxes that ``expand_mailboxes`` leaves out."""
    return boxes.select("parent_id", mailbox_outcome("text")["reason"].alias("reason")).where("reason is not null")


def expand_mailboxes(boxes: DataFrame, known: DataFrame) -> DataFrame:
    """parent_id, part_path (msg-1, ...), text: messages of mailboxes (parent_id, text) that are not children yet. Those of
    over 1,000 messages have none: ``refused_mailboxes`` names them."""
    rows = boxes.select("parent_id", F.posexplode(mailbox_outcome("text")["messages"]).alias("_i", "text")).select("parent_id", F.concat(F.lit("msg-"), (F.col("_i") + 1).cast("string")).alias("part_path"), "text")
    return rows.join(known.select("parent_id", "part_path"), ["parent_id", "part_path"], "left_anti")
