"""SentencePiece encoding and decoding with byte offsets into the original text.

The normaliser walks the compiled character map (a double-array trie), from all places of a text at once, a byte deeper
each step, and takes the longest prefix at every place; it records, for each normalised byte, the source byte it came
from. A model without a map has an empty trie: the same walk, in which every character stands for itself. The library
segments the text; every piece is projected back over the recorded alignment to a [begin, end) span of the original's
UTF-8, whatever the model. The library decodes.

Segmentation may be cut where no piece of the vocabulary crosses: if no piece has a word mark after another character,
each run of marks with what follows is segmented on its own, and a bounded memo keeps the results.

Defined cases: null is the empty text; an empty text has the end id only and decodes to the empty text; texts are never
cut; repeated rows repeat their result; extra columns do not pass (join on doc_id); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lists, table, whole_text

MARK = "▁"
#: Memoised segments per Python worker, and characters of one at most: some 100 MB in all. The memo starts afresh when full.
MEMO, MEMO_CHARS = 300_000, 64
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


class Normalizer:
    """Longest-prefix normalisation by a compiled character map, with source alignment in bytes."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, strip_spaces: bool, escape: bool):
        self.dummy, self.strip, self.escape = dummy_prefix, strip_spaces, escape
        self.trie, self.blob = np.zeros(0, np.uint32), b""
        if charsmap:
            n = struct.unpack_from("<I", charsmap)[0]
            self.trie = np.frombuffer(charsmap, "<u4", n // 4, 4)
            self.blob = charsmap[4 + n :]

    @property
    def identity(self) -> bool:
        """No mapping and no stripping: only spaces become marks."""
        return not len(self.trie) and not self.strip and self.escape

    def prefixes(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte: the length of the longest mapped prefix there (0: none), and where its replacement is."""
        size, value, trie = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32), self.trie
        if not len(trie):
            return size, value
        below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at, depth = np.arange(len(b)), 0
        node = np.full(len(b), below(trie[0]), np.uint32)
        while len(at):
            byte = b[at + depth].astype(np.uint32)
            node = node ^ byte
            unit = trie[node]
            hit = (unit & 0x800000FF) == byte
            at, node, unit, depth = at[hit], node[hit], unit[hit], depth + 1
            node = node ^ below(unit)
            leaf = (unit >> 8 & 1).astype(bool)
            size[at[leaf]], value[at[leaf]] = depth, trie[node[leaf]] & 0x7FFFFFFF
            more = at + depth < len(b)
            at, node = at[more], node[more]
        return size, value

    def mapped(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes after the map, source byte of each)."""
        size, value = self.prefixes(b)
        place = np.arange(len(b), dtype=np.int32)
        starts = np.flatnonzero((size > 0) & ((b & 0xC0) != 0x80))  # prefixes begin at characters
        if not len(starts):
            return b, place
        out, align, at = [], [], 0
        for i in starts.tolist():
            if i < at:
                continue  # inside a longer prefix
            v = int(value[i])
            new = self.blob[v : self.blob.index(b"\0", v)]
            out += [b[at:i], np.frombuffer(new, np.uint8)]
            align += [place[at:i], np.full(len(new), i, np.int32)]
            at = i + int(size[i])
        return np.concatenate([*out, b[at:]]), np.concatenate([*align, place[at:]])

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised UTF-8, source byte of each normalised byte and of the end)."""
        raw = text.encode()
        b, align = self.mapped(np.frombuffer(raw, np.uint8))
        end, space = len(raw), MARK.encode() if self.escape else b" "
        if self.strip:
            blank = b == 32
            keep = ~(blank & np.r_[True, blank[:-1]]) if len(b) else blank
            b, align = b[keep], align[keep]
            if len(b) and b[-1] == 32:
                end, b, align = int(align[-1]), b[:-1], align[:-1]
        if not len(b):
            return b"", np.array([len(raw)], np.int32)
        out = b.tobytes()
        if len(space) > 1:  # all bytes of a mark come from its space
            out = out.replace(b" ", space)
            align = np.repeat(align, (b == 32) * np.uint8(len(space) - 1) + np.uint8(1))
        first = [align[0]] * len(space) if self.dummy else []
        return space * self.dummy + out, np.concatenate((first, align, [end]), dtype=np.int32, casting="unsafe")


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, pieces = proto.normalizer_spec, proto.pieces
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.end = self.sp.eos_id()
        names = [p.piece for p in pieces]
        plain = [p.type in (1, 4) for p in pieces]
        self.norm_len = np.array([1 if p.type == 6 else len(p.piece.encode()) if ok else 0 for p, ok in zip(pieces, plain, strict=True)], np.int32)
        self.cuts = proto.trainer_spec.byte_fallback and self.normalizer.identity and self.normalizer.dummy and not any(re.search(f"[^{MARK}]{MARK}", n) for n, ok in zip(names, plain, strict=True) if ok) and not any(p.type == 4 for p in pieces)
        self.memo: dict[str, bytes] = {}

    def segment(self, text: str) -> np.ndarray:
        """Ids of a text that is not empty, without an end id."""
        if not self.cuts:
            return np.array(self.sp.encode(text), np.int32)
        # every chunk: a run of marks (the first one a dummy or a space) with what follows
        parts = re.findall(f"[ {MARK}]+[^ {MARK}]*", " " + text)
        memo = self.memo
        got = list(map(memo.get, parts))
        if None in got:
            new, fresh = list({p for p, g in zip(parts, got, strict=True) if g is None}), {}
            for p, ids in zip(new, self.sp.encode([p[1:] for p in new], num_threads=1), strict=True):
                # a lone mark has no text left for the library's dummy prefix
                fresh[p] = np.array(ids if len(p) > 1 else [self.sp.piece_to_id(MARK)], np.int32).tobytes()
            got = [fresh[p] if g is None else g for p, g in zip(parts, got, strict=True)]
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
            memo.update((p, ids) for p, ids in islice(fresh.items(), MEMO) if len(p) <= MEMO_CHARS)
        return np.frombuffer(b"".join(got), np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with the end id, begins, ends): spans are bytes of the original's UTF-8; the end id's span is empty."""
        ids = self.segment(text) if text else np.zeros(0, np.int32)
        norm, align = self.normalizer(text)
        lengths = self.norm_len[ids]
        if (ids == self.sp.unk_id()).any():
            # an unknown character has no piece of its own: the library says how long it is
            lengths = np.array([len(p.piece.encode()) for p in self.sp.encode(text, out_type="immutable_proto").pieces], np.int32)
        stops = np.cumsum(lengths)
        if len(ids) and stops[-1] != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        size = np.int32(len(text) if text.isascii() else len(text.encode()))
        return np.append(ids, np.int32(self.end)), np.append(align[stops - lengths], size).astype(np.int32), np.append(align[stops], size).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file on this machine, made once in each Python worker."""
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = Codec(f.read())
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends, decoded of every text; the model file must be at that path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in chunks(batches, "text"):
            rows = [c.encode(t) for t in b.column(1).to_pylist()]
            texts = [c.decode(r[0]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *(lists([r[i] for r in rows], pa.int32()) for i in range(3)), pa.array(texts, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_xxh64"),
    )
