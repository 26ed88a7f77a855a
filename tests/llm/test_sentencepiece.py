import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece as spm

from inkspan.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b   c ", "▁", "▁ ▁x", "a▁b", "\n\n x", "日本語 \U0001f600\x00\x01", "é" * 50, "x" * 3000, " a　b", "</s> <s> <0x41>", " \n \n", "naïve café"]


def test_ids_spans_and_decoding_match_the_library():
    c, sp = sc.Codec(open(PATH, "rb").read()), spm.SentencePieceProcessor(model_file=PATH)
    assert c.cuts
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("ab  \n▁éß日\U0001f600.,thein", k=rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids, begins, ends = c.encode(t)
        assert ids.tolist() == sp.encode(t, add_eos=True), repr(t)
        assert c.decode(ids) == sp.decode(ids.tolist()), repr(t)
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        for i, a, b in zip(ids.tolist(), begins, ends):
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i) and not sp.is_control(i):
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


def test_decoding_of_any_ids_matches_the_library():
    c, sp = sc.Codec(open(PATH, "rb").read()), spm.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(259)]) for _ in range(rng.randrange(8))]
        assert c.decode(np.array(ids, np.int32)) == sp.decode(ids), ids


def test_normaliser_walks_a_compiled_map_like_the_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    spec = proto.normalizer_spec
    mine = sc.Normalizer(spec.precompiled_charsmap, True, True, True)
    rng = random.Random(7)
    for t in ["ﬁne ①②  ｆｕｌｌ", "  lead", "trail  ", "é Å ㌔", "", "  ", "a​b　c"] + ["".join(rng.choices("a ́ﬁｶﾞ①é　\n", k=rng.randrange(30))) for _ in range(500)]:
        out, align = mine(t)
        assert out.decode() == lib.normalize(t), repr(t)
        align = align.tolist()
        assert len(align) == len(out) + 1 and align == sorted(align) and align[-1] <= len(t.encode())


class Walk:
    """The map a byte at a time, for comparison."""

    def __init__(self, n):
        self.trie, self.blob = n.trie.tolist(), n.blob

    def prefix(self, b, at):
        trie, best, unit = self.trie, None, self.trie[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(b)):
            node ^= b[i]
            unit = trie[node]
            if unit & 0x800000FF != b[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (trie[node] & 0x7FFFFFFF, i + 1 - at)
        return best


def test_all_prefixes_at_once_equal_a_walk_by_bytes():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    mine = sc.Normalizer(proto.normalizer_spec.precompiled_charsmap, True, True, True)
    walk, rng = Walk(mine), random.Random(9)
    for _ in range(300):
        b = "".join(rng.choices("ab ́ﬁｶﾞ①é　\n가각ﷺ", k=rng.randrange(40))).encode()
        size, value = mine.prefixes(np.frombuffer(b, np.uint8))
        assert [(int(v), int(n)) if n else None for n, v in zip(size, value)] == [walk.prefix(b, i) for i in range(len(b))]


def test_a_model_with_a_map_is_projected_to_the_original():
    """The query's model has no map, so one is grafted on: ids of the library, spans over the recorded alignment."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib, proto = pb.ModelProto(), pb.ModelProto()
    lib.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = lib.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    c = sc.Codec(proto.SerializeToString())
    sp = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    assert not c.cuts
    rng = random.Random(13)
    for t in ["", "  ", "ﬁne  ｆｕｌｌ ①② ", "é Å ㌔"] + ["".join(rng.choices("ab  \ńﬁｶﾞ①é　the", k=rng.randrange(40))) for _ in range(400)]:
        ids, begins, ends = c.encode(t)
        raw = t.encode()
        assert ids.tolist() == sp.encode(t, add_eos=True), repr(t)
        assert all(0 <= a <= b <= len(raw) for a, b in zip(begins, ends)) and begins.tolist() == sorted(begins)
        for i, a, b in zip(ids.tolist(), begins, ends):
            if a < b and not sp.is_byte(i) and raw[a:b].isascii():
                assert raw[a:b].decode().strip().replace(" ", "▁") in sp.id_to_piece(i) or raw[a:b].isspace()
    ids, begins, ends = c.encode("ﬁ①")
    assert {("ﬁ①".encode()[a:b]).decode() for a, b in zip(begins, ends) if a < b} <= {"ﬁ", "①", "ﬁ①"}


def test_documents(spark, sf):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (None, "x")]
    got = sc.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded, len(r.ids)) for r in got)[0][1] == "x"
    assert {r.decoded for r in got} == {"Hello  world", "", "x"}
    assert sc.encode_documents(spark.createDataFrame([], "text string, doc_id long, ids int"), PATH).count() == 0


def test_query_against_the_library_on_whole_texts(spark, sf):
    sp = spm.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sc.op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_memo_is_bounded_by_characters():
    c, sp = sc.Codec(open(PATH, "rb").read()), spm.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    for t in ["".join(rng.choices("abcdef0123456789+/=", k=1_000_000)), "short words " + "x" * 65, "short words"]:
        assert c.segment(t).tolist() == sp.encode(t)
    assert c.memo and max(map(len, c.memo)) <= sc.MEMO_CHARS and sum(len(k) + len(v) for k, v in c.memo.items()) < 10_000
