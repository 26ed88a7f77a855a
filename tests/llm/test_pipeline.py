import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from inkspan.llm import language_id, pii, simhash

from .test_packing import check
from .test_simhash import jaccard_components, shingles


def test_against_brute_force(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34", None, "s", 5), (9003, "", "en", "s", 0), (9004, "a b\nc mail x.y@z.org", "en", None, 20), (9005, "a  b c mail x.y@z.org", "en", "s", 21), (9005, "a  b c mail x.y@z.org", "en", "s", 21)]
    prose = rows.where("lang = 'en' and n_chars > 1500").orderBy("n_chars").first().text
    extra += [(9007, prose[:900] + " mail x.y@z.org", None, "s", 915), (9008, prose[:900] + " mail x.y@z.org  now", None, None, 919)]
    rows.unionByName(spark.createDataFrame(extra, rows.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = dict(sorted({r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}.items()))
    model = language_id.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    found = {d: model.predict(t) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t) and (found[d][1] >= language_id.LEAST or sum(c.isalpha() for c in t) < language_id.LETTERS)}
    seen = {}
    for d, t in docs.items():
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), d)
    docs = {d: docs[d] for d in seen.values()}
    # near copies by the exact similarity of every pair: what goes has a link to what stays, and hardly any link is missed
    want, pairs = jaccard_components({d: shingles(t) for d, t in docs.items()})
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}
    assert set(got) == set(docs) and all(want[d] == want[c] for d, c in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) and pairs
    docs = {d: t for d, t in docs.items() if got[d] == d}
    assert {d for d in want if want[d] == d} <= set(docs)  # of each true group the smallest stays

    staged = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in cp.STAGES[:-1]:
        before = staged.schema
        staged = f(spark, staged, str(tmp_path))
        assert staged.columns == before.names
    masked = {r.doc_id: r for r in staged.collect()}
    assert set(masked) == set(docs) and 9007 in docs and 9008 not in docs and masked[9007].lang == "en" and staged.count() == len(docs)
    for d, r in masked.items():
        assert not [s for s in pii.base_spans(r.text) if s[0] == "email"] and r.n_chars == len(r.text)
        if not pii.base_spans(docs[d]) and not pii.candidates(docs[d], []):
            assert r.text == docs[d]
    got = cp.run(spark, str(tmp_path)).collect()
    tk, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for d, r in masked.items():
        ids = np.array(tk.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want |= {(d, p // 2048): (p, zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)
    check([(r.sequence_id, r.offset, r.length) for r in got], 2048)


def test_empty_input(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
