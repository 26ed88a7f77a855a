import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkspan.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    tk, mine = Tokenizer.from_file(PATH), pk.WordTokenizer(PATH)
    assert mine.by_word
    rng = random.Random(1)
    odd = ["", " \n", "It's ÉCOLE", "a\x1cb", "x\x85y z\xa0w", "<|endoftext|> a<|startoftext|>b", "é Å", "１２ ½ 日本", "ΑΣ ΟΔΟΣ.", "İx", "​q﻿r", "word\x0bword\x0cx"]
    for t in odd + ["".join(rng.choices("abÉ '́s12½.,\n\t　\x1f<|>e", k=rng.randrange(40))) for _ in range(2000)] + ["".join(rng.choices("abtheßÀöÿÏÝnrS.,", k=rng.randrange(1, 12))) for _ in range(4000)]:
        assert np.frombuffer(mine(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, capacity):
    bins = {}
    for seq, off, n in rows:
        bins.setdefault(seq, []).append((off, n))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_crossover_keeps_all_items_and_capacity():
    rng = np.random.Generator(np.random.PCG64(3))
    lengths = np.sort(rng.integers(1, 100, 500))[::-1].astype(np.int64)
    a, b = pk.first_fits(lengths, rng, 100, 0.3), pk.first_fits(lengths, rng, 100, 0.5)
    for _ in range(20):
        a, b = b, pk.crossover(lengths, a, b, rng, 100)
        assert np.bincount(b, weights=lengths).max() <= 100 and len(b) == 500 and b.min() == 0
    pool, born, won = pk.evolve(0, 0, lengths, [a, b], 1, 100, 40)
    assert born == 40 and won > 0
    assert pk.fitness(lengths, pool[0], 100) <= min(pk.fitness(lengths, g, 100) for g in (a, b))


def test_query(spark, sf):
    tk = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pk.op3_packing(spark, sf).collect()
    want = {}
    for d, t in docs.items():
        ids = np.array(tk.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            want[d, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    n = check([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_shards_and_defined_cases(spark):
    rng = random.Random(2)
    rows = [(i % 7, rng.randrange(1, 65), "x") for i in range(900)] + [(None, 64, None), (1, 1, "x"), (1, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, length long, offset string")
    got = pk.pack(df, capacity=64, shard=200, islands=3, rounds=3).collect()
    assert len(got) == len(rows)
    assert check([(r.sequence_id, r.offset, r.length) for r in got], 64) <= sum(r[1] for r in rows) / 64 * 1.03 + 5
    assert pk.pack(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert sorted(r.length for r in pk.cut_documents(docs, PATH).collect()) == [1, 1, 3]


def test_every_island_of_the_query_crosses_over_and_gains(spark, sf, monkeypatch):
    """Also where the seeds meet the bound: all offspring are made, some win, and the elite that migrates is found next door."""
    states = []
    evolved = pk.evolved
    monkeypatch.setattr(pk, "evolved", lambda *a: states.append(evolved(*a)) or states[-1])
    rows = pk.op3_packing(spark, sf)
    assert rows.count() and len(states) == 1
    got = states[0].groupBy("shard", "island").agg({"born": "max", "won": "max"}).collect()
    assert len(got) == pk.ISLANDS and all(r["max(born)"] == pk.ROUNDS * pk.OFFSPRING and r["max(won)"] > 0 for r in got)
    own = {}
    for r in states[0].collect():
        own.setdefault(r.island, set()).add(bytes(r.genome))
    lengths = np.frombuffer(states[0].first().lengths, "<i4").astype(np.int64)
    seeds = [pk.first_fits(lengths, np.random.Generator(np.random.PCG64([0, 0])), pk.CAPACITY, 0.0)]
    best = min(pk.fitness(lengths, np.frombuffer(g, np.int32), pk.CAPACITY) for s in own.values() for g in s)
    assert best < min(pk.fitness(lengths, g, pk.CAPACITY) for g in seeds)


def test_crossover_saves_sequences_where_best_fit_does_not():
    """Pieces of 0.15 to 0.5 of a sequence: the evolved pool needs fewer sequences than all its seeds."""
    rng = np.random.Generator(np.random.PCG64(1))
    lengths = np.sort(rng.integers(150, 500, 400))[::-1].astype(np.int64)
    pool = [pk.first_fits(lengths, rng, 1000, 0.02 * k) for k in range(8)]
    after, _, _ = pk.evolve(0, 0, lengths, pool, 1, 1000, 400)
    assert pk.fitness(lengths, after[0], 1000)[0] < min(pk.fitness(lengths, g, 1000)[0] for g in pool)


def test_memo_is_bounded_by_characters():
    tk, mine = Tokenizer.from_file(PATH), pk.WordTokenizer(PATH)
    rng = random.Random(5)
    for t in ["".join(rng.choices("abcdef0123456789+/=", k=1_000_000)), "".join(rng.choices("abcde", k=100_000)), "short words"]:
        assert np.frombuffer(mine(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids
    for memo in (mine.memo, mine.core):
        assert max(map(len, memo)) <= pk.MEMO_CHARS and sum(len(k) + len(v) for k, v in memo.items()) < 10_000
