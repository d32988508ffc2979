import random

import numpy as np
import pytest

from shellsieve.llm import minhash_dedup as M
from shellsieve.llm.common import spaced_words


def shingles(text, size):
    w = spaced_words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None in (a, b) or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {(d, len(s), None if d is None else find(d), d is not None and find(d) == d) for d, s in sets}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(1_000_000)}"
        out.append(" ".join(own))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    texts = [*family(rng, 60, 120, 12), *family(rng, 40, 300, 20), *family(rng, 30, 8, 2), "", " \t\n", "one", "ONE", "one two", "one two", None,
             "a b c d", "A  b\nc d", "Été a b c", "été a b c", *[" ".join(f"u{rng.randrange(99)}" for _ in range(50)) for _ in range(20)]]
    texts += ["same text here again"] * 25 + ["x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(None, "same text here again"), (3, dict(rows)[3])]


@pytest.mark.parametrize("size,percent,bands,rows", [(3, 85, 24, 5), (5, 80, 30, 4)])
def test_against_all_pairs(spark, size, percent, bands, rows):
    data = rows_of(size)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in data], "doc_id bigint, text string, id string, n int").repartition(5)
    got = M.near_duplicates(docs, size=size, percent=percent, bands=bands, rows=rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(data)
    assert set(found) == brute(data, size, percent)
    kept = M.drop_near_duplicates(docs, size=size, percent=percent, bands=bands, rows=rows)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, _, _, k in brute(data, size, percent) if k)
    assert sum(r["doc_id"] is None for r in kept.collect()) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.near_duplicates(docs).count() == 0
    assert M.drop_near_duplicates(docs).count() == 0


def test_sketch_bound_keeps_pairs_at_the_threshold():
    rng, signer = np.random.default_rng(1), M.Signer(24, 5)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 85 * 4, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]) for _ in range(2))
        x, y = (np.unpackbits(np.frombuffer(signer(s)[1], np.uint8)) for s in (a, b))
        assert (x ^ y).sum() <= M.most_flips(120, 0.85)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    ids = spark.createDataFrame([(i,) for i in [*range(201), 500, 501, 900]], "id bigint")
    got = {r["id"]: r["comp"] for r in M.components(ids, links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 900}


def test_parity_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(2)
    for n in (1, 30, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)]))
        x, y = (np.unpackbits(M.parity(s).view(np.uint8)) for s in (a, b))
        assert len(x) == M.PARITY_BITS and (x ^ y).sum() <= len(np.setxor1d(a, b))


def test_full_comparison_alone_finds_every_component(spark):
    rng = random.Random(9)
    texts = family(rng, 80, 120, 14)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    signed = M.signatures(docs, key="doc_id", text="text", size=3, bands=24, rows=5)
    members = M.shared_buckets(signed.select(M.F.col("_key").alias("id"), M.F.explode("_bands").alias("_band")))
    own = docs.withColumnRenamed("doc_id", "id").join(
        signed.select(M.F.col("_key").alias("id"), M.F.col("n_shingles").alias("n"), M.as_longs("_sketch").alias("sk")), "id")
    comps = M.link_buckets(members, own, samples=120, size=3, percent=85, rounds=0)
    got = {r["id"]: r["comp"] for r in comps.collect()}
    want = {d: c for d, _, c, _ in brute(list(zip(ids, texts)), 3, 85)}
    assert {d: got.get(d, d) for d in ids} == want
