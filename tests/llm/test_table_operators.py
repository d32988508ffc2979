"""Operators that work on whole tables: sharding, packing, search, WARC, and the pipeline."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shellsieve.llm import bm25_search as S
from shellsieve.llm import packing as P
from shellsieve.llm import sharding as K
from shellsieve.llm import warc as W
from shellsieve.llm.catalogue import ORACLES, QUERIES, tokenizer_file
from shellsieve.llm.common import words
from test_row_operators import odd_docs


# --- sharding

def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rng = random.Random(1)
    texts = ["x" * int(rng.lognormvariate(5, 1)) for _ in range(700)]
    texts = [f"{i % 500} {t}" for i, t in enumerate(texts)] + ["copy of one text"] * 200
    docs = spark.createDataFrame([(i, t, rng.choice(["en", "de"]), f"s{i % 7}") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string").repartition(4)
    for leaves in (1, 5, 8):
        rows = K.shards(docs, leaves=leaves).collect()
        assert len(rows) == len(texts)
        size, slots, home = collections.Counter(), collections.defaultdict(list), {}
        for r in rows:
            t = texts[r["doc_id"]].encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            assert home.setdefault(t, r["shard"]) == r["shard"]
        assert set(size) == set(range(leaves))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(size.values()) - min(size.values()) <= 2 * max(len(t) + 1 for t in texts) + 0.02 * sum(size.values()) + 200 * 17
    assert K.shards(docs, target_bytes=sum(size.values()) // 3).select("shard").distinct().count() == 4 or leaves == 8


def test_sharding_odd_rows(spark):
    docs = odd_docs(spark)
    rows = K.shards(docs, leaves=3).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert K.shards(docs.limit(0), leaves=8).count() == 0


# --- packing

def test_ids_are_the_tokenizer_s(spark, folder):
    tokens = P.Tokens(tokenizer_file())
    rng = random.Random(2)
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", "it's  we'll \t\n x y", "日本語 ½ x²", "<|endoftext|> a", "\u001c\u0085 b", "ǆ ʰ ΐ"]
    texts += ["".join(rng.choice("ab 'sé1\n\t.,—€ß日​") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert tokens(t) == tokens.whole(t), t


def test_cut():
    for n in (1, 5, 1023, 1024, 1025, 2048, 2049, 5000):
        ids = np.arange(n, dtype="<u4").tobytes()
        cuts = P.cut(ids, 1024)
        assert [c[0] for c in cuts] == list(range(-(-n // 1024))) and cuts[0][1] == 0 and sum(c[2] for c in cuts) == n
        assert all(c[2] == 1024 for c in cuts[1:]) and cuts[0][2] <= 1024
        assert all(b[1] == a[1] + a[2] for a, b in zip(cuts, cuts[1:]))
        assert all(c[3] == zlib.crc32(ids[4 * c[1]:4 * (c[1] + c[2])]) for c in cuts)


def test_local_search_empties_sequences():
    assert sum(P.local_search(collections.Counter({(6,): 1, (4,): 1}), 10).values()) == 1          # move
    assert sum(P.local_search(collections.Counter({(6, 3): 1, (5, 4): 1, (2,): 1}), 10).values()) == 2  # exchange, then move
    rng = random.Random(3)
    for _ in range(20):
        counts = collections.Counter(rng.randrange(1, 61) for _ in range(300))
        first = P.best_fit(counts, 100)
        best = P.local_search(first, 100)
        kept = collections.Counter()
        for kind, n in best.items():
            assert sum(kind) <= 100
            for x in kind:
                kept[x] += n
        assert kept == counts and sum(best.values()) <= sum(first.values())
        assert sum(best.values()) <= math.ceil(sum(k * v for k, v in counts.items()) / 100) + 2


def test_local_search_tries_every_pair():
    """No exchange of any two kinds is left, also where more kinds are underfull than are worked on first."""
    rng = random.Random(12)
    kinds = collections.Counter(tuple(sorted((rng.randrange(20, 330) for _ in range(3)), reverse=True)) for _ in range(60))
    best = P.local_search(kinds, 1024, tries=2)
    left = sorted(k for k in best if sum(k) < 1024)
    assert all(P.best_exchange(a, b, 1024) is None for i, a in enumerate(left) for b in left[i:] if a != b or best[a] > 1)
    under = [(i,) for i in range(1, 8)]
    assert sorted(P.pairs_of(under, 2)) == sorted((a, b) for i, b in enumerate(under) for a in under[i:])


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    cuts = P.pieces(docs, tokenizer_file()).cache()
    rows = P.pack(cuts).collect()
    assert len(rows) == cuts.count()
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024
    assert P.pack(P.pieces(docs.limit(0), tokenizer_file())).count() == 0


# --- search

def test_query_blocks_are_read_from_arrow():
    block = pa.table({"query_id": [7, 8, 9], "terms": pa.array([[3, -1], [5], [-1, 3]], pa.list_(pa.int64())), "weights": [[0.5, 2.0], [1.0], [2.0, 0.5]]})
    asked = S.Asked(block)
    assert len(asked) == 2 and [sorted(asked.ids(i).tolist()) for i in range(2)] == [[7, 9], [8]]
    assert [asked.idf[asked.terms(i)].tolist() for i in range(2)] == [[0.5, 2.0], [1.0]]
    assert S.BLOCK_TERMS <= 1_000_000


@pytest.mark.parametrize("shard_words", [40, 100_000])
def test_search_against_full_scores(spark, monkeypatch, shard_words):
    rng = random.Random(4)
    monkeypatch.setattr(S, "SHARD_WORDS", shard_words)
    texts = [" ".join(f"t{min(int(rng.expovariate(0.05)), 80)}" for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    texts += [texts[5]] * 15 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[5])], "doc_id bigint, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in S.top_k(docs, docs.filter("doc_id % 20 = 0"), k=7, block_terms=40).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    bags = [collections.Counter(words(t)) for t in texts] + [collections.Counter(words(texts[5]))]
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = collections.Counter(w for b in bags for w in b)
    idf = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    for q in range(0, len(texts), 20):
        scores = []
        for d in range(len(texts)):
            size = sum(bags[d].values())
            s = sum(idf[w] * bags[d][w] * 2.2 / (bags[d][w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in bags[q] if bags[d][w] and idf[w] > 0)
            if s > 0:
                scores.append((-round(s, 6), d))
        want = [(i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:7], 1)]
        assert sorted(got.get(q, [])) == want
    empty = docs.limit(0)
    assert S.top_k(empty, empty).count() == 0


def test_skipping_skips():
    rng = np.random.default_rng(5)
    texts = [np.concatenate([rng.integers(0, 50, 20), np.full(20 if i == 700 else 0, 60)]).astype(np.uint64) for i in range(2000)]
    shard = S.Shard(np.arange(2000), texts, np.arange(61, dtype=np.uint64), np.append(np.full(60, 0.1), 8.0), 20.0)
    doc, score, scored = shard.best(np.arange(61), 1, 0.0)
    assert doc[np.argmax(score)] == 700 and scored < shard.blocks


def test_blocks_of_other_languages_are_skipped_and_batches_are_exact(monkeypatch):
    """Texts of two languages in turn; before, every block held both and was scored for every query."""
    monkeypatch.setattr(S, "MATRIX", 40_000)  # some frequent terms stay out of the matrix
    rng = np.random.default_rng(6)
    texts = [(rng.integers(0, 50, 20) + 50 * (i % 2)).astype(np.uint64) for i in range(2000)] + [np.empty(0, np.uint64)]
    texts = [np.append(t, np.uint64(100 + i // 3)) if len(t) else t for i, t in enumerate(texts)]
    vocabulary, idf = np.arange(800, dtype=np.uint64), np.append(rng.random(100) + 0.1, np.full(700, 5.0))
    shard = S.Shard(np.arange(2001) * 7, texts, vocabulary, idf, 21.0)
    assert 0 < len(shard.matrix) < 100
    queries = [np.unique(texts[i]).astype(np.int64) for i in range(0, 2000, 50)] + [np.empty(0, np.int64)]
    start = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    query, key, score, scored = shard.best_of(np.concatenate(queries), start, 10, np.zeros(len(queries)))
    top = S.best_rows(query, key, score, 10)
    for i, q in enumerate(queries):
        total = [sum(idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / 21.0)) for w, n in zip(*np.unique(t, return_counts=True)) if w in q) for t in texts]
        want = sorted((-round(x, 6), d * 7) for d, x in enumerate(total) if x > 0)[:10]
        assert [(-round(score[j], 6), key[j]) for j in top if query[j] == i] == want
    assert scored.max() <= 0.7 * shard.blocks and scored[-1] == 0


def test_terms_are_counted_once_for_all_query_blocks(spark):
    docs = spark.createDataFrame([(1, "B a b"), (2, None), (None, "a"), (4, "")], "doc_id bigint, text string")
    counted = S.term_counts(docs, key="doc_id", text="text")
    rows = {r["key"]: r for r in counted.collect()}
    assert [(rows[k]["words"], sorted(rows[k]["counts"])) for k in (1, 2, None, 4)] == [(3, [1, 2]), (0, []), (1, [1]), (0, [])]
    table, n, mean = S.document_frequencies(counted)
    assert (n, mean, sorted(r["df"] for r in table.collect())) == (4, 1.0, [1, 2])
    assert "text" not in counted.columns


# --- WARC

def test_records_link_and_serialise(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T</title><a href=x>Hi</a> &amp;lt; <script>no</script>", 9), (2, None, None, 9), (None, "u", "", 9)],
                                  "page_id bigint, url string, html string, record_id int")
    source = W.responses(pages)
    records = W.derive(source).collect()
    ids = {r["record_id"] for r in source.collect()}
    assert len(records) == 6 and {r["refers_to"] for r in records} == ids and len({r["record_id"] for r in records}) == 6
    text = next(r for r in records if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "T Hi &lt;" or text["block"] == "Hi &lt;"
    W.write(W.derive(source), str(tmp_path / "out"))
    import gzip
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "out").glob("part-*.gz")))
    seen = 0
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert data[n:n + 4] == b"\r\n\r\n" and fields[b"WARC-Refers-To"].decode() in ids
        data = data[n + 4:]
        seen += 1
    assert seen == 6


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, folder, name):
    import compare
    found = compare.difference(compare.spark_rows(QUERIES[name](spark, folder)), compare.duck_rows(compare.connect(folder), ORACLES[name]))
    assert found is None


# --- pipeline

def test_pipeline_stages(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    items = [words(t) for t, in duckdb.execute(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left < ids and len(left) == docs.count(), name
        ids = left
    for r in docs.collect():
        line = b" " + b" ".join(words(r["text"])) + b" "
        assert not any(b" " + b" ".join(w) + b" " in line for w in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_pipeline_odd_rows(spark, folder):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() >= 0
    empty = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_plain_text_of_references_and_unseen_elements(spark):
    cases = {"a&#8217;b &#x2014; &eacute;&mdash;&hellip; &amp;lt; &notin; &#x1F600; &nbsp;&nbsp; x": "a’b — é—… &lt; ∉ \U0001F600 x",
             "<title>T</title><p>Hi": "Hi",
             "<html><head><title>T</title></head><body>Hi": "Hi",
             "<head><title>T</title><style>p{}</style><meta x><script>a</style>b</script>rest</head><p>Hi</p>": "Hi",
             "<HEAD\n><script>'</head>'</script ><title>T</title></HEAD>Hi": "Hi",
             "<head><title>T</title><body>Hi</body>": "Hi",
             "a<script>x</style>y</script>b<style>q</script>r</style>c": "a b c",
             "<header>Top</header>a<!-- <script> -->b<template>t</template>": "Top a b",
             "a<script>never closed": "a", "a &bogus; &; & b": "a &bogus; &; & b", "": ""}
    docs = spark.createDataFrame(list(cases.items()), "html string, want string")
    for r in docs.select("html", "want", W.read_page(docs["html"])["text"].alias("got")).collect():
        assert r["got"] == r["want"], r["html"]
    long = spark.createDataFrame([("<head>" + "x<b>" * 100_000 + "</head>Hi",)], "html string")
    assert long.select(W.read_page(long["html"])["text"].alias("t")).first()["t"] == "Hi"
