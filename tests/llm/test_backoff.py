"""The word model of trusted text in rounds and shards: against the joins over all grams, and what it leaves on disk."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shellsieve.llm import backoff as K
from shellsieve.llm import quality as Q


def texts_of(seed, n, most=40):
    rng = random.Random(seed)
    signs = ["the", "of", ",", "!?", "日本", "ไทย", "é"]
    return [" ".join(rng.choice(signs) if rng.random() < 0.2 else f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, most))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    signs = "ab Z9_\n\t.,!-é日本กไ　 ́\U00020001\U0001F600​ßカｱ퟿\U0010ffff"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(500)] + ["   ", "a", "x" * 70]
    want = [[*K.TOKEN.findall(t), None] for t in texts]
    for cut in (64, 1 << 19):
        before, K.CUT_BYTES = K.CUT_BYTES, cut
        K.few_powers.cache_clear()
        ids, ends = K.token_ids(pa.array(["", *texts]).slice(1))
        K.CUT_BYTES = before
        K.few_powers.cache_clear()
        assert ends.tolist() == np.cumsum([len(t) for t in want]).tolist()
        of = {}
        assert all(of.setdefault(w, i) == i for w, i in zip((w for t in want for w in t), ids.tolist(), strict=True))
        assert len(set(of.values())) == len(of) and of[None] == K.END


@pytest.mark.parametrize(("rounds", "shards"), [(1, 1), (5, 3)])
def test_sums_of_weights_are_the_likelihood(spark, rounds, shards):
    good, other = texts_of(1, 400), [*texts_of(2, 60), "never seen words", "?", " ", "the", "the"]
    docs = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in other], "text string, trusted boolean")
    names = Q.Worded(3).names
    counts = Q.word_counts(docs, 3).groupBy(*names).agg(F.sum("n").alias("c"))
    want = Q.word_likelihood(docs, Q.smoothed_grams(counts, 3, Q.Worded(3)), text="text", order=3, out="s").select("text", "s.*")
    texts = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    found = K.likelihood(texts, lambda: docs.filter("trusted").select("text"), rounds=rounds, shards=shards)
    assert found is not None and found.count() == docs.select("text").distinct().count()
    rows = want.withColumn("k1", F.xxhash64("text")).join(found.selectExpr("k1", "logp AS mine", "n AS words"), "k1").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["words"] == r["n"] and math.isclose(r["mine"], r["logp"], rel_tol=1e-10), r


def test_no_trusted_text_and_no_text(spark):
    docs = spark.createDataFrame([("a b",), ("a c d",)], "text string")
    texts = docs.select(F.xxhash64("text").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "text")
    rows = K.likelihood(texts, lambda: docs.limit(0)).collect()
    assert sorted((r["n"], round(r["logp"], 9)) for r in rows) == [(3, round(-3 * math.log(6), 9)), (4, round(-4 * math.log(6), 9))]
    assert K.likelihood(texts.limit(0), lambda: docs.limit(0)).count() == 0


def test_texts_without_any_known_gram(spark):
    docs = spark.createDataFrame([(t,) for t in texts_of(1, 400)], "text string")
    texts = spark.createDataFrame([(1, 1, "%% §§")], "k1 bigint, k2 bigint, text string")
    r, = K.likelihood(texts, lambda: docs, rounds=3, shards=40).collect()
    assert r["n"] == 3 and r["logp"] < -3


def test_copies_whose_counts_have_no_ones_take_the_joins(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts_of(5, 40) * 4)], "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    texts = docs.select(F.xxhash64("text").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "text")
    assert K.likelihood(texts, lambda: docs.select("text")) is None
    assert Q.judged(docs, labels).filter("quality.perplexity > 0").count() == 160


def test_quality_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Grams of all texts, 24 bytes each, once stayed in the shared folder and in shuffle files."""
    rows = [(i, t, "en") for i, t in enumerate(texts_of(6, 1500, 80))]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), [(i, 1) for i in range(700)]
    monkeypatch.setattr("shellsieve.session.shared_dir", lambda spark: f"file://{tmp_path}")
    found = Q.judged(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert found.filter("quality.perplexity > 1").count() == 1500
    left = {p.name: sum(x.stat().st_size for x in p.rglob("*.parquet")) for p in Path(tmp_path).iterdir()}
    assert sum(left.values()) < 150 * len(rows), left
