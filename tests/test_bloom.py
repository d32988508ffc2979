"""Leakage by Bloom filter: the same rows whatever the filter's size, and next to no shuffle of clean rows."""

import pytest
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators import bloom, dedup


@pytest.fixture(scope="module")
def frames(spark):
    frozen = spark.range(0, 3000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("f"), "id")).alias("text")).repartition(4).cache()
    cand = spark.range(0, 6000).select("id", F.when(F.col("id") % 50 == 49, None).when(F.col("id") % 3 == 0, F.lit("f1"))
                                       .when(F.col("id") % 10 == 1, F.concat(F.lit("f"), "id")).otherwise(F.concat(F.lit("c"), "id")).alias("text"))
    return cand.cache(), frozen


@pytest.mark.parametrize("sizes", [{}, {"exact_rows": 0}, {"exact_rows": 0, "blocks": 1}, {"exact_rows": 0, "blocks": 7}, {"exact_rows": 0, "blocks": 5000}])
def test_equal_rows_for_any_filter(spark, frames, sizes):
    cand, frozen = frames
    known = {r.text for r in frozen.collect()} - {None}
    want = sorted(r.id for r in cand.collect() if r.text not in known)
    assert sorted(r.id for r in dedup.without_leakage(cand, frozen, F.col("text"), **sizes).collect()) == want
    flags = dedup.leakage_flags(cand, frozen, F.col("text"), **sizes)
    assert flags.columns == ["id", "text", "leaked"]
    assert sorted(r.id for r in flags.collect() if not r.leaked) == want
    assert flags.count() == 6000
    once = dedup.without_leakage(cand.unionByName(cand), frozen, X.strip(F.col("text")), within_batch=["id"], **sizes)
    firsts = {}
    for r in sorted(cand.collect()):
        if r.text not in known:
            firsts.setdefault(r.text, r.id)
    assert sorted(r.id for r in once.collect()) == sorted(firsts.values())


def test_clean_rows_pass_by_the_filter(spark, frames):
    cand, frozen = frames
    clean = cand.filter("text LIKE 'c%'")
    sure, others, _ = dedup.sifted(clean, frozen, F.col("text"), exact_rows=0)
    n = clean.count()
    assert sure.count() + others.count() == n
    assert others.count() < 0.02 * n
    plan = sure._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_edges(spark, frames):
    cand, frozen = frames
    assert dedup.without_leakage(cand, frozen.limit(0), F.col("text"), exact_rows=0).count() == 6000
    assert dedup.without_leakage(cand.limit(0), frozen, F.col("text"), exact_rows=0).count() == 0
    assert bloom.blocks_for(0) == 1 and bloom.blocks_for(1600) == 100
    assert bloom.blocks_for(20_000_000) == bloom.MOST_BLOCKS and bloom.blocks_for(10**9) is None
    assert bloom.bloom_table(frozen, "text", 9).count() == 9
