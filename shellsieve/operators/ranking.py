"""Exact ranks over few or hot groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.session import materialise

# Up to this rank Spark limits each group on the map side by itself
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Rows one task sorts when a table is ranked range by range.
ROWS_PER_RANGE = 1_000_000


def hash_order(key: Column, seed: int | str = 42) -> Column:
    """Deterministic pseudo-random order: the md5 text of ``key#seed``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def assign_by_hash_rank(df: DataFrame, *, unique_key: str, strata: list[str], cuts: list[Column],
                        labels: list[str], seed: int | str = 42, out: str = "split",
                        prefix: int = 4, few_strata: bool = False, hashed: str | None = None) -> DataFrame:
    """Cut each stratum, ordered by the hash of ``unique_key``, at exact ranks.

    ``hashed`` names a column that already holds that hash.

    ``cuts[i]`` is an expression over ``n`` (rows of the stratum): rows of rank
    up to it get ``labels[i]``, the rest ``labels[-1]``.

    Only counts per hash prefix are shuffled. The bucket that holds a cut is
    looked at once more to find the hash value at that rank, and all rows are
    then labelled by comparing with it, in place.

    ``few_strata`` states that the strata come from a fixed domain (such as the
    three verdicts); only then is the table of cut values broadcast.
    """
    marked = df.withColumn("_h", F.col(hashed) if hashed else hash_order(F.col(unique_key), seed))
    bucket = F.substring("_h", 1, prefix).alias("_b")
    counts = marked.groupBy(*strata, bucket).agg(F.count("*").alias("_c"))

    # at most 16**prefix rows per stratum
    group = Window.partitionBy(*strata)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumns({"n": F.sum("_c").over(group), "_cum": F.sum("_c").over(running)})
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.least(c.cast("bigint"), F.col("n")).alias("rank"))
                        for i, c in enumerate(cuts)])
    cut_buckets = (cumulated.withColumn("_t", F.explode(targets))
                   .filter((F.col("_t.rank") <= F.col("_cum")) & (F.col("_t.rank") > F.col("_cum") - F.col("_c")))
                   .select(*strata, "_b", F.col("_t.i").alias("_i"),
                           (F.col("_t.rank") - (F.col("_cum") - F.col("_c"))).alias("_local")))

    hint = F.broadcast if few_strata else (lambda frame: frame)
    wanted = cut_buckets.groupBy(*strata, "_b").agg(F.max("_local").alias("_max"))
    inside = (null_safe_join(marked.select(*strata, bucket, "_h"), hint(wanted), [*strata, "_b"])
              .withColumn("_rn", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h")))
              .filter(F.col("_rn") <= F.col("_max")))
    values = (null_safe_join(inside, hint(cut_buckets), [*strata, "_b"])
              .filter(F.col("_rn") == F.col("_local"))
              .groupBy(*strata)
              .agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_cut{i}") for i in range(len(cuts))]))

    if strata:
        joined = null_safe_join(marked, hint(values), strata, "left")
        limits = [F.col(f"_cut{i}") for i in range(len(cuts))]
    else:  # one row of values: scalar subqueries, no join
        joined, limits = marked, [values.select(f"_cut{i}").scalar() for i in range(len(cuts))]
    label = F.lit(labels[-1])
    for name, limit in reversed(list(zip(labels, limits))):
        label = F.when(F.col("_h") <= limit, F.lit(name)).otherwise(label)
    return joined.withColumn(out, label).drop("_h", *[f"_cut{i}" for i in range(len(cuts))])


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int, rank: str | None = None,
                    salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (a total order).

    Small ``n`` is limited on the map side by Spark. For larger ``n`` a first
    round takes the first ``n`` of every salted part, so a hot group is spread
    over ``salts`` tasks; what it removes cannot be among the first ``n``.
    """
    name = rank or "_rn"
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= n).drop("_part", "_salt")
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def boundaries(df: DataFrame, column: str, ranges: int = 256) -> list[float]:
    """At most ``ranges - 1`` increasing cut points. Where they fall only
    balances the work, any list gives the same result."""
    qs = df.select(F.col(column).cast("double").alias("s")).approxQuantile(
        "s", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
    return sorted(set(qs))


def range_of(value: Column, cuts: list[float]) -> Column:
    """Index of the range a value falls in, by bisection: log2(cuts) comparisons."""
    def bisect(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), bisect(lo, mid)).otherwise(bisect(mid + 1, hi))
    return bisect(0, len(cuts))


def in_ranges(df: DataFrame, column: str, out: str = "range", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``df``, written once, with the number of the range its ``column`` falls in.

    Ranges rise with the column and equal values share one; there are as many as
    the table has times ``rows`` rows, so the work of one of them does not grow.
    """
    written = materialise(df, "ranked")
    n = -(-written.count() // rows)
    if n <= 1:
        return written.withColumn(out, F.lit(0))
    return materialise(written.repartitionByRange(n, column).withColumn(out, F.spark_partition_id()), "ranges")


def rank_in_group(df: DataFrame, group: list[str], order: str, out: str = "rank", cuts: list[float] | None = None,
                  rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``row_number`` by a unique number, for groups of any size.

    A group is ranked range by range; each range is then offset by the counts of
    the ranges before it. ``cuts`` puts given bounds in place of counted ranges.
    """
    if cuts is None:
        ranged = in_ranges(df, order, "_range", rows)
    else:
        ranged = df.withColumn("_range", range_of(F.col(order).cast("double"), cuts))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_range").agg(F.count("*").alias("_c"))
               .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c"))
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order)))
    return (null_safe_join(local, offsets, [*group, "_range"])
            .withColumn(out, F.col("_before") + F.col("_rn")).drop("_range", "_rn", "_before"))


def group_slice(df: DataFrame, group: list[str], order: list[Column | str], offset: int, count: int) -> DataFrame:
    """Rows ``offset+1 .. offset+count`` of each group."""
    ranked = first_per_group(df, group, order, offset + count, rank="_pos")
    return ranked.filter(F.col("_pos") > offset).drop("_pos")


def head(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a fixed order (smoke runs, error samples)."""
    return df.orderBy(*order).limit(n)


def sample_per_group(df: DataFrame, group: list[str], unique_key: str, n: int, seed: int | str = 0,
                     few_groups: bool = False) -> DataFrame:
    """Fixed-seed sample without replacement, at most ``n`` rows per group."""
    marked = assign_by_hash_rank(df, unique_key=unique_key, strata=group, cuts=[F.lit(n)],
                                 labels=["in", "out"], seed=seed, out="_s", few_strata=few_groups)
    return marked.filter(F.col("_s") == "in").drop("_s")
