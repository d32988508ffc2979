"""ROC-AUC and PR-AUC from score counts, exact and without a global sort task.

Rows are first reduced to (score, positives, negatives). A global running sum
over the scores would be one task, so the scores are cut into ranges: each range
is summed on its own, and ranges are then offset by the totals of the ones
before them (one small row per range). Tied scores share one rank, so results
do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.operators.ranking import ROWS_PER_RANGE, boundaries, in_ranges, range_of  # noqa: F401


def score_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    y = F.col(truth) == 1
    return (df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def ranged_counts(df: DataFrame, truth: str, score: str, cuts: list[float] | None = None, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Score counts with their ``range``: counted ranges of a written table, or those between ``cuts``."""
    counts = score_counts(df, truth, score)
    if cuts is None:
        return in_ranges(counts, "score", rows=rows)
    return counts.withColumn("range", range_of(F.col("score"), cuts))


def running_counts(ranged: DataFrame, descending: bool = True) -> DataFrame:
    """Add ``tp``/``fp``: counts of this score and all that come before it."""
    order = F.col("range").desc() if descending else F.col("range").asc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = (ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
               .withColumns({"p0": F.coalesce(F.sum("p").over(before), F.lit(0)),
                             "n0": F.coalesce(F.sum("n").over(before), F.lit(0))}).drop("p", "n"))
    inner = F.col("score").desc() if descending else F.col("score").asc()
    within = Window.partitionBy("range").orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumns({"ptp": F.sum("pos").over(within), "pfp": F.sum("neg").over(within)})
            .join(offsets, "range")
            .withColumns({"tp": F.col("ptp") + F.col("p0"), "fp": F.col("pfp") + F.col("n0")})
            .drop("ptp", "pfp", "p0", "n0"))


def roc_auc(df: DataFrame, truth: str, score: str, cuts: list[float] | None = None) -> DataFrame:
    """Rank-sum ROC-AUC; NaN when only one class is present."""
    return roc_of_counts(ranged_counts(df, truth, score, cuts))


def roc_of_counts(ranged: DataFrame) -> DataFrame:
    """The same of ``ranged_counts``. A range contributes through three sums only, so no join back is needed."""
    below = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    parts = local.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
                                       F.sum(F.col("pos") * (F.col("_below") + 0.5 * F.col("neg"))).alias("u"))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = (parts.withColumn("n0", F.coalesce(F.sum("n").over(lower), F.lit(0)))
             .agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"),
                  F.sum(F.col("u") + F.col("p") * F.col("n0")).alias("u")))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select("n_pos", "n_neg", F.when(pairs == 0, F.lit(float("nan"))).otherwise(F.col("u") / pairs).alias("roc_auc"))


def pr_auc(df: DataFrame, truth: str, score: str, cuts: list[float] | None = None) -> DataFrame:
    """Sum of precision times recall step from the top score; NaN without positives."""
    return pr_of_counts(ranged_counts(df, truth, score, cuts))


def pr_of_counts(ranged: DataFrame) -> DataFrame:
    """The same of ``ranged_counts``."""
    points = running_counts(ranged)
    total = points.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
                       F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("a"))
    return total.select("n_pos", "n_neg", F.when(F.col("n_pos") == 0, F.lit(float("nan"))).otherwise(F.col("a") / F.col("n_pos")).alias("pr_auc"))
