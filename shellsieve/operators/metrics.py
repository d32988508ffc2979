"""Evaluation: set metrics, confusion counts, binary rates, group reports.

Two conventions for empty denominators exist side by side: the label metrics
give 0, the binary metrics give NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.functions.decide import verdict_rank
from shellsieve.operators.filters import bare
from shellsieve.taxonomy import BENIGN, MALICIOUS, SUSPICIOUS, TAXONOMY, Taxonomy

def _nan() -> Column:
    return F.lit(float("nan"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 with the 0-for-empty convention."""
    p = tp / F.greatest(F.lit(1), tp + fp)
    r = tp / F.greatest(F.lit(1), tp + fn)
    return {"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(F.lit(1e-9), p + r)}


def with_prf(df: DataFrame) -> DataFrame:
    """Add precision/recall/f1 to a frame that has tp, fp, fn."""
    return df.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def set_counts(truth: Column, pred: Column) -> dict[str, Column]:
    """Per-row tp/fp/fn of two label sets."""
    return {"tp": F.size(F.array_intersect(truth, pred)), "fp": F.size(F.array_except(pred, truth)),
            "fn": F.size(F.array_except(truth, pred))}


def mask_counts(truth: Column, pred: Column) -> dict[str, Column]:
    """The same for sets kept as bits."""
    both = truth.bitwiseAND(pred)
    return {"tp": F.bit_count(both), "fp": F.bit_count(pred) - F.bit_count(both),
            "fn": F.bit_count(truth) - F.bit_count(both)}


def micro(df: DataFrame, truth: str = "true_mask", pred: str = "action_mask", group: list[str] | None = None) -> DataFrame:
    """Micro precision/recall/F1 over action sets (bit columns)."""
    per_row = df.withColumns(mask_counts(F.col(truth), F.col(pred)))
    totals = per_row.groupBy(*(group or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return with_prf(totals)


def per_label(df: DataFrame, truth: str = "true_labels", pred: str = "actions", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """tp/fp/fn, P/R/F1 and support per action; labels nobody used appear with 0.

    Only labels present in a row are expanded, not all of the taxonomy.
    """
    t, p = F.coalesce(F.col(truth), F.array().cast("array<string>")), F.coalesce(F.col(pred), F.array().cast("array<string>"))
    rows = (df.select(t.alias("_t"), p.alias("_p")).withColumn("label", F.explode(F.array_union("_t", "_p")))
            .select("label", F.array_contains("_t", F.col("label")).alias("t"), F.array_contains("_p", F.col("label")).alias("p")))
    counts = rows.groupBy("label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"),
                                       F.count_if(~F.col("t") & F.col("p")).alias("fp"),
                                       F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    labels = tax.to_df(df.sparkSession).filter(F.col("grp") == "action").select("pos", F.col("id").alias("label"))
    full = labels.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return with_prf(full).withColumn("support", F.col("tp") + F.col("fn"))


def macro_f1(per_label_df: DataFrame) -> DataFrame:
    """Plain mean of the label F1s, labels without support included."""
    return per_label_df.agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
                            F.avg("recall").alias("macro_recall"), F.count("*").alias("n_labels"))


def flat_micro(df: DataFrame, scores: str, targets: str, size: int = TAXONOMY.size, threshold: float = 0.5) -> DataFrame:
    """Element-wise micro metrics over aligned vectors; ``> threshold`` on both."""
    above = lambda column: V.mask_of_flags([f"{x} > {V.lit(threshold)}" for x in V.items(column, 0, size)])
    return micro(df.select(F.expr(above(scores)).alias("_p"), F.expr(above(targets)).alias("_t")), "_t", "_p")


def verdict_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of rows with the right verdict; a row without truth is wrong."""
    hit = F.coalesce((F.col(truth) == F.col(pred)).cast("int"), F.lit(0))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_right")).withColumn(
        "verdict_acc", F.col("n_right") / F.greatest(F.lit(1), F.col("n")))


def confusion(df: DataFrame, truth: str, pred: str, names=None) -> DataFrame:
    """Truth rows x predicted columns with a fixed set of columns."""
    names = names or [v.removeprefix("verdict.") for v in TAXONOMY.verdict_ids]
    counted = df.groupBy(F.col(truth).alias("truth"))
    return counted.agg(*[F.count_if(bare(F.col(pred)) == n).alias(f"pred_{n}") for n in names], F.count("*").alias("n"))


def recalls(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Strict and loose recall of malicious truth, non-benign recall of suspicious."""
    t, rank = bare(F.col(truth)), verdict_rank(F.col(pred))
    mal, sus = t == "malicious", t == "suspicious"
    out = df.agg(F.count_if(mal).alias("malicious_total"), F.count_if(mal & (rank == 2)).alias("malicious_strict"),
                 F.count_if(mal & (rank >= 1)).alias("malicious_loose"), F.count_if(sus).alias("suspicious_total"),
                 F.count_if(sus & (rank >= 1)).alias("suspicious_hit"))
    one = F.lit(1)
    return out.withColumns({
        "strict_recall": F.col("malicious_strict") / F.greatest(one, F.col("malicious_total")),
        "loose_recall": F.col("malicious_loose") / F.greatest(one, F.col("malicious_total")),
        "suspicious_recall": F.when(F.col("suspicious_total") > 0, F.col("suspicious_hit") / F.col("suspicious_total")),
    })


def binary_rates(df: DataFrame) -> DataFrame:
    """Rates from tp, fp, fn, tn counts; NaN on an empty denominator."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b == 0, _nan()).otherwise(a / b)
    step = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
                           "accuracy": ratio(tp + tn, tp + fp + fn + tn), "fpr": ratio(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    # NaN compares as the largest value in Spark, so it is tested by name
    empty = F.isnan(p) | F.isnan(r)
    return step.withColumn("f1", F.when(empty | (p + r == 0), _nan()).otherwise(2 * p * r / (p + r)))


def binary(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Counts and rates of a 0/1 prediction against a 0/1 truth."""
    y, p = F.col(truth) == 1, F.col(pred) == 1
    counts = df.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"), F.count_if(y).alias("positive"),
        F.count_if(~y).alias("negative"))
    return binary_rates(counts)


def source_report(df: DataFrame, source: str = "source", label: str = "label", verdict: str = "verdict",
                  mask: str = "action_mask", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Verdict mix per (source, label) and the rates that fit the label.

    Malicious sources get recalls, benign ones accuracy and false-positive
    rates, any other label (honeypot sessions) only the mix.
    """
    v = F.col(verdict)
    with_rule = 0
    for bits in tax.tactic_bits.values():
        with_rule |= bits
    counts = df.groupBy(source, label).agg(
        F.count("*").alias("n"), F.count_if(v == BENIGN).alias("n_benign"),
        F.count_if(v == SUSPICIOUS).alias("n_suspicious"), F.count_if(v == MALICIOUS).alias("n_malicious"),
        F.avg(F.bit_count(F.col(mask))).alias("mean_actions_active"),
        F.avg(F.expr(V.overlaps(mask, with_rule)).cast("int")).alias("attck_rule_hit_rate"))
    n, b, s, m = (F.col(c) for c in ("n", "n_benign", "n_suspicious", "n_malicious"))
    bad, good = F.col(label) == "malicious", F.col(label) == "benign"
    return counts.withColumns({
        "share_benign": b / n, "share_suspicious": s / n, "share_malicious": m / n,
        "malicious_recall": F.when(bad, m / n), "nonbenign_recall": F.when(bad, (m + s) / n),
        "benign_accuracy": F.when(good, b / n), "malicious_fpr": F.when(good, m / n),
        "suspicious_rate": F.when(good, s / n),
    })


def category_stats(df: DataFrame, category: str, verdict: str, p_malicious: Column) -> DataFrame:
    rank = verdict_rank(F.col(verdict))
    return df.groupBy(category).agg(
        F.count("*").alias("n"), F.avg((rank == 2).cast("int")).alias("malicious_recall"),
        F.avg((rank >= 1).cast("int")).alias("nonbenign_recall"), F.avg(p_malicious).alias("mean_p_malicious"))


def evasion_summary(df: DataFrame, dimensions: dict[str, str], verdict: str = "verdict", actions: str | None = None) -> DataFrame:
    """Counts per value of several columns in one pass over the rows.

    Each row yields one (dimension, value) pair per dimension and per detected
    action; the pairs are combined before they are shuffled.
    """
    pairs = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value"))
             for d, c in dimensions.items()]
    listed = F.array(*pairs)
    if actions:
        listed = F.concat(listed, F.transform(F.col(actions), lambda a: F.struct(F.lit("action").alias("dimension"), a.alias("value"))))
    v = F.col(verdict)
    return (df.select(v.alias("_v"), F.explode(listed).alias("_k")).groupBy("_k.dimension", "_k.value")
            .agg(F.count("*").alias("n"), F.count_if(F.col("_v") != MALICIOUS).alias("n_bypass"),
                 F.count_if(F.col("_v") == BENIGN).alias("n_strict"), F.count_if(F.col("_v") == SUSPICIOUS).alias("n_partial")))


def support_delta(before: DataFrame, after: DataFrame, labels: str = "true_labels", changed_only: bool = True,
                  prefix: str = "action.") -> DataFrame:
    """Rows per label before and after, one row per (changed) label."""
    both = (before.select(labels, F.lit(0).alias("phase")).unionByName(after.select(labels, F.lit(1).alias("phase"))))
    counts = (both.select("phase", F.explode(labels).alias("label")).filter(F.col("label").startswith(prefix)).groupBy("label")
              .agg(F.count_if(F.col("phase") == 0).alias("before"), F.count_if(F.col("phase") == 1).alias("after"))
              .withColumn("delta", F.col("after") - F.col("before")))
    return counts.filter(F.col("delta") != 0) if changed_only else counts


def relabel_report(df: DataFrame, before: str = "labels_before", after: str = "true_labels", split: str = "split",
                   watched=("action.web_shell", "action.keylog"), also_test: bool = False) -> DataFrame:
    """Rows, label counts before/after and drops per split."""
    aggs = [F.count("*").alias("n")]
    for label in watched:
        short = label.removeprefix("action.")
        aggs += [F.count_if(F.array_contains(before, label)).alias(f"{short}_before"),
                 F.count_if(F.array_contains(after, label)).alias(f"{short}_after"),
                 F.count_if(F.array_contains("dropped", label)).alias(f"{short}_dropped")]
    frozen = (F.col(split) == "test") & F.lit(not also_test)
    return df.groupBy(split).agg(*aggs).withColumn("frozen", frozen)


def split_sizes(df: DataFrame, split: str = "split", soft: str = "soft_v2") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col(soft).isNotNull()).alias("n_soft"))
