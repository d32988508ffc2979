"""The row-level decision: logits -> verdict, actions, ATT&CK, evasion flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.taxonomy import BENIGN, DEFAULT_THRESHOLD, MALICIOUS, SUSPICIOUS, TAXONOMY, Taxonomy

VERDICT_RANK = {BENIGN: 0, SUSPICIOUS: 1, MALICIOUS: 2}


def decide(df: DataFrame, logits: str = "logits", *, thresholds: dict[str, float] | None = None,
           score_space: str = "probability", verdict_digits: int | None = None,
           action_digits: int | None = None, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Add ``verdict``, ``verdict_probs``, ``action_probs``, ``action_mask``.

    ``score_space`` names what thresholds are compared with: probabilities, or
    the raw logits (there 0.5 means P = 0.62). ``verdict_digits`` and
    ``action_digits`` round the probabilities before they are compared, as
    some reports do (4 or 6 digits); None compares them as they are.
    """
    if score_space not in ("probability", "logit"):
        raise ValueError(f"unknown score space: {score_space}")
    thresholds = thresholds or {}
    nv = len(tax.verdict_ids)
    raw_v = V.items(logits, 0, nv)
    raw_a = V.items(logits, nv, tax.size)
    probs_v = V.rounded(V.softmax(raw_v), verdict_digits)
    probs_a = V.rounded([V.sigmoid(x) for x in raw_a], action_digits)
    wide = df.withColumns({"verdict_probs": F.expr(V.array(probs_v)), "action_probs": F.expr(V.array(probs_a))})

    # later expressions read the arrays just computed instead of repeating them
    ranked = V.items("verdict_probs", 0, nv) if score_space == "probability" else raw_v
    scored = V.items("action_probs", 0, len(tax.action_ids)) if score_space == "probability" else raw_a
    flags = [f"{s} >= {V.lit(thresholds.get(a, DEFAULT_THRESHOLD))}" for a, s in zip(tax.action_ids, scored)]
    return wide.withColumns({
        "verdict": F.expr(V.pick(V.argmax_index(ranked), tax.verdict_ids)),
        "action_mask": F.expr(V.mask_of_flags(flags)),
    })


def with_attck(df: DataFrame, mask: str = "action_mask", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Add ``actions`` (taxonomy order) and the sorted ``tactics``/``techniques``."""
    return df.withColumns({
        "actions": V.actions_of_mask(mask, tax),
        "tactics": V.tactics_of_mask(mask, tax),
        "techniques": V.techniques_of_mask(mask, tax),
    })


def with_evasion_flags(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    v = F.col(verdict)
    return df.withColumns({
        "verdict_bypass": v != MALICIOUS,
        "bypass_type": F.when(v != MALICIOUS, "verdict_not_malicious").otherwise("detected_malicious"),
        "strict_bypass": v == BENIGN,
        "partial_evasion": v == SUSPICIOUS,
    })


def annotate(df: DataFrame, logits: str = "logits", thresholds: dict[str, float] | None = None,
             tax: Taxonomy = TAXONOMY) -> DataFrame:
    """The full red-team record: decision at 6 digits, flags, and the logits
    kept as a map so that thresholds can be moved without scoring again."""
    decided = decide(df, logits, thresholds=thresholds, verdict_digits=6, action_digits=6, tax=tax)
    kept = V.array(V.rounded(V.items(logits, 0, tax.size), 6))
    return with_evasion_flags(with_attck(decided, tax=tax)).withColumn(
        "raw_logits", F.expr(f"map_from_arrays({V.id_array(tax.all_ids)}, {kept})"))


def prob_maps(df: DataFrame, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Turn the probability arrays into label -> probability maps (output edge)."""
    def to_map(ids, column: str) -> Column:
        return F.expr(f"map_from_arrays({V.id_array(ids)}, {column})")
    return df.withColumns({
        "verdict_probs": to_map(tax.verdict_ids, "verdict_probs"),
        "action_probs": to_map(tax.action_ids, "action_probs"),
    })


def verdict_rank(verdict: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in VERDICT_RANK.items():
        expr = F.when(verdict == name, F.lit(rank)).otherwise(expr)
    return expr


def strict_alert(verdict: Column) -> Column:
    return (verdict_rank(verdict) == 2).cast("int")


def loose_alert(verdict: Column) -> Column:
    return (verdict_rank(verdict) >= 1).cast("int")


def score_alert(score: Column, threshold: float) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def malicious_weight(label: Column, target: Column, weight: float = 1.3) -> Column:
    """Loss weight of one (row, label): positives of the malicious verdict count more."""
    return F.when((label == MALICIOUS) & (target > 0.5), F.lit(weight)).otherwise(F.lit(1.0))
