"""Long inputs: overlapping token windows and the merge of their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.taxonomy import TAXONOMY, Taxonomy

# Window and step in tokens; token counts up to which a text is
# scored whole by the single predictor (318) and by the batch evaluators (120).
WINDOW, STEP = 120, 90
PREDICT_LIMIT, BATCH_LIMIT = 318, 120


def window_starts(n: Column, window: int = WINDOW, step: int = STEP, limit: int = BATCH_LIMIT) -> Column:
    """Start offsets; the last window is the first one that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(float(step))).cast("int")) * step
    return F.when(n <= limit, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def windows(df: DataFrame, tokens: str = "tokens", window: int = WINDOW, step: int = STEP,
            limit: int = BATCH_LIMIT, part: Callable[[Column], Column] = lambda own: own) -> DataFrame:
    """One row per window: ``seg`` (0-based), ``start``, ``seg_tokens`` (what ``part`` makes of the window's tokens).

    A text of at most ``limit`` tokens stays whole. The windows are cut before the rows
    are made, so no row carries more than its own tokens.
    """
    n = F.size(tokens)

    def one(start: Column, seg: Column) -> Column:
        own = F.when(n <= limit, F.col(tokens)).otherwise(F.slice(tokens, start + 1, window))
        return F.struct(seg.alias("seg"), start.alias("start"), part(own).alias("seg_tokens"))

    return df.select(*[c for c in df.columns if c != tokens], F.inline(F.transform(window_starts(n, window, step, limit), one)))


def truncate(tokens: Column, budget: int) -> Column:
    return F.slice(tokens, 1, budget)


def merge_scores(df: DataFrame, key: list[str], seg: str = "seg", logits: str = "logits",
                 verdict_merge: str = "most_malicious", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """One score vector per record from the vectors of its windows.

    Actions take the maximum. The verdict logits are those of the window with
    the highest P(malicious), the first one on ties (``most_malicious``), or the
    maximum per label as well (``max_logit``).
    """
    if verdict_merge not in ("most_malicious", "max_logit"):
        raise ValueError(f"unknown verdict merge: {verdict_merge}")
    nv = len(tax.verdict_ids)
    best = [F.expr(f"max(get({logits}, {i}))").alias(f"_m{i}") for i in range(tax.size)]
    if verdict_merge == "max_logit":
        merged = df.groupBy(*key).agg(F.count("*").alias("n_segments"), *best)
        verdict = [f"_m{i}" for i in range(nv)]
    else:
        p_bad = F.expr(V.softmax(V.items(logits, 0, nv))[nv - 1])
        chosen = F.max_by(F.slice(logits, 1, nv), F.struct(p_bad, -F.col(seg))).alias("_v")
        merged = df.groupBy(*key).agg(F.count("*").alias("n_segments"), chosen, *best[nv:])
        verdict = V.items("_v", 0, nv)
    actions = [f"_m{i}" for i in range(nv, tax.size)]
    return merged.select(*key, "n_segments", F.expr(V.array(verdict + actions)).alias(logits))
