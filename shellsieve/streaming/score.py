"""Line stream in, decision out: the batch functions on a streaming frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shellsieve.functions.decide import decide, with_attck
from shellsieve.operators.scoring import rule_logits
from shellsieve.taxonomy import TAXONOMY, Taxonomy


def clean_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trailing CR/LF removed, empty lines skipped."""
    return lines.withColumn(value, F.regexp_replace(value, r"[\r\n]+\z", "")).filter(F.length(value) > 0)


def score_lines(lines: DataFrame, logits: Column | None = None, rules=None, value: str = "value",
                tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Stateless scoring; works on batch and streaming frames alike."""
    scored = clean_lines(lines, value).withColumn(
        "logits", logits if logits is not None else rule_logits(F.col(value), rules or [], tax=tax))
    return with_attck(decide(scored, tax=tax), tax=tax)


def run_available(decided: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, commit it to Parquet, stop. Both paths belong in a
    folder all executors share."""
    return (decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
