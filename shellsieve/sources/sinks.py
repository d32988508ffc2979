"""Sinks. Spark's committer makes each write all-or-nothing; no path that is
being read is ever overwritten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.operators.dedup import without_leakage
from shellsieve.taxonomy import TAXONOMY, Taxonomy


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_annotated(df: DataFrame, path: str, verdict: str = "verdict") -> None:
    """All annotated rows once, laid out by verdict: every subset the reports
    use (bypasses, benign, suspicious, detected) is a partition filter."""
    df.write.partitionBy(verdict).parquet(path)


def annotated_subset(spark: SparkSession, path: str, subset: str, verdict: str = "verdict") -> DataFrame:
    v = F.col(verdict)
    chosen = {"bypasses": v.isin("verdict.benign", "verdict.suspicious"), "benign_bypasses": v == "verdict.benign",
              "suspicious_evasions": v == "verdict.suspicious", "detected_malicious": v == "verdict.malicious"}
    return spark.read.parquet(path).filter(chosen[subset])


def write_splits(df: DataFrame, path: str, split: str = "split", tax: Taxonomy = TAXONOMY) -> None:
    """``split=train|val|test`` folders of JSON lines plus the label descriptions."""
    df.write.partitionBy(split).json(f"{path}/rows")
    (tax.to_df(df.sparkSession).select("pos", F.col("id").alias("label"), "description").orderBy("pos").coalesce(1)
     .write.json(f"{path}/labels_desc"))


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row frame of structs and maps as one nested JSON object."""
    df.coalesce(1).write.json(path)


def write_predictions(df: DataFrame, path: str, source: str = "source") -> None:
    df.write.partitionBy(source).json(path)


def append_new(df: DataFrame, path: str, schema: str, key: str = "text") -> None:
    """Append the rows whose key the target does not hold yet, each key once."""
    spark = df.sparkSession
    existing = spark.read.schema(schema).json(path)
    order = [c for c in df.columns if c != key] or [key]
    without_leakage(df, existing, F.col(key), within_batch=order).write.mode("append").json(path)


def write_cache(old: DataFrame, new: DataFrame, path: str, key: str = "text") -> None:
    """Union of old and new labels at a new path; a new label replaces an old one."""
    from shellsieve.operators.lookups import last_per_key
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    last_per_key(both, key, ["_gen"]).drop("_gen").write.json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array file of objects per task; a task without rows writes an empty array. Null fields are left out."""
    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = True
        for batch in batches:
            if len(batch):
                signs = ["," if i or not empty else "[" for i in range(len(batch))]
                yield pd.DataFrame({"value": signs + batch["value"]})
                empty = False
        yield pd.DataFrame({"value": ["[]" if empty else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(bracketed, "value string").write.text(path)
