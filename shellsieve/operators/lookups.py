"""Label tables joined back by text: teacher labels, caches, truth, arbiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.filters import bare


def digest(key: str) -> Column:
    """Sixteen bytes of sha256 that stand for a text of any length in shuffles; null for null."""
    return F.substring(F.unhex(X.sha256(F.col(key).cast("string"))), 1, 16)


def last_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row per key: the last one in ``order`` wins (a reloaded cache). Texts are grouped by their digest; null is a key."""
    by = digest(key) if df.schema[key].dataType.typeName() == "string" else F.col(key)
    return (df.groupBy(by.alias("_by")).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
            .select(*[F.col(f"_row.{c}") for c in df.columns]))


def lookup(df: DataFrame, table: DataFrame, key: str, order: list[Column | str], found: str = "found") -> DataFrame:
    """Left join on a many-to-one table by the digest of ``key``, its last duplicate
    winning; ``found`` marks the rows that had a match."""
    right = last_per_key(table.withColumn("_digest", digest(key)).drop(key), "_digest", order).withColumn(found, F.lit(True))
    joined = df.withColumn("_digest", digest(key)).join(right, "_digest", "left").drop("_digest")
    return joined.withColumn(found, F.coalesce(found, F.lit(False)))


def cache_marked(wanted: DataFrame, cache: DataFrame, key: str, found: str = "_found") -> DataFrame:
    """All wanted rows with the cached columns and whether they were ``found``; one join by digest."""
    right = cache.withColumns({"_digest": digest(key), found: F.lit(True)}).drop(key)
    joined = wanted.withColumn("_digest", digest(key)).join(right, "_digest", "left").drop("_digest")
    return joined.withColumn(found, F.coalesce(found, F.lit(False)))


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, rows still to be labelled)."""
    marked = cache_marked(wanted, cache, key)
    return marked.filter("_found").drop("_found"), marked.filter("NOT _found").select(*wanted.columns)


def truth_with_verdict(truth: DataFrame, annotated: DataFrame, command: str = "command") -> DataFrame:
    """Truth rows with the model verdict of the same command (sha256); rows
    without one are skipped."""
    verdicts = (annotated.groupBy(F.col("_command_sha256"))
                .agg(F.max_by("model_verdict", F.struct("_order")).alias("model_verdict")))
    return truth.withColumn("_command_sha256", X.sha256(F.col(command))).join(verdicts, "_command_sha256")


def arbiter_counts(ambiguous: DataFrame, arbiter: DataFrame, key: str = "text", truth: str = "gt",
                   verdict: str = "verdict", opinion: str = "arb_verdict") -> DataFrame:
    """How the arbiter decided per (truth, teacher) pair; no opinion is ``unknown``."""
    opinions = arbiter.select(digest(key).alias("_digest"), opinion)
    joined = ambiguous.withColumn("_digest", digest(key)).join(opinions, "_digest", "left")
    return (joined.groupBy(truth, bare(F.col(verdict)).alias("teacher"), F.coalesce(opinion, F.lit("unknown")).alias("arbiter"))
            .agg(F.count("*").alias("n")))


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the run whose name sorts last."""
    return df.filter(F.col(run) == df.agg(F.max(run)).scalar())


def attck_by_join(df: DataFrame, key: list[str], actions: str, rules: DataFrame) -> DataFrame:
    """ATT&CK sets from a rule *table* ``(id, tactics, techniques)``.

    For the built-in taxonomy the bit form in ``functions.decide`` needs no
    join; this is for rule tables that are data. Unknown actions are ignored.
    """
    pairs = df.select(*key, F.explode_outer(actions).alias("id")).join(rules.select("id", "tactics", "techniques"), "id", "left")
    tagged = pairs.select(*key, F.explode_outer(F.concat(
        F.transform(F.coalesce("tactics", F.array().cast("array<string>")), lambda t: F.struct(F.lit(0).alias("k"), t.alias("v"))),
        F.transform(F.coalesce("techniques", F.array().cast("array<string>")), lambda t: F.struct(F.lit(1).alias("k"), t.alias("v"))))).alias("x"))
    return tagged.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.when(F.col("x.k") == 0, F.col("x.v")))).alias("tactics"),
        F.sort_array(F.collect_set(F.when(F.col("x.k") == 1, F.col("x.v")))).alias("techniques"))
