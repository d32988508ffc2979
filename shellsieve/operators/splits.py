"""Leak-free train/validation/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.operators.ranking import assign_by_hash_rank, first_per_group, hash_order
from shellsieve.taxonomy import TAXONOMY, Taxonomy


def share(ratio: float) -> Column:
    """``max(1, int(n * ratio))`` rows."""
    return F.greatest(F.lit(1).cast("bigint"), (F.col("n") * F.lit(float(ratio))).cast("bigint"))


def stratified(df: DataFrame, unique_key: str = "text", stratum: str = "verdict", val_ratio: float = 0.08,
               test_ratio: float = 0.08, seed: int = 42, hashed: str | None = None) -> DataFrame:
    """Per verdict: test first, then validation, the rest is train.

    The frame is scanned three times; if it is costly, materialise it first.
    """
    test = share(test_ratio)
    return assign_by_hash_rank(df, unique_key=unique_key, strata=[stratum], cuts=[test, test + share(val_ratio)],
                               labels=["test", "val", "train"], seed=seed, few_strata=True, hashed=hashed)


def holdout(df: DataFrame, unique_key: str = "text", val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Additions: ``max(1, int(n * ratio))`` rows to validation, the rest to train."""
    return assign_by_hash_rank(df, unique_key=unique_key, strata=[], cuts=[share(val_ratio)],
                               labels=["val", "train"], seed=seed)


def claim_floor(assigned: DataFrame, unique_key: str = "text", actions: str = "actions", split: str = "split",
                min_test: int = 20, seed: int = 42, hashed: str | None = None, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Move train rows to test until every action has ``min_test`` test rows.

    Actions take turns in taxonomy order and claim the earliest unclaimed train
    rows (hash order). How many an action may claim depends only on the test
    set before any claim. All actions together claim at most
    ``len(actions) * min_test`` rows, so only that many first train rows of an
    action can matter: the claiming step sees a table of constant size.

    The frame is scanned three times; if it is costly, materialise it first.
    """
    ids = tax.action_ids
    most = len(ids) * min_test
    pos = F.element_at(F.create_map(*[x for i, a in enumerate(ids) for x in (F.lit(a), F.lit(i))]), F.col("_a"))
    # an action listed twice in a row counts twice in test, but is one candidate
    order = F.col(hashed) if hashed else hash_order(F.col(unique_key), seed)
    listed = (assigned.select(F.col(unique_key).alias("_id"), order.alias("_h"), F.col(split).alias("_s"), F.explode(actions).alias("_a"))
              .filter(F.col("_a").isin(*ids)).withColumn("_p", pos))
    have = listed.filter(F.col("_s") == "test").groupBy("_p").agg(F.count("*").alias("n"))
    candidates = first_per_group(
        listed.filter(F.col("_s") == "train").select("_id", "_h", "_p").distinct(), ["_p"], ["_h", "_id"], most)

    id_type = assigned.schema[unique_key].dataType.simpleString()
    n_actions = len(ids)

    def claim(pdf):
        counts = pdf[pdf["kind"] == 0].set_index("_p")["n"].to_dict()
        queue = pdf[pdf["kind"] == 1].sort_values(["_h", "_id"], kind="stable")
        taken = []
        seen = set()
        for p in range(n_actions):
            deficit = min_test - int(counts.get(p, 0))
            for row_id in queue.loc[queue["_p"] == p, "_id"]:
                if deficit <= 0:
                    break
                if row_id not in seen:
                    seen.add(row_id)
                    taken.append(row_id)
                    deficit -= 1
        return queue.iloc[0:0][["_id"]].reindex(range(len(taken))).assign(_id=taken)

    work = (have.select(F.lit(0).alias("kind"), "_p", "n", F.lit(None).cast("string").alias("_h"),
                        F.lit(None).cast(id_type).alias("_id"))
            .unionByName(candidates.select(F.lit(1).alias("kind"), "_p", F.lit(0).cast("bigint").alias("n"), "_h", "_id")))
    claimed = work.groupBy().applyInPandas(claim, f"_id {id_type}").withColumn("_claimed", F.lit(True))
    # at most ``most`` ids
    return (assigned.join(F.broadcast(claimed), F.col(unique_key) == F.col("_id"), "left")
            .withColumn(split, F.when(F.col("_claimed"), "test").otherwise(F.col(split)))
            .drop("_id", "_claimed"))


def merge_additions(base: DataFrame, additions: DataFrame, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Train and validation grow by the held-out additions; test stays frozen."""
    return base.unionByName(holdout(additions, val_ratio=val_ratio, seed=seed), allowMissingColumns=True)
