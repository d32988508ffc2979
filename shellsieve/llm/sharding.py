"""K-d tree partitioning of documents into shards of nearly equal bytes.

Points are groups of equal texts, weighted by the bytes of all their copies, so
copies share a shard. A node that has to yield several leaves is cut along its
widest metadata dimension (first id, length, language, source, each scaled to the
whole table) at the weighted quantile that shares its bytes among the leaves. The
quantile is found by descending through bits of the key: every pass sums weights
per node and digit in Spark and returns one row per node to the driver.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellsieve.session import materialise

#: Key of a point in a dimension: 20 bits of position, then 43 bits of the text's hash for ties.
POSITION_BITS, TIE_BITS, DIGIT_BITS = 20, 43, 12
#: A digit is fine enough once it holds no more than this share of its node.
CLOSE = 1e-3


def sized(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Narrow table of the documents: id, size, crc, digest and metadata. Null text counts as empty: size 1."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(body, "UTF-8"))).alias("_digest"),
                       F.char_length(body).alias("_chars"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"))


def points(docs: DataFrame) -> DataFrame:
    """One weighted point per text: coordinates are that of its copy with the smallest id, nulls count as 0."""
    return (docs.groupBy("_digest")
            .agg(F.sum("size").alias("_w"), F.min("_key").alias("_id"), F.max("_chars").alias("_len"),
                 F.min("_lang").alias("_l"), F.min("_source").alias("_s"))
            .select("_digest", "_w", F.coalesce(F.col("_id").cast("double"), F.lit(0.0)).alias("d0"),
                    F.log1p(F.col("_len").cast("double")).alias("d1"),
                    F.pmod(F.xxhash64(F.coalesce("_l", F.lit(""))), F.lit(1 << 20)).cast("double").alias("d2"),
                    F.pmod(F.xxhash64(F.coalesce("_s", F.lit(""))), F.lit(1 << 20)).cast("double").alias("d3"),
                    F.shiftrightunsigned(F.xxhash64("_digest"), 64 - TIE_BITS).alias("_tie")))


DIMENSIONS = ("d0", "d1", "d2", "d3")


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    import pandas as pd
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)


def key_of(dim, low: dict, high: dict):
    """63-bit key of a row in the dimension named by the column ``dim``."""
    def scaled(d):
        width = high[d] - low[d]
        return F.lit(0.0) if width <= 0 else (F.col(d) - F.lit(low[d])) / F.lit(width)
    position = F.lit(0.0)
    for i, d in enumerate(DIMENSIONS):
        position = F.when(dim == i, scaled(d)).otherwise(position)
    top = (1 << POSITION_BITS) - 1
    return F.shiftleft(F.floor(position * top).cast("bigint"), TIE_BITS).bitwiseOR(F.col("_tie"))


def weighted_cuts(spark: SparkSession, placed: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """By node, the largest key of its left part, so that the left part weighs about ``goal``.

    ``placed`` has (node, _w, _key63); ``nodes`` has the goal and total of each.
    """
    bits = POSITION_BITS + TIE_BITS
    state = {n: {"prefix": 0, "left": 0.0} for n in nodes}
    cuts: dict[int, int] = {}
    shift = bits
    while state and shift > 0:
        width = min(DIGIT_BITS, shift)
        known = small_table(spark, [{"node": n, "prefix": s["prefix"], "goal": nodes[n]["goal"] - s["left"]} for n, s in state.items()],
                            "node bigint, prefix bigint, goal double")
        inside = (placed.join(F.broadcast(known), "node").filter(F.shiftrightunsigned("_key63", shift) == F.col("prefix"))
                  .withColumn("digit", F.shiftrightunsigned("_key63", shift - width).bitwiseAND(F.lit((1 << width) - 1))))
        sums = inside.groupBy("node", "goal", "digit").agg(F.sum("_w").alias("w"))  # at most 4,096 digits a node
        running = Window.partitionBy("node").orderBy("digit")
        upto = sums.withColumn("cum", F.sum("w").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        crossing = (upto.withColumn("_last", F.lead("cum").over(running).isNull())
                    .filter((F.col("cum") >= F.col("goal")) & (F.col("cum") - F.col("w") < F.col("goal"))
                            | F.col("_last") & (F.col("cum") < F.col("goal"))))
        rows = crossing.select("node", "digit", "w", (F.col("cum") - F.col("w")).alias("before")).collect()
        shift -= width
        for r in rows:
            s, node = state[r["node"]], nodes[r["node"]]
            s["prefix"], s["left"] = s["prefix"] << width | r["digit"], s["left"] + r["before"]
            if r["w"] <= CLOSE * node["total"] or shift == 0:
                # the whole digit goes to the side that comes nearer to the goal
                nearer = abs(s["left"] + r["w"] - node["goal"]) <= abs(s["left"] - node["goal"])
                cuts[r["node"]] = ((s["prefix"] + nearer) << shift) - 1
                del state[r["node"]]
    return cuts


def split(weights: DataFrame, leaves: int) -> tuple[DataFrame, int]:
    """Points with their leaf (0 .. leaves - 1). One pass for ranges and one to three for the quantile per level."""
    spark = weights.sparkSession
    bounds = weights.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))],
                         F.sum("_w").alias("total")).first()
    if not bounds["total"]:
        return weights.withColumn("leaf", F.lit(0)), 0
    low, high = {d: bounds[f"low_{d}"] for d in DIMENSIONS}, {d: bounds[f"high_{d}"] for d in DIMENSIONS}
    frame = weights.withColumn("node", F.lit(1).cast("bigint"))
    want, first = {1: leaves}, {1: 0}
    while any(n > 1 for n in want.values()):
        stats = (frame.groupBy("node").agg(F.sum("_w").alias("total"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS
                                                                        for n, f in (("low", F.min), ("high", F.max))]).collect())
        cutting = {}
        for r in stats:
            if want[r["node"]] > 1:
                spread = [(r[f"high_{d}"] - r[f"low_{d}"]) / (high[d] - low[d]) if high[d] > low[d] else 0.0 for d in DIMENSIONS]
                n = want[r["node"]]
                cutting[r["node"]] = {"dim": max(range(len(spread)), key=lambda i: (spread[i], -i)), "total": float(r["total"]),
                                      "goal": float(r["total"]) * (n // 2) / n}
        dims = small_table(spark, [{"node": n, "dim": c["dim"]} for n, c in cutting.items()], "node bigint, dim int")
        placed = frame.join(F.broadcast(dims), "node").withColumn("_key63", key_of(F.col("dim"), low, high))
        cuts = weighted_cuts(spark, placed.select("node", "_w", "_key63"), cutting)
        moves = small_table(spark, [{"node": n, "dim": c["dim"], "cut": cuts[n]} for n, c in cutting.items()],
                            "node bigint, dim int, cut bigint")
        frame = (frame.join(F.broadcast(moves), "node", "left")
                 .withColumn("node", F.when(F.col("dim").isNull(), F.col("node") * 2)
                             .otherwise(F.col("node") * 2 + (key_of(F.col("dim"), low, high) > F.col("cut")).cast("bigint")))
                 .drop("dim", "cut"))
        grown, starts = {}, {}
        present = {r["node"] for r in stats}
        for n, k in want.items():
            left = k // 2 if n in cutting else k if n in present else 1  # nothing is left to cut in an empty node
            grown[2 * n], starts[2 * n] = left, first[n]
            if n in cutting:
                grown[2 * n + 1], starts[2 * n + 1] = k - left, first[n] + left
        want, first = grown, starts
    leaf = small_table(spark, [{"node": n, "leaf": s} for n, s in first.items()], "node bigint, leaf int")
    return frame.join(F.broadcast(leaf), "node").drop("node"), bounds["total"]


def numbered(docs: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """``slot``: gapless from 0 within each shard, numbered in parts by the hash of the id and offset by counts."""
    parts = max(1, docs.count() // part_rows)
    cut = docs.withColumn("_part", F.pmod(F.xxhash64("_key", "_digest"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key", "_digest")) - 1
    return (cut.withColumn("_own", own).join(offsets, ["shard", "_part"])
            .withColumn("slot", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_before"))


def shards(docs: DataFrame, *, leaves: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text",
           lang: str = "lang", source: str = "source") -> DataFrame:
    """key, size, text_crc32, shard, slot for every row.

    Give the number of ``leaves`` or the ``target_bytes`` of a leaf. The driver
    holds one row per node, so at most twice the number of leaves. Equal texts
    share a shard; a text heavier than a leaf makes its shard heavier. Repeated
    rows each get a slot; an empty table gives no rows. Null ids sort first.
    """
    narrow = materialise(sized(docs, key=key, text=text, lang=lang, source=source), "sized")
    weights = materialise(points(narrow), "points")
    if leaves is None:
        total = weights.agg(F.sum("_w")).first()[0] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    placed, _ = split(weights, leaves)
    with_leaf = narrow.join(placed.select("_digest", F.col("leaf").alias("shard")), "_digest")
    out = numbered(materialise(with_leaf.select("_key", "_digest", "size", "text_crc32", "shard"), "placed"))
    return out.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")
