"""One JSON array, however long, read by many tasks.

The file is cut at every closing brace, so Spark splits it like a text file. A task
cannot know whether its block begins inside a string or how deep; it follows its
pieces for both answers. The totals of a block are one small row, and running
sums over those rows tell every block how it began. A piece that begins and ends
between two elements is an element; only elements of several pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellsieve.functions import text as X
from shellsieve.session import is_small, materialise

#: A piece: where it begins within its block, whether an odd number of quotes stands before it there, and the
#: depth before and after it if the block begins outside (0) or inside (1) of a string.
PIECE = "file string, block bigint, at bigint, value string, odd int, before0 bigint, after0 bigint, before1 bigint, after1 bigint, odd_after int"


def _depth(outside: Column) -> Column:
    opened = F.length(F.regexp_replace(outside, r"[^\[{]", ""))
    return opened - F.length(F.regexp_replace(outside, r"[^\]]", ""))


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running sums over the pieces of each block, which arrive in order; only the sums are kept between batches."""
    block, at, odd, depth = None, 0, 0, [0, 0]
    for batch in batches:
        key = list(zip(batch["file"], batch["block"]))
        borders = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        for a, b in zip(borders, borders[1:]):
            if a == b:
                continue
            if key[a] != block:
                block, at, odd, depth = key[a], 0, 0, [0, 0]
            part = batch.iloc[a:b]
            size, quotes = part["size"].to_numpy(np.int64) + 1, part["quotes"].to_numpy(np.int64)
            odds = (odd + np.concatenate([[0], np.cumsum(quotes)])) % 2
            begin = at + np.concatenate([[0], np.cumsum(size)])
            out = {"file": part["file"], "block": part["block"], "at": begin[:-1], "value": part["value"], "odd": odds[:-1].astype(np.int32)}
            for start in (0, 1):
                inside, ends_inside = (odds[:-1] + start) % 2 == 1, (odds[1:] + start) % 2 == 1
                change = np.where(inside, part["depth1"], part["depth0"]).astype(np.int64) - np.where(ends_inside, 0, 1)
                level = depth[start] + np.concatenate([[0], np.cumsum(change)])
                out[f"before{start}"], out[f"after{start}"] = level[:-1], level[1:]
                depth[start] = int(level[-1])
            at, odd = int(begin[-1]), int(odds[-1])
            yield pd.DataFrame(out).assign(odd_after=odds[1:].astype(np.int32))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Each file cut at its closing braces, with what its block knows about it (``PIECE``)."""
    cut = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*(?:"|$)'
    return cut.select(
        "file", "block", "value", F.octet_length("value").cast("bigint").alias("size"),
        (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).alias("quotes"),
        _depth(F.regexp_replace(plain, strings, "")).alias("depth0"),
        _depth(F.regexp_replace(F.regexp_replace(plain, r'^[^"]*(?:"|$)', ""), strings, "")).alias("depth1"),
    ).mapInPandas(followed, PIECE)


def block_starts(cut: DataFrame) -> DataFrame:
    """(file, block, offset, inside, depth, final): the state in which each block begins and that in which its file ends."""
    last = F.struct("at")
    totals = cut.groupBy("file", "block").agg(
        F.max(F.col("at") + F.octet_length("value") + 1).alias("bytes"), F.max_by("odd_after", last).alias("odd"),
        F.max_by("after0", last).alias("t0"), F.max_by("after1", last).alias("t1"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    begun = totals.withColumn("inside", F.pmod(before(F.col("odd")), F.lit(2)).cast("int")).withColumn("offset", before(F.col("bytes")))
    own = F.when(F.col("inside") == 1, F.col("t1")).otherwise(F.col("t0"))
    return begun.select("file", "block", "offset", "inside", before(own).alias("depth"), F.sum(own).over(Window.partitionBy("file")).alias("final"))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``_source_file, _source_offset, value``: each object of the files' arrays as text, with the place of its first byte's piece.

    ``_source_offset`` orders the elements of a file. Empty arrays and empty files give no rows, repeated elements
    stay. A file that is no array of objects fails the job: another beginning or end, a missing or odd sign
    between elements, an element that is no object or no JSON.
    """
    cut = materialise(pieces(spark, path), "pieces")
    starts = materialise(block_starts(cut), "starts")
    placed = cut.join(F.broadcast(starts) if is_small(starts) else starts, ["file", "block"])
    outside = F.col("inside") == 0
    placed = placed.select(
        "file", "block", (F.col("offset") + F.col("at")).alias("at"), "value", "final",
        (F.pmod(F.col("odd") + F.col("inside"), F.lit(2)) == 1).alias("quoted"),
        (F.col("depth") + F.when(outside, F.col("before0")).otherwise(F.col("before1"))).alias("before"),
        (F.col("depth") + F.when(outside, F.col("after0")).otherwise(F.col("after1"))).alias("after"))
    # the last piece has no closing brace, so a closed array ends one level too deep
    whole = F.when(F.col("final") == -1, F.col("value")).otherwise(
        F.raise_error(F.concat(F.col("file"), F.lit(" is no complete JSON array"))).cast("string"))
    opens = ~F.col("quoted") & ((F.col("before") == 1) | ((F.col("before") == 0) & (F.col("at") == 0)))
    placed = placed.withColumn("value", whole).withColumn("opens", opens)
    end = F.col("opens") & (F.col("after") == -1) & (~F.col("value").contains("{"))
    placed = placed.withColumn("ends", end)
    single = placed.filter("opens AND after = 1 AND NOT ends").select("file", "at", F.concat("value", F.lit("}")).alias("value"))
    several = placed.filter("NOT (opens AND after = 1) AND NOT ends")
    opener = F.when(F.col("opens"), F.col("at"))
    within = Window.partitionBy("file", "block").orderBy("at")
    carried = (several.groupBy("file", "block").agg(F.max(opener).alias("_last"))
               .withColumn("_carried", F.max("_last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))))
    joined = (several.withColumn("_own", F.max(opener).over(within)).join(carried.select("file", "block", "_carried"), ["file", "block"])
              .groupBy("file", F.coalesce("_own", "_carried", F.lit(-1)).alias("at"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "value"))).alias("_parts"))
              .select("file", "at", F.concat(F.array_join("_parts.value", "}"), F.lit("}")).alias("value")))
    tail = placed.filter("ends").select("file", "at", "value").filter(
        ~F.when(F.col("at") == 0, F.col("value").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("value").rlike(r"^\s*\]\s*$")))
    rows = single.unionByName(joined).unionByName(tail)
    sign = F.when(F.col("at") == 0, F.lit(r"^\s*\[\s*\{")).otherwise(F.lit(r"^\s*,\s*\{"))
    body = F.regexp_replace("value", r"^\s*[\[,]\s*", "")
    good = F.rlike(F.col("value"), sign) & F.try_parse_json(body).isNotNull()
    where = F.concat(F.lit("invalid JSON element at "), F.col("file"), F.lit(":"), F.col("at").cast("string"))
    return rows.select(F.col("file").alias("_source_file"), F.col("at").alias("_source_offset"),
                       F.when(good, body).otherwise(F.raise_error(where).cast("string")).alias("value"))


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The fields of ``json_elements``; mistyped or missing ones are null."""
    return json_elements(spark, path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_j")).select("_j.*")
