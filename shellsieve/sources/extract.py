"""Commands out of documents: fenced code and nested ``functions`` objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import patterns as R
from shellsieve.functions import text as X

# Fixed value: a fenced block of a shell dialect or without a language.
FENCE = r"(?s)```(?:bash|sh|shell|console)?\s*\n(.*?)```"


def _block_lines(df: DataFrame, key: list[str], text: str, fence: str) -> DataFrame:
    blocks = df.select(*key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(fence), F.lit(1))).alias("block", "_body"))
    lines = blocks.select(*key, "block", F.posexplode(X.all_lines(F.col("_body"))).alias("line", "_raw"))
    return lines.withColumn("text", X.strip(F.col("_raw"))).drop("_raw")


def fenced_commands(df: DataFrame, key: list[str], text: str = "text", fence: str = FENCE, longest: int = 400) -> DataFrame:
    """Lines of fenced blocks without comments and lines of ``longest`` or more,
    then lines with a ``$`` prompt anywhere in the document."""
    inside = (_block_lines(df, key, text, fence)
              .filter((F.length("text") > 0) & ~F.col("text").startswith("#") & (F.char_length("text") < longest)))
    lines = df.select(*key, F.posexplode(X.all_lines(F.col(text))).alias("line", "_raw"))
    typed = F.regexp_extract("_raw", X.python_regex(r"^\s*\$\s+(.+)$", ignore_case=False), 1)
    prompted = (lines.withColumn("_typed", typed).filter((F.length("_typed") > 0) & (F.char_length("_typed") < longest))
                .select(*key, F.lit(-1).alias("block"), "line", X.strip(F.col("_typed")).alias("text")))
    return inside.unionByName(prompted)


def fenced_payloads(df: DataFrame, key: list[str], text: str = "text", fence: str = FENCE, shortest: int = 3,
                    longest: int = 500) -> DataFrame:
    """Lines of fenced blocks with the prompt prefix removed, description lines
    dropped and a length between the bounds."""
    lines = _block_lines(df, key, text, fence).filter((F.length("text") > 0) & ~F.col("text").startswith("#"))
    bare = X.strip(F.regexp_replace("text", X.python_regex(R.PROMPT_PREFIX, ignore_case=False), ""))
    return (lines.withColumn("text", bare)
            .filter((F.length("text") > 0) & ~X.matches(F.col("text"), R.PROSE_LINE))
            .filter(F.char_length("text").between(shortest, longest)))


def nested_commands(df: DataFrame, key: list[str], functions_json: str, longest: int | None = 500) -> DataFrame:
    """``{kind: [{code: str | [str]}]}`` to one row per stripped command."""
    kinds = df.select(*key, F.explode(F.from_json(functions_json, "MAP<STRING, ARRAY<STRUCT<code: STRING>>>")).alias("kind", "_entries"))
    codes = kinds.select(*key, "kind", F.posexplode("_entries").alias("entry", "_e")).select(*key, "kind", "entry", F.col("_e.code").alias("_code"))
    # a list arrives as its JSON text
    listed = F.when(F.col("_code").startswith("["), F.from_json("_code", "ARRAY<STRING>"))
    items = codes.select(*key, "kind", "entry", F.posexplode(F.coalesce(listed, F.array("_code"))).alias("item", "_c"))
    out = items.withColumn("text", X.strip(F.col("_c"))).drop("_c").filter(F.length("text") > 0)
    return out.filter(F.char_length("text") <= longest) if longest else out
