"""First-wins deduplication, leakage anti-joins, unions and key comparison.

Nothing here sorts a whole key group: every dedup is one aggregation with a
map-side part, so a text that makes up a third of the corpus shrinks to one row
per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators import bloom
from shellsieve.session import BROADCAST_ROWS, materialise


def first_wins(df: DataFrame, key: Column | str, order: list[Column | str], keep: list[str] | None = None) -> DataFrame:
    """Keep, per key, the row that comes first in ``order`` (a total order).

    Filters that decide which rows may claim a key belong before this call.
    ``keep`` names the columns wanted afterwards; leaving out long texts that
    only serve as key keeps them out of the shuffle.
    """
    columns = keep or df.columns
    key_col = F.col(key) if isinstance(key, str) else key
    carried = [c for c in columns if not (isinstance(key, str) and c == key)]
    picked = (df.groupBy(key_col.alias("_key"))
              .agg(F.min_by(F.struct(*carried), F.struct(*order)).alias("_row")))
    if isinstance(key, str):
        return picked.select(*[F.col("_key").alias(c) if c == key else F.col(f"_row.{c}") for c in columns])
    return picked.select("_row.*")


def by_exact_text(df: DataFrame, order: list[Column | str], text: str = "text") -> DataFrame:
    return by_text_hash(df, order, text)


def by_stripped_text(df: DataFrame, order: list[Column | str], text: str = "text") -> DataFrame:
    """Rows that are blank after stripping are dropped; the text is kept stripped."""
    cleaned = df.withColumn(text, X.strip(F.col(text))).filter(F.length(text) > 0)
    return by_text_hash(cleaned, order, text)


def by_squeezed_text(df: DataFrame, order: list[Column | str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Texts that differ only in whitespace are the same; the first keeps its spelling.

    The key is the digest of the squeezed text, so that long texts are neither
    sorted on nor shuffled twice.
    """
    return first_wins(df, F.unhex(X.sha256(X.squeeze(F.col(text)))), order, keep)


def by_text_hash(df: DataFrame, order: list[Column | str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per sha256 of the text; ``order`` says which producer keeps it."""
    return first_wins(df, F.unhex(X.sha256(F.col(text))), order, keep)


def key_set(*frames: DataFrame, key: str = "key") -> DataFrame:
    """Distinct union of one-column key frames."""
    union = None
    for frame in frames:
        part = frame.select(F.col(frame.columns[0]).alias(key))
        union = part if union is None else union.unionByName(part)
    return union.distinct()


def text_digest(key: Column) -> Column:
    """Sixteen bytes that stand for a key of any length in shuffles; null for null."""
    return F.substring(F.unhex(X.sha256(key.cast("string"))), 1, 16)


def sifted(candidates: DataFrame, frozen: DataFrame, key: Column, frozen_key: Column | None = None,
           exact_rows: int = BROADCAST_ROWS, blocks: int | None = None) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(candidates surely not in ``frozen`` or None, the others, digests of ``frozen``).

    Both sides meet by digest (``_probe``, ``_leak``). Up to ``exact_rows`` frozen digests are broadcast as they
    are. Above that a Bloom filter sized from their count (or of ``blocks``) tells most clean candidates
    without a shuffle, and only those it cannot clear go to the exact join. ``candidates`` is read
    once for each of the two parts, so it must give the same rows again. A null key is never in ``frozen``.
    """
    leak = text_digest(frozen_key if frozen_key is not None else key)
    keys = materialise(frozen.select(leak.alias("_leak")).filter("_leak IS NOT NULL").distinct(), "frozen")
    marked = candidates.withColumn("_probe", text_digest(key))
    n = keys.count()
    if n <= exact_rows:
        return None, marked, F.broadcast(keys)
    blocks = blocks or bloom.blocks_for(n)
    if blocks is None:
        return None, marked, keys
    table = materialise(bloom.bloom_table(keys, "_leak", blocks), "bloom")
    tested = bloom.probed(marked, table, "_probe", blocks, "_maybe")
    return tested.filter("NOT _maybe").drop("_maybe"), tested.filter("_maybe").drop("_maybe"), keys


def without_leakage(candidates: DataFrame, frozen: DataFrame, key: Column, frozen_key: Column | None = None,
                    within_batch: list[Column | str] | None = None, **sizes: int) -> DataFrame:
    """Candidates whose key does not occur in ``frozen`` (see ``sifted`` for ``sizes``).

    ``within_batch`` gives an order and then also keeps only the first candidate of every key.
    """
    clean, others, keys = sifted(candidates, frozen, key, frozen_key, **sizes)
    kept = others.join(keys, F.col("_probe") == F.col("_leak"), "left_anti")
    if clean is not None:
        kept = clean.unionByName(kept)
    if within_batch is not None:
        kept = first_wins(kept, "_probe", within_batch)
    return kept.drop("_probe")


def leakage_flags(candidates: DataFrame, frozen: DataFrame, key: Column, frozen_key: Column | None = None, **sizes: int) -> DataFrame:
    """Same test, but marks the rows (``leaked``) so that drops can be counted."""
    clean, others, keys = sifted(candidates, frozen, key, frozen_key, **sizes)
    flagged = (others.join(keys, F.col("_probe") == F.col("_leak"), "left")
               .withColumn("leaked", F.col("_leak").isNotNull()).drop("_probe", "_leak"))
    return flagged if clean is None else clean.drop("_probe").withColumn("leaked", F.lit(False)).unionByName(flagged)


def union_splits(**parts: DataFrame) -> DataFrame:
    """Union by name; ``split`` tells the part, missing columns become null."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key with its multiplicity on both sides and a status.

    Both sides are counted per key before the outer join, because an outer join
    cannot be split at run time when one key is hot.
    """
    l = left.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_left"))
    r = right.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_right"))
    joined = l.join(r, "key", "full_outer").na.fill(0, ["n_left", "n_right"])
    status = (F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra")
              .when(F.col("n_left") == F.col("n_right"), "matched").otherwise("multiplicity"))
    return joined.withColumn("status", status)
