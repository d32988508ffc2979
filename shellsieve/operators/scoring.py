"""Scorers: a pluggable batch scorer, a rule table and a linear n-gram model."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellsieve.functions import text as X
from shellsieve.session import is_small, materialise
from shellsieve.taxonomy import TAXONOMY, Taxonomy


def batch_score(df: DataFrame, load: Callable[[], Callable], text: str = "text", logits: str = "logits",
                size: int = TAXONOMY.size) -> DataFrame:
    """Add a score vector by calling a user's model on Arrow batches.

    ``load`` runs once per task and returns ``score(list_of_texts) -> [n, size]``.
    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``. Null texts
    are scored as empty.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for texts in batches:
            rows = np.asarray(score(texts.fillna("").tolist()), dtype=np.float64)
            if len(texts) and rows.shape != (len(texts), size):
                raise ValueError("the scorer must return one vector of the agreed size per text")
            yield pd.Series(list(rows), dtype="object")

    # only the text column passes through Python
    return df.withColumn(logits, run(F.col(text)))


def rule_logits(c: Column, rules: list[tuple[str, str, float]], base: float = -4.0, tax: Taxonomy = TAXONOMY) -> Column:
    """Score vector from ``(pattern, label, logit)`` rules.

    A label gets the largest logit of its matching rules, or ``base``.
    """
    vector = []
    for label in tax.all_ids:
        hits = [F.when(X.matches(c, p), F.lit(float(s))).otherwise(F.lit(base)) for p, l, s in rules if l == label]
        vector.append(F.greatest(F.lit(base), *hits) if hits else F.lit(base))
    return F.array(*vector)


def explode_ngrams(df: DataFrame, key: list[str], text: str, n_min: int, n_max: int) -> DataFrame:
    """(key, ngram) rows: character n-grams of blank-padded words.

    A word no longer than ``n`` gives itself once and ends its list. Words,
    sizes and offsets are exploded one after the other, which Spark turns into
    nested loops of generated code.
    """
    words = df.select(*key, F.explode(F.array_remove(F.split(X.squeeze(F.col(text)), " "), "")).alias("_w"))
    padded = words.select(*key, F.concat(F.lit(" "), "_w", F.lit(" ")).alias("_p"), (F.char_length("_w") + 2).alias("_l"))
    sizes = F.expr(f"sequence({n_min}, greatest({n_min}, least({n_max}, _l)))")
    sized = padded.select(*key, "_p", "_l", F.explode(sizes).alias("_n"))
    placed = sized.select(*key, "_p", "_n", F.explode(F.expr("sequence(1, greatest(1, _l - _n + 1))")).alias("_i"))
    return placed.select(*key, F.substring("_p", F.col("_i"), F.col("_n")).alias("ngram"))


# Odd constants that spread the code points of an n-gram over 64 bits, one per half of its digest.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gram_hashes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of ``n`` code points; together they stand for the n-gram."""
    out = []
    count = max(0, len(points) - n + 1)
    for factor in SPREAD:
        h = np.full(count, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i:i + count]) * np.uint64(factor)
            h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return out[0], out[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


# Characters whose windows are in memory at once, unless one word is longer.
SLICE_CHARS = 300_000


def word_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The texts as lists of (row, whole words), each list of about ``limit`` characters; long texts are cut at blanks."""
    held, size = [], 0
    for row, text in enumerate(texts):
        start = 0
        while text and start < len(text):
            stop = len(text)
            if stop - start > limit:
                stop = text.rfind(" ", start, start + limit)
                stop = stop if stop > start else text.find(" ", start + limit)
                stop = stop if stop > start else len(text)
            held.append((row, text[start:stop]))
            size += stop - start
            start = stop + 1
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_grams(words: list[tuple[int, str]], n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of every n-gram of blank-padded words, given (row, words with one blank between them).

    All are one array of code points. A window is an n-gram if blanks stand only at its
    ends; a padded word shorter than ``n_min`` is one itself.
    """
    padded = [f" {t} " for _, t in words]
    points, row = code_points("".join(padded)), np.repeat([r for r, _ in words], [len(t) for t in padded])
    blanks = np.cumsum(np.r_[0, points == 32])
    found = [(np.empty(0, np.int64),) * 3]
    for n in range(n_min, n_max + 1):
        at = np.arange(max(0, len(points) - n + 1))
        at = at[(blanks[at + n - 1] - blanks[at + 1] == 0) & (row[at] == row[at + n - 1])]
        found.append((row[at], *(h[at] for h in gram_hashes(points, n))))
    for n in range(3, n_min):
        at = np.arange(max(0, len(points) - n + 1))
        at = at[(points[at] == 32) & (points[at + n - 1] == 32) & (blanks[at + n - 1] - blanks[at + 1] == 0) & (row[at] == row[at + n - 1])]
        found.append((row[at], *(h[at] for h in gram_hashes(points, n))))
    return tuple(np.concatenate(x) for x in zip(*found))


def hashed_weights(weights: DataFrame) -> DataFrame:
    """``h1, h2, coef_idf, idf`` per n-gram; of several rows of an n-gram the largest counts."""
    @F.pandas_udf("h1 bigint, h2 bigint")
    def hashes(grams: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(grams), 2), np.int64)
        lengths = grams.str.len().to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            h1, h2 = gram_hashes(code_points("".join(grams.iloc[at])), int(n))
            out[at, 0], out[at, 1] = h1[::n], h2[::n]
        return pd.DataFrame(out, columns=["h1", "h2"])

    pair = F.struct(F.col("coef_idf").cast("double").alias("coef_idf"), F.col("idf").cast("double").alias("idf"))
    unique = weights.filter(F.char_length("ngram") > 0).groupBy("ngram").agg(F.max(pair).alias("_w"))
    return unique.select(hashes("ngram").alias("_h"), "_w").select("_h.*", "_w.*")


def ngram_linear_score(df: DataFrame, weights: DataFrame, key: list[str], text: str = "text", n_min: int = 3,
                       n_max: int = 5, intercept: float = 0.0, masked: bool = True) -> DataFrame:
    """``key, score``: TF-IDF (L2) dot product of the text's n-grams plus an intercept.

    ``weights``: ``ngram, coef_idf, idf``; of several rows of an n-gram the largest counts. A text without a
    known n-gram, an empty and a null text score the intercept alone. Every row is scored by itself.

    An n-gram is two 64-bit hashes. Texts go through Python as Arrow batches; all windows
    of a batch are hashed at once and looked up in the sorted hashes of the weights, so no
    n-gram ever is a row and nothing is shuffled. That needs the weights in every worker,
    so their number is checked; with more, each text's n-grams are counted in
    place and the counts joined to the weights by hash.
    """
    table = materialise(hashed_weights(weights), "weights")
    body = df.select(*key, X.squeeze(F.lower(X.mask(F.col(text)) if masked else F.col(text))).alias("_text"))
    if is_small(table):
        sorted_table = table.orderBy("h1").toArrow()
        first = sorted_table["h1"].to_numpy()
        if len(first) == len(np.unique(first)):
            return _scored_in_place(body, key, [sorted_table[c].to_numpy() for c in ("h1", "h2", "coef_idf", "idf")], n_min, n_max, intercept)
    return _scored_by_join(body, key, table, n_min, n_max, intercept)


def _scored_in_place(body: DataFrame, key: list[str], table: list[np.ndarray], n_min: int, n_max: int, intercept: float) -> DataFrame:
    bits = 1 << max(16, (len(table[0]) * 16).bit_length())
    seen = np.zeros(bits, bool)  # by the low bits of the first hash: most windows are told apart by one look
    seen[table[0] & (bits - 1)] = True
    shared = body.sparkSession.sparkContext.broadcast((*table, np.packbits(seen)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second, coef, idf, packed = shared.value
        known = np.unpackbits(packed).view(bool)
        for texts in batches:
            found = [np.empty(0, np.int64)]
            for words in word_slices(texts.tolist()) if len(first) else ():
                row, h1, h2 = text_grams(words, n_min, n_max)
                some = np.flatnonzero(known[h1 & (len(known) - 1)])
                at = np.minimum(np.searchsorted(first, h1[some]), len(first) - 1)
                hit = (first[at] == h1[some]) & (second[at] == h2[some])
                found.append(row[some][hit] * len(first) + at[hit])
            pairs, count = np.unique(np.concatenate(found), return_counts=True)
            of, gram = np.divmod(pairs, max(1, len(first)))
            dot = np.bincount(of, count * coef[gram], len(texts))
            norm = np.sqrt(np.bincount(of, (count * idf[gram]) ** 2, len(texts)))
            yield pd.Series(np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0) + intercept)

    return body.select(*key, score("_text").alias("score"))


def _scored_by_join(body: DataFrame, key: list[str], table: DataFrame, n_min: int, n_max: int, intercept: float) -> DataFrame:
    @F.pandas_udf("array<struct<h1: bigint, h2: bigint, c: bigint>>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for t in texts:
                parts = [text_grams(words, n_min, n_max)[1:] for words in word_slices([t])]
                h1, h2 = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
                pairs, c = np.unique(np.stack([h1, h2], 1), axis=0, return_counts=True)
                found.append([{"h1": int(a), "h2": int(b), "c": int(n)} for (a, b), n in zip(pairs, c)])
            yield pd.Series(found, dtype="object")

    rows = materialise(body.select(*key, F.monotonically_increasing_id().alias("_row"), counts("_text").alias("_grams")), "grams")
    known = rows.select("_row", F.explode("_grams").alias("_g")).select("_row", "_g.*").join(table, ["h1", "h2"])
    weighted = F.col("c") * F.col("idf")
    sums = known.groupBy("_row").agg(F.sum(F.col("c") * F.col("coef_idf")).alias("_dot"), F.sum(weighted * weighted).alias("_sq"))
    score = F.when(F.coalesce("_sq", F.lit(0.0)) == 0.0, F.lit(intercept)).otherwise(F.col("_dot") / F.sqrt("_sq") + F.lit(intercept))
    return rows.drop("_grams").join(sums, "_row", "left").select(*key, score.alias("score"))
