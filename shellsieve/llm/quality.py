"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts words from the ``order - 1`` before them. For order 3 ``backoff`` counts
the trusted texts and scores all texts in rounds. For other orders, and where a discount is 0
although counts of its class occur, counts of all texts' grams are gathered, lower orders come from
joins and groupings sharded by gram and context, and every document looks up its grams by a shuffle join.

The same model over characters (``gram_counts``, ``Packed``, ``log_likelihood``)
is the small form that the tests compare with the definition; no query uses it.

A language accepts perplexities up to a quantile of its trusted documents that
were held out of the counts.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.backoff import END, START, TOKEN, trusted_likelihood
from shellsieve.llm.common import WordIds, fold_of, free_name, text_of
from shellsieve.session import is_small, materialise

#: Words of a gram.
ORDER = 3
#: Words a task counts at once.
WORD_CHUNK = 1 << 20
BITS = 12
#: Grams up to which the character model is broadcast (16 bytes each).
MODEL_ROWS = 4_000_000
#: Languages up to which their thresholds are broadcast.
LANGUAGES = 100_000
#: Characters a task counts at once.
CHUNK = 1 << 22


def symbols(text: str | None) -> np.ndarray:
    """One symbol of ``BITS`` bits per character: its code point below 3,840, else one of 256 residues; never 0."""
    points = np.frombuffer(text_of(text).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(points < 3840, np.maximum(points, 1), 3840 + points % 256)


def grams(texts: list[np.ndarray], order: int) -> np.ndarray:
    """The gram that ends at each character of each text; 0 stands before the first character."""
    gap = np.zeros(order - 1, dtype=np.int64)
    flat = np.concatenate([x for t in texts for x in (gap, t)]) if texts else np.empty(0, np.int64)
    n = len(flat) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = flat[:n].copy()
    for k in range(1, order):
        code = code << BITS | flat[k:n + k]
    return code[flat[order - 1:] > 0]


def portions(texts: Iterator, most: int = CHUNK, length: Callable = len) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += length(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def gram_counts(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, n), summed within a portion of a task only."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(symbols(t) for batch in batches for t in batch["text"]):
            gram, n = np.unique(grams(part, order), return_counts=True)
            yield pd.DataFrame({"gram": gram, "n": n})

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "gram bigint, n bigint")


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; 0 where they cannot be told."""
    r = level.agg(*[F.coalesce(F.count_if(F.col("c") == k), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = [k - (k + 1) * y * b / a if a else 0.0 for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(out, 1))


def suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


class Packed:
    """Grams of characters in one number."""

    def keys(self, n: int) -> list[str]:
        return ["gram"]

    def lower(self, n: int) -> list[Column]:
        return [suffix(F.col("gram"), n).alias("gram")]

    def parts(self, level: DataFrame, n: int) -> tuple[DataFrame, list[str], list[str]]:
        """``level`` with the columns of each gram's context and of its last ``n - 1`` symbols, and their names."""
        return level.withColumn("_ctx", F.shiftright("gram", BITS)).withColumn("_low", suffix(F.col("gram"), n - 1)), ["_ctx"], ["_low"]


class Worded:
    """Grams of words, one 64-bit id in a column each: w1 ... w``order``, the last ``n`` of them for grams of n words."""

    def __init__(self, order: int) -> None:
        self.names = [f"w{k}" for k in range(1, order + 1)]

    def keys(self, n: int) -> list[str]:
        return self.names[-n:]

    def lower(self, n: int) -> list[Column]:
        return [F.col(w) for w in self.keys(n)]

    def parts(self, level: DataFrame, n: int) -> tuple[DataFrame, list[str], list[str]]:
        return level, self.keys(n)[:-1], self.keys(n)[1:]


def smoothed_grams(counts: DataFrame, order: int, unit: Packed | Worded) -> DataFrame:
    """(keys of the unit, p) for every gram of ``counts`` (keys, c); c is 0 for grams that trusted text lacks."""
    levels = {order: counts}
    c = F.col("c")
    for n in range(order - 1, 0, -1):
        levels[n] = materialise(levels[n + 1].groupBy(*unit.lower(n)).agg(F.count_if(c > 0).alias("c")), f"level{n}")
    symbols_seen = levels[1].count()
    lower = None
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(levels[n])
        own = F.greatest(c - F.when(c == 1, d1).when(c == 2, d2).when(c >= 3, d3).otherwise(0.0), F.lit(0.0))
        sums = [F.sum("c").alias("total"), (F.count_if(c == 1) * F.lit(d1) + F.count_if(c == 2) * F.lit(d2)
                                            + F.count_if(c >= 3) * F.lit(d3)).alias("free")]
        if lower is None:
            r = levels[n].agg(*sums).first()
            rows = levels[n].select("*", F.lit(r["total"] or None).cast("bigint").alias("total"), F.lit(r["free"]).cast("double").alias("free"),
                                    F.lit(1.0 / (symbols_seen + 1)).alias("p0"))
        else:
            rows, context, low = unit.parts(levels[n], n)
            rows = rows.join(rows.filter(c > 0).groupBy(*context).agg(*sums), context, "left")
            rows = rows.join(lower.select(*[F.col(k).alias(x) for k, x in zip(unit.keys(n - 1), low)], F.col("p").alias("p0")), low)
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise((own + F.col("free") * F.col("p0")) / F.col("total"))
        lower = rows.select(*unit.keys(n), p.alias("p"))
        if n < order:
            lower = materialise(lower, f"p{n}")
    return lower


def model(counts: DataFrame, order: int) -> DataFrame:
    """(gram, logp) for grams of characters."""
    return smoothed_grams(counts, order, Packed()).select("gram", F.log("p").alias("logp"))


def word_ids(text: str | None, ids: WordIds) -> np.ndarray:
    """64-bit ids of the words and signs of a text, then ``END``; nothing for a null or empty text."""
    if not text:
        return np.empty(0, np.int64)
    return np.append(ids(w.encode("utf-8", "surrogatepass") for w in TOKEN.findall(text)).view(np.int64), END)


def word_grams(texts: list[np.ndarray], order: int) -> np.ndarray:
    """One row for each word of each text: the word and the ``order - 1`` before it; ``START`` stands before the first."""
    gap = np.full(order - 1, START, np.int64)
    return np.concatenate([np.empty((0, order), np.int64), *(np.lib.stride_tricks.sliding_window_view(np.concatenate([gap, t]), order)
                                                             for t in texts if len(t))])


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each different row, and for every row the number of its group; rows are told apart by 64-bit hashes."""
    code = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        code = (code ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def word_counts(docs: DataFrame, order: int) -> DataFrame:
    """(w1 ..., n) of ``docs`` (text, trusted), summed within a portion of a task only; n counts trusted texts."""
    names = Worded(order).names

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        texts = ((word_ids(t, ids), bool(k)) for batch in batches for t, k in zip(batch["text"], batch["trusted"]))
        for part in portions(texts, WORD_CHUNK, lambda x: len(x[0])):
            rows = word_grams([t for t, _ in part], order)
            first, group = grouped(rows)
            n = np.bincount(group, weights=np.repeat([float(k) for _, k in part], [len(t) for t, _ in part]), minlength=len(first))
            yield pd.DataFrame(rows[first], columns=names).assign(n=n.astype(np.int64))

    return docs.select("text", "trusted").mapInPandas(count, ", ".join(f"{w} bigint" for w in names) + ", n bigint")


def word_likelihood(docs: DataFrame, probabilities: DataFrame, *, text: str, order: int, out: str) -> DataFrame:
    """``docs`` with a struct (logp, n) in the column ``out``; ``probabilities`` (w1 ..., p) has every gram of the texts.

    Grams meet by their 64-bit hash; equal texts are looked up once.
    """
    names, own = Worded(order).names, free_name(docs, f"{out}_key")
    marked = docs.withColumn(own, F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))))

    def own_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            for part in portions(((key, word_ids(t, ids)) for key, t in zip(batch["key"], batch["text"])), WORD_CHUNK, lambda x: len(x[1])):
                rows = word_grams([t for _, t in part], order)
                of = np.repeat(np.arange(len(part)), [len(t) for _, t in part])
                first, group = grouped(np.column_stack([rows, of]))
                keys = np.empty(len(part), object)
                keys[:] = [key for key, _ in part]
                yield pd.DataFrame(rows[first], columns=names).assign(key=keys[of[first]], k=np.bincount(group, minlength=len(first)))

    asked = (marked.select(F.col(own).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
             .mapInPandas(own_grams, ", ".join(f"{w} bigint" for w in names) + ", key binary, k bigint")
             .select("key", F.xxhash64(*names).alias("gram"), F.col("k").cast("int").alias("k")))
    sums = (asked.join(probabilities.select(F.xxhash64(*names).alias("gram"), F.log("p").alias("logp")), "gram").groupBy("key")
            .agg(F.struct(F.sum(F.col("k") * F.col("logp")).alias("logp"), F.sum("k").alias("n")).alias(out)))
    sums = materialise(sums, "likelihood")
    none = F.struct(F.lit(0.0).alias("logp"), F.lit(0).cast("bigint").alias("n"))
    return (marked.join(sums.withColumnRenamed("key", own), own, "left")
            .withColumn(out, F.coalesce(out, none)).drop(own))


class Lookup:
    """Open-addressing table of grams, filled and probed a whole array at a time."""

    def __init__(self, gram: np.ndarray, value: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(4 * max(1, len(gram)) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.zeros(size), 0
        slot, left = self.slot(gram), np.arange(len(gram))
        while len(left):
            free = self.keys[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = gram[put], value[put]
            left = left[self.keys[slot[left]] != gram[left]]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        slot = self.slot(gram)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != gram)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            out[miss] = self.values[slot[miss]]
            miss = miss[self.keys[slot[miss]] != gram[miss]]
        return out


def log_likelihood(docs: DataFrame, probabilities: DataFrame, *, text: str, order: int, out: str, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` with a struct (logp, n) in the column ``out``; every gram of the texts is in ``probabilities``."""
    spark = docs.sparkSession
    if probabilities.count() <= model_rows:
        table = probabilities.toPandas()
        shared = spark.sparkContext.broadcast((table["gram"].to_numpy(np.int64), table["logp"].to_numpy(np.float64)))

        @F.pandas_udf("logp double, n bigint")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            look = Lookup(*shared.value)
            for series in batches:
                sums, sizes = [], []
                for part in portions(symbols(t) for t in series):
                    n = np.array([len(t) for t in part], dtype=np.int64)
                    value = np.concatenate([[0.0], np.cumsum(look(grams(part, order)))])
                    end = np.cumsum(n)
                    sums.append(value[end] - value[end - n])
                    sizes.append(n)
                yield pd.DataFrame({"logp": np.concatenate(sums) if sums else np.empty(0), "n": np.concatenate(sizes) if sizes else np.empty(0, np.int64)})

        return docs.withColumn(out, scored(F.col(text)))

    digest = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    marked = docs.withColumn(f"{out}_key", digest)

    def own_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, t in zip(batch["key"], batch["text"]):
                gram, n = np.unique(grams([symbols(t)], order), return_counts=True)
                yield pd.DataFrame({"key": [key] * len(gram), "gram": gram, "k": n})

    asked = (marked.select(F.col(f"{out}_key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
             .mapInPandas(own_grams, "key binary, gram bigint, k bigint"))
    sums = (asked.join(probabilities, "gram").groupBy("key")
            .agg(F.struct(F.sum(F.col("k") * F.col("logp")).alias("logp"), F.sum("k").alias("n")).alias(out)))
    none = F.struct(F.lit(0.0).alias("logp"), F.lit(0).cast("bigint").alias("n"))
    return (marked.join(sums.withColumnRenamed("key", f"{out}_key"), f"{out}_key", "left")
            .withColumn(out, F.coalesce(out, none)).drop(f"{out}_key"))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that are labelled as good and never as bad, with their fold."""
    return (labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id"))
            .agg(F.min("quality").alias("_q")).filter("_q = 1").select("_id", fold_of(F.col("_id")).alias("_fold")))


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
           quantile: float = 0.995, prior: int = 20, out: str = "quality") -> DataFrame:
    """``docs`` with a struct (n_symbols, perplexity, threshold, accepted) that clashes with no column.

    Counts are of all trusted texts but one fold of five, thresholds of that fold:
    the ``quantile`` of its perplexities in the row's language (null is a language
    of its own), of all languages where a language has none, and no limit without
    any trusted row. ``prior`` words (about 100 characters) at the mean rate of the
    held-out texts are added to every text, since a few odd words say little.
    ``n_symbols`` counts words, runs of signs and the end of the text. Null and empty
    texts have null perplexity and are not accepted. Repeated rows are judged alike.
    """
    name = free_name(docs, out)
    trust = materialise(trusted_ids(labels, key), "trusted")
    good, scored = trust.filter("_fold <> 0"), None
    if order == 3:
        marks = [free_name(docs, f"{out}_key{k}") for k in (1, 2)]
        scored = trusted_likelihood(docs, good.select("_id"), key=key, text=text, names=marks, out=name)
    if scored is None:
        flagged = (docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
                   .join(good.select("_id", F.lit(True).alias("trusted")), "_id", "left"))
        counts = word_counts(flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), order)
        counts = materialise(counts.groupBy(*Worded(order).names).agg(F.sum("n").alias("c")), "grams")
        scored = word_likelihood(docs, smoothed_grams(counts, order, Worded(order)), text=text, order=order, out=name)
    logp, n = F.col(f"{name}.logp"), F.col(f"{name}.n")
    narrow = materialise(scored.select(F.col(key).alias("_id"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), logp.alias("_logp"), n.alias("_n"))
                         .filter("_n > 0").join(trust.filter("_fold = 0").select("_id"), "_id"), "held_out")
    mean = narrow.agg((F.sum("_logp") / F.sum("_n")).alias("v")).first()["v"] or 0.0

    def smoothed(total: Column, size: Column) -> Column:
        return F.exp(-(total + F.lit(prior * mean)) / (size + prior))

    limit_of = F.percentile_approx(smoothed(F.col("_logp"), F.col("_n")), quantile, 10_000)
    limits = materialise(narrow.groupBy("_lang").agg(limit_of.alias("_own")), "limits")
    overall = narrow.agg(limit_of.alias("v")).first()["v"]
    limits = F.broadcast(limits) if is_small(limits, LANGUAGES) else limits
    language, limit = free_name(scored, "_lang_of"), free_name(scored, "_limit_of")
    limits = limits.select(F.col("_lang").alias(language), F.col("_own").alias(limit))
    threshold = F.coalesce(F.col(limit), F.lit(overall).cast("double"), F.lit(float("inf")))
    perplexity = F.when(n > 0, smoothed(logp, n))
    verdict = F.struct(n.alias("n_symbols"), perplexity.alias("perplexity"), threshold.alias("threshold"),
                       F.coalesce(perplexity <= threshold, F.lit(False)).alias("accepted"))
    return (scored.join(limits, F.coalesce(F.col(lang), F.lit("")) == F.col(language), "left")
            .withColumn(name, verdict).drop(language, limit))


def drop_poor(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Accepted rows, columns unchanged."""
    name = free_name(docs, "_quality")
    return judged(docs, labels, out=name, **options).filter(F.col(f"{name}.accepted")).select(*docs.columns)
