"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words and their first four, five and six
letters, so inflected forms share a term. The score is the logistic of
``w0 + sum w_i + 1/2 * sum_f((sum v_if)^2 - sum v_if^2)``: the linear weights see
single terms, the factors see pairs. Training reads a bounded sample of labelled
rows; scoring reads every whole text and needs no shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import CACHE_ENTRIES, fold_of, free_name, words
from shellsieve.session import materialise

#: Most frequent terms among whose pairs effects are looked for that no term has by itself; rows and chi-square of such a pair.
#: Half a million pairs are tested, so the bar is well above that of a single term.
PAIR_TERMS, PAIR_ROWS, PAIR_CHI2 = 1_000, 30, 60.0
#: At most about so many labelled rows are fitted (chosen by the hash of the id).
SAMPLE_ROWS = 12_000
BITS = 26
PREFIXES = (4, 5, 6)


def terms_of(word: bytes) -> list[bytes]:
    """The word itself and its marked prefixes."""
    letters = word.decode("utf-8", "ignore")
    return [word, *(b"^" + letters[:n].encode("utf-8") for n in PREFIXES if len(letters) >= n)]


class Buckets:
    """Distinct hashed terms of a text, sorted; the hashes of a word are remembered.

    With ``keep`` (a sorted array) only these hashes count, and their positions in it are told.
    """

    def __init__(self, bits: int, keep: np.ndarray | None = None) -> None:
        import xxhash
        self.hash, self.mask, self.known = xxhash.xxh3_64_intdigest, (1 << bits) - 1, {}
        self.keep = None if keep is None else {int(t): i for i, t in enumerate(keep)}

    def learn(self, word: bytes) -> tuple:
        found = (self.hash(t) & self.mask for t in terms_of(word))
        self.known[word] = out = tuple(found if self.keep is None else (self.keep[t] for t in found if t in self.keep))
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words(text)):
            found = known.get(w)
            if found is None:
                found = self.learn(w)
            if found:
                out.update(found)
        return np.sort(np.fromiter(out, dtype=np.int32, count=len(out)))


@dataclass
class Machine:
    """Weights of the learned terms (hashes, rising); all other terms weigh nothing."""
    bias: float
    terms: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bits: int

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, at: np.ndarray) -> float:
        """Score of a text by the positions of its terms."""
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(at), -500, 500))))

    def buckets(self) -> Buckets:
        return Buckets(self.bits, self.terms)


def pair_terms(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, min_rows: int, min_chi2: float) -> np.ndarray:
    """Those of ``terms`` (rising) that are in a pair whose rate of label 1 is not the sum of the two terms' own effects.

    A pair counts from ``min_rows`` rows on; its chi-square is against the base rate
    plus what either term adds to it alone.
    """
    if not len(terms) or y.min() == y.max():
        return terms[:0]
    both, hits = np.zeros((len(terms), len(terms)), np.float32), np.zeros((len(terms), len(terms)), np.float32)
    for start in range(0, len(rows), 1000):
        part = np.zeros((len(rows[start:start + 1000]), len(terms)), np.float32)
        for i, r in enumerate(rows[start:start + 1000]):
            at = np.searchsorted(terms, r)
            at = at[at < len(terms)]
            part[i, at[np.isin(terms[at], r)]] = 1
        both += part.T @ part
        hits += part.T @ (part * y[start:start + 1000, None].astype(np.float32))
    own = np.diag(hits) / np.maximum(1, np.diag(both))
    rate = np.clip(own[:, None] + own[None, :] - y.mean(), 0.02, 0.98)
    chi2 = (hits - both * rate) ** 2 / np.maximum(1e-9, both * rate * (1 - rate))
    np.fill_diagonal(chi2, 0)
    return terms[((both >= min_rows) & (chi2 >= min_chi2)).any(axis=1)]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, rank: int = 4, epochs: int = 30,
             rate: float = 0.2, l1: float = 1e-5, l2: float = 1e-5, min_rows: int = 4, min_chi2: float = 12.0,
             most_frequent: int = PAIR_TERMS, pair_rows: int = PAIR_ROWS, pair_chi2: float = PAIR_CHI2, batch: int = 256, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, with a soft threshold on the linear weights.

    Only terms in ``min_rows`` rows or more whose chi-square against the label is at
    least ``min_chi2`` are learned, and of the ``most_frequent`` terms those that
    ``pair_terms`` finds; the thousands of others would be fitted to chance. Without rows of both labels the machine
    is the constant rate of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if not len(y) or y.min() == y.max():
        return Machine(bias, np.empty(0, np.int64), np.empty(0, np.float32), np.empty((0, rank), np.float32), bits)
    seen, n = np.unique(np.concatenate(rows), return_counts=True)
    hits = np.zeros(len(seen))
    for r, label in zip(rows, y):
        if label:
            hits[np.searchsorted(seen, r)] += 1
    expected, total = n * y.mean(), len(y)
    chi2 = (hits - expected) ** 2 / (expected * (1 - y.mean()) * np.maximum(1e-9, 1 - n / total))
    single = seen[(n >= min_rows) & (chi2 >= min_chi2)]
    frequent = np.sort(seen[np.argsort(-n, kind="stable")[:most_frequent]])
    used = np.union1d(single, pair_terms(rows, y, frequent, pair_rows, pair_chi2)).astype(np.int64)
    kept = []
    for r in rows:
        at = np.minimum(np.searchsorted(used, r), max(0, len(used) - 1))
        kept.append(at[used[at] == r] if len(used) else np.empty(0, np.int64))
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-8)
    v, gv = rng.normal(0, 0.05, (len(used), rank)), np.full((len(used), rank), 1e-8)
    b, gb = bias, 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            x = [kept[i] for i in chosen]
            lengths = np.array([len(r) for r in x])
            flat, row = np.concatenate(x), np.repeat(np.arange(len(x)), lengths)
            vf = v[flat]
            sums = np.stack([np.bincount(row, vf[:, f], len(x)) for f in range(rank)], axis=1)
            squares = np.bincount(row, (vf * vf).sum(axis=1), len(x))
            z = b + np.bincount(row, w[flat], len(x)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]
            g /= len(x)
            touched, slot = np.unique(flat, return_inverse=True)
            dw = np.bincount(slot, g[row], len(touched)) + l2 * w[touched]
            dv = g[row][:, None] * (sums[row] - vf)
            dv = np.stack([np.bincount(slot, dv[:, f], len(touched)) for f in range(rank)], axis=1) + l2 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += g.sum() ** 2
            step = rate / np.sqrt(gw[touched])
            moved = w[touched] - step * dw
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            v[touched] -= rate / np.sqrt(gv[touched]) * dv
            b -= rate / np.sqrt(gb) * g.sum()
    return Machine(float(b), used, w.astype(np.float32), v.astype(np.float32), bits)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, bits: int = BITS, min_rows: int = 4, min_chi2: float = 12.0, **options) -> Machine:
    """Fit on the labelled rows, or on about ``sample_rows`` of them by the hash of their id.

    Rows with null id or label teach nothing; an id labelled twice counts as toxic
    if one label says so. Only ids of the sample are broadcast. Terms are screened
    in Spark, and only screened and the most frequent terms of the sample come to the driver.
    """
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y")))
    n = known.count()
    if n > sample_rows:
        parts = 1 << 30
        known = known.filter(F.pmod(F.xxhash64("_key"), F.lit(parts)) < F.lit(int(parts * sample_rows / n)))

    @F.pandas_udf("array<int>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets(bits)
        for series in batches:
            yield pd.Series([buckets(t) for t in series], dtype="object")

    rows = materialise(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
                       .join(F.broadcast(known), "_key").select("_key", "_y", terms("_text").alias("_terms")), "sample")
    all_rows = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("_y"), F.lit(0.0)).alias("rate")).first()
    seen = rows.select("_y", F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("_y").alias("hits"))
    expected = F.col("n") * all_rows["rate"]
    spread = expected * (1 - all_rows["rate"]) * F.greatest(F.lit(1e-9), 1 - F.col("n") / max(1, all_rows["n"]))
    seen = materialise(seen, "terms")
    wanted = seen.filter((F.col("n") >= min_rows) & ((F.col("hits") - expected) ** 2 >= min_chi2 * spread)).select("t").toPandas()["t"]
    frequent = seen.orderBy(F.col("n").desc(), "t").limit(options.get("most_frequent", PAIR_TERMS)).select("t").toPandas()["t"]
    kept = np.union1d(wanted.to_numpy(np.int32), frequent.to_numpy(np.int32))

    @F.pandas_udf("array<int>")
    def screened(series: pd.Series) -> pd.Series:
        return pd.Series([np.intersect1d(np.asarray(t, np.int32), kept, assume_unique=True) for t in series], dtype="object")

    sample = rows.select("_key", "_y", screened("_terms").alias("_terms")).toPandas().sort_values("_key", kind="stable")
    return fit_rows([np.asarray(t, dtype=np.int64) for t in sample["_terms"]], sample["_y"].to_numpy(), bits=bits,
                    min_rows=min_rows, min_chi2=min_chi2, **options)


def scorer(spark, machine: Machine):
    """Column function: text -> score from 0 to 1. The broadcast holds terms of the bounded sample only.

    Null and empty texts have no terms and score the bias alone.
    """
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        buckets = model.buckets()
        for series in batches:
            yield pd.Series([model.score(buckets(t)) for t in series], dtype="float64")

    return score


def score(docs: DataFrame, machine: Machine, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column that clashes with no other; row by row, all other columns stay in the JVM."""
    return docs.withColumn(free_name(docs, out), scorer(docs.sparkSession, machine)(F.col(text)))


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    return labels.filter(fold_of(F.col(key)) != 0)


def drop_toxic(docs: DataFrame, machine: Machine, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows scored below ``threshold``, columns unchanged."""
    name = free_name(docs, "_score")
    return score(docs, machine, text=text, out=name).filter(F.col(name) < threshold).select(*docs.columns)
