"""Fit one linear scorer per label on hashed character n-grams (MLlib).

Soft targets need no special loss: a row with target ``p`` is a positive of
weight ``p`` and a negative of weight ``1 - p``, which is the same cross entropy.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.functions.decide import malicious_weight
from shellsieve.session import materialise

#: Labels fitted at the same time.
FITS = 4


def word_ngrams(c: Column, n: int) -> Column:
    """Character n-grams of the blank-padded words of a text, in one array.

    Offsets are taken inside words, so the cost is linear in the text.
    """
    words = F.array_remove(F.split(X.squeeze(F.lower(c)), " "), "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        offsets = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(padded) - n + 1))
        return F.transform(offsets, lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(words, grams))


def features(df: DataFrame, text: str = "text", n: int = 3, size: int = 1 << 16) -> DataFrame:
    """Add the sparse vector ``features``; its width does not depend on the data."""
    listed = df.withColumn("_grams", word_ngrams(F.col(text), n))
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=size).transform(listed).drop("_grams")


def weighted_rows(df: DataFrame, label: str, targets: str = "targets") -> DataFrame:
    """``features, y, w`` for one label; positives of the malicious verdict count more."""
    target = F.element_at(targets, label)
    loss = malicious_weight(F.lit(label), target)
    pairs = F.array(F.struct(F.lit(1.0).alias("y"), (target * loss).alias("w")), F.struct(F.lit(0.0).alias("y"), ((1.0 - target) * loss).alias("w")))
    return df.select("features", F.inline(pairs)).filter(F.col("w") > 0)


def fit_scorers(df: DataFrame, labels, targets: str = "targets", max_iter: int = 20, reg: float = 1e-4) -> dict[str, LogisticRegressionModel]:
    """label -> model. ``df`` has ``features`` and ``targets`` (label -> [0, 1]).

    Each fit is a series of distributed aggregations; features are written once
    for all of them. The gradient is one vector of the hashed width. ``FITS`` labels
    are fitted side by side, since most jobs of a fit are short.
    """
    ready = materialise(df.select("features", targets), "features")
    learner = LogisticRegression(labelCol="y", weightCol="w", maxIter=max_iter, regParam=reg)
    with ThreadPool(FITS) as pool:
        models = pool.map(lambda label: learner.fit(weighted_rows(ready, label, targets)), labels, chunksize=1)
    return dict(zip(labels, models))


def apply_scorers(df: DataFrame, models: dict[str, LogisticRegressionModel], prefix: str = "logit_") -> DataFrame:
    """One logit column per label from ``features``."""
    for label, model in models.items():
        scored = model.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(df)
        df = scored.withColumn(prefix + label.split(".")[-1], vector_to_array("_raw")[1]).drop("_raw")
    return df
