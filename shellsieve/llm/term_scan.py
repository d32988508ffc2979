"""Ranked lexical search for a set of items: one automaton of all their terms counts matches straight from the text.

There is no index of documents. Terms stand between blanks in the automaton, so only
whole terms match; a match names its term, and the term names the items that hold it.
A first scan writes each document's length and its counts of item terms; sums over
that table are the statistics, and a second pass over it scores and keeps the best of
each item per task, which Spark merges. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.common import WORD_BYTES, free_name, text_of, words
from shellsieve.session import materialise

#: Different (item, term) rows in one block of items; with more, the documents are scanned once per block.
BLOCK_TERMS = 300_000
#: Scores worked out at once in a task: documents of a batch times items of a block.
CELLS = 2_000_000


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """One row per item and term: item, term, times. Rows that repeat count once; different texts of one item are taken together."""
    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: [w.decode() for w in words(t)])

    each = items.select(F.col(key).alias("item"), F.col(text).alias("text")).distinct()
    return each.select("item", F.explode(split("text")).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def counted(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Per document: key, n (terms with repeats), hits (numbers of the item terms it holds), tf (how often)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for number, term in enumerate(shared.value or ["-"]):
            automaton.add_word(f" {term} ", number)
        automaton.make_automaton()
        for batch in batches:
            sizes, hits, tf, ends = [], [], [], [0]
            for t in batch.column(1).to_pylist():
                plain = text_of(t).encode("utf-8").translate(WORD_BYTES)
                sizes.append(len(plain.split()))
                found = np.fromiter((number for _, number in automaton.iter(f" {plain.decode()} ")), np.int64) if shared.value else np.empty(0, np.int64)
                terms_here, times = np.unique(found, return_counts=True)
                hits.append(terms_here)
                tf.append(times)
                ends.append(ends[-1] + len(terms_here))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *x])).cast(kind))
                     for x, kind in ((hits, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "hits", "tf"])

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text)).mapInArrow(scan, "doc bigint, n bigint, hits array<int>, tf array<bigint>")


def best_rows(item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each item; equal scores by ascending document, null documents last."""
    order = np.lexsort((doc, null, -score, item))
    first = np.r_[True, item[order][1:] != item[order][:-1]] if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def scored(counts: DataFrame, postings: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, items: int, n_docs: int, n_terms: int,
           k: int) -> DataFrame:
    """The k best documents of each item within each task: item (its number), doc, score."""
    starts = np.cumsum([0, *[len(i) for i, _ in postings]])
    flat = [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in zip(*postings)] if postings else [np.empty(0, np.int64)] * 2
    shared = counts.sparkSession.sparkContext.broadcast((starts, *flat, weights))

    def score_batch(batch: pa.RecordBatch, start: int, stop: int):
        from_term, term_item, term_times, weight = shared.value
        part = batch.slice(start, stop - start)
        hits = pa.chunked_array([part.column("hits")]).combine_chunks()
        term = hits.flatten().to_numpy().astype(np.int64)
        tf = part.column("tf").flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(part)), hits.value_lengths().to_numpy())
        length = 25 + 75 * part.column("n").to_numpy().astype(np.int64) * n_docs // max(1, n_terms)
        value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length[row]))
        many = from_term[term + 1] - from_term[term]
        at = np.repeat(from_term[term] - np.cumsum(np.r_[0, many[:-1]]) if len(term) else term, many) + np.arange(int(many.sum()))
        table = np.zeros(len(part) * items, np.int64)
        np.add.at(table, np.repeat(row, many) * items + term_item[at], np.repeat(value, many) * term_times[at])
        some = np.flatnonzero(table > 0)
        doc = part.column("doc")
        row_of = some // items
        return (some % items, table[some], doc.is_null().to_numpy(zero_copy_only=False)[row_of],
                doc.fill_null(0).to_numpy()[row_of])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        for batch in batches:
            step = max(1, CELLS // max(1, items))
            for start in range(0, len(batch), step):
                new = score_batch(batch, start, min(len(batch), start + step))
                joined = [np.concatenate(x) for x in zip(kept, new)]
                at = best_rows(*joined, k)
                kept = tuple(x[at] for x in joined)
        item, score, null, doc = kept
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc", "score"])

    return counts.mapInArrow(best, "item bigint, doc bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
         k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k highest-scoring documents above 0 of each item: the item's key, rank (from 1), the document's key (bigint), score.

    Equal scores go by ascending key, null keys last. Null, empty and blank texts hold
    no terms and are found by no item; repeated document rows are ranked one by one;
    repeated item rows count once. Items without a term, and empty tables, give no rows.
    Texts of any length are counted whole. Only the keys and texts named are read, so
    other columns may have any names. What a task holds is one document, one automaton
    of at most about ``block_terms`` terms and k rows per item of a block.
    """
    spark = docs.sparkSession
    wanted = materialise(item_terms(items, item_key, item_text), "item_terms")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    results = []
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pylist()
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        keys = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x))
        place = {x: i for i, x in enumerate(keys)}
        held: list[list[tuple[int, int]]] = [[] for _ in terms]
        for r in rows:
            held[number[r["term"]]].append((place[r["item"]], r["times"]))
        postings = [(np.array([i for i, _ in h]), np.array([n for _, n in h])) for h in held]
        counts = materialise(counted(docs, key, text, terms), "term_counts")
        total = counts.agg(F.coalesce(F.sum((F.col("n") > 0).cast("bigint")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r["hit"]: r["df"] for r in counts.select(F.explode("hits").alias("hit")).groupBy("hit").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        found = scored(counts, postings, weights, len(keys), total["docs"], total["terms"], k)
        names = spark.createDataFrame(list(enumerate(keys)), f"item bigint, name {dict(wanted.dtypes)['item']}")
        results.append(found.join(F.broadcast(names), "item").select("name", "doc", "score"))
    every = results[0]
    for more in results[1:]:
        every = every.unionAll(more)
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    place_name = free_name(every, "rank")
    return (every.withColumn(place_name, F.row_number().over(order)).filter(F.col(place_name) <= k)
            .select(F.col("name").alias(item_key), F.col(place_name).cast("int").alias("rank"), F.col("doc").alias(key), "score"))
