"""Benchmark passages in documents, found with few edited words.

An item of ``n`` words is looked for with at most ``edit_share * n`` inserted,
deleted or replaced words. Item-sized windows of the documents, at every
``stride``-th word, meet windows of the items at every word, so an occurrence
always has an aligned pair. The CGK random walk embeds both: at step ``t`` it
emits the current word and moves on if a random bit of (step, word) says so, which
turns few edits into few differing steps. Each repeat has its own walk and its own
sampled steps, whose words form the hash key; repeats go on until a simulated
pair with the most edits allowed is found with the target recall. Candidates are
verified by the exact edit distance of the item to the document around the window.

One walk finds the fewer pairs the more edits they have, so an item of more than
``PIECE_WORDS`` words is searched by equal pieces: if it has at most ``k`` edits, one
of its ``m`` pieces has at most ``k // m`` of them (pigeonhole) and is found.

Windows that hold too few words of the items to be within the edits are skipped
before the walk; that loses nothing.
"""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import free_name, words
from shellsieve.llm.minhash_dedup import mix

#: Items indexed at once; more items are searched in further passes over the documents.
BLOCK_ITEMS = 5_000
#: Longer items are searched by pieces of at most so many words.
PIECE_WORDS = 64
HIT = "item_id bigint, edits int, n_words int, first_word bigint, last_word bigint"
PAD = np.uint64(0)
UNKNOWN = np.uint64(1)
ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fitting_distance(item: list, text: list) -> tuple[int, int]:
    """(edits, end) of the substring of ``text`` nearest to ``item``; bit-parallel, any length."""
    n = len(item)
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        hp, hm = (down | ~(diag | up)) & full, up & diag
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        up, down = (hm | ~(diag | hp)) & full, hp & diag
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Walk:
    """One repeat: step bits by word and the sampled steps."""
    seed: int
    steps: list[int]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Hash of the sampled steps of the walk over each row of word ids."""
        row = np.arange(len(windows)) * (windows.shape[1] + 1)
        flat = np.hstack([windows, np.zeros((len(windows), 1), np.uint64)]).ravel()  # the walk stops at the padding
        width, at = windows.shape[1], np.zeros(len(windows), dtype=np.int64)
        key = np.full(len(windows), width, dtype=np.uint64)
        for t in range(self.steps[-1] + 1):
            word = flat[row + at]
            if t in self.steps:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
            bit = ((word + np.uint64(1)) * np.uint64(self.seed * 2 + 1) * ODD[t % len(ODD)]) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), width)
        return key


@dataclass
class Class:
    """Items or pieces of similar length, searched with windows of one width."""
    width: int
    stride: int
    need: int
    walks: list[Walk]
    vocabulary: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)


def simulated_hit_rate(rng, walks_of, width: int, edits: int, pairs: int = 200, most: int = 20_000) -> float:
    """Share of random windows that keep their key after ``edits`` random word edits, over fresh walks.

    Rates too low to be told from ``pairs`` windows take more of them, up to ``most``.
    """
    hits = tried = 0
    while tried < pairs or hits < 10 and tried < most:
        tried += 1
        a = rng.integers(10, 1 << 40, width, dtype=np.uint64)
        b = list(a)
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(b)))
            new = np.uint64(rng.integers(10, 1 << 40))
            if kind == 0:
                b[at] = new
            elif kind == 1:
                b.insert(at, new)
            elif len(b) > 1:
                del b[at]
        b = np.array((b + list(rng.integers(10, 1 << 40, width, dtype=np.uint64)))[:width], dtype=np.uint64)
        keys = walks_of(int(rng.integers(1 << 30))).keys(np.stack([a, b]))
        hits += keys[0] == keys[1]
    return (hits + 1) / (tried + 2)


class Index:
    """LSH tables over the windows of the items; built once, sent to the tasks."""

    def __init__(self, items: list[tuple[int, list[bytes]]], *, edit_share: float, target_recall: float, samples: int, seed: int = 3) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.edit_share = edit_share
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.ids = {x: i + 2 for i, x in enumerate(vocabulary)}
        self.classes: list[Class] = []
        rng = np.random.default_rng(seed)
        #: (item, first word in it, words, edits that one of the item's pieces does not exceed)
        self.pieces = [(i, a, w[a:b], int(edit_share * len(w)) // m) for i, (_, w) in enumerate(self.items)
                       for m in [-(-len(w) // PIECE_WORDS)] for a, b in [(len(w) * j // m, len(w) * (j + 1) // m) for j in range(m)]]
        by_length = sorted(range(len(self.pieces)), key=lambda p: len(self.pieces[p][2]))
        group: list[int] = []
        for i in [*by_length, None]:
            if group and (i is None or len(self.pieces[i][2]) > 1.15 * len(self.pieces[group[0]][2])):
                self.add(group, rng, target_recall, samples)
                group = []
            if i is not None:
                group.append(i)

    def add(self, group: list[int], rng, target_recall: float, samples: int) -> None:
        least, most = len(self.pieces[group[0]][2]), len(self.pieces[group[-1]][2])
        stride = max(1, min(8, least // 5))
        width = least - stride + 1
        edits = max(self.pieces[p][3] for p in group)

        def walk(seed: int) -> Walk:
            r = np.random.default_rng(seed)
            return Walk(int(r.integers(1 << 60)), sorted(r.choice(width, min(samples, width), replace=False).tolist()))

        # edits fall over the whole piece, a window sees its share of them
        rate = simulated_hit_rate(rng, walk, width, math.ceil(edits * width / most))
        repeats = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - rate)))
        walks = [walk(int(rng.integers(1 << 30))) for _ in range(repeats)]
        own = np.zeros(len(self.ids) + 2, dtype=bool)
        found = Class(width, stride, max(1, width - edits), walks, own)
        windows, origin = [], []
        for p in group:
            i, first, part, _ = self.pieces[p]
            ids = np.array([self.ids[x] for x in part], dtype=np.uint64)
            own[ids.astype(np.int64)] = True
            for offset in range(len(ids) - width + 1):
                windows.append(ids[offset:offset + width])
                origin.append((i, first + offset))
        windows = np.stack(windows)
        for walk_ in walks:
            table: dict[int, set] = {}
            for key, at in zip(walk_.keys(windows).tolist(), origin):
                table.setdefault(key, set()).add(at)
            found.tables.append(table)
            found.keys.append(np.array(sorted(table), dtype=np.uint64))
        self.classes.append(found)

    def search(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item, edits, item words, first word, last word) of the best place of every item that occurs."""
        get = self.ids.get
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        widest = max((c.width for c in self.classes), default=0)
        ids = np.zeros(edge[-1] + widest, dtype=np.int64)
        ids[:edge[-1]] = [get(w, 1) for t in texts for w in t]
        owner = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(edge[-1]) - edge[owner]
        candidates: list[dict[int, set[int]]] = [{} for _ in texts]
        for c in self.classes:
            known = np.concatenate([[0], np.cumsum(c.vocabulary[ids])])
            starts = np.flatnonzero(place % c.stride == 0)
            ends = np.minimum(starts + c.width, edge[owner[starts] + 1])
            starts = starts[known[ends] - known[starts] >= c.need]
            if not len(starts):
                continue
            inside = starts[:, None] + np.arange(c.width)
            windows = np.where(inside < edge[owner[starts] + 1][:, None], ids[inside], 0).astype(np.uint64)
            for walk, table, wanted in zip(c.walks, c.tables, c.keys):
                keys = walk.keys(windows)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                for i in np.flatnonzero(wanted[at] == keys):
                    start = int(starts[i])
                    for item, offset in table[int(keys[i])]:
                        candidates[owner[start]].setdefault(item, set()).add(int(place[start]) - offset)
        return [[hit for item, places in sorted(found.items()) if (hit := self.verify(text, item, places))]
                for text, found in zip(texts, candidates)]

    def verify(self, text: list[bytes], item: int, places: set[int]):
        item_id, own = self.items[item]
        n = len(own)
        k = int(self.edit_share * n)
        best = None
        for a, b in merged(places, n, k):
            part = text[max(0, a):b]
            edits, end = fitting_distance(own, part)
            if edits <= k and (best is None or edits < best[0]):
                length = first_length(own, part[:end], edits)
                best = (edits, max(0, a) + end - length, max(0, a) + end - 1)
        return None if best is None else (item_id, best[0], n, best[1], best[2])


def first_length(item: list, text: list, edits: int) -> int:
    """Shortest suffix of ``text`` at the given distance from ``item``."""
    row = list(range(len(item) + 1))
    if row[-1] == edits:
        return 0
    reverse = item[::-1]
    for j, w in enumerate(reversed(text), 1):
        new = [j]
        for i, x in enumerate(reverse, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
        row = new
        if row[-1] == edits:
            return j
    return len(text)


def merged(places: set[int], n: int, k: int) -> list[tuple[int, int]]:
    """Word ranges around candidate starts, overlapping ones joined up to twice the item's length."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        a, b = p - k, p + n + k
        if out and a <= out[-1][1] and b - out[-1][0] <= 2 * n + 4 * k:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def portions(texts: Iterable[list[bytes]], most: int = 500_000) -> Iterator[list[list[bytes]]]:
    """Texts in runs of about ``most`` words, searched together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def hits_of(spark, index: Index):
    """Column function: text -> array of hits of the indexed items."""
    shared = spark.sparkContext.broadcast(index)
    names = [x.split()[0] for x in HIT.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in HIT.split(', '))}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for series in batches:
            found = []
            for part in portions(words(t) for t in series):
                found += [[dict(zip(names, h)) for h in hits] for hits in known.search(part)]
            yield pd.Series(found, dtype="object")

    return find


def blocks(items: DataFrame, *, item_key: str, item_text: str, block_items: int, **options) -> Iterator[Index]:
    """Indexes of at most about ``block_items`` items each, so what is broadcast is bounded."""
    rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL").distinct()
    n = max(1, math.ceil(rows.count() / block_items))
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == b) if n > 1 else rows
        found = [(r["i"], words(r["t"])) for r in part.orderBy("i", "t").toLocalIterator()]
        if any(w for _, w in found):
            yield Index(found, **options)


def contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 edit_share: float = 0.2, target_recall: float = 0.95, samples: int = 4, block_items: int = BLOCK_ITEMS,
                 out: str = "hits") -> DataFrame:
    """``docs`` with an array of hits (fields of ``HIT``), one per item found, in a column that clashes with no other.

    Row by row; nothing is shuffled. Null and empty texts, and items without
    words, have no hits; an item id that occurs with several texts may hit once
    for each. Repeated rows get equal results.
    """
    name, spark = free_name(docs, out), docs.sparkSession
    found = [hits_of(spark, index)(F.col(text)) for index in
             blocks(items, item_key=item_key, item_text=item_text, block_items=block_items,
                    edit_share=edit_share, target_recall=target_recall, samples=samples)]
    if not found:
        return docs.withColumn(name, F.from_json(F.lit("[]"), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in HIT.split(', '))}>>"))
    return docs.withColumn(name, found[0] if len(found) == 1 else F.concat(*found))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows without any hit, columns unchanged."""
    name = free_name(docs, "_hits")
    return contaminated(docs, items, out=name, **options).filter(F.size(name) == 0).select(*docs.columns)
