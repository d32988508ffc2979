"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

Texts are cut into the words of a pattern, a batch of documents at a time, and each
batch becomes one row: its documents as lists of word numbers beside the ids of its
distinct words. A word starts as its bytes; all distinct words of a batch are merged
side by side in arrays, every step joining the leftmost pair of the lowest rank of each.
What is derived from the ids is worked out by Spark once per distinct word and joined
per document. Nothing is shuffled, so one document, word or source with a third of all
rows costs no more than its share.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from shellsieve.llm.common import byte_slices

#: UTF-8 bytes of text in one batch row; a longer document is a batch of its own.
BATCH_BYTES = 8_000_000
#: Words merged side by side, and the bytes up to which a word is.
ROWS, LONG = 8_192, 64
#: In place of a rank where a pair has none.
NO_RANK = 2**40


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is also the id, of each byte string of a ``.tiktoken`` file (a few MB whatever the corpus)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: the end of a fold over nothing, which copies no arrays."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


class Merges:
    """Ranked merges of many words at once: every step joins, in each word, the leftmost pair of the lowest rank.

    Words are rows of a table of ids, filled up with -1. Longer ones than ``LONG`` are
    merged by themselves with a heap of their pairs, in n log n steps.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pairs = ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.keys = np.array(sorted(self.pairs) or [-2], np.int64)
        self.values = np.array([self.pairs.get(k, NO_RANK) for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        size = np.array([len(w) for w in words])
        width = max(2, size.max())
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks, rows, place = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(words)), np.arange(width)
        while len(rows):
            held = ranks[rows]
            at = held.argmin(1)
            low = held[np.arange(len(rows)), at]
            more = low < NO_RANK
            rows, at, low, held = rows[more], at[more], low[more], held[more]
            if not len(rows):
                break
            # what stands behind the pair moves up by one
            source = np.minimum(place + (place > at[:, None]), width - 1)
            moved = np.take_along_axis(ids[rows], source, 1)
            moved[:, -1] = -1
            moved[np.arange(len(rows)), at] = low
            held = np.take_along_axis(held, np.minimum(source[:, :-1], width - 2), 1)
            held[:, -1] = NO_RANK
            held[np.arange(len(rows)), at] = self.rank(low, moved[np.arange(len(rows)), at + 1])
            behind = np.flatnonzero(at > 0)
            held[behind, at[behind] - 1] = self.rank(moved[behind, at[behind] - 1], low[behind])
            ids[rows], ranks[rows] = moved, held
        return ids[ids >= 0], np.count_nonzero(ids >= 0, axis=1)

    def alone(self, word: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            rank = self.pairs.get(ids[i] << 32 | ids[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j == n or ids[j] != right:
                continue  # one of the two was merged before
            ids[i], ids[j], after[i] = low, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                add(i, after[i])
            if before[i] >= 0:
                add(before[i], i)
        return [x for x in ids if x >= 0]

    def __call__(self, words: list[bytes]) -> pa.ListArray:
        """The ids of each word: its own where the whole word has a rank, else what the merges leave."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        known, rest = np.flatnonzero(whole >= 0), np.flatnonzero(whole < 0)
        rest = rest[np.argsort(size[rest], kind="stable")]
        short = int(np.searchsorted(size[rest], LONG, side="right"))
        flat, counts = [whole[known]], [np.ones(len(known), np.int64)]
        for start in range(0, short, ROWS):
            ids, n = self.together([words[i] for i in rest[start:min(short, start + ROWS)]])
            flat.append(ids)
            counts.append(n)
        for i in rest[short:]:
            ids = np.array(self.alone(words[i]), np.int64)
            flat.append(ids)
            counts.append(np.array([len(ids)]))
        place = np.empty(len(words), np.int64)
        place[np.concatenate([known, rest])] = np.arange(len(words))
        ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).astype(np.int32))).take(pa.array(place))


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    """One per worker process."""
    return Merges(read_ranks(path))


class Cutter:
    """The matches of a pattern, with letters and numbers as the Unicode tables of ``tiktoken`` have them.

    The ``regex`` library takes more code points that Python does not know for letters or
    numbers; where a text holds one, a sign that is neither stands in for it while the
    text is cut.
    """

    def __init__(self, pattern: str) -> None:
        import unicodedata

        import regex
        import tiktoken
        known = tiktoken.Encoding("signs", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.odd = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and not known.encode_ordinary(c))
        self.instead = dict.fromkeys(map(ord, self.odd), "\ufffe")
        self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.instead))]


@lru_cache(maxsize=4)
def cutter_of(pattern: str) -> Cutter:
    """One per worker process."""
    return Cutter(pattern)


def in_batches(docs: DataFrame, text: str, pattern: str, ranks_path: str, batch_bytes: int) -> DataFrame:
    """One row per batch: ``rows`` (the documents), ``codes`` (per document its words as places in ``words``), ``words`` (ids of the distinct ones)."""
    schema = StructType([StructField("rows", ArrayType(docs.schema)), StructField("codes", ArrayType(ArrayType(IntegerType()))),
                         StructField("words", ArrayType(ArrayType(IntegerType())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merges = cutter_of(pattern), merges_of(ranks_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for start, stop in byte_slices(texts, batch_bytes):
                found, ends = [], [0]
                for t in texts.slice(start, stop - start).to_pylist():
                    found += find(t) if t else ()
                    ends.append(len(found))
                coded = pa.array(found, pa.string()).dictionary_encode()
                codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices)
                words = merges(coded.dictionary.cast(pa.binary()).to_pylist())
                rows = pa.StructArray.from_arrays([c.slice(start, stop - start) for c in batch.columns], fields=list(batch.schema))
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, codes, words)]
                yield pa.RecordBatch.from_arrays(one, ["rows", "codes", "words"])

    return docs.mapInArrow(cut, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", out: str = "ids", keep: list[str] | None = None,
           joined: dict[str, Callable[[Column], Column]] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``out``, the ids of the whole text as array<int>.

    Every match of ``pattern`` is encoded by itself, without special tokens. With
    ``joined`` there is, in place of ``out``, one string per entry: what its function
    makes of each word's ids, one word after another; it runs once per distinct word.
    Null and empty texts have no ids. Equal words and repeated rows give equal ids, each
    row is kept; an empty table gives no rows. A text of any length is one list, and a
    word of n bytes takes n log n steps. Other columns may have any names but the new ones, which are replaced.
    """
    made = joined or {out: lambda ids: ids}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in made}]
    batches = in_batches(docs.select(text, *[c for c in keep if c != text]), text, pattern, ranks_path, batch_bytes)

    def per_word(ids: Column) -> Column:
        return F.struct(*[f(ids).alias(n) for n, f in made.items()])

    def per_row(known: Column) -> Column:
        def value(codes: Column, name: str) -> Column:
            of_words = F.transform(codes, lambda c: F.get(known, c)[name])
            return F.array_join(of_words, "") if joined else F.flatten(of_words)
        return F.transform("codes", lambda codes: F.struct(*[value(codes, n).alias(n) for n in made]))

    each = batches.select(F.explode(F.arrays_zip(F.col("rows"), bind(F.transform("words", per_word), per_row).alias("made"))).alias("one"))
    return each.select(*[F.col("one.rows")[c].alias(c) for c in keep], *[F.col("one.made")[n].alias(n) for n in made])


def hex_pieces(ids: Column, ranks_path: str) -> Column:
    """The byte strings of the ids in hexadecimal, concatenated; null if an id has none."""
    ranks = read_ranks(ranks_path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    known = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    found = bind(known, lambda k: F.transform(ids, lambda i: F.get(k, i)))
    return bind(found, lambda f: F.when(F.exists(f, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_join(f, "")))


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of a list of ids: their pieces, concatenated. Null for null, no bytes for an empty list, null if an id has no piece."""
    return F.unhex(hex_pieces(ids, ranks_path))


def hex_little_endian(ids: Column) -> Column:
    """The ids as little-endian unsigned 32-bit integers in hexadecimal, one after another."""
    def turned(x: Column) -> Column:
        x = x.cast("bigint").bitwiseAND(F.lit(2**32 - 1))
        bytes_ = [F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)), 24 - 8 * k) for k in range(4)]
        return F.substring(F.hex(sum(bytes_, F.lit(2**32))), 2, 8)

    return F.array_join(F.transform(ids, turned), "")
