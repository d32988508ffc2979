"""Packing token pieces into sequences: best fit, then swap-based local search.

How many sequences are needed depends only on how many pieces there are of each
length, at most ``capacity`` numbers whatever the corpus. Best-fit decreasing runs
on these counts and yields kinds of sequences (a multiset of lengths and how often
it is used). Local search then moves pieces between underfull kinds, or exchanges
one for one or two for one, whenever that raises the sum of squared fills; fills
drift apart until sequences empty out. At last every piece, numbered within its
length by Spark, looks up its place.
"""

import struct
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellsieve.llm.common import CACHE_ENTRIES, text_of

CAPACITY = 1024
END_OF_TEXT = 2
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"

# Characters for which the pattern below cuts words as the tokenizer does.
_LETTERS = "A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F"
_PLAIN = f"[\\t\\n\\r\\x20-\\x7E\\u00A1\\u00A7\\u00A9\\u00AB\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF\\u00D7\\u00F7{_LETTERS}\\u2013\\u2014\\u2018-\\u201E\\u2022\\u2026\\u20AC]*"
_WORD = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")


def byte_of_symbol() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable Latin-1 stands for itself, the rest follows at 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of the byte-level BPE in a ``tokenizers`` file, as little-endian 32-bit numbers.

    Byte-level BPE never merges across the tokenizer's own word pattern, so the ids
    of a plain text are those of its words, which are remembered. A word's ids come
    from ``tiktoken`` over the vocabulary of the file (merge order and ids agree in
    it); texts with other characters go to ``tokenizers`` whole. The tests compare both.

    With ``added`` the added tokens of the file (such as the end of a text) are single
    ids where their strings stand in a text, as ``tokenizers`` does by itself; without,
    their strings are plain text. More than ``entries`` remembered words are forgotten.
    """

    def __init__(self, path: str, added: bool = True, entries: int = CACHE_ENTRIES) -> None:
        import os
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import tiktoken
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not added
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in self.model.get_vocab(False).items()}
        extra = self.model.get_added_tokens_decoder()
        special = set(extra)
        self.added = re.compile("|".join(re.escape(t.content) for t in extra.values()) or "(?!)") if added else None
        self.one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", special_tokens={},
                                     mergeable_ranks={t: i for t, i in ranks.items() if i not in special})._core_bpe.encode_single_piece
        self.plain, self.word, self.known, self.entries = re.compile(_PLAIN), re.compile(_WORD), {}, entries

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text_of(text)
        if not self.plain.fullmatch(text) or self.added and self.added.search(text):
            return self.whole(text)
        known = self.known
        if len(known) > self.entries:
            known.clear()
        found = self.word.findall(text)
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pack = struct.pack
            for w in found:
                if w not in known:
                    ids = self.one(w.encode("utf-8"))
                    known[w] = pack(f"<{len(ids)}I", *ids)
            return b"".join(map(known.__getitem__, found))


@lru_cache(maxsize=4)
def tokens_of(path: str, added: bool = True, entries: int = CACHE_ENTRIES) -> Tokens:
    """One per worker process and file, so the tasks of a worker share what it remembers."""
    return Tokens(path, added, entries)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); a document over ``capacity`` ids has a shorter first piece, the others are full."""
    import zlib
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)] if n else [0]
    return [(i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int = END_OF_TEXT) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. Null text is one piece with the end token alone."""
    tail = np.array([end], dtype="<u4").tobytes()

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in PIECE.split(', '))}>>")
    def tokenized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, names = tokens_of(tokenizer), [x.split()[0] for x in PIECE.split(", ")]
        for series in batches:
            yield pd.Series([[dict(zip(names, p)) for p in cut(tokens(t) + tail, capacity)] for t in series], dtype="object")

    cuts = docs.select(F.col(key).alias("_key"), F.explode(tokenized(F.col(text))).alias("_p"))
    return cuts.select(F.col("_key").alias(key), "_p.*")


# --- kinds of sequences -------------------------------------------------------

def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on counts: {lengths, descending: sequences of that kind}.

    All pieces of a length go to the fullest sequences with room, many at a time.
    """
    kinds: Counter = Counter()
    room: dict[int, set] = {}
    open_rooms: list[int] = []

    def put(kind: tuple, n: int, left: int) -> None:
        kinds[kind] += n
        if left:
            if left not in room or not room[left]:
                room[left] = set()
                insort(open_rooms, left)
            room[left].add(kind)

    def take(kind: tuple, n: int, left: int) -> None:
        kinds[kind] -= n
        if not kinds[kind]:
            del kinds[kind]
            room[left].discard(kind)
            if not room[left]:
                open_rooms.remove(left)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full, capacity - fit * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            size = open_rooms[at]
            kind = min(room[size])
            fit = size // length
            n = min(kinds[kind], left // fit) if left >= fit else 1
            fit = fit if left >= fit else left
            take(kind, n, size)
            put(kind + (length,) * fit, n, size - fit * length)
            left -= n * fit
    return Counter({tuple(sorted(k, reverse=True)): n for k, n in kinds.items()})


def gain(a: int, b: int, moved: int) -> int:
    """Change of the sum of squared fills when the fuller ``a`` takes a net ``moved`` from ``b``."""
    return (a + moved) ** 2 + (b - moved) ** 2 - a * a - b * b


def without(kind: tuple, *lengths: int) -> tuple:
    rest = list(kind)
    for x in lengths:
        rest.remove(x)
    return tuple(rest)


def best_exchange(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The move, one-for-one or two-for-one exchange between two sequences that raises squared fill most."""
    if sum(a) < sum(b):
        a, b = b, a
    fa, fb = sum(a), sum(b)
    free, best, out = capacity - fa, 0, None

    def offer(moved: int, give: tuple, get: tuple) -> None:
        nonlocal best, out
        if 0 < moved <= free and (g := gain(fa, fb, moved)) > best:
            best, out = g, (tuple(sorted(without(a, *give) + get, reverse=True)), without(b, *get) + give)

    mine, theirs = sorted(set(a)), sorted(set(b))
    pairs = sorted({(x, y) for i, x in enumerate(b) for y in b[i + 1:]})
    for y in theirs:
        offer(y, (), (y,))
        for x in mine:
            offer(y - x, (x,), (y,))
    for y, z in pairs:
        for x in mine:
            offer(y + z - x, (x,), (y, z))
    own = sorted({(x, y) for i, x in enumerate(a) for y in a[i + 1:]})
    for x, z in own:
        for y in theirs:
            offer(y - x - z, (x, z), (y,))
    return None if out is None else (out[0], tuple(sorted(out[1], reverse=True)))


def pairs_of(under: list[tuple], tries: int) -> Iterator[tuple[tuple, tuple]]:
    """All pairs (fuller, emptier or equal) of kinds in rising fill: first the ``tries`` emptiest with the ``tries`` fullest, then the rest."""
    edge = len(under) - tries
    for first in (True, False):
        for i, b in enumerate(under):
            for j in range(len(under) - 1, i - 1, -1):
                if (i < tries and j >= edge) == first:
                    yield under[j], b
                elif first:
                    break


def local_search(kinds: Counter, capacity: int, tries: int = 64) -> Counter:
    """Exchange pieces between underfull sequences until no exchange of any two raises squared fill.

    The ``tries`` emptiest kinds are worked on first, each against as many of the
    fullest underfull kinds, then all others. An exchange acts on all sequences of
    the two kinds at once. Squared fill rises with each, so the search ends. Pieces
    are never lost: every exchange keeps the multiset of lengths.
    """
    kinds = Counter({k: n for k, n in kinds.items() if n})
    done: set = set()
    while True:
        under = sorted((k for k in kinds if sum(k) < capacity), key=lambda k: (sum(k), k))
        found = None
        for a, b in pairs_of(under, tries):
            if (a, b) in done or a == b and kinds[a] < 2:
                continue
            found = best_exchange(a, b, capacity)
            if found:
                break
            done.add((a, b))
        if not found:
            return kinds
        n = kinds[a] // 2 if a == b else min(kinds[a], kinds[b])
        for k, d in ((a, -n), (b, -n), (found[0], n), (found[1], n)):
            if k:
                kinds[k] += d
                if not kinds[k]:
                    del kinds[k]


def places(kinds: Counter) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, ranks, first sequence, offset) for runs of ranks that share a place in one kind."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for kind, n in sorted(kinds.items(), reverse=True):
        offset = 0
        for length in kind:
            out.setdefault(length, []).append((used[length], n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def ranked_in_length(cuts: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """``cuts`` with ``_rank``, gapless from 0 within a length, though one length may hold a third of all pieces.

    A length is numbered in parts by the hash of key and piece; parts are offset by the counts before them.
    """
    parts = max(1, cuts.count() // part_rows)
    salted = cuts.withColumn("_part", F.pmod(F.xxhash64(*[c for c in cuts.columns if c != "length"]), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("length", "_part").orderBy(*[c for c in cuts.columns if c != "length"])
    return (salted.withColumn("_own", F.row_number().over(inside) - 1).join(offsets, ["length", "_part"])
            .withColumn("_rank", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before"))


def assign(ranked: DataFrame, runs: dict[int, list]) -> DataFrame:
    """Sequence and offset of every ranked piece, by binary search in the runs of its length."""
    spark: SparkSession = ranked.sparkSession
    shared = spark.sparkContext.broadcast({n: np.array(r, dtype=np.int64) for n, r in runs.items()})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for value in np.unique(n):
            at = np.flatnonzero(n == value)
            run = table[int(value)]
            i = np.searchsorted(run[:, 0], r[at], side="right") - 1
            seq[at], off[at] = run[i, 2] + r[at] - run[i, 0], run[i, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_place", place("length", "_rank")).select("*", "_place.*").drop("_place", "_rank")


def pack(cuts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``cuts`` (a written table with a ``length`` column) with sequence_id and offset.

    Only the counts by length (at most ``capacity`` rows) come to the driver. An
    empty table gives no rows; repeated rows are packed one by one.
    """
    counts = {int(r["length"]): int(r["n"]) for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return assign(ranked_in_length(cuts), places(local_search(best_fit(counts, capacity), capacity)))
