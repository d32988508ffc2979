"""Log-likelihood of texts under an interpolated modified Kneser-Ney model of trusted words, order 3, within little disk.

In back-off form log p(w | u, v) is a sum of weights: of the word w, of the pair (v, w)
and the triple (u, v, w) where trusted text has them, and of the contexts v and (u, v).
Only trusted text is counted, and a text's likelihood is the sum of the weights it meets.

The work goes in rounds. A round takes the triples whose middle word falls in its part of
the hash space: counts, contexts and continuation counts of such triples need no other
round. Texts are cut into words anew in every round, since their words would take more
disk than the texts. Within a round grams go to shards by 64-bit hashes of pairs, as
arrays; a common word is spread over all shards by its neighbours. What a round wrote is
removed before the next one starts, so disk stays far below the sum of all grams.
"""

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import byte_slices
from shellsieve.session import Scratch, is_small

#: Scripts without blanks between words: kana, Han, Thai, Lao, Burmese, Khmer.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A character of such a script, a word of any other, or a run of signs; the case of letters is kept.
TOKEN = re.compile(rf"[{ALONE}]|[^\W{ALONE}]+|[^\w\s{ALONE}]+")
START, END = 0, 1
#: Words for which a round is made, and rounds at most.
ROUND_WORDS, ROUNDS = 2_000_000, 8
#: Grams of trusted text that a shard holds in memory in one round, and shards at least.
SHARD_GRAMS, SHARDS = 4_000_000, 24
#: UTF-8 bytes cut into words at once and of a portion of the texts, and words of a portion of trusted text.
CUT_BYTES, TEXT_BYTES, PORTION = 1 << 19, 1 << 21, 1 << 18
#: Ids of trusted texts up to which they are broadcast.
TRUSTED_IDS = 4_000_000
GRAMS, WEIGHTS, REQUESTS = 0, 1, 2
BLOBS = "shard int, kind int, docs int, rows int, data binary"
_STEP, _A, _B, _PAIR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_WORD, _TARGET, _CONTEXT = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


@cache
def kinds() -> np.ndarray:
    """By code point: 0 blank, 1 part of a word, 2 sign, 3 a word of its own."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every, out = "".join(map(chr, points)), np.full(0x110000, 2, np.uint8)
    for kind, pattern in ((0, r"\s+"), (1, rf"[^\W{ALONE}]+"), (3, rf"[{ALONE}]+")):
        for m in re.finditer(pattern, every):
            out[points[m.start():m.end()]] = kind
    return out


@cache
def codes() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * _STEP)


@cache
def few_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(CUT_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of a fixed odd number modulo 2^64, and their inverses."""
    out = []
    for base in (int(_STEP), pow(int(_STEP), -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def token_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words and signs (``TOKEN``) of the texts, each followed by ``END``, and where each text ends.

    No text is null or empty.
    """
    parts = [few_ids(texts.slice(start, stop - start)) for start, stop in byte_slices(texts, CUT_BYTES)]
    shift = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return (np.concatenate([np.empty(0, np.uint64), *(ids for ids, _ in parts)]),
            np.concatenate([np.empty(0, np.int64), *(ends + n for (_, ends), n in zip(parts, shift))]))


def few_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``token_ids`` of texts that are cut at once; a word's id is a polynomial of its characters, taken from running sums over all texts."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2])[at[0]:at[-1]])
    at = at - at[0]
    if raw.isascii():
        points = np.frombuffer(raw, np.uint8)
    else:
        at = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())])
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    edge[at] = True
    first, last = np.flatnonzero(edge[:-1] & (kind > 0)), np.flatnonzero(edge[1:] & (kind > 0)) + 1
    up, down = few_powers() if len(points) <= CUT_BYTES else powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(codes()[points] * up[:len(points)], out=total[1:])
    ids = mixed((total[last] - total[first]) * down[first])
    cuts = np.searchsorted(first, at[1:])
    return np.insert(ids, cuts, np.uint64(END)), cuts + np.arange(1, len(cuts) + 1)


def before(ids: np.ndarray, ends: np.ndarray, start: int = START) -> np.ndarray:
    """What stands before each place of its text; ``start`` before the first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], ends[:-1]])] = start
    return out


def spread(x: np.ndarray, parts: int) -> np.ndarray:
    """Even parts of 32-bit numbers."""
    return (x * np.uint64(parts)) >> np.uint64(32)


def round_of(words: np.ndarray, rounds: int) -> np.ndarray:
    return spread(words >> np.uint64(32), rounds)


def word_key(words: np.ndarray) -> np.ndarray:
    return words ^ _WORD


def target_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * _TARGET + w * _PAIR + _WORD)


def context_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(u * _CONTEXT + v * _STEP)


def triple_key(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(context + w * _PAIR)


def packed(x: np.ndarray) -> bytes:
    """Bytes of an array, those of the same weight together, which compresses small numbers; hashes as they are."""
    x = np.ascontiguousarray(x)
    return x.tobytes() if x.dtype == np.uint64 else x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * width, at)
    return raw.view(kind) if kind is np.uint64 else np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(n)


def unpacked_all(data: bytes, kinds_: tuple[type, ...], n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds_:
        out.append(unpacked(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def split(key: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard that ``key`` names."""
    shard = spread(key & np.uint64(0xFFFFFFFF), shards).astype(np.uint16)
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    arrays = [a[order] for a in arrays]
    for s, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
        if b > a:
            yield s, [x[a:b] for x in arrays]


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                                      ["shard", "kind", "docs", "rows", "data"])


def dealt(blobs: DataFrame, shards: int) -> DataFrame:
    """The blobs of a shard together, its grams and weights before the requests."""
    return blobs.repartition(shards, "shard").sortWithinPartitions("shard", "kind")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, pa.Buffer]]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("shard", "kind", "docs", "rows")), (x.as_buffer() for x in batch["data"]))


def gathered(batches: Iterator[pa.RecordBatch], kinds_: tuple[type, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """All arrays of each shard, joined."""
    current, parts = None, []
    for shard, _, _, rows, data in by_shard(batches):
        if shard != current and parts:
            yield current, [np.concatenate(x) for x in zip(*parts)]
            parts = []
        current = shard
        parts.append(unpacked_all(data, kinds_, rows))
    if parts:
        yield current, [np.concatenate(x) for x in zip(*parts)]


def text_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about ``TEXT_BYTES`` of text together."""
    parts, size = [], 0
    for batch in batches:
        for start, stop in byte_slices(batch["text"], TEXT_BYTES):
            part = batch.slice(start, stop - start)
            more = part["text"].nbytes
            if parts and size + more > TEXT_BYTES:
                yield pa.concat_batches(parts)
                parts, size = [], 0
            parts.append(part)
            size += more
    if parts:
        yield pa.concat_batches(parts)


class Discounts:
    """D1, D2, D3+ of a level, and whether each is above 0 where counts of its class occur."""

    def __init__(self, ones: int, twos: int, threes: int, fours: int, three_or_more: int) -> None:
        n = ones, twos, threes, fours
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
        self.of_class = np.array([0.0, *(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))])
        self.sizes = ones, twos, three_or_more
        self.proper = all(x > 0 or not m for x, m in zip(self.of_class[1:], self.sizes))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.of_class[np.minimum(counts, 3)]

    def free(self, ones, twos, three_or_more):
        d = [float(x) for x in self.of_class[1:]]
        return ones * d[0] + twos * d[1] + three_or_more * d[2]


def classes(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


def seen(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (k1, k2, n) of each text with its number of words, and rows (shard, data) with the different words of a portion."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_portions(batches):
            ids, ends = token_ids(part["text"])
            words = np.unique(ids)
            own = list(split(word_key(words), shards, words))
            none, m = len(own) * [None], len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([part["k1"], pa.array(none, pa.int64())]), pa.concat_arrays([part["k2"], pa.array(none, pa.int64())]),
                 pa.array([*np.diff(ends, prepend=0).tolist(), *none], pa.int64()), pa.array([*m * [None], *(s for s, _ in own)], pa.int32()),
                 pa.array([*m * [None], *(x.tobytes() for _, (x,) in own)], pa.binary())], ["k1", "k2", "n", "shard", "data"])

    return docs.mapInArrow(read, "k1 bigint, k2 bigint, n bigint, shard int, data binary")


def different(blobs: DataFrame, shards: int) -> int:
    """Different words in the rows (shard, data) of ``seen``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, new, size = np.empty(0, np.uint64), [], 0
        for batch in batches:
            for data in batch["data"].to_pylist():
                new.append(np.frombuffer(data, np.uint64))
                size += len(new[-1])
                if size > max(PORTION, len(known)):
                    known, new, size = np.unique(np.concatenate([known, *new])), [], 0
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(np.concatenate([known, *new])))], pa.int64())], ["n"])

    return blobs.repartition(shards, "shard").select("data").mapInArrow(count, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0


def portions(trusted: DataFrame) -> DataFrame:
    """Trusted texts as (part, size, words, length, tokens, texts, ends): the words of a portion, and its tokens as their numbers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in parts])
            lengths = np.concatenate([np.diff(e, prepend=0) for _, e in parts]).astype(np.int64)
            words, number = np.unique(np.concatenate([np.array([START], np.uint64), ids]), return_inverse=True)
            values = (int.from_bytes(os.urandom(8), "little", signed=True), len(words), packed(words), len(ids),
                      packed(number[1:].astype(np.uint32)), len(lengths), packed(lengths))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))],
                                              ["part", "size", "words", "length", "tokens", "texts", "lengths"])

        parts, size = [], 0
        for part in text_portions(batches):
            parts.append(token_ids(part["text"]))
            size += len(parts[-1][0])
            if size >= PORTION:
                yield row(parts)
                parts, size = [], 0
        if parts:
            yield row(parts)

    return trusted.mapInArrow(read, "part bigint, size bigint, words binary, length bigint, tokens binary, texts bigint, lengths binary")


def own_triples(row: dict, number: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a portion, and the numbers of u, v and w of each place whose middle word is in the round."""
    words = unpacked(row["words"], np.uint64, row["size"])
    w = unpacked(row["tokens"], np.uint32, row["length"])
    ends = np.cumsum(unpacked(row["lengths"], np.int64, row["texts"]))
    v = before(w, ends)
    u = before(v, ends)
    at = np.flatnonzero((round_of(words, rounds) == number)[v])
    return words, u[at], v[at], w[at]


def counted(table: DataFrame, number: int, rounds: int, shards: int) -> DataFrame:
    """(level, word, x1 ... x5) of one round: for words how many differ before them, then what follows them: number of pairs
    seen after different words, and those seen after one, two, more; for levels 2 and 3 the counts of counts."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            words, u, v, w = own_triples(row, number, rounds)
            u, v, w = words[u], words[v], words[w]
            key = triple_key(context_key(u, v), w)
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            v, w = v[first], w[first]
            target = target_key(v, w)
            yield blob_batch([(s, GRAMS, 0, len(x[0]), b"".join(map(packed, x)))
                              for s, x in split(target, shards, key[first], target, v, w, np.bincount(group))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, target, v, w, n) in gathered(batches, (np.uint64, np.uint64, np.uint64, np.uint64, np.int64)):
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            triples = np.bincount(group, n).astype(np.int64)
            _, pick, group = np.unique(target[first], return_index=True, return_inverse=True)
            pairs, v, w = np.bincount(group), v[first][pick], w[first][pick]
            words, group = np.unique(np.concatenate([w, v]), return_inverse=True)
            of_w, of_v, m = group[:len(w)], group[len(w):], len(words)
            sums = [np.bincount(of_w, minlength=m), *(np.bincount(of_v, x, m).astype(np.int64) for x in (pairs, pairs == 1, pairs == 2, pairs >= 3))]
            stats = list(zip(classes(pairs), classes(triples)))
            yield pa.RecordBatch.from_arrays([pa.array([1] * m + [2, 3], pa.int32()),
                                              pa.array(np.concatenate([words.view(np.int64), [0, 0]]), pa.int64()),
                                              *(pa.array(np.concatenate([x, y]), pa.int64()) for x, y in zip(sums, stats))],
                                             ["level", "word", "x1", "x2", "x3", "x4", "x5"])

    return dealt(table.mapInArrow(emit, BLOBS), shards).mapInArrow(merge, "level int, word bigint, x1 bigint, x2 bigint, x3 bigint, x4 bigint, x5 bigint")


def informed(table: DataFrame, words: DataFrame) -> DataFrame:
    """``portions`` with what ``words`` (word, x1 ... x5) knows of each word of a portion."""
    names = [f"x{k}" for k in range(1, 6)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            own = unpacked(row["words"], np.uint64, row["size"]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["part"]), pa.int64()), pa.array(own)], ["part", "word"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["word"].to_numpy().view(np.uint64))
        for name in names:
            left = left.append_column(name, pa.array([packed(right[name].to_numpy()[order])], pa.binary()))
        return left

    asked = table.select("part", "size", "words").mapInArrow(emit, "part bigint, word bigint").join(words, "word", "left").fillna(0, names)
    schema = ", ".join(f"{c} {t}" for c, t in table.dtypes) + ", " + ", ".join(f"{x} binary" for x in names)
    return table.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(join, schema)


def trusted_blobs(table: DataFrame, number: int, rounds: int, shards: int, levels: dict[int, Discounts], total: int, floor: float) -> DataFrame:
    """Blobs of one round: triples of trusted text by context, and weights of its pairs."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist()):
            words, u, v, w = own_triples(row, number, rounds)
            ones, pairs, once, twice, more = (unpacked(row[f"x{k}"], np.int64, len(words)) for k in range(1, 6))
            p1 = (ones - levels[1](ones)) / total + floor
            free = levels[2].free(once, twice, more) / np.maximum(pairs, 1)
            context = context_key(words[u], words[v])
            key = triple_key(context, words[w])
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            v, w = v[first], w[first]
            target = target_key(words[v], words[w])
            yield blob_batch([(s, GRAMS, 0, len(x[0]), b"".join(map(packed, x)))
                              for s, x in split(target, shards, context[first], key[first], target, np.bincount(group), p1[w], pairs[v], free[v])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (context, key, target, n, p1, pairs, free) in gathered(batches, (np.uint64, np.uint64, np.uint64, np.int64, np.float64, np.int64, np.float64)):
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            triples = np.bincount(group, n).astype(np.int64)
            own, pick, group = np.unique(target[first], return_index=True, return_inverse=True)
            c = np.bincount(group)
            at = first[pick]
            p2 = (c - levels[2](c)) / pairs[at] + free[at] * p1[at]
            rows = [(shard, WEIGHTS, 0, len(own), packed(own) + packed(np.log(p2) - np.log(free[at]) - np.log(p1[at])))]
            rows += [(s, GRAMS, 0, len(x[0]), b"".join(map(packed, x))) for s, x in split(context[first], shards, context[first], key[first], triples, p2[group])]
            yield blob_batch(rows)

    return dealt(table.mapInArrow(emit, BLOBS), shards).mapInArrow(merge, BLOBS)


def word_blobs(words: DataFrame, number: int, rounds: int, shards: int, levels: dict[int, Discounts], total: int, floor: float) -> DataFrame:
    """Weights of the words of one round, less that of an unknown word."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch["word"].to_numpy().view(np.uint64)
            own = np.flatnonzero(round_of(word, rounds) == number)
            ones, pairs, once, twice, more = (batch[f"x{k}"].to_numpy()[own] for k in range(1, 6))
            p1 = np.where(ones > 0, (ones - levels[1](ones)) / total + floor, floor)
            free = np.where(pairs > 0, levels[2].free(once, twice, more) / np.maximum(pairs, 1), 1.0)
            key = word_key(word[own])
            yield blob_batch([(s, WEIGHTS, 0, len(x[0]), b"".join(map(packed, x))) for s, x in split(key, shards, key, np.log(p1 / floor) + np.log(free))])

    return words.mapInArrow(emit, BLOBS)


def request_blobs(docs: DataFrame, number: int, rounds: int, shards: int) -> DataFrame:
    """The weights that the texts ask for in one round; (k1, k2) of each text stand before its grams' keys and text numbers."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.array([START], np.uint64)
        first_asked = round_of(start, rounds)[0] == number
        for part in text_portions(batches):
            k1, k2 = (part[c].to_numpy() for c in ("k1", "k2"))
            w, ends = token_ids(part["text"])
            doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
            mine = round_of(w, rounds) == number
            middle = np.flatnonzero(before(mine, ends, first_asked))
            mine = np.flatnonzero(mine)
            v = before(w, ends)
            u = before(v, ends)[middle]
            v, ahead = v[middle], w[middle]
            context, target, word = context_key(u, v), target_key(v, ahead), word_key(w[mine])
            starts = np.repeat(word_key(start), len(ends) if first_asked else 0)
            key = np.concatenate([word, starts, target, context, triple_key(context, ahead)])
            place = np.concatenate([word, starts, target, context, context])
            of = np.concatenate([doc[mine], np.arange(len(starts), dtype=np.int32), doc[middle], doc[middle], doc[middle]])
            rows = []
            for s, (keys, texts) in split(place, shards, key, of):
                here = np.bincount(texts, minlength=len(ends)) > 0
                at = np.flatnonzero(here)
                texts = (np.cumsum(here) - 1).astype(np.int32)[texts]
                rows.append((s, REQUESTS, len(at), len(keys), k1[at].tobytes() + k2[at].tobytes() + keys.tobytes() + packed(np.diff(texts, prepend=np.int32(0)))))
            yield blob_batch(rows)

    return docs.mapInArrow(emit, BLOBS)


def weights(triples: list[list[np.ndarray]], known: list[list[np.ndarray]], level: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their weights: those of ``known``, of the contexts and of the triples of a shard."""
    keys, values = [k for k, _ in known], [x for _, x in known]
    if triples:
        context, key, n, lower = (np.concatenate(x) for x in zip(*triples))
        own, group = np.unique(context, return_inverse=True)
        off = level(n)
        total = np.bincount(group, n)
        free = np.bincount(group, off) / total
        p = (n - off) / total[group] + free[group] * lower
        keys += [own, key]
        values += [np.log(free), np.log(p) - np.log(free[group]) - np.log(lower)]
    keys, values = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0), *values])
    order = np.argsort(keys)
    return keys[order], values[order]


def answered(blobs: DataFrame, level: Discounts) -> DataFrame:
    """(k1, k2, value): the sum of the weights that each text meets in a shard."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, triples, known, table = None, [], [], None
        for shard, kind, docs, rows, data in by_shard(batches):
            if shard != current:
                current, triples, known, table = shard, [], [], None
            if kind == GRAMS:
                triples.append(unpacked_all(data, (np.uint64, np.uint64, np.int64, np.float64), rows))
            elif kind == WEIGHTS:
                known.append(unpacked_all(data, (np.uint64, np.float64), rows))
            else:
                if table is None:
                    table, triples, known = weights(triples, known, level), [], []
                keys, values = table
                k1, k2 = np.frombuffer(data, np.int64, docs), np.frombuffer(data, np.int64, docs, 8 * docs)
                asked, text = np.frombuffer(data, np.uint64, rows, 16 * docs), np.cumsum(unpacked(data, np.int32, rows, 16 * docs + 8 * rows))
                found = np.zeros(docs)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == asked)
                    found = np.bincount(text[hit], values[at[hit]], docs).astype(np.float64, copy=False)  # whole numbers where nothing was hit
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(found)], ["k1", "k2", "value"])

    return blobs.mapInArrow(answer, "k1 bigint, k2 bigint, value double")


def likelihood(texts: DataFrame, trusted: Callable[[], DataFrame], *, rounds: int | None = None, shards: int | None = None) -> DataFrame | None:
    """(k1, k2, logp, n) of the texts (k1, k2, text), one row for equal texts; the model is that of the rows (text) of ``trusted``.

    None where a discount is 0 although counts of its class occur, as with corpora of exact copies: words can
    then have no probability at all, which a sum of weights cannot tell.
    """
    spark = texts.sparkSession
    with Scratch(spark) as scratch:
        usual = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        read = scratch.write(seen(texts, usual), "seen")
        sums = scratch.write(read.filter("shard IS NULL").groupBy("k1", "k2").agg(F.lit(0.0).alias("value"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")), "sums")
        vocabulary = different(read.filter("shard IS NOT NULL"), usual)
        length = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
        scratch.drop(read)
        rounds = rounds or min(ROUNDS, max(1, -(-length // ROUND_WORDS)))
        nothing = 1 / (vocabulary + 1)
        table = scratch.write(portions(trusted()), "portions")
        size = table.agg(F.sum("length").alias("n")).first()["n"] or 0
        shards = shards or max(SHARDS, -(-2 * size // (rounds * SHARD_GRAMS)))
        base = np.log(nothing)
        if size:
            names = [f"x{k}" for k in range(1, 6)]
            some = [scratch.write(counted(table, r, rounds, shards), "counts") for r in range(rounds)]
            every = some[0]
            for more in some[1:]:
                every = every.unionByName(more)
            counts = scratch.write(every.groupBy("level", "word").agg(*[F.sum(x).alias(x) for x in names]), "words")
            scratch.drop(*some)
            levels = {r["level"]: Discounts(*[r[x] for x in names]) for r in counts.filter("level > 1").collect()}
            words = counts.filter("level = 1").drop("level")
            r = words.agg(*[F.count_if(F.col("x1") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count_if(F.col("x1") >= 3).alias("n5"), F.sum("x1").alias("total")).first()
            levels[1], total = Discounts(*[r[f"n{k}"] for k in range(1, 6)]), r["total"]
            floor = float(levels[1].free(*levels[1].sizes) / total * nothing)
            if not (floor and levels[2].proper and levels[3].proper):
                return None
            base = np.log(floor)
            old, table = table, scratch.write(informed(table, words), "informed", batch_rows=10_000)
            scratch.drop(old)
            for r in range(rounds):
                blobs = (trusted_blobs(table, r, rounds, shards, levels, total, floor).unionByName(word_blobs(words, r, rounds, shards, levels, total, floor))
                         .unionByName(request_blobs(texts, r, rounds, shards)))
                found = answered(dealt(blobs, shards), levels[3]).select("k1", "k2", "value", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))
                old, sums = sums, scratch.write(found.unionByName(sums).groupBy("k1", "k2").agg(*[F.sum(x).alias(x) for x in ("value", "n", "m")]), "sums")
                scratch.drop(old)
        return scratch.keep(scratch.write(sums.select("k1", "k2", (F.col("value") / F.col("m") + F.col("n") / F.col("m") * F.lit(float(base))).alias("logp"),
                                                      (F.col("n") / F.col("m")).cast("bigint").alias("n")), "likelihood"))


def trusted_likelihood(docs: DataFrame, trusted: DataFrame, *, key: str, text: str, names: tuple[str, str], out: str) -> DataFrame | None:
    """``docs`` with a struct (logp, n) in the column ``out`` under the model of the rows whose ``key`` is in ``trusted`` (_id), or None as ``likelihood``."""
    own = {names[0]: F.xxhash64(F.col(text)), names[1]: F.xxhash64(F.lit(1), F.col(text))}
    marked = docs.withColumns(own)
    full = F.col("text").isNotNull() & (F.col("text") != "")
    texts = marked.select(*[F.col(x).alias(k) for k, x in zip(("k1", "k2"), names)], F.col(text).alias("text")).filter(full)
    trusted = F.broadcast(trusted) if is_small(trusted, TRUSTED_IDS) else trusted
    sums = likelihood(texts, lambda: docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).filter(full).join(trusted, "_id").select("text"))
    if sums is None:
        return None
    none = F.struct(F.lit(0.0).alias("logp"), F.lit(0).cast("bigint").alias("n"))
    sums = sums.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.struct("logp", "n").alias(out))
    return marked.join(sums, list(names), "left").withColumn(out, F.coalesce(out, none)).select(*docs.columns, out)
