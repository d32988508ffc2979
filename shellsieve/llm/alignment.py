"""Alignment of two tokenizers over the bytes of each text, on Arrow tables.

Token ids of a batch are lists; flattened, with the parent of every token, the
running sum of byte lengths less that of the parent's start is the byte at which a
token ends. (document, end) is one integer. A full join of both tokenizers' ends,
sorted, gives every stretch of bytes that one token of each covers: these are the
links, and where both sides have an end the groups are cut. How many documents hold a
pair of ids is counted per task by ``Table.group_by`` and summed by Spark. Counts of
the most frequent pairs, a bounded number, are looked up in place; the others, each in
few documents, are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import byte_slices, row_slices
from shellsieve.llm.packing import byte_of_symbol, tokens_of
from shellsieve.session import materialise

#: UTF-8 bytes of text aligned at once; a longer text is aligned by itself. A slice takes about 70 bytes of memory a byte.
SLICE_BYTES = 500_000
#: Words that each side remembers before it forgets them all (about 300 bytes each), so a worker stays small on text of ever new words.
KNOWN_WORDS = 250_000
#: Bits of a key that hold the byte at which a token ends.
END_BITS = 40
#: Pairs looked up at once, unless one text has more.
SLICE_PAIRS = 500_000
#: Pairs whose counts a task holds before it sends them on.
HELD_PAIRS = 1_000_000
#: Most frequent pairs that are looked up in place, 16 bytes each, at most.
HOT_PAIRS = 500_000
MARKS = ("_row bigint, key {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
         "pairs array<bigint>, times array<bigint>, counted array<bigint>, held array<bigint>")


class Pieces:
    """Ids of a sentencepiece model, as little-endian 32-bit numbers.

    No piece of the model may go on with a blank after another character (checked), so
    ids never reach across the start of a run of blanks and those of each run with what
    follows are remembered.
    """

    def __init__(self, path: str) -> None:
        import re
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(re.search("[^▁]▁", p) for p in self.names)
        self.run = re.compile(" *[^ ]+| +")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.apart or "▁" in text:
            return self.whole(text)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = []
        for run in self.run.findall(f" {text}"):
            ids = known.get(run)
            if ids is None:
                # the model puts the first blank there, but not before an empty text
                ids = known[run] = self.whole(run[1:]) if run != " " else np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def token_bytes(self) -> list[bytes]:
        import re
        byte = re.compile("<0x([0-9A-F]{2})>")
        return [bytes.fromhex(m[1]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode("utf-8") for p in self.names]


class Sides:
    """Both tokenizers, the bytes of each id, and the ids as text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        symbols = byte_of_symbol()
        self.a, self.b = tokens_of(path_a, False, KNOWN_WORDS), Pieces(path_b)
        names = {i: t for t, i in self.a.model.get_vocab(True).items()}
        in_a = [bytes(symbols.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes = [pa.array(x, pa.binary()) for x in (in_a, self.b.token_bytes())]
        self.lengths = [pc.binary_length(x).cast(pa.int64()) for x in self.bytes]
        self.labels = [pa.array([str(i) for i in range(len(x))]) for x in self.bytes]

    def lists(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both sides; no ids for a text without bytes or one that either side does not keep to the byte."""
        spaced = [f" {t}" if t else "" for t in texts]
        sides = [[self.a(s) if s else b"" for s in spaced], [self.b(t) if t else b"" for t in texts]]
        wanted = pa.array([s.encode("utf-8") for s in spaced], pa.binary())
        same = np.ones(len(texts), bool)
        for side, ids in enumerate(sides):
            found = listed(ids)
            joined = pc.binary_join(pa.ListArray.from_arrays(found.offsets, self.bytes[side].take(found.values)), pa.scalar(b"", pa.binary()))
            same &= pc.equal(joined, wanted).to_numpy(zero_copy_only=False)
        return tuple(listed([x if ok else b"" for x, ok in zip(ids, same)]) for ids in sides)


def listed(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))


@lru_cache(maxsize=2)
def sides_of(path_a: str, path_b: str) -> Sides:
    """One per worker process, so the tasks of a worker share what it remembers."""
    return Sides(path_a, path_b)


def ends(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """A row per token: key (document and the byte where the token ends), its id, its place among the tokens."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    running = pc.cumulative_sum(lengths.take(flat))
    starts = pa.array(np.r_[0, running.to_numpy()]).take(ids.offsets)
    within = pc.subtract(running, starts.take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, pa.scalar(END_BITS, pa.int64())), within), name: flat, f"{name}_at": pa.array(np.arange(len(flat)))})


def group_texts(ids: pa.ListArray, labels: pa.Array, last: pa.Array) -> pa.Array:
    """The ids of each group, joined by commas; ``last`` has the place of each group's last token."""
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.add(last, 1).cast(pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, labels.take(ids.values)), ",")


def aligned(sides: Sides, texts: list[str | None]) -> tuple[dict[str, pa.Array], pa.Table]:
    """Columns of the texts (n_a ... times), and for each pair of ids the number of these texts that hold it linked."""
    a, b = sides.lists(texts)
    stretches = (ends(a, sides.lengths[0], "a").join(ends(b, sides.lengths[1], "b"), "key", join_type="full outer", use_threads=False)
                 .sort_by("key").combine_chunks())
    parent = pc.shift_right(stretches["key"], END_BITS)
    common = stretches.append_column("doc", parent).filter(pc.and_(stretches["a"].is_valid(), stretches["b"].is_valid())).combine_chunks()
    texts_a, texts_b = (group_texts(ids, label, common[f"{n}_at"].combine_chunks())
                        for n, ids, label in (("a", a, sides.labels[0]), ("b", b, sides.labels[1])))
    per_doc = np.bincount(common["doc"].to_numpy(), minlength=len(texts)).astype(np.int64)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32)),
                                                     pc.binary_join_element_wise(texts_a, texts_b, "|")), ";")
    pair = pc.add(pc.multiply(pc.fill_null_backward(stretches["a"]), len(sides.labels[1])), pc.fill_null_backward(stretches["b"]))
    links = pa.table({"doc": parent, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    links = links.take(np.argsort(links["doc"].to_numpy(), kind="stable"))
    different = np.bincount(links["doc"].to_numpy(), minlength=len(texts))
    offsets = pa.array(np.r_[0, np.cumsum(different)].astype(np.int32))
    return ({"n_a": a.value_lengths().cast(pa.int64()), "n_b": b.value_lengths().cast(pa.int64()), "n_groups": pa.array(per_doc),
             "n_links": pa.array(np.bincount(parent.to_numpy(), minlength=len(texts)).astype(np.int64)),
             "groups_sha256": pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(groups, per_doc)]),
             "pairs": pa.ListArray.from_arrays(offsets, links["pair"].combine_chunks()),
             "times": pa.ListArray.from_arrays(offsets, links["count_all"].combine_chunks())},
            links.group_by("pair", use_threads=False).aggregate([([], "count_all")]))


def marked(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """One row per document with its counts and linked pairs, and rows that hold partial counts of pairs only (``_row`` null)."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sides = sides_of(path_a, path_b)
        number, partial = TaskContext.get().partitionId() << 33, None
        names = [x.split()[0] for x in MARKS.split(", ")]

        def sent(counts: pa.Table) -> pa.RecordBatch:
            whole = pa.array([0, len(counts)], pa.int32())
            lists = {n: pa.ListArray.from_arrays(whole, counts[c].combine_chunks()) for n, c in (("counted", "pair"), ("held", "count_all"))}
            return pa.RecordBatch.from_arrays([lists.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

        for batch in batches:
            kinds = [pa.int64(), batch.schema.field("key").type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 4]
            schema = pa.schema(list(zip(names, kinds)))
            texts = batch.column("text")
            for start, stop in byte_slices(texts, SLICE_BYTES):
                n = stop - start
                columns, counts = aligned(sides, texts.slice(start, n).to_pylist())
                columns |= {"_row": pa.array(np.arange(number, number + n)), "key": batch.column("key").slice(start, n)}
                number += n
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
                partial = counts if partial is None else (pa.concat_tables([partial, counts]).group_by("pair", use_threads=False)
                                                          .aggregate([("count_all", "sum")]).rename_columns(["pair", "count_all"]))
                if len(partial) > HELD_PAIRS:
                    yield sent(partial)
                    partial = None
        if partial is not None:
            yield sent(partial)

    return source.mapInArrow(mark, MARKS.format(key=source.schema["key"].dataType.simpleString()))


def hot_limit(pairs: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more; only counts by size class come to the driver."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 8)
    classes = sorted(((r["size"], r["least"], r["pairs"]) for r in pairs.groupBy(size.alias("size"))
                      .agg(F.min("n").alias("least"), F.count("*").alias("pairs")).collect()), reverse=True)
    limit, total = 2**62, 0
    for _, least, number in classes:
        total += number
        if total > most:
            break
        limit = least
    return limit


def align(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: key, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a blank and the text, side B the text (and puts the blank there
    itself). A link is a pair of token occurrences whose bytes overlap; a pair of ids
    counts the documents that hold it linked; ``n_best`` are the links whose count is
    the highest of their A id, ties included, ``count_sum`` is over all links. Groups are
    cut where tokens of both sides end. Null and empty texts, and texts whose bytes one
    side does not keep, have no tokens: zeros and an empty digest. Repeated rows count
    and are returned one by one; an empty table gives no rows. A text of any length is
    aligned whole, by itself. Other columns are not read, so they may have any names.
    """
    marks = materialise(marked(docs, path_a, path_b, key, text), "token_links")
    sides = sides_of(path_a, path_b)
    size_a, size_b = len(sides.labels[0]), len(sides.labels[1])
    pairs = materialise(marks.filter(F.col("_row").isNull()).select(F.explode(F.arrays_zip("counted", "held")).alias("one"))
                        .groupBy(F.col("one.counted").alias("pair")).agg(F.sum("one.held").alias("n")), "pair_counts")
    best = materialise(pairs.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("most")), "best_counts")
    limit = hot_limit(pairs, hot_pairs)
    hot = pairs.filter(F.col("n") >= limit).orderBy("pair").toArrow()
    top = np.zeros(size_a, np.int64)
    for r in best.collect():  # one row per id of side A at most
        top[r["a"]] = r["most"]
    shared = docs.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), top))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, most = shared.value
        for batch in (whole.slice(start, stop - start) for whole in batches
                      for start, stop in row_slices(whole.column("pairs").value_lengths(), SLICE_PAIRS)):
            linked = batch.column("pairs")
            pair, times = linked.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), linked.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            count = counts[at[known]] if len(keys) else np.empty(0, np.int64)
            total, good = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, row[known], count * times[known])
            np.add.at(good, row[known], np.where(count == most[pair[known] // size_b], times[known], 0))
            left = pa.array(np.r_[0, np.cumsum(np.bincount(row[~known], minlength=len(batch)))].astype(np.int32))
            rare = [pa.ListArray.from_arrays(left, pa.array(x[~known])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(total), pa.array(good), *rare],
                                             [*batch.schema.names[:7], "total", "good", "pairs", "times"])

    of_docs = marks.filter(F.col("_row").isNotNull()).select(*marks.columns[:9])
    shown = ", ".join(MARKS.format(key=dict(marks.dtypes)["key"]).split(", ")[:7])
    first = materialise(of_docs.mapInArrow(look_up, f"{shown}, total bigint, good bigint, pairs array<bigint>, times array<bigint>"), "hot_links")
    rare = (first.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("one")).select("_row", F.col("one.pairs").alias("pair"), "one.times")
            .join(pairs.filter(F.col("n") < limit), "pair").join(F.broadcast(best), F.expr(f"pair div {size_b} = a"))
            .groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("others")))
    none = F.lit(0).cast("bigint")
    return first.join(rare, "_row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("good") + F.coalesce("others", none)).alias("n_best"),
        (F.col("total") + F.coalesce("more", none)).alias("count_sum"), "groups_sha256")
