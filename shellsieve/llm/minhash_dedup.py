"""Near-duplicate groups: MinHash bands, odd sketches, exact check, connected components.

1. Every text becomes its set of word shingles. Texts with the same set form a
   class, represented by its smallest id: copies shrink to one row before anything
   is compared.
2. A representative has ``bands * rows`` MinHash samples. The samples are folded
   into a bitmap by flipping one bit each (an odd sketch): samples that two texts
   share cancel out in the XOR, so its population count tells their similarity.
3. Representatives that share a band are candidates. One that has too many shingles
   which no other candidate has cannot reach the threshold with any and is left
   out; of a family of edited copies only the close ones remain. A bucket never
   emits all its pairs at once: in every round one member of each bucket, the one
   with most company first, is compared with the members that are not yet in its
   component, which costs its size. Buckets whose members are all connected are
   done; what is left over when rounds no longer help is compared in full, so no
   link is lost. There the parity bitmap of the whole set bounds the symmetric
   difference from below, and only pairs within what a link allows come out.
4. Pairs that pass the sketch are verified on the full sets.
5. Components are the smallest reachable id, by alternating star contraction.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import WordIds, spaced_words
from shellsieve.session import materialise

SKETCH_BITS = 512
#: Bits of the parity bitmap of a whole set.
PARITY_BITS = 1024
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(ids):
        return np.empty(0, np.uint64)
    n = min(size, len(ids))
    h = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * _MULT[k % len(_MULT)] + ids[k:len(ids) - n + 1 + k])
    return np.unique(h)


class Signer:
    """MinHash bands and odd sketch of a set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.where = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def samples(self, hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
        best = np.full(len(self.mult), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), chunk):
            part = hashes[at:at + chunk, None] * self.mult + self.add
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        s = self.samples(hashes)
        band = np.arange(1, self.bands + 1, dtype=np.uint64)
        for part in s.reshape(self.bands, self.rows).T:
            band = mix(band * _MULT[0] + part)
        bits = np.bincount((mix(s ^ self.where) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return band.view(np.int64), np.packbits(bits.astype(np.uint8)).tobytes()


def most_flips(samples: int, similarity: float, sigmas: float = 6.0) -> int:
    """Population count of the XOR that a pair of this similarity stays under, but for ``sigmas`` standard deviations.

    The number of samples that differ is binomial; each leaves two flips, of which
    an even number in one bit cancels, so flips never outnumber twice the samples that differ.
    """
    differ = samples * (1 - similarity)
    differ += sigmas * (samples * similarity * (1 - similarity)) ** 0.5
    return int(min(SKETCH_BITS, np.ceil(2 * differ)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def signatures(docs: DataFrame, *, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """_key, n_shingles, _class (fingerprint of the set), _bands, _sketch. Empty sets have no bands and a null class."""
    fields = "n bigint, class binary, bands array<bigint>, sketch binary"

    @F.pandas_udf(fields)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash
        ids, signer = WordIds(), Signer(bands, rows)
        for series in batches:
            out = []
            for t in series:
                h = shingle_hashes(ids(spaced_words(t)), size)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), *signer(h)) if len(h) else (0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "class", "bands", "sketch"])

    return (docs.select(F.col(key).alias("_key"), sign(F.col(text)).alias("_s"))
            .select("_key", F.col("_s.n").alias("n_shingles"), F.col("_s.class").alias("_class"),
                    F.col("_s.bands").alias("_bands"), F.col("_s.sketch").alias("_sketch")))


def flips(a: str, b: str, bits: int = SKETCH_BITS):
    """Population count of the XOR of two bitmaps kept as arrays of longs."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, bits // 64)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Odd sketch of a whole set as longs: every hash flips one bit.

    The XOR of two has no more bits set than the sets have elements that the other lacks.
    """
    bits = np.bincount((mix(hashes) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def parities(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, whole): the parity bitmap of each text's set."""
    @F.pandas_udf("array<bigint>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds()
        for series in batches:
            yield pd.Series([parity(shingle_hashes(ids(spaced_words(t)), size)) for t in series], dtype="object")

    return texts.select("id", "n", fold("text").alias("whole"))


def as_longs(sketch: str):
    """A binary sketch as an array of longs, for bit operations inside generated code."""
    return F.array(*[F.conv(F.hex(F.substring(F.col(sketch), 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(SKETCH_BITS // 64)])


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts`` has (id, text), one row per id."""
    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids = WordIds()
        last = (None, None)
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                if last[0] != x:
                    last = (x, shingle_hashes(ids(spaced_words(x)), size))
                out.append(linked(last[1], shingle_hashes(ids(spaced_words(y)), size), percent))
            yield pd.Series(out, dtype=bool)

    other = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")
    both = other.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a")
    return both.filter(check("_ta", "_tb")).select("a", "b")


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over ``links`` (a, b); ids without links are their own component.

    Large-star and small-star steps alternate until no edge changes; every step
    only groups edges by one end, and the smaller end replaces long neighbour lists.
    """
    spark_edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    edges = materialise(spark_edges, "edges")
    seen = None
    while True:
        # large star: every larger neighbour of a node is linked to the smallest of node and neighbours
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("_m")).withColumn("_m", F.least("_m", "hi"))
        large = (both.join(low, "hi").filter(F.col("lo") > F.col("hi"))
                 .select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).filter("hi <> lo").distinct())
        # small star: smaller neighbours and the node itself are linked to the smallest
        low2 = large.groupBy("hi").agg(F.min("lo").alias("_m"))
        small = (large.join(low2, "hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
                 .unionByName(low2.select("hi", F.col("_m").alias("lo"))).filter("hi <> lo").distinct())
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("comp"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def too_lonely(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Ids whose own shingles, found in no other of the ``texts`` (id, text, n), outnumber what any link allows.

    If u of n shingles are nowhere else, an intersection has n - u at most and a
    union n at least, so 100 * (n - u) < percent * n rules every link out.
    """
    @F.pandas_udf("array<bigint>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds()
        for series in batches:
            yield pd.Series([shingle_hashes(ids(spaced_words(t)), size).view(np.int64) for t in series], dtype="object")

    alone = (texts.select("id", F.explode(shingles("text")).alias("s")).groupBy("s")
             .agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("u")))
    return texts.select("id", "n").join(alone, "id").filter(100 * (F.col("n") - F.col("u")) < percent * F.col("n")).select("id")


def shared_buckets(members: DataFrame) -> DataFrame:
    """(_band, id, company) of the buckets that hold several ids."""
    sizes = members.groupBy("_band").agg(F.count("*").alias("company")).filter("company > 1")
    return members.join(sizes, "_band").select("_band", "id", "company")


def link_buckets(members: DataFrame, texts: DataFrame, *, samples: int, size: int, percent: int, rounds: int = 3) -> DataFrame:
    """All links needed for the components of ``members`` (_band, id, company), verified on full sets.

    ``texts`` has (id, text, n, sk): the size of the set and the sketch as longs. A round compares, in every
    bucket that still holds several components, one member with all members outside
    its component: in the first round the one whose buckets are largest, later one
    by hash. After the rounds the pairs of different components that are left in a
    bucket are compared in full.
    """
    most = most_flips(samples, percent / 100)
    company = members.groupBy("id").agg(F.sum("company").alias("company"))
    ids = materialise(company, "ids")
    comps, links = ids.select("id", F.col("id").alias("comp")), None
    current = materialise(members.select("_band", "id").join(texts.select("id", "sk").join(ids, "id"), "id"), "members")
    for turn in range(rounds + 1):
        now = current.join(comps, "id")
        first = -F.col("company") if turn == 0 else F.xxhash64("id", F.lit(turn))
        alive = now.groupBy("_band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
                                         F.min(F.struct(first.alias("h"), "id", "comp", "sk")).alias("_one"))
        alive = alive.filter("_lo < _hi")
        if turn < rounds:
            found = (now.join(alive.select("_band", "_one"), "_band").filter(F.col("comp") != F.col("_one.comp"))
                     .select("id", F.col("_one.id").alias("other"), "sk", F.col("_one.sk").alias("other_sk")))
            found = found.filter(flips("sk", "other_sk") <= most)
        else:
            left = materialise(now.join(alive.select("_band"), "_band").select("_band", "id", "comp", "sk"), "rest")
            whole = materialise(parities(texts.join(left.select("id").distinct(), "id", "left_semi"), size), "parities")
            rest = left.join(whole, "id")
            other = rest.select("_band", *[F.col(c).alias(f"other_{c}") for c in ("id", "comp", "sk", "n", "whole")])
            # a link allows (100 - percent) / (100 + percent) of both sizes as symmetric difference
            near = (100 + percent) * flips("whole", "other_whole", PARITY_BITS) <= (100 - percent) * (F.col("n") + F.col("other_n"))
            found = (rest.alias("x").join(other.alias("y"), (F.col("x._band") == F.col("y._band")) & (F.col("id") < F.col("other_id"))
                                          & (F.col("comp") != F.col("other_comp")) & (flips("sk", "other_sk") <= most) & near)
                     .withColumnRenamed("other_id", "other"))
        pairs = materialise(found.select(F.greatest("id", "other").alias("b"), F.least("id", "other").alias("a")).distinct(), "pairs")
        if pairs.isEmpty():
            continue
        new = materialise(verified(pairs, texts, size, percent), "links")
        links = new if links is None else links.unionByName(new)
        comps = materialise(components(ids.select("id"), links), "components")
    return comps


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    bands: int = 30, rows: int = 4) -> DataFrame:
    """key, n_shingles, component_id, kept for every row.

    Words are runs of non-blanks with A-Z lower-cased. Texts without words have no
    shingles and are linked with nothing; texts with fewer words than ``size`` have
    one shingle. With the default bands a pair at the threshold is missed in all
    bands with probability 1.4e-7. Repeated rows belong to one component; a row
    with null id is linked with nothing and has a null component and kept = false.
    """
    signed = materialise(signatures(docs, key=key, text=text, size=size, bands=bands, rows=rows), "signatures")
    known = signed.filter(F.col("_class").isNotNull() & F.col("_key").isNotNull())
    classes = materialise(known.groupBy("_class").agg(F.min("_key").alias("id"), F.min_by(F.struct("n_shingles", "_bands", "_sketch"), "_key").alias("_b"))
                          .select("_class", "id", F.col("_b.n_shingles").alias("n"), "_b._bands", "_b._sketch"), "classes")
    banded = classes.select("id", F.explode("_bands").alias("_band"))
    members = materialise(shared_buckets(banded), "buckets")
    sketches = classes.select("id", "n", as_longs("_sketch").alias("sk"))
    own_text = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = materialise(own_text.join(members.select("id").distinct(), "id").dropDuplicates(["id"]).join(sketches, "id"), "texts")
    lonely = materialise(too_lonely(texts, size, percent), "lonely")
    close = materialise(shared_buckets(members.select("_band", "id").join(lonely, "id", "left_anti")), "close")
    comps = link_buckets(close, texts, samples=bands * rows, size=size, percent=percent)
    of_class = (classes.select("_class", "id").join(comps, "id", "left")
                .select("_class", F.coalesce("comp", "id").alias("_comp")))
    # a hot class meets one row of the other side; Spark may split it
    return (signed.select("_key", "n_shingles", "_class").join(of_class, "_class", "left")
            .select(F.col("_key").alias(key), "n_shingles", F.when(F.col("_key").isNotNull(), F.coalesce("_comp", "_key")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, columns unchanged; of repeated rows of the kept document one stays.

    Rows with null id stay, they are in no group.
    """
    kept = near_duplicates(docs, key=key, text=text, **options).filter("kept").select(F.col(key).alias("_kept")).distinct()
    joined = docs.join(kept, F.col(key) == F.col("_kept"), "left_semi")
    return joined.dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))


