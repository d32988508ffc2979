"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries after which a worker forgets its word cache, so its memory stays bounded.
CACHE_ENTRIES = 1_000_000

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a blank.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(text: str | None) -> str:
    return "" if text is None else text


def words(text: str | None) -> list[bytes]:
    """UTF-8 words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text_of(text).encode("utf-8").translate(WORD_BYTES).split()


def spaced_words(text: str | None) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text_of(text).encode("utf-8").lower().split()


class WordIds:
    """64-bit word hashes, remembered until ``CACHE_ENTRIES`` different words were seen."""

    def __init__(self) -> None:
        import xxhash
        self._hash = xxhash.xxh3_64_intdigest
        self._known: dict[bytes, int] = {}

    def __call__(self, tokens: Iterable[bytes]) -> np.ndarray:
        known, make = self._known, self._hash
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = make(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` UTF-8 bytes together; a longer text is a range of its own."""
    return row_slices(pc.binary_length(texts), limit)


def row_slices(sizes: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose ``sizes`` (null: 0) add up to at most ``limit``; a larger row is a range of its own."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
