"""Byte-level BPE by folded merges, alignment of two tokenizers, ranked search by one automaton, and ids of packed pieces."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shellsieve.llm import alignment, byte_bpe, packing, term_scan
from shellsieve.llm.common import row_slices, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "", " ", "\n\t ", "x▁y", "a<|endoftext|>b", "</s><s> <0x41> q", "Été ß 日本語 \U0001F600 \x00\x01\x1c ﬁ　½", "  two  blanks ", "same", "same",
       "word " * 3000, "x" * 3000, "ab!?" * 400, "é́‍", "﻿bom\r\n\x85\xa0 x", "I'll they're 'S 12345 ½Ⅷ", "a\x1d b c", "trailing "]


def odd_docs(spark):
    """Null keys, repeated rows and columns whose names clash with those the operators make."""
    rows = [(i, t, 1, "p", [1], 2.0) for i, t in enumerate(ODD)] + [(None, "same", None, None, None, None), (7, "same", 1, "p", [1], 2.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int, pairs string, codes array<int>, score double")


# --- byte-level BPE

def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    rng, own = random.Random(4), tiktoken_encoding()
    signs = "abcdehilnorst ABC 0123 .,!?-\n\t'éüñ日本語ёж\U0001F600 "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, batch_bytes=5_000).withColumn("back", byte_bpe.decode(F.col("ids"), RANKS)).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["ids"] == own.encode_ordinary(r["text"])
        assert bytes(r["back"]) == r["text"].encode("utf-8")


def test_merges_of_many_and_of_long_words():
    rng, own = random.Random(5), tiktoken_encoding()._core_bpe
    words = [bytes(rng.choice(b"etaoin shr") for _ in range(rng.randrange(1, 100))) for _ in range(20_000)]
    words += [b"", b" the", b"x" * 5_000, rng.randbytes(64), rng.randbytes(65), bytes(rng.choice(b"abc") for _ in range(200_000))]
    assert byte_bpe.merges_of(str(RANKS))(words).to_pylist() == [own.encode_single_piece(w) if w else [] for w in words]


def test_words_end_where_the_library_ends_them(spark):
    own, step = tiktoken_encoding(), 4_000
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in points[i:i + step]) for i in range(0, len(points), step)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r["ids"] == own.encode_ordinary(r["text"])


def test_odd_texts_are_encoded_whole(spark):
    own = tiktoken_encoding()
    rows = byte_bpe.encode(odd_docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2 and set(rows[0].asDict()) == {"doc_id", "text", "ids", "pairs", "codes", "score"}
    assert all(r["ids"] == own.encode_ordinary(r["text"] or "") for r in rows)
    empty = byte_bpe.encode(odd_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and dict(empty.dtypes)["ids"] == "array<int>"
    assert odd_docs(spark).select(byte_bpe.decode(F.lit(None).cast("array<int>"), RANKS).alias("x"),
                                  byte_bpe.decode(F.array(F.lit(10**6)), RANKS).alias("y")).first() == (None, None)


def test_byte_bpe_query(spark, folder):
    from shellsieve.llm.catalogue import op11_byte_bpe
    own = tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = op11_byte_bpe(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# --- alignment

def spans(ids, pieces):
    at, out = 0, []
    for i, p in zip(ids, pieces):
        out.append((at, at + len(p), i))
        at += len(p)
    return out


def plain_alignment(rows):
    """The contract read literally, with untouched tokenizers and every pair of tokens compared."""
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbols, names = packing.byte_of_symbol(), {i: x for x, i in t.get_vocab(True).items()}

    def of_piece(i):
        p = model.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes.fromhex(m[1]) if m else p.replace("▁", " ").encode()

    found, count = [], Counter()
    for key, x in rows:
        a, b = (t.encode(f" {x}", add_special_tokens=False).ids, model.encode(x)) if x else ([], [])
        in_a, in_b = [bytes(symbols[c] for c in names[i]) for i in a], [of_piece(i) for i in b]
        if not x or not b"".join(in_a) == b"".join(in_b) == f" {x}".encode():
            found.append((key, [], [], [], []))
            continue
        left, right = spans(a, in_a), spans(b, in_b)
        links = [(i, j) for s, e, i in left for u, v, j in right if u < e and s < v]
        groups, low = [], 0
        for end in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= end) for side in (left, right)))
            low = end
        found.append((key, a, b, links, groups))
        count.update(set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(k, len(a), len(b), len(g), len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for k, a, b, x, g in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, str(r)))


@pytest.mark.parametrize("hot", [500_000, 50, 0])
def test_alignment_is_the_plain_one_however_many_counts_are_hot(spark, hot):
    docs = [(r["doc_id"], r["text"][:500]) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(80).collect()]
    docs += [(1000 + i, x) for i, x in enumerate(ODD) if not x or len(x) < 500] + [(None, "same"), (3, "same")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert ordered(alignment.align(frame, BYTES, PIECES, hot_pairs=hot).collect()) == ordered(plain_alignment(docs))


def test_alignment_of_odd_and_long_texts(spark):
    docs = odd_docs(spark)
    rows = alignment.align(docs, BYTES, PIECES).collect()
    assert len(rows) == len(ODD) + 2
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(of[i]["n_a"] == 0 and of[i]["groups_sha256"] == "" for i in (0, 1, 2, 5))
    assert of[12]["n_links"] >= 3000 and of[12]["n_links"] == of[12]["n_a"] + of[12]["n_b"] - of[12]["n_groups"]
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_alignment_forgets_words_and_takes_rows_in_slices():
    sides = alignment.Sides(str(BYTES), str(PIECES))
    texts = [" ".join(f"q{i}" for i in range(start, start + 10_000)) for start in range(0, 400_000, 10_000)]
    first = sides.lists(texts[:1])
    for t in texts[1:]:
        sides.lists([t])
    assert max(len(sides.a.known), len(sides.b.known)) < 300_000
    assert sides.lists(texts[:1]) == first
    assert list(row_slices(pa.array([3, 3, None, 9, 1, 1]), 6)) == [(0, 3), (3, 4), (4, 6)]


# --- ranked search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_rank(docs, items, k):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    texts = defaultdict(set)
    for i, t in items:
        texts[i].add(t or "")
    out = []
    for item, ts in texts.items():
        wanted = [w for t in ts for w in TERM.findall(t.translate(LOWER))]
        scores = []
        for (d, c), size in zip(held, sizes):
            m = 25 + (75 * size * n) // terms if terms else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in wanted if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block", [300_000, 7])
def test_ranks_are_the_plain_ones(spark, block):
    rng = random.Random(8)
    some = ["alpha", "Beta", "gamma", "élan", "été", "日本", "x1", "the", "and"]
    docs = [(i, "".join(rng.choice(some) + rng.choice([" ", ", ", "_", "\n", "--"]) for _ in range(rng.randrange(40)))) for i in range(120)]
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [(3, docs[3][1]), (None, docs[4][1]), (900, docs[4][1])]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 8)))) for i in range(12)]
    items += [items[0], (1, "alpha alpha"), (50, None), (51, ""), (52, "?!"), (53, "nowhere"), (None, "gamma the"), (54, "ÉTÉ Alpha_beta")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).withColumn("rank", F.lit(1)).withColumn("score", F.lit("s"))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit(1))
    rows = term_scan.rank(d, b, k=5, block_terms=block).collect()
    assert ordered(rows) == ordered(plain_rank(docs, items, 5))


def test_ranks_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{k} bigint, text string") for k in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert term_scan.rank(docs, items).count() == 0
    assert term_scan.rank(one, items).count() == 0
    assert term_scan.rank(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0


# --- packing

def test_packed_ids_are_those_of_an_untouched_tokenizer():
    plain, own = Tokenizer.from_file(BYTES), packing.Tokens(BYTES)
    for text in [*ODD, "hello <|endoftext|> x", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n", "<|endoftext", "é<|endoftext|>日"]:
        assert own(text) == np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
