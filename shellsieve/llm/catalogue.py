"""The queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.llm import (alignment, bm25_search, byte_bpe, decontaminate, html_extract, license_scan, minhash_dedup, packing, quality, sharding,
                            term_scan, toxicity, warc)
from shellsieve.llm.common import fold_of, table
from shellsieve.session import materialise


def tokenizer_file() -> str:
    """The public byte-level BPE; ``TOKENIZER_FILE`` names another place."""
    return vocabulary("byte_bpe_50k.json", "TOKENIZER_FILE")


def vocabulary(name: str, variable: str) -> str:
    """A file of the public tokenizers, or the one that the environment variable names."""
    import public_tokenizers
    return os.environ.get(variable) or str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"), out="found")
    return found.select("doc_id", *[f"found.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")],
                        F.size("found.spans").alias("n_spans"))


def op2_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, folder, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "source_headers",
                          "source_digest", "content_length", "block_digest", "block")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, folder, "benchmark"), out="hits")
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op4_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shards(table(spark, folder, "documents"), leaves=8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", "grown_shard")


def op5_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bm25_search.top_k(docs, docs.filter(F.col("doc_id") % 20 == 0), k=10)


def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, out="text").select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = minhash_dedup.near_duplicates(docs, size=3, percent=85, bands=24, rows=5)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(materialise(packing.pieces(docs, tokenizer_file()), "pieces"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, folder, "labels")))
    scored = toxicity.score(docs, machine, out="score")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, table(spark, folder, "labels"), out="quality").select("doc_id", "lang", "quality.*")


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken", "RANKS_FILE")
    coded = byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep=["doc_id"],
                            joined={"coded": byte_bpe.hex_little_endian, "decoded": lambda ids: byte_bpe.hex_pieces(ids, ranks)})
    return coded.select("doc_id", (F.length("coded") / 8).cast("bigint").alias("n_tokens"),
                        F.sha2(F.unhex("coded"), 256).alias("ids_sha256"), F.sha2(F.unhex("decoded"), 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_file(), vocabulary("piece_bpe_32k.model", "PIECES_FILE"))


def op13_term_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return term_scan.rank(docs, table(spark, folder, "benchmark").select("item_id", "text"), k=10)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc_derivatives, op3_decontamination, op4_kd_sharding, op5_bm25_topk, op6_html_extract,
                                   op7_minhash_dedup, op8_sequence_packing, op9_toxicity, op10_quality, op11_byte_bpe, op12_token_alignment, op13_term_scan, pipeline)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = r"[ \t\n\r\f\x0B]+"


def _sql_uuid(parts: str) -> str:
    return (f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' "
            f"FROM (SELECT md5({parts}) AS h))")


def _sql_plain(html: str) -> str:
    t = rf"regexp_replace(regexp_replace({html}, '(?is){warc.UNSEEN.removeprefix('(?is)')}', ' ', 'g'), '<[^<>]*>', ' ', 'g')"
    for name, char in warc.REFERENCES[:-1]:
        t = f"replace({t}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '&amp;?', '&', 'g')"  # cut titles end in references without their last sign
    return f"trim(regexp_replace({t}, '{_WS}', ' ', 'g'), ' ')"


_NL = "chr(13) || chr(10)"
ORACLES = {
    "op2_warc_derivatives": f"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
             {_sql_uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to FROM pages),
t AS (SELECT *, {_sql_plain('payload')} AS body, CAST(strlen(payload) AS VARCHAR) AS n,
             'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || CAST(strlen(payload) AS VARCHAR) AS source_headers,
             'sha256:' || sha256(payload) AS source_digest,
             len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href\\s*=')) AS links,
             trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '{_WS}', ' ', 'g'), ' ') AS title FROM r),
d AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
             'source-content-length: ' || n || {_NL} || 'text-content-length: ' || CAST(strlen(body) AS VARCHAR) || {_NL}
             || 'outlinks: ' || CAST(links AS VARCHAR) || {_NL} || 'title: ' || title AS block FROM t
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', body FROM t)
SELECT page_id, record_type, {_sql_uuid("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, content_type,
       source_headers, source_digest, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM d""",
    "op5_bm25_topk": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
      FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = d.doc_id, st
      WHERE q.doc_id % 20 = 0 AND idf > 0 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_term_scan": rf"""
WITH w AS (SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)),
tf AS (SELECT row_id, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT row_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM dl),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM st) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf GROUP BY term),
it AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
       FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, row_id, doc_id,
             CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM it JOIN tf USING (term) JOIN wt USING (term) JOIN dl USING (row_id), st GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
