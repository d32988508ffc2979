"""Derived WARC records: linked metadata and plain-text conversions of responses.

For every response a ``metadata`` and a ``conversion`` record are made. Both point
to the response by WARC-Refers-To, keep its target, date, source headers and
payload digest, and carry block digests of their own. Ids are UUIDs made from the
response's id and the kind of the derived record, so a rerun gives the same records.
Everything is column expressions, but for the plain text.
"""

import html as markup
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

CRLF = "\r\n"
#: The references and the unseen elements of the given pages, as the SQL twin can say them; ``visible`` does more.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
              ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
UNSEEN = r"(?is)<!--.*?-->|<(script|style|head|noscript|template)\b[^>]*>.*?</(script|style|head|noscript|template)\s*>"

#: Elements that no reader sees, the title among them; they do not nest, so each ends at its own closing tag or with the text.
HIDDEN = ("script", "style", "title", "noscript", "template")
_COMMENT = r"<!--.*?(?:-->|\Z)"
_OWN = "|".join(rf"<{e}(?=[\s/>])[^<>]*+>.*?(?:</{e}\s*>|\Z)" for e in HIDDEN)
#: A head ends at its closing tag outside of the elements in it, or where the body starts.
_HEAD = rf"<head(?=[\s/>])[^<>]*+>(?:[^<]++|{_COMMENT}|{_OWN}|(?!</head\s*>|<body[\s/>])<)*+(?:</head\s*>)?"
_NO_TEXT = re.compile(rf"(?isa){_COMMENT}|{_HEAD}|{_OWN}")
#: A tag has no other opening bracket in it, so a run of them is looked at once.
_TAG, _SPACE = re.compile(r"<[^<>]*+>"), re.compile(r"[ \t\n\r\f\x0B]+")


def uuid_of(*parts: Column) -> Column:
    """``urn:uuid`` of the md5 of the parts, in the layout of a version-3 UUID."""
    h = F.md5(F.encode(F.concat_ws("|", *parts), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
                    F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: id, target, date, HTTP headers, payload. Null bodies are empty, null urls stay null."""
    payload = F.coalesce(F.col(body), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.col(key).alias("page_id"), uuid_of(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")),
                                                            F.coalesce(F.col(url), F.lit(""))).alias("record_id"),
                        F.col(url).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"),
                        payload.alias("payload"), digest_of(payload).alias("payload_digest"))


_LINK = re.compile(r"(?ia)<a\s[^<>]*?href\s*=")
_TITLE = re.compile(r"(?isa)<title(?=[\s/>])[^<>]*+>(.*?)(?:</title|\Z)")


def visible(html: str | None) -> str | None:
    """Visible text: unseen elements, comments and tags become blanks, all numeric and named
    references are decoded once (no-break spaces to blanks), white space is squeezed.

    The head and the title are unseen wherever they stand; ``derive`` tells the title in the metadata.
    """
    if html is None:
        return None
    return _SPACE.sub(" ", markup.unescape(_TAG.sub(" ", _NO_TEXT.sub(" ", html))).replace("\u00a0", " ")).strip(" ")


def links(html: str) -> int:
    """Anchors with a target that stand where a reader may see them: not in comments, scripts and the like."""
    return len(_LINK.findall(_NO_TEXT.sub(" ", html)))


def title(html: str) -> str:
    """What the first title element holds, white space squeezed; empty without one."""
    found = _TITLE.search(html)
    return _SPACE.sub(" ", found[1]).strip(" ") if found else ""


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("links", LongType()), StructField("title", StringType())]))
def read_page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": html.map(visible), "links": html.map(links).astype("int64"), "title": html.map(title)})


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its conversion record.

    ``source`` has the columns of ``responses`` (more are ignored). A response
    without target keeps a null target; an empty payload gives an empty
    conversion, and payloads of any length are converted whole, in time with their
    length. Repeated responses give repeated records with the same ids.
    """
    names = ["page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"]
    one = source.select(*names).withColumn("_page", read_page(F.coalesce("payload", F.lit(""))))
    text = F.col("_page.text")
    fields = F.concat(F.lit("source-content-length: "), F.octet_length("payload").cast("string"), F.lit(f"{CRLF}text-content-length: "),
                      F.octet_length(text).cast("string"), F.lit(f"{CRLF}outlinks: "), F.col("_page.links").cast("string"),
                      F.lit(f"{CRLF}title: "), F.col("_page.title"))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")))
    rows = one.select("page_id", "target_uri", "warc_date", "http_headers", "payload_digest", F.col("record_id").alias("refers_to"),
                      F.explode(kinds).alias("_k")).select("*", "_k.*").drop("_k")
    return rows.select("page_id", "record_type", uuid_of(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to",
                       "target_uri", "warc_date", "content_type", F.col("http_headers").alias("source_headers"),
                       F.col("payload_digest").alias("source_digest"), F.octet_length("block").cast("bigint").alias("content_length"),
                       digest_of(F.col("block")).alias("block_digest"), "block")


def serialised(records: DataFrame) -> Column:
    """A record as WARC/1.1 text without its closing blank lines; source headers go in extension fields, one per line."""
    source = F.regexp_replace("source_headers", r"\r?\n", "; ")
    head = [("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("warc_date")),
            ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Block-Digest", F.col("block_digest")),
            ("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Source-Headers", source),
            ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in head]  # a null value leaves its line out
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), F.col("block"))


def write(records: DataFrame, path: str) -> None:
    """WARC files, one per task, gzip-compressed as a whole; records end with two line ends as the format asks."""
    (records.select(serialised(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path))
