"""Scans. Provenance columns are ``_source_file`` and, where asked for,
``_source_line`` (1-based, blank lines counted)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellsieve.functions import text as X
from shellsieve.session import is_small, materialise
from shellsieve.sources import arrays, schemas


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute a scan that has fewer splits than there are cores.

    A lone small file is one task however wide the cluster is. Scans of real
    size have splits enough and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _fields(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType = schemas.LABELED, glob: str = "*.jsonl") -> DataFrame:
    """Recursive scan; lines that are no JSON object are skipped, a field of another type is null.

    ``_source_file`` gives the file part of the order first-wins dedup needs;
    ``numbered_jsonl`` also tells the line.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
             .select("value", F.col("_metadata.file_path").alias("_source_file")))
    return loose_rows(lines, schema).select(*_fields(schema).names, "_source_file")


def loose_rows(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Lines (``value`` and more) that are JSON objects, with their fields; mistyped fields are null."""
    kept = [c for c in lines.columns if c != "value"]
    objects = lines.filter(X.strip(F.col("value")).startswith("{") & F.try_parse_json("value").isNotNull())
    return objects.select(*kept, F.from_json("value", _fields(schema), {"mode": "PERMISSIVE"}).alias("_j")).select(*kept, "_j.*")


def numbered_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = schemas.LABELED, glob: str = "*.jsonl") -> DataFrame:
    """``jsonl`` with ``_source_file`` and ``_source_line``: the total order of the rows."""
    return loose_rows(numbered_lines(spark, path, glob), schema)


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """``_source_file, _source_line, value`` for every line of every file.

    Files stay splittable: a task numbers the lines of its own blocks, and each
    block is offset by the line counts of the earlier blocks of the same file.
    The files are scanned once: lines, counts and numbers come from one written
    table, because another scan may be split at other places. A block without a
    count fails the job.
    """
    scanned = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
               .select("value", F.col("_metadata.file_path").alias("_source_file"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid")))
    lines = materialise(scanned, "lines")
    blocks = lines.groupBy("_source_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "blocks")
    lost = F.raise_error(F.concat(F.lit("no line count for "), F.col("_source_file"))).cast("bigint")
    before = F.when(F.col("_before").isNull(), lost).otherwise(F.col("_before"))
    return (lines.join(F.broadcast(offsets) if is_small(offsets) else offsets, ["_source_file", "_block"], "left")
            .select("_source_file", (before + F.col("_mid") - F.col("_first") + 1).alias("_source_line"), "value"))


def parsed_lines(lines: DataFrame, schema: str | T.StructType, required: str = "command") -> DataFrame:
    """Parse numbered lines and say what is wrong with each (``_reject``).

    Blank lines are dropped. A line is rejected if it is no JSON object or its
    ``required`` field is missing, no string or blank.
    """
    corrupt = T.StructType([*_fields(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = (lines.filter(F.length(X.strip(F.col("value"))) > 0)
              .withColumn("_j", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    blank = F.length(X.strip(F.coalesce(F.col(f"_j.{required}"), F.lit("")))) == 0
    reject = (F.when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), F.lit("invalid JSON"))
              .when(blank, F.lit(f"missing {required}")))
    return parsed.select("_source_file", "_source_line", "value", reject.alias("_reject"), "_j.*").drop("_corrupt_record")


def strict_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = schemas.REDTEAM, required: str = "command",
                 glob: str = "*.jsonl") -> DataFrame:
    """Like ``parsed_lines`` but the first bad line fails the job with path:line."""
    rows = parsed_lines(numbered_lines(spark, path, glob), schema, required)
    where = F.concat(F.col("_reject"), F.lit(" at "), F.col("_source_file"), F.lit(":"), F.col("_source_line").cast("string"))
    checked = F.when(F.col("_reject").isNotNull(), F.raise_error(where).cast("bigint")).otherwise(F.col("_source_line"))
    return rows.withColumn("_source_line", checked).filter(F.col("_source_line") > 0).drop("value", "_reject")


def redteam_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Strict scan with file, line and sha256 of the command, first of every
    whitespace-equal command kept."""
    from shellsieve.operators.dedup import first_wins
    rows = strict_jsonl(spark, path).withColumn("_command_sha256", X.sha256(F.col("command")))
    return first_wins(rows, X.squeeze(F.col("command")), ["_source_file", "_source_line"])


def json_array(spark: SparkSession, path: str, schema: str | T.StructType = schemas.SPLIT) -> DataFrame:
    """A split stored as one JSON array of objects, read by many tasks (``arrays``); anything else fails the job."""
    return arrays.json_array(spark, path, _fields(schema))


def risk_bench(spark: SparkSession, path: str, positive: str = "risky") -> DataFrame:
    """Parquet benchmark: command as text, label as 0/1."""
    return spark.read.parquet(path).select(F.col("command").cast("string").alias("command"),
                                           (F.coalesce(F.col("label") == positive, F.lit(False))).cast("int").alias("y"))


def command_lines(df: DataFrame, value: str = "value", longest: int = 500) -> DataFrame:
    """Stripped lines without blanks, comments and over-long ones."""
    line = X.strip(F.col(value))
    return (df.withColumn("text", line)
            .filter((F.length("text") > 0) & ~F.col("text").startswith("#") & (F.char_length("text") <= longest)))


def line_corpus(spark: SparkSession, path: str, source: str, label: str) -> DataFrame:
    return command_lines(spark.read.text(path)).select("text", F.lit(source).alias("source"), F.lit(label).alias("label"))


def honeypot(spark: SparkSession, paths: dict[str, str], longest: int = 500) -> DataFrame:
    """Honeypot commands; the period is that of the file they came from."""
    out = None
    for period, path in paths.items():
        text = X.strip(F.col("command"))
        part = (loose_rows(spark.read.text(path), schemas.HONEYPOT)
                .select(text.alias("text"), F.lit("honeypot").alias("source"), F.lit("attack_session").alias("label"),
                        F.lit(period).alias("period"), "frequency")
                .filter((F.length("text") > 0) & (F.char_length("text") <= longest)))
        out = part if out is None else out.unionByName(part)
    return out


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """A ``{action: threshold}`` JSON object as rows, values still text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("action", "threshold"))


def label_cache(spark: SparkSession, path: str) -> DataFrame:
    """text -> soft; of repeated texts the last line wins."""
    from shellsieve.operators.lookups import last_per_key
    rows = parsed_lines(numbered_lines(spark, path), schemas.CACHE, required="text").filter(F.col("_reject").isNull())
    return last_per_key(rows.select("text", "soft", "_source_file", "_source_line"), "text", ["_source_file", "_source_line"]).select("text", "soft")


def run_id(path: Column, marker: str = "runs") -> Column:
    """The folder below ``marker`` in a file path names the run."""
    return F.regexp_extract(path, rf"/{marker}/([^/]+)/", 1)


def inventory(spark: SparkSession, path: str, glob: str | None = None, fmt: str = "text") -> DataFrame:
    """Rows and bytes per file; blank lines of text files do not count."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.format(fmt).load(path)
    if fmt == "text":
        rows = rows.filter(F.length(X.strip(F.col("value"))) > 0)
    return (rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
            .agg(F.count("*").alias("rows")))


#: Stores whose files a task can read as a stream; the files of others come whole from Spark's reader.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
CHUNK_BYTES = 8 << 20


def open_stream(uri: str):
    """A binary stream of a file in one of the ``STREAMED`` stores."""
    from urllib.parse import unquote, urlparse
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_stream(path)


def stream_sha256(uri: str, chunk: int = CHUNK_BYTES) -> str:
    """sha256 of a file of any length, ``chunk`` bytes at a time."""
    digest = hashlib.sha256()
    with open_stream(uri) as stream:
        while block := stream.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def checksums(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """sha256 and size per file.

    Spark lists the files with their sizes and deals them out by size; each is read
    in chunks inside its task, so its length does not matter. Empty files are not listed. Only in a store that
    nothing but Spark's reader reaches are files read whole (2 GB at most, else the job fails).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    listed = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    first = listed.first()
    if first is not None and first["file"].partition(":")[0] not in STREAMED:
        return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    @F.pandas_udf("string")
    def hashed(uris: pd.Series) -> pd.Series:
        return uris.map(stream_sha256)

    return listed.withColumn("sha256", hashed("file"))
