"""Stateful twins of batch operators on event streams: dedup and the session fold.

Both keep state only until the watermark passes: a key of the dedup ``delay`` after it
was seen, a session (a count, the highest verdict, a bit set) until it is closed.
Rows later than the watermark are left out; a row without an event time has no place
in a stream and is left out too. Event times without a zone are taken in the session's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shellsieve.functions.decide import verdict_rank
from shellsieve.operators.lookups import digest
from shellsieve.operators.sessions import decide_sessions
from shellsieve.taxonomy import TAXONOMY, Taxonomy


def timed(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    return (stream.filter(F.col(event_time).isNotNull()).withColumn(event_time, F.col(event_time).cast("timestamp"))
            .withWatermark(event_time, delay))


def distinct_within(stream: DataFrame, text: str | Column, event_time: str, delay: str) -> DataFrame:
    """The first row of each text within ``delay`` of event time; the state holds a digest per text, never the text.

    Null texts equal each other. Of repeated rows in one micro-batch any one stays.
    """
    keyed = stream.withColumn("_digest", F.col(text) if isinstance(text, str) else text)
    return (timed(keyed.withColumn("_digest", F.coalesce(digest("_digest"), F.lit(b""))), event_time, delay)
            .dropDuplicatesWithinWatermark(["_digest"]).drop("_digest"))


def fold_sessions(stream: DataFrame, session: list[str], event_time: str, delay: str, *, length: str | None = None, gap: str | None = None,
                  verdict: str = "verdict", mask: str = "action_mask", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """One row per closed session, as ``sessions.roll_up`` has it: ``start`` and ``end`` beside the keys.

    A session is all commands of its keys within ``length`` (whole days, hours, ...), or
    until ``gap`` passes without one. It is given out once the watermark is past its end.
    """
    if (length is None) == (gap is None):
        raise ValueError("give either length or gap")
    span = F.window(event_time, length) if gap is None else F.session_window(event_time, gap)
    folded = timed(stream, event_time, delay).groupBy(*session, span.alias("_span")).agg(
        F.count("*").alias("n_commands"), F.max(verdict_rank(F.col(verdict))).alias("max_rank"), F.bit_or(mask).alias("all_mask"))
    return decide_sessions(folded, tax).select(*session, F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), "n_commands",
                                               "hit_chains", "verdict", "all_actions")


def run_appended(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take up what has come since the checkpoint, append the finished rows to Parquet, stop.

    Started again with the same two paths it goes on where it stopped, state included.
    Both paths belong in a folder all executors share.
    """
    return (result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
