"""Sessions of commands: roll-up verdict, action set and attack chains.

Action sets are bits of one BIGINT, so a session is folded with ``max`` and
``bit_or`` and combined on the map side; its length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.functions.decide import verdict_rank
from shellsieve.taxonomy import CHAINS, MALICIOUS, SUSPICIOUS, TAXONOMY, Taxonomy


def chain_hits(mask: str, chains=CHAINS, tax: Taxonomy = TAXONOMY) -> Column:
    """Names of the chains a set of actions fulfils, in rule order, each once."""
    hits = [f"IF({' AND '.join(V.overlaps(mask, tax.bits(g)) for g in groups)}, {V.lit(name)}, NULL)" for name, groups in chains]
    return F.expr(f"array_distinct(array_compact({V.array(hits)}))")


def roll_up(df: DataFrame, session: list[str], verdict: str = "verdict", mask: str = "action_mask",
            tax: Taxonomy = TAXONOMY) -> DataFrame:
    """One row per session.

    Any malicious command makes it malicious; else a chain hit makes it
    suspicious; else the highest verdict counts.
    """
    return decide_sessions(df.groupBy(*session).agg(F.count("*").alias("n_commands"), F.max(verdict_rank(F.col(verdict))).alias("max_rank"),
                                                    F.bit_or(F.col(mask)).alias("all_mask")), tax)


def decide_sessions(folded: DataFrame, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Chains, verdict and actions of folded sessions (``max_rank``, ``all_mask``)."""
    chained = folded.withColumn("hit_chains", chain_hits("all_mask", tax=tax))
    highest = F.element_at(F.array(*[F.lit(v) for v in tax.verdict_ids]), F.col("max_rank") + 1)
    rolled = (F.when(F.col("max_rank") == 2, F.lit(MALICIOUS))
              .when(F.size("hit_chains") > 0, F.lit(SUSPICIOUS)).otherwise(highest))
    return (chained.withColumns({"verdict": rolled, "all_actions": V.actions_of_mask("all_mask", tax)})
            .drop("max_rank"))


def command_verdicts(df: DataFrame, session: list[str], position: str, verdict: str = "verdict") -> DataFrame:
    """The ordered verdicts in long form: no row ever holds a whole session."""
    return df.select(*session, position, verdict)


def verdict_sequence(df: DataFrame, session: list[str], position: str, verdict: str = "verdict", chunk: int = 10_000) -> DataFrame:
    """The ordered verdicts as lists, one per session and ``part``.

    Positions count from 0; a part holds ``chunk`` of them, so a session of any
    length is never gathered in one place. Short sessions are one part.
    """
    part = F.floor(F.col(position) / chunk).alias("part")
    return (df.groupBy(*session, part).agg(F.sort_array(F.collect_list(F.struct(position, verdict))).alias("_s"))
            .withColumn("per_command_verdicts", F.col(f"_s.{verdict}")).drop("_s"))


def explode_sessions(df: DataFrame, commands: str = "commands") -> DataFrame:
    """``commands`` arrays to one row per command with its position."""
    kept = [c for c in df.columns if c != commands]
    return df.select(*kept, F.posexplode(commands).alias("pos", "command"))
