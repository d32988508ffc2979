"""Template x token expansion with labels attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.dedup import first_wins
from shellsieve.operators.ranking import rank_in_group
from shellsieve.taxonomy import MALICIOUS


def expand_templates(templates: list[tuple[str, str, int]], tokens: DataFrame, placeholder: str = "{sh}", max_tokens: int | None = None,
                     extra: dict[str, str] | None = None, source: str = "template") -> DataFrame:
    """Every template with every token.

    ``templates``: ``tool, template, pos``, a hand-written list that is carried
    in the plan as an array, so each token row expands in place. ``tokens``:
    ``token, token_pos``. Line feeds become ``"; "``, blanks are stripped, the
    first of equal commands stays. ``extra`` maps a tool to an additional action.
    """
    used = tokens if max_tokens is None else tokens.filter(F.col("token_pos") < max_tokens)
    command = X.strip(F.replace(F.replace(F.col("template"), F.lit(placeholder), F.col("token")), F.lit("\n"), F.lit("; ")))
    actions = F.array(F.lit("action.execute_local"))
    for tool, action in (extra or {}).items():
        actions = F.when(F.col("tool") == tool, F.array(F.lit("action.execute_local"), F.lit(action))).otherwise(actions)
    listed = F.array(*[F.struct(F.lit(tool).alias("tool"), F.lit(template).alias("template"), F.lit(pos).alias("pos"))
                       for tool, template, pos in templates])
    rows = (used.select("token", "token_pos", F.inline(listed)).withColumn("text", command).filter(F.length("text") > 0)
            .withColumns({"verdict": F.lit(MALICIOUS), "actions": actions, "source": F.lit(source)}))
    return (first_wins(rows.select("text", "verdict", "actions", "source", "tool", "pos", "token_pos"), "text", ["pos", "token_pos"])
            .drop("pos", "token_pos"))


def seed_ids(df: DataFrame, prefix: str, order: str) -> DataFrame:
    """Ids like ``benign-000``, counted per prefix in the order of a unique number."""
    ranked = rank_in_group(df, [prefix], order, "_n")
    return ranked.withColumn("id", F.format_string("%s-%03d", F.col(prefix), F.col("_n") - 1)).drop("_n")
