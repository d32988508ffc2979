"""Row validity, label clean-up, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import patterns as R
from shellsieve.functions import text as X
from shellsieve.functions import vectors as V
from shellsieve.taxonomy import GATED_ACTIONS, MALICIOUS, TAXONOMY, Taxonomy


def valid_rows(df: DataFrame, text: str = "text", verdict: str = "verdict", tax: Taxonomy = TAXONOMY) -> DataFrame:
    return df.filter((F.length(text) > 0) & F.col(verdict).isin(*tax.verdict_ids))


def known_labels(names: Column, domain) -> Column:
    """Labels inside the domain; order and repeats stay."""
    wanted = F.array(*[F.lit(d) for d in domain])
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda a: F.array_contains(wanted, a))


def to_split_rows(df: DataFrame, tax: Taxonomy = TAXONOMY) -> DataFrame:
    """``{text, true_labels, soft_v2}`` plus what else the frame carries."""
    labels = F.concat(F.array(F.col("verdict")), known_labels(F.col("actions"), tax.action_ids))
    out = df.withColumn("true_labels", labels)
    return out.withColumn("soft_v2", V.well_formed(F.col("soft"), tax)) if "soft" in df.columns else out


def length_between(c: Column, low: int, high: int) -> Column:
    """Length in characters (code points), both ends included."""
    return F.char_length(c).between(low, high)


def gate(c: Column, accept: str, reject: str | None = None) -> Column:
    """No reject hit and at least one accept hit."""
    ok = X.matches(c, accept)
    return ok if reject is None else ~X.matches(c, reject) & ok


def teacher_gate(soft: str, action: str, target: str, min_pos: float = 0.7, max_neg: float = 0.3,
                 tax: Taxonomy = TAXONOMY) -> Column:
    """Keep a candidate by the teacher's probability of its action.

    ``pos`` needs at least ``min_pos``, ``neg`` at most ``max_neg``; any other
    target needs one of the gated actions at ``min_pos``.
    """
    nv = len(tax.verdict_ids)
    scores = dict(zip(tax.action_ids, V.items(soft, nv, tax.size)))
    own = "(CASE " + action + " " + " ".join(f"WHEN {V.lit(a)} THEN {s}" for a, s in scores.items()) + " END)"
    gated = " OR ".join(f"{scores[a]} >= {V.lit(min_pos)}" for a in GATED_ACTIONS)
    keep = f"(CASE {target} WHEN 'pos' THEN {own} >= {V.lit(min_pos)} WHEN 'neg' THEN {own} <= {V.lit(max_neg)} ELSE {gated} END)"
    return F.expr(f"coalesce(size({soft}) = {tax.size} AND {keep}, false)")


def rule_category(c: Column) -> Column:
    """Ordered rules; the first that hits names the category."""
    return (F.when(X.matches(c, R.DEFINITE_PAYLOAD), "definite_payload")
            .when(X.matches(c, R.FETCH) & X.matches(c, R.RUN), "definite_payload")
            .when(X.matches(c, R.SHELL_ESCAPE), "shell_escape")
            .otherwise("dual_use"))


def drop_noisy_labels(df: DataFrame, labels: str = "true_labels", text: str = "text", split: str = "split",
                      also_test: bool = False, drop_keylog: bool = True) -> DataFrame:
    """Remove ``web_shell`` (and ``keylog``) from rows that are reverse or bind
    shells unless the text itself shows evidence for them.

    Adds ``dropped``. The test split is frozen unless ``also_test``.
    """
    has = lambda a: F.array_contains(labels, a)
    shell = has("action.reverse_shell") | has("action.bind_shell")
    open_row = F.lit(True) if also_test else F.col(split) != "test"
    deploys = X.matches(F.col(text), R.WEB_DEPLOY) | X.matches(F.col(text), R.WEB_WRITE)
    web = open_row & shell & has("action.web_shell") & ~deploys
    key = open_row & shell & has("action.keylog") & ~X.matches(F.col(text), R.KEY_CAPTURE) & F.lit(drop_keylog)
    dropped = F.array_compact(F.array(F.when(web, F.lit("action.web_shell")), F.when(key, F.lit("action.keylog"))))
    marked = df.withColumn("dropped", dropped)
    return marked.withColumn(labels, F.filter(labels, lambda a: ~F.array_contains("dropped", a)))


def bare(verdict: Column) -> Column:
    return F.regexp_replace(verdict, r"^verdict\.", "")


def hard_negatives(df: DataFrame, truth: str = "gt", verdict: str = "verdict") -> DataFrame:
    """Truth malicious, model verdict anything else."""
    return df.filter((F.col(truth) == "malicious") & (bare(F.col(verdict)) != "malicious"))


def disagreements(df: DataFrame, truth: str = "gt", verdict: str = "verdict", tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Both labels valid and different."""
    names = [v.removeprefix("verdict.") for v in tax.verdict_ids]
    return df.filter(F.col(truth).isin(*names) & F.col(verdict).isin(*tax.verdict_ids)
                     & (F.col(truth) != bare(F.col(verdict))))


def double_confirmed(df: DataFrame, truth: str = "gt", arbiter: str = "arb_verdict") -> DataFrame:
    """Truth and arbiter both malicious; the verdict is then forced to malicious."""
    return (df.filter((F.col(truth) == "malicious") & (F.col(arbiter) == "malicious"))
            .withColumn("verdict", F.lit(MALICIOUS)))


def non_benign(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.filter(F.col(verdict) != "verdict.benign")
