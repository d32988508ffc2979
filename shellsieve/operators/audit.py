"""Conformance: row invariants, cross-table counts, taxonomy checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import vectors as V
from shellsieve.taxonomy import BENIGN, MALICIOUS, SUSPICIOUS, TAXONOMY, Taxonomy


def row_errors(verdict: Column, verdict_probs: str, bypass: Column, action_probs: str, logits: str,
               model: Column | None = None, expected_model: str | None = None, tax: Taxonomy = TAXONOMY) -> Column:
    """Array of what is wrong with one annotated record, empty if nothing is.

    A record with an unknown verdict reports only that.
    """
    nv, na = len(tax.verdict_ids), len(tax.action_ids)
    argmax = F.expr(V.pick(V.argmax_index(V.items(verdict_probs, 0, nv)), tax.verdict_ids))
    known = F.coalesce(verdict.isin(*tax.verdict_ids), F.lit(False))
    checks = [
        (~F.coalesce(argmax == verdict, F.lit(False)), "verdict_not_argmax"),
        (~F.coalesce(bypass == (verdict != MALICIOUS), F.lit(False)), "bypass_flag"),
        (F.expr(f"coalesce(size({verdict_probs}), 0)") != nv, "verdict_probs_size"),
        (F.expr(f"coalesce(size({action_probs}), 0)") != na, "action_probs_size"),
        (F.expr(f"coalesce(size({logits}), 0)") != nv + na, "logits_size"),
    ]
    if expected_model is not None:
        checks.append((~F.coalesce(model == expected_model, F.lit(False)), "model_mismatch"))
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return F.when(known, found).otherwise(F.array(F.lit("invalid_verdict")))


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def first_errors(df: DataFrame, key: str, errors: str = "errors", n: int = 100) -> DataFrame:
    """The first ``n`` errors in key order, as the report shows them."""
    return df.select(key, F.posexplode(errors).alias("i", "error")).orderBy(key, "i").limit(n).drop("i")


def gates(annotated: DataFrame, candidates: DataFrame, key: str, verdict: str = "verdict", at_least: int = 1000) -> DataFrame:
    """One row of cross-table counts and yes/no requirements.

    Both sides are counted per key with a map-side part, then summed up: one
    shuffle, and no key is gathered in one place.
    """
    v = F.col(verdict)
    one, none = F.lit(1), F.lit(0)
    a = annotated.select(F.col(key).alias("_k"), one.alias("_a"), none.alias("_c"), v.alias("_v"))
    c = candidates.select(F.col(key).alias("_k"), none.alias("_a"), one.alias("_c"), F.lit(None).cast("string").alias("_v"))
    per_key = a.unionByName(c).groupBy("_k").agg(
        F.sum("_a").alias("_a"), F.max("_c").alias("_c"), F.count_if(F.col("_v") == BENIGN).alias("_b"),
        F.count_if(F.col("_v") == SUSPICIOUS).alias("_s"), F.count_if(F.col("_v") == MALICIOUS).alias("_m"),
        F.count_if(F.col("_v") != MALICIOUS).alias("_n"))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    report = per_key.agg(
        total("_a").alias("n_annotated"), total("_n").alias("bypasses"), total("_b").alias("benign_bypasses"),
        total("_s").alias("suspicious_evasions"), total("_m").alias("detected_malicious"),
        total("_c").alias("unique_candidates"), F.count_if(F.col("_a") > 0).alias("unique_annotated"),
        F.count_if((F.col("_c") == 1) & (F.col("_a") == 0)).alias("missing"),
        F.count_if((F.col("_c") == 0) & (F.col("_a") > 0)).alias("extra"))
    return report.withColumns({
        "split_sum_ok": F.col("bypasses") == F.col("benign_bypasses") + F.col("suspicious_evasions"),
        "candidates_gate": F.col("unique_candidates") >= at_least,
        "bypass_gate": F.col("bypasses") >= at_least,
        "strict_gate": F.col("benign_bypasses") >= at_least,
        "all_detected": (F.col("missing") == 0) & (F.col("extra") == 0),
    })


def label_conformance(df: DataFrame, key: str, verdict: str = "verdict", actions: str = "actions", soft: str | None = None,
                      tax: Taxonomy = TAXONOMY) -> DataFrame:
    """Violations in a labelled table: (key, issue, value) rows."""
    domain = F.array(*[F.lit(a) for a in tax.action_ids])
    pair = lambda issue, value: F.struct(F.lit(issue).alias("issue"), value.cast("string").alias("value"))
    listed = F.coalesce(F.col(actions), F.array().cast("array<string>"))
    outside = F.transform(F.filter(listed, lambda a: ~F.array_contains(domain, a)), lambda a: pair("action_outside_taxonomy", a))
    repeats = F.transform(
        F.filter(F.array_distinct(listed), lambda a: F.size(F.filter(listed, lambda b: b == a)) > 1),
        lambda a: pair("action_repeated", a))
    single = [F.when(~F.coalesce(F.col(verdict).isin(*tax.verdict_ids), F.lit(False)), pair("verdict_outside_taxonomy", F.col(verdict)))]
    if soft:
        single.append(F.when(F.col(soft).isNotNull() & (F.size(soft) != tax.size), pair("soft_size", F.size(soft))))
    issues = F.concat(F.array_compact(F.array(*single)), outside, repeats)
    return df.select(key, F.explode(issues).alias("x")).select(key, "x.issue", "x.value")


def taxonomy_errors(table: DataFrame, groups=("verdict", "action"), declared: dict[str, int] | None = None) -> DataFrame:
    """Structural errors of a taxonomy table itself: (id, error) rows.

    ``declared`` gives the number of labels a group is said to have.
    """
    rules = F.coalesce(F.size("tactics"), F.lit(0)) * F.coalesce(F.size("techniques"), F.lit(0))
    name = F.coalesce(F.col("id"), F.lit("<missing-id>"))
    found = F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("missing id")),
        F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.lit("missing description")),
        F.when(F.col("id").isNotNull() & ~F.col("id").startswith(F.concat(F.col("grp"), F.lit("."))), F.lit("wrong prefix")),
        F.when((F.col("grp") == "action") & (rules <= 0), F.lit("missing tactics/techniques"))))
    per_row = table.select(name.alias("id"), F.explode(found).alias("error"))
    repeated = (table.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
                .select("id", F.lit("duplicate id").alias("error")))
    present = table.agg(*[F.count_if(F.col("grp") == g).alias(g) for g in groups])
    found = [F.when(F.col(g) == 0, F.struct(F.lit(g).alias("id"), F.lit("missing or empty group").alias("error"))) for g in groups]
    found += [F.when(F.col(g) != n, F.struct(F.lit(g).alias("id"), F.lit("count differs from declared").alias("error")))
              for g, n in (declared or {}).items()]
    per_group = present.select(F.inline(F.array_compact(F.array(*found))))
    return per_row.unionByName(repeated).unionByName(per_group)
