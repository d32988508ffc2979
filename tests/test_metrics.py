import math
import random

import pytest
from pyspark.sql import functions as F

from shellsieve.operators import audit, curves, metrics, scoring, sessions, thresholds
from shellsieve.functions import vectors as V
from shellsieve.taxonomy import TAXONOMY


def counts(spark, tp, fp, fn, tn):
    return metrics.binary_rates(spark.createDataFrame([(tp, fp, fn, tn)], "tp int, fp int, fn int, tn int")).first()


def test_published_counts_give_published_rates(spark):
    # confusion matrix rows b/s/m: 2179,113,1 / 98,1409,102 / 0,109,1967
    strict = counts(spark, 1967, 1, 109, 2292)
    assert (round(strict.precision * 100, 3), round(strict.recall * 100, 3), round(strict.f1 * 100, 3), round(strict.fpr * 100, 4)) == (99.949, 94.75, 97.28, 0.0436)
    loose = counts(spark, 2076, 114, 0, 2179)
    assert (round(loose.precision * 100, 3), loose.recall, round(loose.f1 * 100, 3), round(loose.fpr * 100, 4)) == (94.795, 1.0, 97.328, 4.9717)
    r = metrics.with_prf(spark.createDataFrame([(19508, 1656, 1554)], "tp int, fp int, fn int")).first()
    assert (round(r.precision * 100, 3), round(r.recall * 100, 3), round(r.f1 * 100, 3)) == (92.175, 92.622, 92.398)


def test_confusion_matrix_of_published_rows(spark):
    table = {"benign": (2179, 113, 1), "suspicious": (98, 1409, 102), "malicious": (0, 109, 1967)}
    names = list(table)
    rows = [(t, f"verdict.{names[j]}", n) for t, ns in table.items() for j, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "gt string, verdict string, n int").withColumn("_", F.explode(F.expr("IF(n > 0, sequence(1, n), array())"))).drop("n", "_")
    got = {r.truth: (r.pred_benign, r.pred_suspicious, r.pred_malicious) for r in metrics.confusion(df, "gt", "verdict").collect()}
    assert got == table
    r = metrics.recalls(df, "gt", "verdict").first()
    assert round(r.strict_recall, 4) == 0.9475 and r.loose_recall == 1.0 and r.suspicious_total == 1609


def test_empty_denominators(spark):
    r = counts(spark, 0, 0, 0, 0)
    assert all(math.isnan(x) for x in (r.precision, r.recall, r.f1, r.accuracy, r.fpr))
    assert math.isnan(counts(spark, 0, 0, 5, 5).f1) and math.isnan(counts(spark, 0, 3, 5, 5).f1)
    empty = spark.createDataFrame([], "true_mask bigint, action_mask bigint")
    z = metrics.micro(empty).first()
    assert (z.tp, z.precision, z.recall, z.f1) == (0, 0.0, 0.0, 0.0)


def test_labels_without_support_stay(spark):
    df = spark.createDataFrame([(["action.download"], ["action.download", "action.keylog"]), ([], None)], "t array<string>, p array<string>")
    rows = {r.label: r for r in metrics.per_label(df, "t", "p").collect()}
    assert len(rows) == 28 and rows["action.download"].f1 == 1.0 and rows["action.keylog"].fp == 1 and rows["action.timestomp"].support == 0
    assert metrics.macro_f1(metrics.per_label(df, "t", "p")).first().macro_f1 == pytest.approx(1 / 28)


def naive_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def naive_pr(y, s):
    area, n_pos = 0.0, sum(y)
    for cut in sorted(set(s), reverse=True):
        chosen = [a for a, b in zip(y, s) if b >= cut]
        area += sum(a for a, b in zip(y, s) if b == cut) / n_pos * sum(chosen) / len(chosen)
    return area


@pytest.mark.parametrize("ties", [False, True])
def test_curves_against_naive(spark, ties):
    rng = random.Random(7)
    y = [rng.random() < 0.3 for _ in range(300)]
    s = [round(rng.gauss(1 if a else 0, 1), 1 if ties else 12) for a in y]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(y, s)], "y int, s double").repartition(5)
    for cuts in ([], [0.0], curves.boundaries(df, "s", 16)):
        assert curves.roc_auc(df, "y", "s", cuts).first().roc_auc == pytest.approx(naive_auc(y, s))
        assert curves.pr_auc(df, "y", "s", cuts).first().pr_auc == pytest.approx(naive_pr(y, s))


def test_curves_over_counted_ranges(spark):
    rng = random.Random(8)
    y = [rng.random() < 0.3 for _ in range(300)]
    s = [round(rng.gauss(1 if a else 0, 1), 2) for a in y]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(y, s)], "y int, s double").repartition(5)
    ranged = curves.ranged_counts(df, "y", "s", rows=5)
    assert ranged.select("range").distinct().count() > 20
    assert curves.roc_of_counts(ranged).first().roc_auc == pytest.approx(naive_auc(y, s))
    assert curves.pr_of_counts(ranged).first().pr_auc == pytest.approx(naive_pr(y, s))


def test_one_class_is_nan(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "y int, s double")
    assert math.isnan(curves.roc_auc(df, "y", "s").first().roc_auc) and math.isnan(curves.pr_auc(df, "y", "s").first().pr_auc)


def direct_tune(rows):
    ids = TAXONOMY.action_ids

    def f1(th):
        tp = fp = fn = 0
        for scores, true in rows:
            pred = {a for i, a in enumerate(ids) if scores[i] >= th[a]}
            tp, fp, fn = tp + len(true & pred), fp + len(pred - true), fn + len(true - pred)
        p, r = tp / max(1, tp + fp), tp / max(1, tp + fn)
        return 2 * p * r / max(1e-9, p + r)
    th = dict.fromkeys(ids, 0.5)
    for _ in range(2):
        for a in ids:
            best, best_f1 = th[a], f1(th)
            for t in thresholds.GRID:
                th[a] = t
                if f1(th) > best_f1:
                    best, best_f1 = t, f1(th)
            th[a] = best
    return th, f1(th)


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_ascent_against_direct_version(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        true = {a for a in TAXONOMY.action_ids if rng.random() < 0.2}
        rows.append(([min(1.0, max(0.0, rng.gauss(0.6 if a in true else 0.4, 0.15))) for a in TAXONOMY.action_ids], true))
    df = spark.createDataFrame([(s, sorted(t)) for s, t in rows], "scores array<double>, labels array<string>")
    got = thresholds.tune(thresholds.sweep(df, "scores", "labels")).collect()
    want, want_f1 = direct_tune(rows)
    assert {r.action: r.threshold for r in got} == want and got[0].micro_f1 == pytest.approx(want_f1)


def test_threshold_defaults(spark):
    given = spark.createDataFrame([("action.keylog", "0.35"), ("action.nope", "0.1"), ("action.download", "high")], "action string, threshold string")
    d = thresholds.as_dict(thresholds.with_defaults(given))
    assert len(d) == 28 and d["action.keylog"] == 0.35 and d["action.download"] == 0.5 and "action.nope" not in d


def test_sessions(spark):
    rows = [("one", 0, "verdict.benign", "action.download"), ("chain", 0, "verdict.benign", "action.network_scan"), ("chain", 1, "verdict.benign", "action.exfiltrate"),
            ("chain", 2, "verdict.benign", "action.process_inject"), ("bad", 0, "verdict.suspicious", "action.none"), ("bad", 1, "verdict.malicious", "action.keylog"),
            ("twice", 0, "verdict.suspicious", "action.download"), ("twice", 1, "verdict.benign", "action.download_execute"), ("twice", 2, "verdict.benign", "action.execute_local")]
    df = spark.createDataFrame(rows, "id string, pos int, verdict string, action string").withColumn("action_mask", V.mask_of_name("action")).repartition(4)
    got = {r.id: r for r in sessions.roll_up(df, ["id"]).collect()}
    assert (got["one"].verdict, got["one"].hit_chains) == ("verdict.benign", [])
    assert (got["chain"].verdict, got["chain"].hit_chains) == ("verdict.suspicious", ["recon_priv_exfil"])
    assert (got["bad"].verdict, got["bad"].all_actions) == ("verdict.malicious", ["action.keylog"])
    assert got["twice"].hit_chains == ["download_execute"]
    seq = {r.id: r.per_command_verdicts for r in sessions.verdict_sequence(df, ["id"], "pos").collect()}
    assert seq["bad"] == ["verdict.suspicious", "verdict.malicious"]


def direct_ngram(text, weights, lo, hi, intercept):
    counts = {}
    for word in text.lower().split():
        p = f" {word} "
        for n in range(lo, hi + 1):
            if len(p) <= n:
                counts[p] = counts.get(p, 0) + 1
                break
            for i in range(len(p) - n + 1):
                counts[p[i:i + n]] = counts.get(p[i:i + n], 0) + 1
    known = {g: c for g, c in counts.items() if g in weights}
    norm = math.sqrt(sum((c * weights[g][1]) ** 2 for g, c in known.items()))
    return intercept if norm == 0 else sum(c * weights[g][0] for g, c in known.items()) / norm + intercept


@pytest.mark.parametrize("small", [True, False])
def test_ngram_scorer(spark, monkeypatch, small):
    monkeypatch.setattr(scoring, "is_small", lambda df: small)
    weights = {" ls": (0.5, 2.0), "ls ": (-1.0, 1.5), " a ": (0.25, 3.0), "curl": (2.0, 4.0), " cu": (0.1, 1.1), " x y": (9.0, 9.0)}
    w = spark.createDataFrame([(g, *v) for g, v in weights.items()], "ngram string, coef_idf double, idf double")
    texts = ["ls ls -la", "a", "curl a CURL", "", "   ", "zzz", "x y", " ls　"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.score for r in scoring.ngram_linear_score(df, w, ["i"], n_min=3, n_max=5, intercept=-0.5).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(direct_ngram(t, weights, 3, 5, -0.5)), t


def test_row_errors(spark):
    good = ("verdict.benign", [0.8, 0.1, 0.1], True, [0.0] * 28, [0.0] * 31)
    rows = [good, ("verdict.none", *good[1:]), (None, *good[1:]), ("verdict.malicious", *good[1:]), (*good[:2], None, [0.0] * 27, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, vp array<double>, b boolean, ap array<double>, l array<double>")
    got = [r.e for r in df.select("i", audit.row_errors(F.col("v"), "vp", F.col("b"), "ap", "l").alias("e")).orderBy("i").collect()]
    assert got == [[], ["invalid_verdict"], ["invalid_verdict"], ["verdict_not_argmax", "bypass_flag"], ["bypass_flag", "action_probs_size", "logits_size"]]


def test_taxonomy_is_clean_and_errors_are_found(spark):
    table = TAXONOMY.to_df(spark)
    assert audit.taxonomy_errors(table).count() == 0
    bad = table.filter("id <> 'action.keylog'").unionByName(spark.createDataFrame(
        [("action", 40, "keylog", " ", ["x"], []), ("verdict", 41, "verdict.benign", "d", [], [])], table.schema)).filter("grp <> 'none'")
    got = sorted((r.id, r.error) for r in audit.taxonomy_errors(bad).collect())
    assert got == [("keylog", "missing description"), ("keylog", "missing tactics/techniques"), ("keylog", "wrong prefix"), ("verdict.benign", "duplicate id")]
    assert [r.id for r in audit.taxonomy_errors(table.filter("grp = 'action'")).collect()] == ["verdict"]
    assert [(r.id, r.error) for r in audit.taxonomy_errors(table, declared={"verdict": 3, "action": 29}).collect()] == [("action", "count differs from declared")]


def test_conformance_of_labelled_rows(spark):
    rows = [(1, "verdict.benign", ["action.keylog"], [0.0] * 31), (2, None, ["x", "x"], [0.0] * 30), (3, "verdict.odd", None, None)]
    df = spark.createDataFrame(rows, "i int, verdict string, actions array<string>, soft array<double>")
    got = sorted((r.i, r.issue, r.value) for r in audit.label_conformance(df, "i", soft="soft").na.fill("-").collect())
    assert got == [(2, "action_outside_taxonomy", "x"), (2, "action_outside_taxonomy", "x"), (2, "action_repeated", "x"), (2, "soft_size", "30"),
                   (2, "verdict_outside_taxonomy", "-"), (3, "verdict_outside_taxonomy", "verdict.odd")]


def test_long_session_comes_in_parts(spark):
    df = spark.range(25).select(F.lit("s").alias("id"), F.col("id").alias("pos"), F.concat(F.lit("v"), F.col("id")).alias("verdict")).repartition(5)
    parts = {r.part: r.per_command_verdicts for r in sessions.verdict_sequence(df, ["id"], "pos", chunk=10).collect()}
    assert sum((parts[p] for p in sorted(parts)), []) == [f"v{i}" for i in range(25)] and len(parts) == 3
