import json
import random

import pytest
from pyspark.sql import functions as F

from shellsieve.plans import jobs
from shellsieve.taxonomy import TAXONOMY


def stand_in():
    """A scorer whose words decide; local, so that it is shipped by value."""
    def load():
        def score(texts):
            out = []
            for t in texts:
                v = [1.0, 0.0, 0.0] + [-3.0] * 28
                words = t.split()
                v[1] = 2.0 if "sus" in words else 0.0
                v[2] = 4.0 if "evil" in words else 0.0
                for i, w in enumerate(("fetch", "run")):
                    if w in words:
                        v[3 + i] = 3.0
                out.append(v)
            return out
        return score
    return load


load = stand_in()


def test_build_splits(spark, tmp_path):
    rng = random.Random(3)
    src = tmp_path / "corpus" / "sub"
    src.mkdir(parents=True)
    rows = []
    for i in range(300):
        acts = rng.sample(TAXONOMY.action_ids[:6], rng.randint(0, 3)) + ["action.odd"]
        rows.append({"text": f"cmd {i}", "verdict": rng.choice(TAXONOMY.verdict_ids), "actions": acts, "soft": [0.5] * (31 if i % 2 else 30)})
    rows += [{"text": "cmd 1", "verdict": "verdict.benign"}, {"text": "x", "verdict": "none"}, {"text": "", "verdict": "verdict.benign"}]
    (src / "a.jsonl").write_text("\n".join(map(json.dumps, rows[:200])))
    (src / "b.jsonl").write_text("\n".join(map(json.dumps, rows[200:])) + "\nbroken\n")
    sizes = {r.split: r.n for r in jobs.build_splits(spark, str(tmp_path / "corpus"), str(tmp_path / "out"), min_test=12).collect()}
    assert sum(sizes.values()) == 300 and set(sizes) == {"train", "val", "test"}
    out = jobs.read_splits(spark, str(tmp_path / "out"))
    assert out.select("text").distinct().count() == 300
    assert not any("action.odd" in r.true_labels for r in out.collect())
    support = {r.label: r["count"] for r in out.filter("split = 'test'").select(F.explode("true_labels").alias("label")).groupBy("label").count().collect()}
    assert all(support[a] >= 12 for a in TAXONOMY.action_ids[:6])
    assert out.filter("soft_v2 is null").count() == 150


def test_redteam_run_and_verification(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = ([{"command": "evil fetch", "category": "a", "ground_truth": "malicious"}, {"command": "evil  fetch", "category": "a"}, {"command": "sus run", "ground_truth": "malicious"},
              {"command": "plain", "category": "b", "ground_truth": "suspicious"}, {"command": "pad " * 300 + "evil", "ground_truth": "malicious", "evasion_strategy": "long"}])
    (raw / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out = str(tmp_path / "runs" / "r1" / "results")
    s = jobs.redteam_run(spark, str(raw), out, load, "m1").first()
    assert (s.unique_candidates, s.bypasses_non_malicious, s.strict_benign_bypasses, s.partial_suspicious_evasions, s.detected_malicious) == (4, 2, 1, 1, 2)
    assert s.thresholds_used["action.keylog"] == 0.5 and s.bypass_rate_non_malicious == 0.5
    counts = {(r.dimension, r.value): r.n for r in spark.read.parquet(out + "/counts").collect()}
    assert counts[("category", "unknown")] == 2 and counts[("strategy", "long")] == 1 and counts[("action", "action.download")] == 1
    v = jobs.verify_run(spark, str(raw), out, "m1", at_least=3).first()
    assert (v.status, v.row_errors, v.unique_candidates, v.missing, v.candidates_gate, v.bypass_gate) == ("verified", 0, 4, 0, True, False)
    assert (v.n_files, v.altered_files) == (1, 0)
    assert jobs.verify_run(spark, str(raw), out, "m2").first().row_errors == 4
    (raw / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")  # the same rows in other bytes
    changed = jobs.verify_run(spark, str(raw), out, "m1", at_least=3).first()
    assert (changed.status, changed.altered_files) == ("failed", 1)
    assert {(r.file, r.state) for r in jobs.compare_files(spark, str(raw), out).collect()} == {("x.jsonl", "changed")}
    (raw / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (raw / "y.jsonl").write_text('{"command": "new one"}\n')
    assert jobs.verify_run(spark, str(raw), out, "m1").first().status == "failed"
    jobs.redteam_run(spark, str(raw), str(tmp_path / "runs" / "r2" / "results"), load, "m1")
    t = jobs.truth_report(spark, str(raw), str(tmp_path / "runs" / "*" / "results" / "annotated")).first()
    assert (t.malicious_total, t.malicious_strict, t.malicious_loose, t.suspicious_total, t.suspicious_hit) == (3, 2, 3, 1, 0)


def test_sessions_and_long_inputs(spark):
    df = spark.createDataFrame([("s1", ["fetch a", "run b"]), ("s2", ["plain"]), ("s3", ["x " * 318, "x " * 400 + "evil"])], "session_id string, commands array<string>")
    got = {r.session_id: r for r in jobs.score_sessions(df, load).collect()}
    assert (got["s1"].verdict, got["s1"].hit_chains, got["s1"].n_commands) == ("verdict.suspicious", ["download_execute"], 2)
    assert got["s2"].verdict == "verdict.benign" and got["s3"].verdict == "verdict.malicious"


def test_merge_never_lets_test_text_into_train(spark):
    base = spark.createDataFrame([("a", ["verdict.benign"], "train"), ("t", ["verdict.benign"], "test")], "text string, true_labels array<string>, split string")
    arb = spark.createDataFrame([("t ", "malicious", "malicious"), ("n1", "malicious", "malicious"), ("n1", "malicious", "malicious"), ("n2", "malicious", "benign"), ("n3", "malicious", "malicious")],
                                "text string, gt string, arb_verdict string")
    teacher = spark.createDataFrame([("t ", "verdict.benign", []), ("n1", "verdict.suspicious", ["action.keylog", "odd"]), ("n2", "verdict.benign", [])],
                                    "text string, verdict string, actions array<string>")
    add = jobs.hard_negative_additions(arb, teacher)
    assert sorted(r.text for r in add.collect()) == ["n1", "t "]
    merged = jobs.merge_candidates(base, add)
    assert sorted((r.text, r.split, r.teacher_verdict) for r in merged.collect()) == [("a", "train", None), ("n1", "val", "verdict.suspicious"), ("t", "test", None)]
    out, report = jobs.relabel_splits(spark.createDataFrame([("nc", ["action.bind_shell", "action.keylog"], "train")], "text string, true_labels array<string>, split string"))
    assert out.first().true_labels == ["action.bind_shell"] and report.first().keylog_dropped == 1


def test_reports(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        v = [rng.gauss(0, 1) for _ in range(31)]
        rows.append((i, v, [rng.choice(TAXONOMY.verdict_ids)] + [a for j, a in enumerate(TAXONOMY.action_ids) if v[3 + j] > rng.gauss(0.4, 0.5)],
                     rng.choice(["s1", "s2"]), rng.choice(["malicious", "benign"])))
    df = spark.createDataFrame(rows, "id int, logits array<double>, true_labels array<string>, source string, label string")
    base = jobs.evaluate(df)["micro"].first().f1
    tuned = {r.action: r.threshold for r in jobs.tune_thresholds(df).collect()}
    best = jobs.tune_thresholds(df).first().micro_f1
    assert best >= base and jobs.evaluate(df, tuned)["micro"].first().f1 == pytest.approx(best)
    parts = jobs.external_report(df)
    assert parts["sources"].count() == 4 and 0 <= parts["roc"].first().roc_auc <= 1 and 0 < parts["pr"].first().pr_auc <= 1
    w = spark.createDataFrame([("bad", 3.0, 1.0), ("goo", -3.0, 1.0)], "ngram string, coef_idf double, idf double")
    cmds = spark.createDataFrame([(0, "bad x", 1), (1, "good x", 0), (2, "zz", 1)], "id int, command string, y int")
    got = {r.rule: (r.tp, r.fp, r.fn, r.tn) for r in jobs.risk_bench_report(cmds, w, 3, 5, 0.1).collect()}
    assert got == {"thr=0.00": (2, 0, 0, 1), "thr=0.40": (1, 0, 1, 1)}


def test_fitted_scorers(spark):
    from shellsieve.functions import vectors as V
    from shellsieve.operators import fit
    rows = [(f"fetch thing {i}" if i % 2 else f"list other {i}", ["verdict.malicious"] if i % 2 else ["verdict.benign"]) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, true_labels array<string>").withColumn("soft", F.lit(None).cast("array<double>"))
    ready = fit.features(df).withColumn("targets", V.soft_targets("soft", "true_labels"))
    weights = fit.weighted_rows(ready, "verdict.malicious").groupBy("y").agg(F.sum("w").alias("w"))
    assert {r.y: round(r.w, 6) for r in weights.collect()} == {0.0: 30.0, 1.0: 39.0}
    half = fit.weighted_rows(ready.withColumn("targets", F.create_map(F.lit("verdict.malicious"), F.lit(0.25))), "verdict.malicious")
    assert {r.y: round(r.w, 6) for r in half.groupBy("y").agg(F.sum("w").alias("w")).collect()} == {0.0: 45.0, 1.0: 15.0}
    models = fit.fit_scorers(ready, ["verdict.malicious"], max_iter=10)
    scored = fit.apply_scorers(fit.features(spark.createDataFrame([("fetch it",), ("list it",), ("",)], "text string")), models)
    got = {r.text: r.logit_malicious for r in scored.collect()}
    assert got["fetch it"] > 0 > got["list it"] and len(got) == 3
    grams = spark.createDataFrame([("Ab cde",), ("",), ("a",)], "t string").select(fit.word_ngrams(F.col("t"), 3)).collect()
    assert [r[0] for r in grams] == [[" ab", "ab ", " cd", "cde", "de "], [], [" a "]]


def test_scorers_of_every_label(spark, folder, monkeypatch):
    """The query asks for every label with the operator's own settings; a converged
    fit without regularisation on the one-hot language gives the weighted log-odds."""
    import math

    from pyspark.ml.functions import array_to_vector
    from shellsieve.functions.decide import malicious_weight
    from shellsieve.operators import fit
    from shellsieve.plans import scoring as P
    asked, fit_scorers = [], fit.fit_scorers
    monkeypatch.setattr(fit, "fit_scorers", lambda df, labels, **settings: asked.append((tuple(labels), settings)) or {})
    P.fitted_label_scorers(spark, folder)
    assert asked == [(TAXONOMY.all_ids, {})]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = docs.join(P.label_targets(spark, folder), "doc_id").cache()
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    one_hot = rows.withColumn("features", array_to_vector(F.array(*[(F.col("lang") == x).cast("double") for x in langs])))
    counts = {}
    for label in TAXONOMY.all_ids:
        t = F.element_at("targets", label)
        w = malicious_weight(F.lit(label), t)
        for r in rows.groupBy("lang").agg(F.sum(t * w).alias("a"), F.sum((1 - t) * w).alias("b")).collect():
            counts[label, r.lang] = (r.a, r.b)
    sure = [x for x in TAXONOMY.all_ids if all(all(counts[x, lang]) for lang in langs)]
    assert sure and any(x in TAXONOMY.action_ids for x in sure)
    models = fit_scorers(one_hot, sure, max_iter=100, reg=0.0)
    first = fit.apply_scorers(one_hot.dropDuplicates(["lang"]), models).collect()
    for x in sure:
        for r in first:
            a, b = counts[x, r.lang]
            assert r["logit_" + x.split(".")[-1]] == pytest.approx(math.log(a / b), abs=0.02)
