"""Stateful streams: restarts from the checkpoint, late rows, closed sessions, and agreement with the batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shellsieve.operators import scoring, sessions
from shellsieve.session import scratch_path
from shellsieve.streaming import stateful
from shellsieve.taxonomy import TAXONOMY

DAY = dt.datetime(2024, 3, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def runs(spark, parts, schema, build):
    """Rows after each run, and the state rows each run left."""
    source, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    seen, state = [], []
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        result = build(spark.readStream.schema(schema).parquet(source))
        q = stateful.run_appended(result, out, check)
        q.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
        seen.append(spark.read.schema(result.schema).parquet(out).collect())
    return seen, state


def test_dedup_remembers_across_restarts_and_forgets_after_the_delay(spark):
    parts = [[(1, "a", at(0)), (2, "b", at(1)), (3, "a", at(1)), (4, None, at(1)), (5, None, at(0)), (6, "zz", None)],
             [(7, "a", at(2)), (8, "c", at(3)), (9, "x" * 100_000, at(3))],
             [(10, "far", at(60))],
             [(11, "a", at(61)), (12, "old", at(2)), (13, "c", at(61))]]
    seen, state = runs(spark, parts, "id int, text string, ts timestamp", lambda s: stateful.distinct_within(s, "text", "ts", "5 hours"))
    texts = [sorted(str(r["text"])[:4] for r in rows) for rows in seen]
    assert texts[0] == ["None", "a", "b"] and texts[1] == ["None", "a", "b", "c", "xxxx"]
    assert texts[2] == sorted([*texts[1], "far"])
    assert texts[3] == sorted([*texts[2], "a", "c"])  # forgotten, so new again; "old" came too late
    assert state[1] == 5 and state[2] == 1


ROWS = "user string, ts timestamp, verdict string, action_mask bigint"


def commands():
    bit = {a: 1 << i for i, a in enumerate(TAXONOMY.action_ids)}
    first = [("u", at(1), "verdict.benign", bit["action.download"]), ("v", at(2), "verdict.malicious", 0), ("u", None, "verdict.malicious", 0)]
    more = [("u", at(5), "verdict.benign", bit["action.execute_local"]), ("v", at(30), "verdict.suspicious", bit["action.keylog"])]
    return [first, more, [("w", at(500), "verdict.benign", 0)], [("u", at(6), "verdict.malicious", 0), ("w", at(501), "verdict.benign", 0)]]


def test_sessions_agree_with_the_batch_fold_and_leave_no_state(spark):
    seen, state = runs(spark, commands(), ROWS, lambda s: stateful.fold_sessions(s, ["user"], "ts", "48 hours", length="1 day"))
    assert seen[0] == seen[1] == [] and seen[2] == seen[3]  # the last malicious command came too late
    whole = spark.createDataFrame([r for part in commands()[:2] for r in part if r[1]], ROWS).withColumn("start", F.date_trunc("day", "ts"))
    batch = sessions.roll_up(whole, ["user", "start"])
    names = ["user", "start", "n_commands", "hit_chains", "verdict", "all_actions"]
    assert sorted(tuple(r[n] for n in names) for r in seen[2]) == sorted(tuple(r[n] for n in names) for r in batch.collect())
    assert {r["verdict"] for r in seen[2] if r["user"] == "u"} == {"verdict.suspicious"}  # a chain across both runs
    assert state == [2, 3, 1, 1]


def test_sessions_by_gap(spark):
    seen, _ = runs(spark, commands(), ROWS, lambda s: stateful.fold_sessions(s, ["user"], "ts", "48 hours", gap="3 hours"))
    assert sorted((r["user"], r["start"], r["n_commands"]) for r in seen[2]) == [("u", at(1), 1), ("u", at(5), 1), ("v", at(2), 1), ("v", at(30), 1)]
    with pytest.raises(ValueError):
        stateful.fold_sessions(spark.createDataFrame([], ROWS), ["user"], "ts", "1 hour")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("low,high", [(3, 5), (2, 3), (5, 7), (1, 1)])
def test_ngram_windows_are_those_of_padded_words(spark, monkeypatch, small, low, high):
    import random

    from test_metrics import direct_ngram
    monkeypatch.setattr(scoring, "is_small", lambda df: small)
    rng = random.Random(low)
    texts = [" ".join("".join(rng.choice("abé日\U0001F600") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(9))) for _ in range(40)]
    texts += ["", "a", "ab", "abc  abc\tabc", "日", None]
    grams = {g for t in texts for w in (t or "").split() for p in [f" {w} "] for n in range(1, 8) for g in [p[i:i + n] for i in range(len(p))]}
    weights = {g: (rng.uniform(-1, 1), rng.uniform(0.5, 3)) for g in sorted(grams) if rng.random() < 0.6 and g.strip()}
    w = spark.createDataFrame([(g, *v) for g, v in weights.items()] + [("", 1.0, 1.0)], "ngram string, coef_idf double, idf double")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: r.score for r in scoring.ngram_linear_score(df, w, ["i"], n_min=low, n_max=high, intercept=-0.5, masked=False).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(direct_ngram(t or "", weights, low, high, -0.5)), (t, low, high)


def test_long_texts_are_cut_between_words_only():
    texts = ["ab " * 50 + "x" * 40, None, "", "y" * 70 + " z", "q"]
    for limit in (1, 7, 64, 10_000):
        back = {}
        for part in scoring.word_slices([t.strip() if t else t for t in texts], limit):
            for row, words in part:
                back.setdefault(row, []).extend(words.split(" "))
        assert back == {i: t.split() for i, t in enumerate(texts) if t}


def test_ngram_scorer_without_weights(spark):
    none = spark.createDataFrame([], "ngram string, coef_idf double, idf double")
    df = spark.createDataFrame([(1, "some text"), (2, None)], "i int, text string")
    assert [r.score for r in scoring.ngram_linear_score(df, none, ["i"], intercept=0.25).collect()] == [0.25, 0.25]
