import math
import re

import pytest
from pyspark.sql import functions as F

from shellsieve.functions import decide as D
from shellsieve.functions import text as X
from shellsieve.functions import vectors as V
from shellsieve.operators import filters, segments
from shellsieve.taxonomy import TAXONOMY

# fixed values: published logits of one smoke record with its published decision
SMOKE = [-12.856752, -8.838493, 7.354877, -18.480038, -8.172768, -13.1199, 10.489138, -13.623333, -12.07583, -15.201737, -14.260557, -19.040867,
         11.217665, -7.232934, -14.493118, -9.515999, -4.015068, -17.187267, -16.29969, -18.443531, -15.382742, -12.636331, -13.975891, -17.736486,
         -15.013826, -14.513886, -9.940004, -14.789833, -14.912048, -11.892166, -17.488258]


def vectors(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, logits array<double>")


def test_taxonomy_counts():
    assert (len(TAXONOMY.verdict_ids), len(TAXONOMY.action_ids), len(TAXONOMY.tactic_bits), len(TAXONOMY.technique_bits)) == (3, 28, 12, 25)
    assert TAXONOMY.group_offsets == {"verdict": (0, 3), "action": (3, 31)}


def test_smoke_record(spark):
    r = D.prob_maps(D.annotate(vectors(spark, SMOKE))).first()
    assert r.verdict == "verdict.malicious" and not r.verdict_bypass and r.bypass_type == "detected_malicious"
    assert r.actions == ["action.command_and_control", "action.reverse_shell"]
    assert r.tactics == ["command_and_control", "initial_access"] and r.techniques == ["T1059", "T1071"]
    assert r.verdict_probs["verdict.malicious"] == 1.0
    assert r.action_probs["action.keylog"] == 0.017722 and r.action_probs["action.execute_local"] == 0.000282
    assert r.raw_logits["action.reverse_shell"] == 11.217665 and len(r.raw_logits) == 31


def test_ties_extremes_and_spaces(spark):
    tie = [1.0, 1.0, 1.0] + [0.0] * 28
    far = [-1e4, 1e4, 0.0] + [1e4, -1e4] * 14
    half = [0.0, 0.0, 1e-9] + [0.5] * 28
    rows = D.decide(vectors(spark, tie, far, half)).orderBy("i").collect()
    assert rows[0].verdict == "verdict.benign" and rows[0].action_mask == (1 << 28) - 1
    assert rows[1].verdict == "verdict.suspicious" and bin(rows[1].action_mask).count("1") == 14
    assert not any(math.isnan(p) for p in rows[1].action_probs)
    assert rows[2].verdict == "verdict.malicious"
    # rounding before the comparison makes it a tie that the first id wins
    assert D.decide(vectors(spark, half), verdict_digits=6).first().verdict == "verdict.benign"
    raw = D.decide(vectors(spark, [0.0] * 3 + [0.49] * 28), score_space="logit").first()
    assert raw.action_mask == 0 and D.decide(vectors(spark, [0.0] * 3 + [0.49] * 28)).first().action_mask != 0
    limited = D.decide(vectors(spark, tie), thresholds={a: 0.6 for a in TAXONOMY.action_ids[1:]}).first()
    assert limited.action_mask == 1
    with pytest.raises(ValueError):
        D.decide(vectors(spark, tie), score_space="odds")


def test_hard_labels_and_malformed_vectors(spark):
    soft = [0.4, 0.4, 0.2] + [0.5] + [0.49] * 27
    df = spark.createDataFrame([(0, soft), (1, soft[:30]), (2, None)], "i int, soft array<double>").orderBy("i")
    labels = df.select(V.hard_labels("soft")).collect()
    assert labels[0][0] == ["verdict.benign", "action.download"]
    assert [r[0] is not None for r in df.select(V.well_formed(F.col("soft"))).collect()] == [True, False, False]


def test_teacher_gate(spark):
    base = [0.0] * 31
    def at(action, p):
        v = list(base)
        v[3 + TAXONOMY.action_ids.index(action)] = p
        return v
    rows = [(at("action.keylog", 0.7), "action.keylog", "pos", True), (at("action.keylog", 0.69), "action.keylog", "pos", False),
            (at("action.keylog", 0.3), "action.keylog", "neg", True), (at("action.keylog", 0.31), "action.keylog", "neg", False),
            (at("action.bind_shell", 0.7), "action.keylog", None, True), (at("action.download", 0.9), "action.keylog", None, False),
            (base[:30], "action.keylog", "neg", False), (None, "action.keylog", "neg", False)]
    df = spark.createDataFrame(rows, "soft array<double>, action string, target string, want boolean")
    assert all(r[0] == r[1] for r in df.select(filters.teacher_gate("soft", "action", "target"), "want").collect())


def test_window_edges(spark):
    def direct(n, limit):
        if n <= limit:
            return [(0, n)]
        out, start = [], 0
        while True:
            out.append((start, min(120, n - start)))
            if start + 120 >= n:
                return out
            start += 90
    sizes = [0, 1, 119, 120, 121, 209, 210, 211, 300, 301, 318, 319, 1000]
    df = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, tokens array<int>")
    for limit in (120, 318):
        got = {}
        for r in segments.windows(df, limit=limit).orderBy("n", "seg").collect():
            got.setdefault(r.n, []).append((r.start, len(r.seg_tokens)))
            assert list(r.seg_tokens) == list(range(r.start, r.start + len(r.seg_tokens)))
        assert got == {n: direct(n, limit) for n in sizes}


def test_windows_keep_what_is_made_of_their_own_tokens(spark):
    chunk = re.compile(f"(?:[{X.PUNCT}]|[^{X.PUNCT} {X.UNICODE_WS}]+)[ {X.UNICODE_WS}]*")
    every = "".join(f"{chr(c)}a{chr(c)}{chr(c)}" for c in range(1, 0x3100) if c != 0x200B)
    texts = ["", " ", every, "\xe9" * 300_000, "a\xe9" * 200_000 + " !", "word, \u3000" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", X.token_chunks(F.col("text")).alias("tokens"))
    got = {i: [] for i in range(len(texts))}
    for r in segments.windows(df, part=lambda own: F.array_join(own, "")).orderBy("n", "seg").collect():
        got[r.n].append(r.seg_tokens)
    for i, text in enumerate(texts):
        own = chunk.findall(text)
        starts = [0] if len(own) <= 120 else range(0, -(-(len(own) - 120) // 90) * 90 + 1, 90)
        assert got[i] == ["".join(own[s:s + 120]) for s in starts]


def test_merge_takes_first_most_malicious_segment(spark):
    a = [5.0, 0.0, 1.0] + [0.0] * 28
    b = [0.0, 0.0, 3.0] + [-1.0] * 28
    c = [0.0, 0.0, 3.0] + [2.0] * 28
    df = spark.createDataFrame([("x", 0, a), ("x", 1, b), ("x", 2, c), ("y", 0, a)], "id string, seg int, logits array<double>")
    best = {r.id: r for r in segments.merge_scores(df, ["id"]).collect()}
    assert best["x"].logits == [0.0, 0.0, 3.0] + [2.0] * 28 and best["x"].n_segments == 3 and best["y"].logits == a
    top = {r.id: r for r in segments.merge_scores(df, ["id"], verdict_merge="max_logit").collect()}
    assert top["x"].logits == [5.0, 0.0, 3.0] + [2.0] * 28
    with pytest.raises(ValueError):
        segments.merge_scores(df, ["id"], verdict_merge="mean")
