import random

from pyspark.sql import functions as F

from shellsieve.operators import dedup, ranking, splits
from shellsieve.taxonomy import TAXONOMY


def test_small_strata(spark):
    rows = [(f"b{i}", "verdict.benign") for i in range(100)] + [("s", "verdict.suspicious"), ("m1", "verdict.malicious"), ("m2", "verdict.malicious")]
    out = splits.stratified(spark.createDataFrame(rows, "text string, verdict string"))
    counts = {(r.verdict, r.split): r["count"] for r in out.groupBy("verdict", "split").count().collect()}
    assert counts == {("verdict.benign", "test"): 8, ("verdict.benign", "val"): 8, ("verdict.benign", "train"): 84,
                      ("verdict.suspicious", "test"): 1, ("verdict.malicious", "test"): 1, ("verdict.malicious", "val"): 1}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("text"), F.when(F.col("id") < 2000, "verdict.benign").otherwise(None).alias("verdict"))
    one = {r.text: r.split for r in splits.stratified(df.coalesce(1)).collect()}
    many = {r.text: r.split for r in splits.stratified(df.repartition(13)).collect()}
    assert one == many and sorted(set(one.values())) == ["test", "train", "val"]
    assert sum(v == "test" for k, v in one.items() if int(k) >= 2000) == 80  # a null stratum is a stratum


def test_holdout_of_nothing_and_one(spark):
    empty = splits.holdout(spark.range(0).select(F.col("id").cast("string").alias("text")))
    assert empty.count() == 0
    assert [r.split for r in splits.holdout(spark.range(1).select(F.col("id").cast("string").alias("text"))).collect()] == ["val"]


def direct_floor(rows, floor):
    """rows: (id, hash, split, actions); claims one action after the other."""
    train = sorted((r for r in rows if r[2] == "train"), key=lambda r: r[1])
    moved = set()
    for a in TAXONOMY.action_ids:
        have = sum(r[3].count(a) for r in rows if r[2] == "test")
        for r in list(train):
            if have >= floor:
                break
            if a in r[3]:
                train.remove(r)
                moved.add(r[0])
                have += 1
    return moved


def test_floor_against_direct_version(spark):
    for seed in range(4):
        rng = random.Random(seed)
        ids = list(TAXONOMY.action_ids)
        rows = []
        for i in range(rng.choice([40, 200])):
            acts = rng.choices(ids[:rng.choice([3, 28])], k=rng.randint(0, 4))
            rows.append((f"t{i}", rng.choice(["train"] * 6 + ["test", "val"]), acts))
        df = spark.createDataFrame(rows, "text string, split string, actions array<string>")
        hashes = {r.text: r.h for r in df.select("text", ranking.hash_order(F.col("text")).alias("h")).collect()}
        want = direct_floor([(t, hashes[t], s, a) for t, s, a in rows], 5)
        got = {r.text for r in splits.claim_floor(df, min_test=5).filter("split = 'test'").collect()} - {t for t, s, _ in rows if s == "test"}
        assert got == want


def test_first_per_group_small_and_salted_agree(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    for n in (7, 1500):
        got = {(r.g, r.id) for r in ranking.first_per_group(df, ["g"], ["id"], n).select("g", "id").collect()}
        groups = {}
        for r in df.orderBy("id").collect():
            groups.setdefault(r.g, []).append(r.id)
        assert got == {(g, i) for g, members in groups.items() for i in members[:n]}


def test_rank_in_group_is_row_number(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 10007).alias("o"), F.when(F.col("id") % 3 > 0, "hot").alias("g")).repartition(6)
    got = {r.o: (r.g, r["rank"]) for r in ranking.rank_in_group(df, ["g"], "o", cuts=[1000.0, 1000.5, 5000.0]).collect()}
    for g in ("hot", None):
        members = sorted(o for o, (h, _) in got.items() if h == g)
        assert [got[o][1] for o in members] == list(range(1, len(members) + 1))
    assert len(got) == 2000


def test_rank_in_many_counted_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 10007).alias("o"), F.when(F.col("id") % 3 > 0, "hot").alias("g")).repartition(6)
    ranged = ranking.in_ranges(df, "o", rows=3)
    assert ranged.select("range").distinct().count() > 900
    got = {r.o: (r.g, r["rank"]) for r in ranking.rank_in_group(df, ["g"], "o", rows=20).collect()}
    for g in ("hot", None):
        members = sorted(o for o, (h, _) in got.items() if h == g)
        assert [got[o][1] for o in members] == list(range(1, len(members) + 1))
    assert len(got) == 3000


def test_sample_is_a_stable_subset(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("g"))
    small = {r.id for r in ranking.sample_per_group(df, ["g"], "id", 10).collect()}
    large = {r.id for r in ranking.sample_per_group(df.repartition(5), ["g"], "id", 300).collect()}
    assert len(small) == 40 and len(large) == 1000 and small < large


def test_first_wins_order_and_hot_key(spark):
    rows = [("a", "f2", 1), ("a", "f1", 9), ("a ", "f1", 1), (None, "f1", 2), (None, "f0", 3)] + [("hot", "f3", i) for i in range(500)]
    df = spark.createDataFrame(rows, "text string, file string, line int").repartition(7)
    got = {(r.text, r.file, r.line) for r in dedup.by_exact_text(df, ["file", "line"]).collect()}
    assert got == {("a", "f1", 9), ("a ", "f1", 1), (None, "f0", 3), ("hot", "f3", 0)}
    assert df.columns == dedup.by_exact_text(df, ["file", "line"]).columns
    stripped = {(r.text, r.file) for r in dedup.by_stripped_text(df.filter("text is not null"), ["file", "line"]).collect()}
    assert stripped == {("a", "f1"), ("hot", "f3")}


def test_leakage_flag_within_batch(spark):
    cand = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "i int, text string")
    frozen = spark.createDataFrame([("z ",), ("z",), ("q",)], "text string")
    from shellsieve.functions.text import fingerprint
    loose = dedup.without_leakage(cand, frozen, fingerprint(F.col("text")))
    once = dedup.without_leakage(cand, frozen, fingerprint(F.col("text")), within_batch=["i"])
    assert sorted(r.i for r in loose.collect()) == [1, 2, 3] and sorted(r.i for r in once.collect()) == [1, 3]


def test_compare_keys(spark):
    left = spark.createDataFrame([("a",)] * 300 + [("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a",)] * 300 + [("b",), ("b",), ("d",)], "k string")
    got = {r.key: (r.n_left, r.n_right, r.status) for r in dedup.compare_keys(left, right, "k").collect()}
    assert got == {"a": (300, 300, "matched"), "b": (1, 2, "multiplicity"), "c": (1, 0, "missing"), "d": (0, 1, "extra")}
