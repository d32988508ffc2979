from shellsieve.operators import lookups


def test_cache_split_by_digest(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "text string, n int")
    cache = spark.createDataFrame([("a", 9), (None, 8)], "text string, soft int")
    hits, todo = lookups.cache_split(wanted, cache, "text")
    assert sorted(map(tuple, hits.collect())) == [("a", 1, 9), ("a", 4, 9)]
    assert todo.columns == wanted.columns and {r.n for r in todo.collect()} == {2, 3}


def test_lookup_takes_the_last_duplicate(spark):
    rows = spark.createDataFrame([("a",), ("c",), (None,)], "text string")
    table = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "text string, at int, soft int")
    got = {r.text: (r.soft, r.found) for r in lookups.lookup(rows, table, "text", ["at"]).collect()}
    assert got == {"a": (20, True), "c": (None, False), None: (None, False)}


def test_last_per_key_keeps_columns_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, None, 30), (4, None, 40), (5, "", 50)], "at int, text string, soft int")
    kept = lookups.last_per_key(rows, "text", ["at"])
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [(2, "a", 20), (4, None, 40), (5, "", 50)]
    assert sorted(r.at for r in lookups.last_per_key(rows, "soft", ["at"]).collect()) == [1, 2, 3, 4, 5]
