"""JSON arrays cut into many splits against ``json.load``."""

import json
import random

import pytest

from shellsieve.sources import arrays, scans, sinks

ODD = ["a}b", '{["x\\', "\\\\}", "", 'q"}{', "é}", None, 5, True, "]},{", "\n}", "\u2028"]


def value(rng, depth=0):
    r = rng.random()
    if r < .5 or depth > 3:
        return rng.choice(ODD)
    if r < .75:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc}"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_many_splits_equal_json_load(spark, tmp_path, tiny_splits):
    rng = random.Random(3)
    want = {}
    for name, n, indent in (("a", 300, None), ("b", 150, 1), ("c", 1, None), ("d", 0, None)):
        rows = [{"text": f"t{i}", "v": value(rng)} for i in range(n)]
        if n > 100:
            rows[7] = {"v": "long } text" * 200}  # one element over several blocks
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
        if n:
            want[name] = rows
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    got = {}
    for r in arrays.json_elements(spark, str(tmp_path)).orderBy("_source_file", "_source_offset").collect():
        got.setdefault(r._source_file[-6], []).append(json.loads(r.value))
    assert got == want


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1', '[{"a":1}{"b":2}]', '[{"a":1},5]', '{"a":1}', "[1,2]", '[{"a":1}] x', '[{"a":1},]',
                                  '[{"a":{"b":2}', '[[{"a":1}]]', '[{"a":tru}]'])
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="JSON"):
        arrays.json_elements(spark, str(tmp_path)).collect()


def test_empty_arrays_and_spaces(spark, tmp_path):
    for i, text in enumerate(("", "[]", " [ ] \n", "[ {} ]\n")):
        (tmp_path / f"{i}.json").write_text(text)
    assert [r.value for r in arrays.json_elements(spark, str(tmp_path)).collect()] == ["{}"]


def test_written_arrays_come_back(spark, tmp_path, tiny_splits):
    rows = [(f"t{i} }}" if i % 3 else None, [str(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, true_labels array<string>").repartition(5)
    sinks.write_json_arrays(df.filter("true_labels[0] <> '7'"), str(tmp_path / "out"))
    sinks.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    back = scans.json_array(spark, str(tmp_path / "out")).collect()
    assert sorted((r.text or "", r.true_labels) for r in back) == sorted((t or "", x) for t, x in rows if x != ["7"])
    assert all(json.loads(f.read_text()) is not None for f in (tmp_path / "out").glob("*.txt"))
    assert scans.json_array(spark, str(tmp_path / "none")).count() == 0
