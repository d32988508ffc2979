"""The YAML reader: what it reads, and that all else is a reject with a reason."""

import json

import pytest

from shellsieve.sources import extract, yaml_pages
from shellsieve.sources.yaml_pages import LONGEST, to_json

PAGE = """---
description: |
  two
    lines

functions:
  shell:
    - code: |
        a -x
        b: c
    - description: "it's # \\"q\\""
      code: 'x ''y'' # z'   # note
  sudo:
  - code:
    - one
    - two
  -
    code: >-
      f1
      f2
  empty:
"k e": ~
---
body: [
"""
FUNCTIONS = {"shell": [{"code": "a -x\nb: c\n"}, {"description": 'it\'s # "q"', "code": "x 'y' # z"}],
             "sudo": [{"code": ["one", "two"]}, {"code": "f1 f2"}], "empty": None}


def test_front_matter_of_a_page():
    value, reject = to_json(PAGE)
    assert reject is None
    assert json.loads(value) == {"description": "two\n  lines\n", "functions": FUNCTIONS, "k e": None}
    assert json.loads(to_json(PAGE.replace("\n", "\r\n"))[0])["functions"] == FUNCTIONS


@pytest.mark.parametrize("text, value", [
    ("a: http://x y", {"a": "http://x y"}), ("a:\n- 1\n- 2\nb: c", {"a": ["1", "2"], "b": "c"}), ("a:\n  - - x\n    - y\n", {"a": [["x", "y"]]}),
    ("a: -x", {"a": "-x"}), ("a: |+\n  x\n", {"a": "x\n"}), ("a: |-\n  x\n\n", {"a": "x"}), ("a: |\n  x\u2028y\n", {"a": "x\u2028y\n"}), ("# c\na: b # c", {"a": "b"})])
def test_forms(text, value):
    assert to_json(text) == (json.dumps(value, ensure_ascii=False), None)


@pytest.mark.parametrize("text, reason", [
    ("a:\n\tb: 1", "tab as indent"), ("a: [1]", "unread form"), ("a: &x 1", "unread form"), ("a: 1\na: 2", "repeated key"), ("- a", "no mapping"),
    ("a: 'x", "open quote"), ("a: b\n  c", "value over several lines"), ("a: b: c", "mapping in a value"), ("x", "neither entry nor item"), (None, "empty"),
    (" \n", "empty"), ("a:\n   b: 1\n  c: 2", "indent"), ('a: "\\q"', "escape"), ("a: - x", "item in a value"), ("x" * (LONGEST + 1), "too long"),
    ("\n".join(" " * i + "a:" for i in range(60)), "too deep"), ("# only", "no mapping")])
def test_rejects(text, reason):
    assert to_json(text) == (None, reason)


def test_stream_over_many_splits(spark, tmp_path):
    docs = [f"id: {i}\nfunctions:\n  k{i}:\n    - code: c{i}" for i in range(300)]
    (tmp_path / "s.yml").write_text("\n---\n".join(docs) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        pages = yaml_pages.yaml_documents(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() > 5
        rows = pages.select(yaml_pages.yaml_json(pages["text"]).alias("y")).selectExpr("get_json_object(y.value, '$.functions') AS f", "y.reject")
        assert rows.filter("reject IS NOT NULL").count() == 0
        assert sorted(r.text for r in extract.nested_commands(rows, ["reject"], "f").collect()) == sorted(f"c{i}" for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
