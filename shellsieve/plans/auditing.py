"""Audit queries: reconciliation, invariants, gates, inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shellsieve.functions import decide as D
from shellsieve.functions import text as X
from shellsieve.operators import audit, dedup, lookups, metrics, splits
from shellsieve.plans.catalogue import event_commands, query, score_vectors, table
from shellsieve.plans.corpus import CORPUS_SQL, labelled_corpus
from shellsieve.session import materialise, scratch_path
from shellsieve.sources import scans, sinks


@query("""WITH l AS (SELECT doc_id AS key, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT vec_id + 100 AS key, count(*) AS n FROM embeddings GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN r.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' WHEN l.n = r.n THEN 'matched' ELSE 'multiplicity' END AS status
FROM l FULL OUTER JOIN r USING (key)) GROUP BY status""")
def reconcile_tables(spark, folder):
    """Documents against result records whose ids are shifted by 100."""
    right = table(spark, folder, "embeddings").select((F.col("vec_id") + 100).alias("doc_id"))
    return dedup.compare_keys(table(spark, folder, "documents"), right, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT sha256(text) AS key, count(*) AS n FROM (SELECT text FROM documents WHERE lang = 'en' UNION ALL SELECT text FROM benchmark) GROUP BY 1)
SELECT key, coalesce(l.n, 0)::BIGINT AS n_left, coalesce(r.n, 0)::BIGINT AS n_right, CASE WHEN r.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' WHEN l.n = r.n THEN 'matched' ELSE 'multiplicity' END AS status
FROM l FULL OUTER JOIN r USING (key)""")
def key_difference(spark, folder):
    """Missing and extra commands by sha256."""
    docs = table(spark, folder, "documents")
    left = docs.select(X.sha256(F.col("text")).alias("h"))
    right = docs.filter("lang = 'en'").select("text").unionByName(table(spark, folder, "benchmark").select("text")).select(X.sha256(F.col("text")).alias("h"))
    return dedup.compare_keys(left, right, "h")


def damaged(spark, folder):
    """Annotated records with defects of every kind planted by rule.

    As in a real run they are a written table: checks look at every column many
    times, and should not have the whole decision folded into each look.
    """
    a = D.with_evasion_flags(D.decide(score_vectors(spark, folder)))
    i = F.col("vec_id") % 10
    bad = (a.withColumn("model_dir", F.when(i == 5, "other").otherwise("model"))
           .withColumn("verdict", F.when(i == 1, "verdict.none").when(i == 2, F.lit("verdict.benign")).otherwise(F.col("verdict")))
           .withColumn("verdict_bypass", F.when(i == 3, ~F.col("verdict_bypass")).otherwise(F.col("verdict_bypass")))
           .withColumn("logits", F.when(i == 4, F.slice("logits", 1, 30)).otherwise(F.col("logits"))))
    return materialise(bad.select("vec_id", "verdict", "verdict_probs", "verdict_bypass", "action_probs", "logits", "model_dir"), "annotated")


DAMAGED = """$DECIDED$, x AS (SELECT vec_id, vec_id % 10 AS i, verdict AS good, CASE vec_id % 10 WHEN 1 THEN 'verdict.none' WHEN 2 THEN 'verdict.benign' ELSE verdict END AS verdict,
  CASE WHEN vec_id % 10 = 3 THEN NOT (verdict <> 'verdict.malicious') ELSE verdict <> 'verdict.malicious' END AS bypass FROM v),
 er AS (SELECT vec_id, CASE WHEN i = 1 THEN ['invalid_verdict'] ELSE list_filter([CASE WHEN verdict <> good THEN 'verdict_not_argmax' END,
  CASE WHEN bypass <> (verdict <> 'verdict.malicious') THEN 'bypass_flag' END, CASE WHEN i = 4 THEN 'logits_size' END, CASE WHEN i = 5 THEN 'model_mismatch' END], lambda e: e IS NOT NULL) END AS errors FROM x)"""


def _with_errors(spark, folder):
    return damaged(spark, folder).withColumn("errors", audit.row_errors(
        F.col("verdict"), "verdict_probs", F.col("verdict_bypass"), "action_probs", "logits", F.col("model_dir"), "model"))


@query("WITH " + DAMAGED + " SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM er) GROUP BY error")
def result_invariants(spark, folder):
    return audit.error_counts(_with_errors(spark, folder))


@query("WITH " + DAMAGED + " SELECT vec_id, errors[i] AS error FROM (SELECT *, unnest(range(1, len(errors) + 1)) AS i FROM er) ORDER BY vec_id, i LIMIT 100")
def first_errors(spark, folder):
    """The first 100 errors, as the verification report lists them."""
    return audit.first_errors(_with_errors(spark, folder), "vec_id")


@query("""WITH $DECIDED$, a AS (SELECT vec_id AS k, verdict FROM v), c AS (SELECT doc_id AS k FROM documents)
SELECT count(*) AS n_annotated, count(*) FILTER (WHERE verdict <> 'verdict.malicious') AS bypasses, count(*) FILTER (WHERE verdict = 'verdict.benign') AS benign_bypasses,
 count(*) FILTER (WHERE verdict = 'verdict.suspicious') AS suspicious_evasions, count(*) FILTER (WHERE verdict = 'verdict.malicious') AS detected_malicious,
 (SELECT count(DISTINCT k) FROM c) AS unique_candidates, count(DISTINCT k) AS unique_annotated, (SELECT count(DISTINCT k) FROM c WHERE k NOT IN (SELECT k FROM a)) AS missing,
 count(DISTINCT k) FILTER (WHERE k NOT IN (SELECT k FROM c)) AS extra, true AS split_sum_ok, (SELECT count(DISTINCT k) FROM c) >= 1000 AS candidates_gate,
 count(*) FILTER (WHERE verdict <> 'verdict.malicious') >= 1000 AS bypass_gate, count(*) FILTER (WHERE verdict = 'verdict.benign') >= 1000 AS strict_gate,
 (SELECT count(DISTINCT k) FROM c WHERE k NOT IN (SELECT k FROM a)) = 0 AND count(DISTINCT k) FILTER (WHERE k NOT IN (SELECT k FROM c)) = 0 AS all_detected FROM a""")
def cross_table_gates(spark, folder):
    annotated = D.decide(score_vectors(spark, folder)).select(F.col("vec_id").alias("k"), "verdict")
    return audit.gates(annotated, table(spark, folder, "documents").select(F.col("doc_id").alias("k")), "k")


@query("""WITH $EVENTS$, w AS (SELECT event_id, verdict, [action, action, 'action.download'] AS acts, CASE WHEN k = 7 THEN 30 WHEN k = 8 THEN 31 END AS ns, k FROM cmds)
SELECT event_id, 'verdict_outside_taxonomy' AS issue, 'verdict.odd' AS value FROM w WHERE k = 9
UNION ALL SELECT event_id, 'soft_size', '30' FROM w WHERE ns = 30
UNION ALL SELECT event_id, 'action_outside_taxonomy', a FROM (SELECT event_id, unnest(acts) AS a FROM w) WHERE NOT list_contains($ACTIONS$, a)
UNION ALL SELECT event_id, 'action_repeated', a FROM (SELECT event_id, a, count(*) AS c FROM (SELECT event_id, unnest(acts) AS a FROM w) GROUP BY 1, 2) WHERE c > 1""")
def taxonomy_conformance(spark, folder):
    """Labels outside the taxonomy, repeats and wrong vectors in a labelled table."""
    c = event_commands(spark, folder)
    size = F.when(F.col("k") == 7, 30).when(F.col("k") == 8, 31)
    rows = c.select("event_id", F.when(F.col("k") == 9, "verdict.odd").otherwise(F.col("verdict")).alias("verdict"),
                    F.array("action", "action", F.lit("action.download")).alias("actions"), F.array_repeat(F.lit(0.5), size).alias("soft"))
    return audit.label_conformance(rows, "event_id", soft="soft")


@query("""SELECT CASE WHEN n > 1 THEN 'duplicate id' END AS error, id FROM (SELECT 'verdict.' || event_type AS id, count(*) AS n FROM events GROUP BY 1) WHERE n > 1
UNION ALL SELECT 'wrong prefix', 'verdict.' || event_type FROM events WHERE event_type = 'error'
UNION ALL SELECT 'missing description', 'verdict.' || event_type FROM events WHERE value < 1
UNION ALL SELECT 'missing tactics/techniques', 'verdict.' || event_type FROM events WHERE event_type = 'error'""")
def taxonomy_check(spark, folder):
    """Structural checks of a taxonomy table; the events play its entries."""
    e = table(spark, folder, "events")
    bad = F.col("event_type") == "error"
    entries = e.select(F.when(bad, "action").otherwise("verdict").alias("grp"), F.concat(F.lit("verdict."), "event_type").alias("id"),
                       F.when(F.col("value") < 1, "").otherwise("text").alias("description"),
                       F.when(~bad, F.array(F.lit("t"))).alias("tactics"), F.when(~bad, F.array(F.lit("t"))).alias("techniques"))
    return audit.taxonomy_errors(entries)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows, 1 AS has_bytes FROM {t}" for t in TABLES))
def file_inventory(spark, folder):
    """Rows of every table from the scan's own file metadata, over all files of a table, and whether each has bytes."""
    found = None
    for name in TABLES:
        part = scans.inventory(spark, f"{folder}/{name}.parquet", fmt="parquet").withColumn("table", F.lit(f"{name}.parquet"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(F.col("table").alias("file")).agg(F.sum("rows").alias("rows"), F.min((F.col("bytes") > 0).cast("int")).alias("has_bytes"))


@query()
def file_checksums(spark, folder):
    """sha256 and size of every table file (read as binary, not as rows)."""
    return scans.checksums(spark, folder, "*.parquet").select(F.element_at(F.split("file", "/"), -1).alias("file"), "bytes", "sha256")


@query("""WITH $EVENTS$, m AS (SELECT max(strftime(day, '%Y%m%d')) AS r FROM cmds) SELECT strftime(day, '%Y%m%d') AS run_id, count(*) AS n, count(DISTINCT user_id) AS n_users FROM cmds, m
WHERE strftime(day, '%Y%m%d') = m.r GROUP BY 1""")
def latest_run(spark, folder):
    """Only the run whose name sorts last (runs are days here)."""
    c = event_commands(spark, folder).withColumn("run_id", F.date_format("day", "yyyyMMdd"))
    return lookups.latest_run(c).groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("WITH " + CORPUS_SQL + " SELECT split, count(*) AS n, count(*) FILTER (WHERE len(acts) > 0) AS n_soft FROM assigned GROUP BY split")
def split_sizes(spark, folder):
    assigned = splits.stratified(labelled_corpus(spark, folder), "doc_id", hashed="h")
    return metrics.split_sizes(assigned.withColumn("soft_v2", F.when(F.size("actions") > 0, F.col("actions"))))


@query("""WITH $DECIDED$ SELECT 'benign_bypasses' AS subset, count(*) AS n FROM v WHERE verdict = 'verdict.benign' UNION ALL SELECT 'suspicious_evasions', count(*) FROM v WHERE verdict = 'verdict.suspicious'
UNION ALL SELECT 'detected_malicious', count(*) FROM v WHERE verdict = 'verdict.malicious' UNION ALL SELECT 'bypasses', count(*) FROM v WHERE verdict <> 'verdict.malicious'""")
def annotated_fan_out(spark, folder):
    """Annotated rows written once by verdict; subsets are partition filters."""
    path = scratch_path(spark, "annotated")
    annotated = D.with_attck(D.decide(score_vectors(spark, folder)))
    sinks.write_annotated(annotated.select("vec_id", "verdict", "actions", "tactics", "techniques"), path)
    out = None
    for name in ("benign_bypasses", "suspicious_evasions", "detected_malicious", "bypasses"):
        part = sinks.annotated_subset(spark, path, name).agg(F.lit(name).alias("subset"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
n AS (SELECT doc_id, ls[i] AS value, row_number() OVER (ORDER BY doc_id, i) AS line FROM l)
SELECT line, length(value)::BIGINT AS n_chars, md5(value) AS value_md5 FROM n WHERE length(regexp_replace(value, '\\s+', '', 'g')) > 0""")
def line_provenance(spark, folder):
    """Document lines written as text files in order, then numbered by the scan:
    1-based, blank lines counted; files are chained by their line totals."""
    path = scratch_path(spark, "lines")
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("i", "value"))
    lines.orderBy("doc_id", "i").select("value").write.text(path)
    numbered = scans.numbered_lines(spark, path, "*.txt")
    earlier = Window.orderBy("_source_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = (numbered.groupBy("_source_file").agg(F.max("_source_line").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return (numbered.filter(F.length(X.strip(F.col("value"))) > 0).join(starts, "_source_file")
            .select((F.col("_start") + F.col("_source_line")).alias("line"), F.char_length("value").cast("bigint").alias("n_chars"),
                    F.md5(F.col("value").cast("binary")).alias("value_md5")))
