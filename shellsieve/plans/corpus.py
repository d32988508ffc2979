"""Corpus queries: validity, dedup, leakage, splits, sampling, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellsieve.functions import patterns as R
from shellsieve.functions import text as X
from shellsieve.functions import vectors as V
from shellsieve.operators import dedup, filters, generate, lookups, metrics, ranking, splits
from shellsieve.plans.catalogue import (csv, document_lines, event_commands, query, r6, score_vectors, table,
                                        truth_verdicts)
from shellsieve.session import materialise, scratch_path
from shellsieve.sources import scans, schemas, sinks
from shellsieve.taxonomy import TAXONOMY


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def corpus_dedup_first_wins(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return dedup.by_text_hash(docs, ["doc_id"], keep=["doc_id", "source", "lang"])


@query("""WITH s AS (SELECT doc_id, source, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id DESC) AS rn
FROM s WHERE length(t) > 0) WHERE rn = 1""")
def corpus_dedup_stripped_priority(spark, folder):
    """After stripping; English sources rank before the others."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    first = F.when(F.col("lang") == "en", 0).otherwise(1)
    return dedup.by_stripped_text(docs, [first, (-F.col("doc_id"))]).select("doc_id", "source", "lang")


@query("""SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) AS rn
FROM documents) WHERE rn = 1""")
def corpus_dedup_normalized(spark, folder):
    docs = scans.spread(table(spark, folder, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    return dedup.by_squeezed_text(docs, ["doc_id"], keep=["doc_id", "n_chars"])


@query("""WITH $LINES$
SELECT lang, count(*) AS n_kept, sum(length(text))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY lang, doc_id, line) AS rn
FROM lines) WHERE rn = 1 GROUP BY lang""")
def dedup_by_hash_across_groups(spark, folder):
    """The first group (language) to produce a line keeps it."""
    lines = document_lines(spark, folder).withColumn("n", F.char_length("text").cast("bigint"))
    kept = dedup.by_text_hash(lines, ["lang", "doc_id", "line"], keep=["lang", "n"])
    return kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("n").alias("chars"))


@query("""WITH $LINES$,
b AS (SELECT DISTINCT sha1(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark))
SELECT source, count(*) AS n, count(*) FILTER (WHERE sha1(text) IN (SELECT k FROM b)) AS n_leaked,
       count(*) FILTER (WHERE sha1(text) NOT IN (SELECT k FROM b)) AS n_kept FROM lines GROUP BY source""")
def leakage_report(spark, folder):
    """Corpus lines against the lines of the frozen benchmark, counted per source."""
    frozen = table(spark, folder, "benchmark").select(F.explode(X.split_lines(F.col("text"))).alias("text"))
    flagged = dedup.leakage_flags(document_lines(spark, folder), frozen, X.fingerprint(F.col("text")))
    return flagged.groupBy("source").agg(F.count("*").alias("n"), F.count_if("leaked").alias("n_leaked"),
                                         F.count_if(~F.col("leaked")).alias("n_kept"))


@query("""WITH $LINES$,
b AS (SELECT DISTINCT sha1(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark))
SELECT doc_id, count(*) AS n_lines FROM lines WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = sha1(lines.text)) GROUP BY doc_id""")
def leakage_anti_join(spark, folder):
    frozen = table(spark, folder, "benchmark").select(F.explode(X.split_lines(F.col("text"))).alias("text"))
    kept = dedup.without_leakage(document_lines(spark, folder), frozen, X.fingerprint(F.col("text")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("""SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE length(text) > 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g')
  NOT IN (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM conversations WHERE text IS NOT NULL
          UNION SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM documents WHERE lang = 'de' AND text IS NOT NULL)""")
def leakage_bloom_anti_join(spark, folder):
    """Documents whose text is neither a conversation turn nor that of a German document; clean ones pass by the Bloom filter, without a shuffle."""
    docs = table(spark, folder, "documents")
    frozen = dedup.key_set(table(spark, folder, "conversations").select("text"), docs.filter("lang = 'de'").select("text"))
    kept = dedup.without_leakage(docs.filter(F.length("text") > 0).select("doc_id", "text"), frozen, X.strip(F.col("text")), X.strip(F.col("key")), exact_rows=0)
    return kept.select("doc_id", X.sha256(F.col("text")).alias("text_sha256"))


@query("""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
f AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents UNION SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM benchmark),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = c.t))
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conv_id, turn) AS rn FROM k) WHERE rn = 1""")
def leakage_union_within_batch(spark, folder):
    """Turns not in the corpus nor the benchmark, each text once."""
    frozen = dedup.key_set(table(spark, folder, "documents").select("text"), table(spark, folder, "benchmark").select("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kept = dedup.without_leakage(turns, frozen, X.strip(F.col("text")), X.strip(F.col("key")), within_batch=["conv_id", "turn"])
    return kept.select("conv_id", "turn", "role")


@query("""WITH $TRUTH$, $DECIDED$
SELECT documents.doc_id, truth.verdict, array_to_string(list_concat([truth.verdict], list_transform(coalesce(v.tact, []), lambda i: ($ACTIONS$)[i])), ',') AS true_labels,
       v.lg IS NOT NULL AS has_soft FROM documents JOIN truth USING (doc_id) LEFT JOIN v ON v.vec_id = documents.doc_id WHERE length(text) > 0""")
def valid_split_rows(spark, folder):
    """Valid rows in split form; labels outside the taxonomy and vectors of a
    wrong length do not survive."""
    vectors = score_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "true_actions", "logits")
    rows = (table(spark, folder, "documents").select("doc_id", "text")
            .join(truth_verdicts(spark, folder).select("doc_id", "verdict"), "doc_id", "left")
            .join(vectors, "doc_id", "left")
            .withColumns({"actions": F.concat(F.array(F.lit("action.none")), F.coalesce("true_actions", F.array().cast("array<string>"))),
                          "soft": F.col("logits")}))
    out = filters.to_split_rows(filters.valid_rows(rows))
    return out.select("doc_id", "verdict", csv("true_labels").alias("true_labels"), F.col("soft_v2").isNotNull().alias("has_soft"))


@query("""WITH $LINES$ SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) BETWEEN 3 AND 500) AS n_3_500,
count(*) FILTER (WHERE length(text) < 400) AS n_lt_400 FROM lines GROUP BY source""")
def length_filter(spark, folder):
    lines = document_lines(spark, folder)
    return lines.groupBy("source").agg(F.count("*").alias("n"), F.count_if(filters.length_between(F.col("text"), 3, 500)).alias("n_3_500"),
                                       F.count_if(F.char_length("text") < 400).alias("n_lt_400"))


@query("WITH $TRUTH$ SELECT verdict, count(*) AS n, min(doc_id) AS first_doc FROM truth GROUP BY verdict")
def verdict_from_labels(spark, folder):
    return truth_verdicts(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def labelled_corpus(spark, folder):
    """Labelled documents, each text once, with the actions of their vector.

    Splits look at it several times and need only the hash of the text, so that
    is what is kept, and written once.
    """
    vectors = score_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "true_actions")
    rows = (table(spark, folder, "documents").select("doc_id", "text")
            .join(truth_verdicts(spark, folder).select("doc_id", "verdict"), "doc_id"))
    hashed = filters.valid_rows(rows).withColumn("h", ranking.hash_order(F.col("text")))
    kept = dedup.by_text_hash(hashed, ["doc_id"], keep=["doc_id", "verdict", "h"])
    joined = kept.join(vectors, "doc_id", "left")
    return materialise(joined.select("doc_id", "verdict", "h",
                                     F.coalesce("true_actions", F.array().cast("array<string>")).alias("actions")), "corpus")


CORPUS_SQL = """$TRUTH$, $DECIDED$,
  corpus AS (SELECT doc_id, verdict, md5(text || '#42') AS h FROM (SELECT documents.doc_id, text, verdict,
      row_number() OVER (PARTITION BY text ORDER BY documents.doc_id) AS rn FROM documents JOIN truth USING (doc_id) WHERE length(text) > 0) WHERE rn = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY h) AS rn, count(*) OVER (PARTITION BY verdict) AS n FROM corpus),
  cut AS (SELECT *, greatest(1, CAST(floor(n * 0.08::DOUBLE) AS BIGINT)) AS m FROM ranked),
  assigned AS (SELECT cut.doc_id, cut.verdict, h, CASE WHEN rn <= m THEN 'test' WHEN rn <= 2 * m THEN 'val' ELSE 'train' END AS split,
      coalesce(v.tact, []) AS acts FROM cut LEFT JOIN v ON v.vec_id = cut.doc_id)"""


@query("WITH " + CORPUS_SQL + " SELECT doc_id, verdict, split FROM assigned")
def stratified_split(spark, folder):
    return splits.stratified(labelled_corpus(spark, folder), "doc_id", hashed="h").select("doc_id", "verdict", "split")


def _floor_sql(n_actions: int, floor: int) -> str:
    """One step per action, each seeing what the earlier ones claimed."""
    steps = ["c0 AS (SELECT doc_id FROM assigned WHERE false)"]
    for k in range(1, n_actions + 1):
        steps.append(f"""c{k} AS MATERIALIZED (SELECT doc_id FROM c{k - 1} UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h) AS rn
 FROM assigned WHERE split = 'train' AND list_contains(acts, {k}) AND doc_id NOT IN (SELECT doc_id FROM c{k - 1}))
 WHERE rn <= {floor} - (SELECT count(*) FROM assigned WHERE split = 'test' AND list_contains(acts, {k})))""")
    return ",\n  ".join(steps)


@query("WITH " + CORPUS_SQL + ",\n  " + _floor_sql(28, 20) + """
SELECT doc_id, verdict, CASE WHEN doc_id IN (SELECT doc_id FROM c28) THEN 'test' ELSE split END AS split FROM assigned""")
def split_action_floor(spark, folder):
    """The stratified split with at least 20 test rows per action."""
    assigned = materialise(splits.stratified(labelled_corpus(spark, folder), "doc_id", hashed="h"), "assigned")
    return splits.claim_floor(assigned, "doc_id", hashed="h").select("doc_id", "verdict", "split")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '#42')) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r""")
def holdout_90_10(spark, folder):
    return splits.holdout(table(spark, folder, "documents").select("doc_id"), unique_key="doc_id")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '#0')) AS rn FROM documents) WHERE rn <= 25""")
def capped_sample_per_source(spark, folder):
    """Sampling operator: at most 25 documents per source, fixed seed."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return ranking.sample_per_group(docs, ["source"], "doc_id", 25)


@query("""WITH $LINES$, u AS (SELECT lang, text, min(doc_id * 1000000 + line) AS pos FROM lines GROUP BY lang, text)
SELECT lang, pos, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS rn FROM u) WHERE rn <= 40""")
def first_n_distinct_per_group(spark, folder):
    """The first 40 distinct lines of each language."""
    lines = document_lines(spark, folder).withColumn("pos", F.col("doc_id") * 1000000 + F.col("line"))
    distinct = lines.groupBy("lang", "text").agg(F.min("pos").alias("pos"))
    return ranking.first_per_group(distinct, ["lang"], ["pos"], 40).select("lang", "pos", F.char_length("text").cast("bigint").alias("n_chars"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn BETWEEN 5 AND 12""")
def group_slice(spark, folder):
    """Rows 5 to 12 of each source (offset 4, count 8)."""
    return ranking.group_slice(table(spark, folder, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 4, 8)


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def first_rows_in_order(spark, folder):
    """Row cap in a fixed order (top-k report)."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return ranking.head(docs, [F.col("n_chars").desc(), "doc_id"], 20)


@query("""WITH b AS (SELECT doc_id, lang FROM documents WHERE lang <> 'en'), a AS (SELECT doc_id, lang FROM documents WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || '#42')) AS rn, count(*) OVER () AS n FROM a)
SELECT doc_id, lang, 'test' AS split FROM b UNION ALL
SELECT doc_id, lang, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'train' END FROM r""")
def union_with_holdout(spark, folder):
    """English documents as additions to a frozen test split of the others."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    base = dedup.union_splits(test=docs.filter("lang <> 'en'"))
    return base.unionByName(splits.holdout(docs.filter("lang = 'en'"), unique_key="doc_id"))


@query("""WITH $DECIDED$ SELECT vec_id, verdict AS hard_verdict, array_to_string(list_transform(act, lambda i: ($ACTIONS$)[i]), ',') AS hard_actions FROM v""")
def hard_labels_from_soft(spark, folder):
    rows = score_vectors(spark, folder)
    soft = rows.withColumn("soft", F.expr(V.probabilities("logits")))
    labels = soft.withColumn("labels", V.hard_labels("soft"))
    return labels.select("vec_id", F.col("labels")[0].alias("hard_verdict"), csv(F.slice("labels", 2, 28)).alias("hard_actions"))


@query("""WITH $DECIDED$, t AS (SELECT vec_id, ap, CAST(label AS INTEGER) % 28 + 1 AS ai, CASE WHEN label % 3 = 0 THEN 'pos' WHEN label % 3 = 1 THEN 'neg' ELSE 'other' END AS target FROM d)
SELECT target, count(*) AS n, count(*) FILTER (WHERE CASE target WHEN 'pos' THEN ap[ai] >= 0.55::DOUBLE WHEN 'neg' THEN ap[ai] <= 0.45::DOUBLE
 ELSE len(list_filter([17,9,16,23,21,26,7,22,14,12,8,11], lambda i: ap[i] >= 0.55::DOUBLE)) > 0 END) AS n_kept FROM t GROUP BY target""")
def teacher_probability_gate(spark, folder):
    """Candidates kept by the teacher's probability of their own action (bounds
    0.55/0.45 fit the narrow scores of the test vectors)."""
    rows = score_vectors(spark, folder)
    target = F.when(F.col("label") % 3 == 0, "pos").when(F.col("label") % 3 == 1, "neg").otherwise("other")
    marked = rows.select(F.expr(V.probabilities("logits")).alias("soft"), F.expr(V.pick("label % 28", TAXONOMY.action_ids)).alias("action"), target.alias("target"))
    keep = filters.teacher_gate("soft", "action", "target", min_pos=0.55, max_neg=0.45)
    return marked.groupBy("target").agg(F.count("*").alias("n"), F.count_if(keep).alias("n_kept"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(html, '(?i)(fsockopen|/dev/tcp/|nc\\s+-e|ncat\\s+-e|bash\\s+-i|0>&1|proc_open\\(|socket\\.socket)')
 AND regexp_matches(html, '(?i)(\\.php\\b|\\.jsp\\b|\\.aspx\\b|/html/|/www/|/uploads/)')) AS n_web,
 count(*) FILTER (WHERE regexp_matches(html, '(?i)(ssh |scp |rsync |xargs .*ssh|for h in|while read)')) AS n_spread FROM pages""")
def regex_gates(spark, folder):
    html = F.col("html")
    return scans.spread(table(spark, folder, "pages").select("page_id", "html"), "page_id").agg(F.count("*").alias("n"), F.count_if(filters.gate(html, R.WEB_ACCEPT, R.WEB_REJECT)).alias("n_web"),
                                             F.count_if(filters.gate(html, R.SPREAD_ACCEPT)).alias("n_spread"))


@query("""WITH t(tool, template, pos) AS (VALUES ('alpha', 'alpha --run {sh} region', 0), ('alpha', 'alpha -x {sh}' || chr(10) || 'done', 1), ('beta', ' beta {sh} ', 2)),
k AS (SELECT s_name AS token, s_suppkey AS token_pos FROM supplier),
x AS (SELECT tool, pos, token_pos, trim(replace(replace(template, '{sh}', token), chr(10), '; ')) AS text FROM t CROSS JOIN k)
SELECT text, tool, CASE WHEN tool = 'beta' THEN 'action.execute_local,action.network_scan' ELSE 'action.execute_local' END AS actions
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos, token_pos) AS rn FROM x) WHERE rn = 1""")
def template_cross(spark, folder):
    """Inert templates with every supplier name."""
    templates = [("alpha", "alpha --run {sh} region", 0), ("alpha", "alpha -x {sh}\ndone", 1), ("beta", " beta {sh} ", 2)]
    tokens = table(spark, folder, "supplier").select(F.col("s_name").alias("token"), F.col("s_suppkey").alias("token_pos"))
    out = generate.expand_templates(templates, tokens, extra={"beta": "action.network_scan"})
    return out.select("text", "tool", csv("actions").alias("actions"))


@query("""SELECT format('{}-{:03d}', lower(c_mktsegment), row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) AS id, c_name AS text FROM customer""")
def seed_table_ids(spark, folder):
    """Generated ids ``prefix-000`` per seed list (here: customers of a segment)."""
    seeds = table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("risk"), F.col("c_name").alias("text"), "c_custkey")
    return generate.seed_ids(seeds, "risk", "c_custkey").select("id", "text")


LABELLED_TURNS = """t AS (SELECT conv_id, turn, role, text, list_filter(['verdict.malicious', CASE WHEN length(text) > 300 THEN 'action.reverse_shell' END,
  CASE WHEN role = 'user' THEN 'action.bind_shell' END, CASE WHEN turn <= 2 THEN 'action.web_shell' END, CASE WHEN turn >= 1 THEN 'action.keylog' END], lambda x: x IS NOT NULL) AS labs,
  CASE WHEN conv_id % 10 = 0 THEN 'test' WHEN conv_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM conversations),
 f AS (SELECT *, (list_contains(labs, 'action.reverse_shell') OR list_contains(labs, 'action.bind_shell')) AND split <> 'test' AS go FROM t),
 r AS (SELECT *, go AND list_contains(labs, 'action.web_shell') AND NOT (regexp_matches(text, '(?i)(/var/www|/usr/share/nginx|/html/|/uploads/|/wp-content/|\\.php\\b|\\.jsp\\b|\\.aspx\\b|\\.phtml\\b|nginx/html|www/html|webshell-detection-lab)')
  OR regexp_matches(text, '(?i)(>\\s*\\S+\\.(php|jsp|aspx|phtml)\\b|tee\\s+\\S+\\.(php|jsp|aspx)|<\\?php|system\\(\\$_(GET|POST|REQUEST|COOKIE))')) AS dw,
  go AND list_contains(labs, 'action.keylog') AND NOT regexp_matches(text, '(?i)(keylog|evtest|/dev/input|logkeys|xinput|script\\s+-q|strace|keystroke|kbd)') AS dk FROM f),
 o AS (SELECT *, list_filter(labs, lambda x: NOT ((x = 'action.web_shell' AND dw) OR (x = 'action.keylog' AND dk))) AS labs2 FROM r)"""


def labelled_turns(spark, folder):
    t = table(spark, folder, "conversations")
    label = lambda cond, name: F.when(cond, F.lit(name))
    labels = F.array_compact(F.array(F.lit("verdict.malicious"), label(F.char_length("text") > 300, "action.reverse_shell"),
                                     label(F.col("role") == "user", "action.bind_shell"), label(F.col("turn") <= 2, "action.web_shell"),
                                     label(F.col("turn") >= 1, "action.keylog")))
    split = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "val").otherwise("train")
    return t.select("conv_id", "turn", "text", labels.alias("true_labels"), labels.alias("labels_before"), split.alias("split"))


@query("WITH " + LABELLED_TURNS + " SELECT conv_id, turn, split, array_to_string(labs2, ',') AS true_labels FROM o")
def relabel_conditional(spark, folder):
    out = filters.drop_noisy_labels(labelled_turns(spark, folder))
    return out.select("conv_id", "turn", "split", csv("true_labels").alias("true_labels"))


@query("WITH " + LABELLED_TURNS + """ SELECT split, count(*) AS n, count(*) FILTER (WHERE list_contains(labs, 'action.web_shell')) AS web_shell_before,
 count(*) FILTER (WHERE list_contains(labs2, 'action.web_shell')) AS web_shell_after, count(*) FILTER (WHERE dw) AS web_shell_dropped,
 count(*) FILTER (WHERE list_contains(labs, 'action.keylog')) AS keylog_before, count(*) FILTER (WHERE list_contains(labs2, 'action.keylog')) AS keylog_after,
 count(*) FILTER (WHERE dk) AS keylog_dropped, split = 'test' AS frozen FROM o GROUP BY split""")
def relabel_report(spark, folder):
    return metrics.relabel_report(filters.drop_noisy_labels(labelled_turns(spark, folder)))


@query("""WITH $EVENTS$, b AS (SELECT action AS label, count(*) AS before FROM cmds GROUP BY 1),
a AS (SELECT label, count(*) AS after FROM (SELECT action AS label FROM cmds UNION ALL SELECT 'action.backdoor' FROM cmds WHERE verdict = 'verdict.malicious'
 UNION ALL SELECT action FROM cmds WHERE event_type = 'view') GROUP BY 1)
SELECT label, coalesce(before, 0)::BIGINT AS before, coalesce(after, 0)::BIGINT AS after, (coalesce(after, 0) - coalesce(before, 0))::BIGINT AS delta
FROM b FULL OUTER JOIN a USING (label) WHERE coalesce(after, 0) <> coalesce(before, 0)""")
def label_support_delta(spark, folder):
    """Label support of a command set before and after additions."""
    c = event_commands(spark, folder)
    before = c.select(F.array("action").alias("true_labels"))
    extra = c.filter("verdict = 'verdict.malicious'").select(F.array(F.lit("action.backdoor")).alias("true_labels"))
    more = c.filter("event_type = 'view'").select(F.array("action").alias("true_labels"))
    return metrics.support_delta(before, before.unionByName(extra).unionByName(more))


@query("""WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, length(text)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM d) WHERE rn = 1""")
def jsonl_round_trip(spark, folder):
    """Written as JSON lines in document order, scanned again, deduplicated in
    (file, line) order."""
    path = scratch_path(spark, "round-trip")
    docs = table(spark, folder, "documents").select("text", F.col("doc_id").cast("string").alias("source"))
    sinks.write_jsonl(docs.orderBy(F.col("source").cast("bigint")), path)
    lines = scans.parsed_lines(scans.numbered_lines(spark, path, "*.json"), "text STRING, source STRING", required="text")
    kept = dedup.by_exact_text(lines.select("text", "source", "_source_file", "_source_line"), ["_source_file", "_source_line"])
    return kept.select(F.col("source").cast("bigint").alias("doc_id"), F.char_length("text").cast("bigint").alias("n_chars"))


@query("""WITH $LINES$, a AS (SELECT DISTINCT text FROM lines WHERE lang = 'en'), b AS (SELECT DISTINCT text FROM lines WHERE lang <> 'en')
SELECT (SELECT count(*) FROM a) AS n_before, count(*) AS n_after, sum(length(text))::BIGINT AS chars FROM (SELECT text FROM a UNION SELECT text FROM b)""")
def append_without_repeats(spark, folder):
    """Lines appended to a store that already holds the English ones."""
    path = scratch_path(spark, "append")
    lines = document_lines(spark, folder)
    sinks.write_jsonl(lines.filter("lang = 'en'").select("text").distinct(), path)
    before = spark.read.schema("text STRING").json(path).agg(F.count("*").alias("n_before"))
    n_before = before.first()["n_before"]
    sinks.append_new(lines.select("text"), path, "text STRING")
    after = spark.read.schema("text STRING").json(path)
    return after.agg(F.lit(n_before).cast("bigint").alias("n_before"), F.count("*").alias("n_after"), F.sum(F.char_length("text")).alias("chars"))


@query("""WITH $EVENTS$, c AS (SELECT action, max_by(value, event_id) AS value, max(event_id) AS event_id FROM cmds GROUP BY action)
SELECT action, round(value, 6) AS value, event_id FROM c""")
def cache_last_wins(spark, folder):
    """Cache semantics: the last entry of a key is the one read."""
    c = event_commands(spark, folder).select("action", "value", "event_id")
    return lookups.last_per_key(c, "action", ["event_id"]).select("action", r6("value").alias("value"), "event_id")


@query("""WITH u AS (SELECT DISTINCT text FROM conversations), dl AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT count(*) AS n_wanted, count(*) FILTER (WHERE text IN (SELECT text FROM dl)) AS n_hits, count(*) FILTER (WHERE text NOT IN (SELECT text FROM dl)) AS n_todo FROM u""")
def cache_hit_split(spark, folder):
    """Turn texts already known as document lines, and those still to be labelled."""
    one_each = lambda df: df.withColumn("_k", lookups.digest("text")).dropDuplicates(["_k"]).drop("_k")
    wanted = one_each(table(spark, folder, "conversations").select("text"))
    lines = table(spark, folder, "documents").select(F.explode(X.split_lines(F.col("text"))).alias("text"))
    marked = lookups.cache_marked(wanted, one_each(lines), "text", found="cached")
    return marked.agg(F.count("*").alias("n_wanted"), F.count_if("cached").alias("n_hits"), F.count_if(~F.col("cached")).alias("n_todo"))


@query("""WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'verdict.benign' ELSE 'verdict.suspicious' END AS label FROM f WHERE length(text) > 0""")
def corpus_build(spark, folder):
    """Labelled JSON lines in which every text occurs twice with other verdicts and every fifth
    has a mistyped vector: the first line of a text stays, whatever the vector."""
    path = scratch_path(spark, "labelled")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    even = F.col("doc_id") % 2 == 0
    first, second = F.when(even, "verdict.benign").otherwise("verdict.suspicious"), F.lit("verdict.malicious")
    twice = docs.withColumn("verdict", first).withColumn("turn", F.lit(0)).unionByName(docs.withColumn("verdict", second).withColumn("turn", F.lit(1)))
    line = F.to_json(F.struct("text", "verdict", F.col("doc_id").cast("string").alias("model")))
    spoiled = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(',"soft":"none"}'))).otherwise(line)
    twice.orderBy("doc_id", "turn").select(spoiled.alias("value")).write.text(path)
    rows = filters.valid_rows(scans.numbered_jsonl(spark, path, glob="*.txt"))
    kept = filters.to_split_rows(dedup.by_exact_text(rows, ["_source_file", "_source_line"]))
    return kept.select(F.col("model").cast("bigint").alias("doc_id"), F.get("true_labels", F.lit(0)).alias("label"))


# --- file forms: written, read back, compared with the table they came from

@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'invalid JSON' WHEN doc_id % 11 = 0 THEN 'missing command' ELSE 'accepted' END AS state, count(*) AS n,
 sum(length(text))::BIGINT AS chars FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 GROUP BY 1""")
def strict_scan_rejects(spark, folder):
    """The strict scan over lines of which some are cut off and some have no command: how many it would stop at."""
    path, docs = scratch_path(spark, "strict"), table(spark, folder, "documents").filter(F.length(X.strip(F.col("text"))) > 0)
    line = F.to_json(F.struct(F.when((F.col("doc_id") % 11 != 0) | (F.col("doc_id") % 7 == 0), F.col("text")).alias("command"),
                              F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0), F.col("text")).alias("intent"),
                              F.char_length("text").cast("string").alias("id")))
    cut = F.when(F.col("doc_id") % 7 == 0, F.concat(F.char_length("text").cast("string"), F.lit("|"), F.expr("left(_line, length(_line) - 1)"))).otherwise(F.col("_line"))
    docs.withColumn("_line", line).select(cut.alias("value")).write.text(path)
    rows = scans.parsed_lines(scans.numbered_lines(spark, path, "*.txt"), schemas.REDTEAM)
    size = F.coalesce(F.col("id"), F.regexp_extract("value", "^([0-9]+)", 1)).cast("bigint")
    return rows.groupBy(F.coalesce("_reject", F.lit("accepted")).alias("state")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"))


@query("SELECT y, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS y FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY y")
def risk_bench_scan(spark, folder):
    """A risk benchmark in Parquet: labels become 0 and 1, a missing one 0."""
    path = scratch_path(spark, "risk")
    labels = table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "risky").otherwise("safe").alias("label"))
    table(spark, folder, "documents").join(labels, "doc_id", "left").select(F.col("text").alias("command"), "label").write.parquet(path)
    return scans.risk_bench(spark, path).groupBy("y").agg(F.count("*").alias("n"), F.sum(F.char_length("command")).cast("bigint").alias("chars"))


@query("""WITH $LINES$ SELECT md5(text) AS line_md5, 'web' AS source, 'benign' AS label, count(*) AS n FROM lines
WHERE length(text) <= 500 AND text NOT LIKE '#%' GROUP BY 1""")
def line_corpus_scan(spark, folder):
    """Plain lines: stripped, without blanks, comments and over-long ones."""
    path = scratch_path(spark, "plain-lines")
    docs = table(spark, folder, "documents")
    docs.select(F.explode(X.split_lines(F.col("text"))).alias("value")).write.text(path)
    rows = scans.line_corpus(spark, path, "web", "benign")
    return rows.groupBy(F.md5(F.col("text").cast("binary")).alias("line_md5"), "source", "label").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'early' ELSE 'late' END AS period, count(*) AS n, sum(n_chars)::BIGINT AS frequency,
 sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars FROM documents
WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 500 GROUP BY 1""")
def honeypot_scan(spark, folder):
    """Honeypot commands of two periods, those of at most 500 characters."""
    paths = {p: scratch_path(spark, f"honeypot-{p}") for p in ("early", "late")}
    docs = table(spark, folder, "documents").select(F.col("text").alias("command"), F.col("n_chars").alias("frequency"), "doc_id")
    for i, path in enumerate(paths.values()):
        sinks.write_jsonl(docs.filter(F.col("doc_id") % 2 == i).drop("doc_id"), path)
    return scans.honeypot(spark, paths).groupBy("period").agg(F.count("*").alias("n"), F.sum("frequency").alias("frequency"),
                                                              F.sum(F.char_length("text")).cast("bigint").alias("chars"))


@query("""SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(length(text))::BIGINT AS chars, 31::BIGINT AS labels
FROM documents GROUP BY 1""")
def split_folders(spark, folder):
    """Splits as folders of JSON lines beside the label descriptions, read back."""
    path, part = scratch_path(spark, "splits"), F.col("doc_id") % 10
    rows = table(spark, folder, "documents").select("text", F.array().cast("array<string>").alias("true_labels"), F.lit(None).cast("array<double>").alias("soft_v2"),
                                                    F.when(part == 0, "test").when(part == 1, "val").otherwise("train").alias("split"))
    sinks.write_splits(rows, path)
    labels = spark.read.schema("label STRING").json(f"{path}/labels_desc").count()
    back = spark.read.schema(f"{schemas.SPLIT}, split STRING").json(f"{path}/rows")
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("bigint").alias("chars"), F.lit(labels).cast("bigint").alias("labels"))


@query("SELECT lang, count(*) AS n, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest FROM documents GROUP BY lang")
def summary_object(spark, folder):
    """Per-language counts as one nested JSON object, read back into rows."""
    path, size = scratch_path(spark, "summary"), F.char_length("text")
    per = table(spark, folder, "documents").groupBy("lang").agg(F.struct(F.count("*").alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest")).alias("v"))
    sinks.write_summary(per.agg(F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias("languages")), path)  # one entry per language
    back = spark.read.schema("languages MAP<STRING, STRUCT<n: BIGINT, shortest: BIGINT, longest: BIGINT>>").json(path)
    return back.select(F.explode("languages").alias("lang", "v")).select("lang", "v.*")


@query("SELECT lang, doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE lang IN ('en', 'fr')")
def prediction_folders(spark, folder):
    """Predictions laid out by source, of which two are read back."""
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(table(spark, folder, "documents").select("doc_id", F.char_length("text").alias("n_chars"), "lang"), path, source="lang")
    back = spark.read.schema("doc_id BIGINT, n_chars BIGINT, lang STRING").json(path)
    return back.filter(F.col("lang").isin("en", "fr")).select("lang", "doc_id", "n_chars")


@query("""WITH o AS (SELECT md5(text) AS key, max(doc_id) AS v FROM documents GROUP BY 1), n AS (SELECT md5(text) AS key, max(doc_id) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT o.key AS text_md5, CASE WHEN n.v IS NULL THEN o.v ELSE n.v + 1000000 END AS value FROM o LEFT JOIN n USING (key)""")
def cache_rewrite(spark, folder):
    """A label cache rewritten: a new label replaces an old one of the same text, the rest stays."""
    path = scratch_path(spark, "cache")
    docs = table(spark, folder, "documents").groupBy("text").agg(F.max("doc_id").alias("value"))
    new = table(spark, folder, "documents").filter(F.col("doc_id") % 3 == 0).groupBy("text").agg((F.max("doc_id") + 1000000).alias("value"))
    sinks.write_cache(docs, new, path)
    return spark.read.schema("text STRING, value BIGINT").json(path).select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "value")


@query("WITH " + """$TRUTH$ SELECT doc_id, verdict FROM truth WHERE verdict <> 'verdict.benign'""")
def non_benign_rows(spark, folder):
    """Labelled documents that are not benign."""
    return filters.non_benign(truth_verdicts(spark, folder)).select("doc_id", "verdict")


@query("SELECT sha256(text) AS text_sha256, lang, source, count(*) AS n FROM documents GROUP BY ALL")
def json_array_scan(spark, folder):
    """Documents written as JSON array files and read back in pieces by many tasks."""
    path = scratch_path(spark, "arrays")
    docs = table(spark, folder, "documents")
    sinks.write_json_arrays(docs.select("text", F.array("lang").alias("true_labels"), "source"), path)
    rows = scans.json_array(spark, path)
    return (rows.groupBy(X.sha256(F.col("text")).alias("text_sha256"), F.get("true_labels", F.lit(0)).alias("lang"), "source")
            .agg(F.count("*").alias("n")))
