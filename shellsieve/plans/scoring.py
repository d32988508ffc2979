"""Scoring queries: decisions, windows, merges, scorers, sessions, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellsieve.functions import decide as D
from shellsieve.functions import patterns as R
from shellsieve.functions import text as X
from shellsieve.functions import vectors as V
from shellsieve.operators import dedup, fit, lookups, metrics, scoring, segments, sessions
from shellsieve.plans import jobs
from shellsieve.plans.catalogue import SNIPPETS, csv, event_commands, query, r6, score_vectors, table, truth_verdicts
from shellsieve.session import materialise, scratch_path
from shellsieve.sources import extract, scans, schemas, yaml_pages
from shellsieve.streaming import score as stream
from shellsieve.streaming import stateful
from shellsieve.taxonomy import BENIGN, TAXONOMY


@query("""WITH $DECIDED$ SELECT vec_id, verdict, round(p0, 6) AS p_benign, round(p1, 6) AS p_suspicious, round(p2, 6) AS p_malicious,
 len(act)::BIGINT AS n_actions, array_to_string(list_transform(act, lambda i: ($ACTIONS$)[i]), ',') AS actions, round(list_max(ap), 6) AS top_action_p FROM v""")
def decide_verdict_actions(spark, folder):
    out = D.with_attck(D.decide(score_vectors(spark, folder)))
    p = F.col("verdict_probs")
    return out.select("vec_id", "verdict", r6(p[0]).alias("p_benign"), r6(p[1]).alias("p_suspicious"), r6(p[2]).alias("p_malicious"),
                      F.size("actions").cast("bigint").alias("n_actions"), csv("actions").alias("actions"),
                      r6(F.array_max("action_probs")).alias("top_action_p"))


@query("""WITH $DECIDED$, $TACTICS$, $TECHNIQUES$, a AS (SELECT vec_id, unnest(act) AS i FROM v)
SELECT v.vec_id, coalesce((SELECT string_agg(DISTINCT tactic.name, ',' ORDER BY tactic.name) FROM a JOIN tactic USING (i) WHERE a.vec_id = v.vec_id), '') AS tactics,
 coalesce((SELECT string_agg(DISTINCT technique.name, ',' ORDER BY technique.name) FROM a JOIN technique USING (i) WHERE a.vec_id = v.vec_id), '') AS techniques FROM v""")
def attck_derive(spark, folder):
    out = D.with_attck(D.decide(score_vectors(spark, folder)))
    return out.select("vec_id", csv("tactics").alias("tactics"), csv("techniques").alias("techniques"))


@query("""WITH $EVENTS$, $TACTICS$, $TECHNIQUES$, a AS (SELECT event_id, list_position($ACTIONS$, action) AS i FROM cmds)
SELECT event_id, coalesce((SELECT string_agg(DISTINCT tactic.name, ',' ORDER BY tactic.name) FROM tactic WHERE tactic.i = a.i), '') AS tactics,
 coalesce((SELECT string_agg(DISTINCT technique.name, ',' ORDER BY technique.name) FROM technique WHERE technique.i = a.i), '') AS techniques FROM a""")
def attck_rule_table_join(spark, folder):
    """The same derivation from a rule table instead of the built-in rules."""
    rules = F.broadcast(TAXONOMY.to_df(spark).filter("grp = 'action'"))  # 28 rows
    commands = event_commands(spark, folder).select("event_id", F.array("action").alias("actions"))
    out = lookups.attck_by_join(commands, ["event_id"], "actions", rules)
    return out.select("event_id", csv("tactics").alias("tactics"), csv("techniques").alias("techniques"))


@query("""WITH $DECIDED$ SELECT vec_id, count(*) AS n_prob, sum(CASE WHEN lg[3 + i] >= 0.05::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS n_over_logit,
 sum(CASE WHEN ap[i] >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_over_prob FROM (SELECT *, unnest(range(1, 29)) AS i FROM v) GROUP BY vec_id""")
def score_space_compare(spark, folder):
    """Thresholds against raw logits and against probabilities are not the same."""
    rows = score_vectors(spark, folder)
    limits = {a: 0.05 for a in TAXONOMY.action_ids}
    raw = D.decide(rows, thresholds=limits, score_space="logit").withColumnRenamed("action_mask", "logit_mask").drop("verdict", "verdict_probs", "action_probs")
    both = D.decide(raw)
    return both.select("vec_id", F.size("action_probs").cast("bigint").alias("n_prob"), F.bit_count("logit_mask").cast("bigint").alias("n_over_logit"),
                       F.bit_count("action_mask").cast("bigint").alias("n_over_prob"))


# Documents without a score vector are scored by these rules.
DOC_RULES = [(r"license|notice", "verdict.benign", 2.0), (r"[a-z0-9]@[a-z0-9]", "verdict.suspicious", 1.0), (r"[0-9]{4}", "verdict.malicious", 0.5),
             (r"http", "action.download", 2.0), (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "action.network_scan", 1.0)]


def sql_rule_vector(column: str, rules, base: float = -4.0) -> str:
    """``rule_logits`` in SQL: one item per label, in taxonomy order."""
    items = []
    for label in TAXONOMY.all_ids:
        hits = [f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN {s} ELSE {base} END" for p, l, s in rules if l == label]
        items.append(f"CAST(greatest({', '.join([str(base), *hits])}) AS DOUBLE)")
    return f"[{', '.join(items)}]"


REDTEAM_SQL = SNIPPETS["DECIDED"].replace(" FROM embeddings)", f""" FROM embeddings
   UNION ALL SELECT doc_id, NULL, {sql_rule_vector('text', DOC_RULES)}, list_transform(range(28), lambda x: 0.0::DOUBLE)
   FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id))""") + """,
 n AS (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) AS rn FROM documents),
 rt AS (SELECT n.doc_id, n.lang, n.source, n.text, v.* FROM n JOIN v ON v.vec_id = n.doc_id WHERE rn = 1)"""


def redteam(spark, folder, keep_text=False):
    """Whitespace-deduplicated documents, each with its score vector or that of the rules, annotated.

    Reports need the text only as the dedup key, so it is not carried along.
    """
    docs = scans.spread(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    docs = docs.withColumn("rule_vector", scoring.rule_logits(F.col("text"), DOC_RULES))
    unique = dedup.by_squeezed_text(docs, ["doc_id"], keep=None if keep_text else ["doc_id", "lang", "source", "rule_vector"])
    vectors = score_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "logits", "true_actions")
    scored = unique.join(vectors, "doc_id", "left").withColumns({
        "logits": F.coalesce("logits", "rule_vector"), "true_actions": F.coalesce("true_actions", F.array().cast("array<string>"))})
    return D.annotate(scored.drop("rule_vector"))


@query("WITH " + REDTEAM_SQL + """ SELECT doc_id, sha256(text) AS command_sha256, verdict, verdict <> 'verdict.malicious' AS verdict_bypass,
 CASE WHEN verdict <> 'verdict.malicious' THEN 'verdict_not_malicious' ELSE 'detected_malicious' END AS bypass_type, verdict = 'verdict.benign' AS strict_bypass,
 verdict = 'verdict.suspicious' AS partial_evasion, round(lg[3], 6) AS logit_malicious, len(lg)::BIGINT AS n_logits FROM rt""")
def redteam_annotate(spark, folder):
    out = redteam(spark, folder, keep_text=True)
    return out.select("doc_id", X.sha256(F.col("text")).alias("command_sha256"), "verdict", "verdict_bypass", "bypass_type", "strict_bypass",
                      "partial_evasion", F.col("raw_logits")["verdict.malicious"].alias("logit_malicious"),
                      F.size("raw_logits").cast("bigint").alias("n_logits"))


@query("WITH " + REDTEAM_SQL + """ SELECT lang, count(*) AS n, count(*) FILTER (WHERE verdict <> 'verdict.malicious') AS n_bypass,
 count(*) FILTER (WHERE verdict = 'verdict.benign') AS n_strict, count(*) FILTER (WHERE verdict = 'verdict.suspicious') AS n_partial,
 count(*) FILTER (WHERE verdict = 'verdict.malicious') AS n_detected, sum(len(act))::BIGINT AS n_actions,
 round(count(*) FILTER (WHERE verdict <> 'verdict.malicious') / count(*)::DOUBLE, 6) AS bypass_rate FROM rt GROUP BY lang""")
def redteam_summary(spark, folder):
    """Flagship: normalise, dedup, decide, flag evasions, count per group."""
    out = redteam(spark, folder)
    return (out.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("verdict_bypass").alias("n_bypass"), F.count_if("strict_bypass").alias("n_strict"),
        F.count_if("partial_evasion").alias("n_partial"), F.count_if(~F.col("verdict_bypass")).alias("n_detected"),
        F.sum(F.bit_count("action_mask")).cast("bigint").alias("n_actions"))
        .withColumn("bypass_rate", r6(F.col("n_bypass") / F.col("n"))))


@query("WITH " + REDTEAM_SQL + """, k AS (SELECT verdict, unnest(list_concat([{'d': 'category', 'v': lang}, {'d': 'strategy', 'v': source}],
  list_transform(act, lambda i: {'d': 'action', 'v': ($ACTIONS$)[i]}))) AS kv FROM rt)
SELECT kv.d AS dimension, kv.v AS value, count(*) AS n, count(*) FILTER (WHERE verdict <> 'verdict.malicious') AS n_bypass,
 count(*) FILTER (WHERE verdict = 'verdict.benign') AS n_strict, count(*) FILTER (WHERE verdict = 'verdict.suspicious') AS n_partial FROM k GROUP BY 1, 2""")
def evasion_by_group(spark, folder):
    return metrics.evasion_summary(redteam(spark, folder), {"category": "lang", "strategy": "source"}, actions="actions")


@query("WITH " + REDTEAM_SQL + """ SELECT source, array_to_string(list_sort(list(verdict || '=' || c)), ',') AS verdict_counts FROM
 (SELECT source, verdict, count(*) AS c FROM rt GROUP BY 1, 2) GROUP BY source""")
def verdict_counts_by_file(spark, folder):
    """Nested counts: source -> {verdict: n}."""
    counts = redteam(spark, folder).groupBy("source", "verdict").agg(F.count("*").alias("c"))
    nested = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "c"))).alias("m"))  # three entries at most
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return nested.select("source", csv(F.sort_array(pairs)).alias("verdict_counts"))


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[!-/:-@\\[-`{-~]|[^!-/:-@\\[-`{-~\\s]+')) AS n FROM documents),
s AS (SELECT doc_id, n, CASE WHEN n <= 120 THEN 1 ELSE 1 + CAST(ceil((n - 120) / 90.0) AS BIGINT) END AS k FROM t)
SELECT doc_id, i AS seg, i * 90 AS start, CASE WHEN n <= 120 THEN n ELSE least(120, n - i * 90) END AS seg_tokens FROM (SELECT *, unnest(range(k)) AS i FROM s)""")
def token_windows(spark, folder):
    docs = scans.spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    out = segments.windows(docs.select("doc_id", X.basic_tokens(F.col("text")).alias("tokens")))
    return out.select("doc_id", F.col("seg").cast("bigint").alias("seg"), F.col("start").cast("bigint").alias("start"),
                      F.size("seg_tokens").cast("bigint").alias("seg_tokens"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[!-/:-@\\[-`{-~]|[^!-/:-@\\[-`{-~\\s]+') AS tok FROM documents)
SELECT doc_id, len(tok)::BIGINT AS n_tokens, least(len(tok), 256)::BIGINT AS n_256, md5(array_to_string(tok[1:320], ' ')) AS head_320 FROM t""")
def token_truncate(spark, folder):
    docs = scans.spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.basic_tokens(F.col("text")).alias("tok")).select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"), F.size(segments.truncate(F.col("tok"), 256)).cast("bigint").alias("n_256"),
                       F.md5(F.concat_ws(" ", segments.truncate(F.col("tok"), 320)).cast("binary")).alias("head_320"))


def _merged(how):
    def run(spark, folder):
        parts = score_vectors(spark, folder).select("label", F.col("vec_id").alias("seg"), "logits")
        merged = segments.merge_scores(parts, ["label"], verdict_merge=how)
        out = D.decide(merged)
        return out.select(F.col("label").cast("bigint").alias("label"), F.col("n_segments"), "verdict", r6(F.col("logits")[2]).alias("logit_malicious"),
                          r6(F.array_max(F.slice("logits", 4, 28))).alias("top_action"), F.bit_count("action_mask").cast("bigint").alias("n_actions"))
    return run


MERGE_TAIL = """, m AS (SELECT label, count(*) AS n_segments, {verdict}, {actions} FROM d GROUP BY label)
SELECT label::BIGINT AS label, n_segments, CASE WHEN v1 >= v2 AND v1 >= v3 THEN 'verdict.benign' WHEN v2 >= v3 THEN 'verdict.suspicious' ELSE 'verdict.malicious' END AS verdict,
 round(v3, 6) AS logit_malicious, round(greatest({all}), 6) AS top_action, ({active})::BIGINT AS n_actions FROM m"""


def _merge_sql(verdict: str) -> str:
    actions = ", ".join(f"max(lg[{i}]) AS a{i}" for i in range(4, 32))
    return "WITH $DECIDED$" + MERGE_TAIL.format(verdict=verdict, actions=actions, all=", ".join(f"a{i}" for i in range(4, 32)),
                                                active=" + ".join(f"(a{i} >= 0)::INT" for i in range(4, 32)))


@query(_merge_sql(", ".join(f"arg_max(lg[{i}], (p2, -vec_id)) AS v{i}" for i in (1, 2, 3))))
def segment_merge(spark, folder):
    """Vectors with the same label as the windows of one record."""
    return _merged("most_malicious")(spark, folder)


@query(_merge_sql(", ".join(f"max(lg[{i}]) AS v{i}" for i in (1, 2, 3))))
def segment_merge_max(spark, folder):
    return _merged("max_logit")(spark, folder)


@query("""SELECT doc_id, round(((length(text) * 1) % 17 - 8) / 4.0::DOUBLE, 6) AS first_logit, round(((length(text) * 31) % 17 - 8) / 4.0::DOUBLE, 6) AS last_logit,
 CASE WHEN (length(text) * 1) % 17 >= (length(text) * 2) % 17 AND (length(text) * 1) % 17 >= (length(text) * 3) % 17 THEN 'verdict.benign'
      WHEN (length(text) * 2) % 17 >= (length(text) * 3) % 17 THEN 'verdict.suspicious' ELSE 'verdict.malicious' END AS verdict FROM documents""")
def batch_score(spark, folder):
    """The pluggable scorer on Arrow batches, with a stand-in model."""
    def load():
        import numpy as np
        weights = np.arange(1, 32)

        def score(texts):
            sizes = np.array([len(t) for t in texts], dtype="int64")
            return ((sizes[:, None] * weights[None, :]) % 17 - 8) / 4.0
        return score

    scored = scoring.batch_score(table(spark, folder, "documents").select("doc_id", "text"), load)
    out = D.decide(scored)
    return out.select("doc_id", r6(F.col("logits")[0]).alias("first_logit"), r6(F.col("logits")[30]).alias("last_logit"), "verdict")


# fixed values: a small rule table in the shape the rule scorer takes
RULES = [
    (R.DEFINITE_PAYLOAD, "verdict.malicious", 6.0), (R.SHELL_ESCAPE, "verdict.malicious", 4.0), (R.FETCH, "verdict.suspicious", 2.0),
    (R.FETCH, "action.download", 3.0), (R.RUN, "action.download_execute", 3.0), (r"script", "action.execute_local", 2.0),
    (r"https?://", "verdict.suspicious", 1.0), (r"track\(", "action.system_probe", 1.5),
]


def _rule_case(label: str, base: float = -4.0) -> str:
    hits = [f"CASE WHEN regexp_matches(html, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {s} ELSE {base} END" for p, l, s in RULES if l == label]
    return f"CAST(greatest({', '.join([str(base), *hits])}) AS DOUBLE)"


@query(f"""SELECT page_id, {_rule_case('verdict.malicious')} AS logit_malicious, {_rule_case('verdict.suspicious')} AS logit_suspicious,
 {_rule_case('action.download')} AS logit_download, {_rule_case('action.execute_local')} AS logit_execute, {_rule_case('action.keylog')} AS logit_keylog FROM pages""")
def rule_table_score(spark, folder):
    pages = scans.spread(table(spark, folder, "pages").select("page_id", "html"), "page_id").withColumn("logits", scoring.rule_logits(F.col("html"), RULES))
    at = lambda label: F.col("logits")[TAXONOMY.all_ids.index(label)]
    return pages.select("page_id", at("verdict.malicious").alias("logit_malicious"), at("verdict.suspicious").alias("logit_suspicious"),
                        at("action.download").alias("logit_download"), at("action.execute_local").alias("logit_execute"), at("action.keylog").alias("logit_keylog"))


MASK_SQL = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}''"`;|)]+', 'http://example.com', 'g'),
   '\b(?:\d{1,3}\.){3}\d{1,3}\b', '1.1.1.1', 'g'), '[A-Za-z0-9+/]{40,}={0,2}', 'BASE64', 'g')"""

NGRAM_MIN, NGRAM_MAX, INTERCEPT = 3, 5, -0.25

NGRAM_SQL = f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 0)) AS word FROM conv),
 pad AS (SELECT doc_id, ' ' || word || ' ' AS p, length(word) + 2 AS l FROM w),
 g AS (SELECT doc_id, substring(p, i, n) AS ngram FROM (SELECT *, unnest(range(1, l - n + 2)) AS i FROM (SELECT *, unnest(range({NGRAM_MIN}, least({NGRAM_MAX}, l) + 1)) AS n FROM pad))),
 bench AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 0)) AS word FROM benchmark),
 bpad AS (SELECT ' ' || word || ' ' AS p, length(word) + 2 AS l FROM bench),
 bg AS (SELECT substring(p, i, n) AS ngram FROM (SELECT *, unnest(range(1, l - n + 2)) AS i FROM (SELECT *, unnest(range({NGRAM_MIN}, least({NGRAM_MAX}, l) + 1)) AS n FROM bpad))),
 weights AS (SELECT ngram, (length(ngram) + count(*) % 7 - 5) / 8.0::DOUBLE AS coef_idf, 1 + (count(*) % 5) / 4.0::DOUBLE AS idf FROM bg GROUP BY ngram),
 pg AS (SELECT doc_id, g.ngram, count(*) AS c, any_value(coef_idf) AS cw, any_value(idf) AS idf FROM g JOIN weights USING (ngram) GROUP BY 1, 2),
 s AS (SELECT doc_id, sum(c * cw) AS dot, sum((c * idf) * (c * idf)) AS sq FROM pg GROUP BY doc_id)
SELECT conv.doc_id, round(coalesce(dot / sqrt(sq), 0) + {INTERCEPT}, 6) AS score FROM conv LEFT JOIN s USING (doc_id)"""


def ngram_weights(spark, folder):
    """A weight table that grows with its source: n-grams of the benchmark."""
    texts = table(spark, folder, "benchmark").select(F.lower("text").alias("text"))
    grams = scoring.explode_ngrams(texts, [], "text", NGRAM_MIN, NGRAM_MAX)
    n = F.col("n")
    return (grams.groupBy("ngram").agg(F.count("*").alias("n"))
            .select("ngram", ((F.char_length("ngram") + n % 7 - 5) / F.lit(8.0)).alias("coef_idf"), (1 + (n % 5) / F.lit(4.0)).alias("idf")))


@query(NGRAM_SQL.replace("WITH w", f"WITH conv AS (SELECT conv_id * 1000 + turn AS doc_id, {MASK_SQL} AS text FROM conversations), w"))
def ngram_linear_score(spark, folder):
    """Every conversation turn against the n-gram weight table."""
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    turns = scans.spread(turns, "doc_id")
    out = scoring.ngram_linear_score(turns, ngram_weights(spark, folder), ["doc_id"], n_min=NGRAM_MIN, n_max=NGRAM_MAX, intercept=INTERCEPT)
    return out.select("doc_id", r6("score").alias("score"))


@query("""WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
 m AS (SELECT *, """ + MASK_SQL + """ AS masked FROM t)
SELECT kind, id, md5(masked) AS masked_md5, length(masked)::BIGINT AS n_chars, masked <> text AS changed FROM m""")
def mask_patterns(spark, folder):
    """URLs, addresses and base64 runs masked in whole documents and pages. The SQL
    has no looking around; its plain forms differ only beside non-ASCII letters and
    an odd number of signs, which the tests check by brute force."""
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    masked = scans.spread(docs.unionByName(pages), "id").withColumn("masked", X.mask(F.col("text")))
    return masked.select("kind", "id", F.md5(F.col("masked").cast("binary")).alias("masked_md5"), F.char_length("masked").cast("bigint").alias("n_chars"),
                         (F.col("masked") != F.col("text")).alias("changed"))


def label_targets(spark, folder):
    """Labelled documents -> (doc_id, targets of all labels). Actions are those of
    the score vector; without one they are unknown, so the row is in no action's fit."""
    vectors = score_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "true_actions")
    rows = truth_verdicts(spark, folder).join(vectors, "doc_id", "left")
    is_true = [F.col("verdict") == v for v in TAXONOMY.verdict_ids] + [F.array_contains("true_actions", a) for a in TAXONOMY.action_ids]
    targets = F.create_map(*[x for label, t in zip(TAXONOMY.all_ids, is_true) for x in (F.lit(label), t.cast("double"))])
    return rows.select("doc_id", targets.alias("targets"))


@query()
def fitted_label_scorers(spark, folder):
    """Linear scorers for every label fitted on the labelled documents and
    applied to all documents (an iterative fit has no SQL form)."""
    docs = fit.features(scans.spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")).drop("text")
    docs = materialise(docs, "features")
    labelled = docs.join(label_targets(spark, folder), "doc_id").select("features", "targets")
    return fit.apply_scorers(docs, fit.fit_scorers(labelled, TAXONOMY.all_ids)).drop("features")


SESSION_SQL = """WITH $EVENTS$, s AS (SELECT user_id, day, count(*) AS n_commands, max(CASE verdict WHEN 'verdict.malicious' THEN 2 WHEN 'verdict.suspicious' THEN 1 ELSE 0 END) AS r,
 list_distinct(list(action)) AS acts FROM cmds GROUP BY user_id, day),
c AS (SELECT *, array_to_string(list_filter([
  CASE WHEN (list_contains(acts, 'action.download') AND list_contains(acts, 'action.execute_local')) THEN 'download_execute' END,
  CASE WHEN list_contains(acts, 'action.system_probe') AND list_contains(acts, 'action.account_add') AND list_contains(acts, 'action.exfiltrate') THEN 'recon_priv_exfil' END,
  CASE WHEN list_contains(acts, 'action.schedule_persist') AND list_contains(acts, 'action.clear_logs') THEN 'persist_clearlog' END], lambda x: x IS NOT NULL), ',') AS hit_chains FROM s)
SELECT user_id, day, n_commands, hit_chains, CASE WHEN r = 2 THEN 'verdict.malicious' WHEN hit_chains <> '' THEN 'verdict.suspicious' WHEN r = 1 THEN 'verdict.suspicious' ELSE 'verdict.benign' END AS verdict,
 array_to_string(list_filter($ACTIONS$, lambda a: list_contains(acts, a)), ',') AS all_actions FROM c"""


@query(SESSION_SQL)
def session_rollup(spark, folder):
    """Sessions of one user and day."""
    c = event_commands(spark, folder).withColumn("action_mask", V.mask_of_name("action"))
    out = sessions.roll_up(c, ["user_id", "day"])
    return out.select("user_id", "day", "n_commands", csv("hit_chains").alias("hit_chains"), "verdict", csv("all_actions").alias("all_actions"))


@query("""WITH $EVENTS$, s AS (SELECT user_id, list_distinct(list(action)) AS a FROM cmds GROUP BY user_id),
r(pos, name, needed) AS (VALUES (0, 'download_execute', [['action.download'], ['action.execute_local']]), (1, 'download_execute', [['action.download'], ['action.download_execute']]),
 (2, 'recon_priv_exfil', [['action.system_probe', 'action.network_scan'], ['action.process_inject'], ['action.exfiltrate']]),
 (3, 'recon_priv_exfil', [['action.system_probe'], ['action.account_add'], ['action.exfiltrate']]), (4, 'persist_clearlog', [['action.schedule_persist'], ['action.clear_logs']]),
 (5, 'persist_clearlog', [['action.service_persist'], ['action.clear_logs']]), (6, 'persist_clearlog', [['action.schedule_persist'], ['action.timestomp']]),
 (7, 'c2_persist', [['action.reverse_shell'], ['action.service_persist']]), (8, 'c2_persist', [['action.reverse_shell'], ['action.schedule_persist']]),
 (9, 'c2_persist', [['action.reverse_shell'], ['action.registry_persist']]))
SELECT DISTINCT user_id, name AS chain FROM s, r WHERE len(list_filter(needed, lambda g: len(list_filter(g, lambda x: list_contains(a, x))) > 0)) = len(needed)""")
def chain_rules(spark, folder):
    """Which chains the whole history of a user fulfils."""
    masks = event_commands(spark, folder).groupBy("user_id").agg(F.bit_or(V.mask_of_name("action")).alias("m"))
    return masks.select("user_id", F.explode(sessions.chain_hits("m")).alias("chain"))


TURN_VERDICT_SQL = "CASE WHEN length(text) >= 600 THEN 'verdict.malicious' WHEN length(text) >= 300 THEN 'verdict.suspicious' ELSE 'verdict.benign' END"


def turn_verdicts(spark, folder):
    n = F.char_length("text")
    return table(spark, folder, "conversations").withColumn(
        "verdict", F.when(n >= 600, "verdict.malicious").when(n >= 300, "verdict.suspicious").otherwise("verdict.benign"))


@query(f"SELECT conv_id, turn, {TURN_VERDICT_SQL} AS verdict FROM conversations")
def session_command_verdicts(spark, folder):
    """Ordered verdicts of every session in long form."""
    return sessions.command_verdicts(turn_verdicts(spark, folder), ["conv_id"], "turn")


@query(f"""SELECT conv_id, turn // 10000 AS part, count(*) AS n, string_agg({TURN_VERDICT_SQL}, ',' ORDER BY turn) AS verdicts FROM conversations GROUP BY 1, 2""")
def session_verdict_list(spark, folder):
    """Ordered verdict lists of the sessions, in parts of 10,000 turns."""
    lists = sessions.verdict_sequence(turn_verdicts(spark, folder), ["conv_id"], "turn")
    return lists.select("conv_id", F.col("part").cast("bigint").alias("part"), F.size("per_command_verdicts").cast("bigint").alias("n"),
                        csv("per_command_verdicts").alias("verdicts"))


@query("""WITH b AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), chr(10)) AS ls FROM pages),
l AS (SELECT page_id, i - 1 AS line, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM b WHERE len(ls) > 0))
SELECT page_id, count(*) AS n_lines, sum(length(text))::BIGINT AS chars FROM l WHERE length(text) > 0 AND text NOT LIKE '#%' AND length(text) < 400 GROUP BY page_id""")
def extract_code(spark, folder):
    """Lines inside the article block of a page (one block per page)."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    lines = extract.fenced_commands(pages, ["page_id"], "html", fence=r"(?s)<article>(.*?)</article>").filter("block >= 0")
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("chars"))


@query(r"""WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
m AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN ls[i] ELSE '$ ' || ls[i] END AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
x AS (SELECT doc_id, 'fenced' AS half, regexp_replace(l, '^\s+|\s+$', '', 'g') AS text FROM m WHERE i % 2 = 1),
y AS (SELECT doc_id, 'prompt' AS half, regexp_extract(l, '^\s*\$\s+(.+)$', 1) AS text FROM m),
z AS (SELECT * FROM x WHERE length(text) BETWEEN 1 AND 399 AND NOT starts_with(text, '#')
 UNION ALL SELECT doc_id, half, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM y WHERE length(text) BETWEEN 1 AND 399)
SELECT doc_id, half, count(*) AS n_lines, sum(length(text))::BIGINT AS chars, max(text) AS last_text FROM z GROUP BY 1, 2""")
def extract_markdown(spark, folder):
    """Documents as Markdown: every other line in a fenced block with CR LF, the
    rest behind a prompt; both halves of the extraction."""
    docs = table(spark, folder, "documents").select("doc_id", X.split_lines(F.col("text")).alias("ls"))
    fenced = F.array_join(F.filter("ls", lambda x, i: i % 2 == 0), "\r\n")
    typed = F.array_join(F.transform(F.filter("ls", lambda x, i: i % 2 == 1), lambda x: F.concat(F.lit("$ "), x)), "\n")
    pages = docs.select("doc_id", F.concat(F.lit("```bash\n"), fenced, F.lit("\n```\n"), typed).alias("text"))
    lines = extract.fenced_commands(pages, ["doc_id"])
    half = F.when(F.col("block") >= 0, "fenced").otherwise("prompt")
    return lines.groupBy("doc_id", half.alias("half")).agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("chars"),
                                                           F.max("text").alias("last_text"))


@query("""WITH b AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), chr(10)) AS ls FROM pages),
l AS (SELECT page_id, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM b WHERE len(ls) > 0)),
p AS (SELECT page_id, regexp_replace(regexp_replace(text, '^[\\w@.-]+[\\$#>]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS text FROM l WHERE length(text) > 0 AND text NOT LIKE '#%')
SELECT page_id, count(*) AS n_lines, max(length(text))::BIGINT AS longest FROM p WHERE length(text) BETWEEN 3 AND 500
 AND NOT regexp_matches(text, '(?i)^(victim|listener|target|attacker|windows|linux|macos|server|client)\\s*[:\\-]') GROUP BY page_id""")
def extract_payload_lines(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    lines = extract.fenced_payloads(pages, ["page_id"], "html", fence=r"(?s)<article>(.*?)</article>")
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.max(F.char_length("text")).cast("bigint").alias("longest"))


@query("""WITH $EVENTS$, x AS (SELECT event_id, event_type, k, CASE WHEN k % 2 = 0 THEN [event_type || ' ' || k] ELSE [' ' || event_type || ' ', 'k ' || k] END AS codes FROM cmds)
SELECT event_id, event_type AS kind, i - 1 AS item, trim(codes[i]) AS text FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM x)""")
def flatten_nested_json(spark, folder):
    """``{kind: [{code: text or list}]}`` documents built from the events."""
    c = event_commands(spark, folder)
    kind, k = F.col("event_type"), F.col("k").cast("string")
    single = F.to_json(F.create_map(kind, F.array(F.struct(F.concat(kind, F.lit(" "), k).alias("code")))))
    listed = F.to_json(F.create_map(kind, F.array(F.struct(F.array(F.concat(F.lit(" "), kind, F.lit(" ")), F.concat(F.lit("k "), k)).alias("code")))))
    docs = c.select("event_id", F.when(F.col("k") % 2 == 0, single).otherwise(listed).alias("functions"))
    out = extract.nested_commands(docs, ["event_id"], "functions")
    return out.select("event_id", "kind", F.col("item").cast("bigint").alias("item"), "text")


@query("""WITH $EVENTS$ SELECT event_id, '_reject' AS kind, 0::BIGINT AS item, 'tab as indent' AS text FROM cmds WHERE k % 10 = 9
UNION ALL SELECT event_id, event_type, 0, event_type || ' ' || k FROM cmds WHERE k % 2 = 0
UNION ALL SELECT event_id, event_type, 0, event_type || '''' FROM cmds WHERE k % 2 = 1 AND k % 10 <> 9
UNION ALL SELECT event_id, event_type, 1, 'k: ' || k FROM cmds WHERE k % 2 = 1 AND k % 10 <> 9""")
def yaml_pages_flatten(spark, folder):
    """The same documents written as one YAML stream, read back and flattened; pages that cannot be read are rows of their own."""
    path = scratch_path(spark, "yaml")
    c = event_commands(spark, folder)
    head = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\n"), F.when(F.col("k") % 10 == 9, F.lit("\t")).otherwise(F.lit("")),
                    F.lit("functions: # by kind\n  "), F.col("event_type"), F.lit(":\n    - "))
    single = F.concat(F.lit("code: |\n        "), F.col("event_type"), F.lit(" "), F.col("k").cast("string"))
    listed = F.concat(F.lit("code:\n      - ' "), F.col("event_type"), F.lit("'' '\n      - \"k: "), F.col("k").cast("string"), F.lit("\""))
    c.select(F.concat(head, F.when(F.col("k") % 2 == 0, single).otherwise(listed)).alias("value")).write.option("lineSep", "\n---\n").text(path)
    pages = yaml_pages.yaml_documents(spark, path).withColumn("_y", yaml_pages.yaml_json(F.col("text")))
    pages = pages.select(F.regexp_extract("text", r"^id: (\d+)", 1).cast("bigint").alias("event_id"), "_y.*")
    good = extract.nested_commands(pages.filter("reject IS NULL").withColumn("functions", F.get_json_object("value", "$.functions")), ["event_id"], "functions")
    rejects = pages.filter("reject IS NOT NULL").select("event_id", F.lit("_reject").alias("kind"), F.lit(0).cast("bigint").alias("item"), F.col("reject").alias("text"))
    return good.select("event_id", "kind", F.col("item").cast("bigint").alias("item"), "text").unionByName(rejects)


@query("""WITH $EVENTS$ SELECT event_id, CASE WHEN k % 3 = 0 THEN k / 100.0::DOUBLE ELSE 0 END AS p_malicious, CASE WHEN k % 2 = 0 THEN value ELSE 0 END AS noul_keylog,
 31::BIGINT AS n FROM cmds""")
def teacher_decode(spark, folder):
    """Nested teacher answers to a score vector; what is missing counts as 0."""
    c = event_commands(spark, folder)
    probs = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("verdict.malicious"), F.col("k") / F.lit(100.0)))
    verdict = F.to_json(F.struct(probs.alias("probabilities")))
    keylog = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("value").alias("noul")))).otherwise(F.lit("{}"))
    text = F.concat(F.lit('{"__verdict__":'), verdict, F.lit(',"action.keylog":'), keylog, F.lit("}"))
    answers = c.select("event_id", F.from_json(text, schemas.ANSWERS).alias("answers"))
    soft = answers.select("event_id", V.soft_of_answers("answers").alias("soft"))
    at = lambda label: F.col("soft")[TAXONOMY.all_ids.index(label)]
    return soft.select("event_id", at("verdict.malicious").alias("p_malicious"), at("action.keylog").alias("noul_keylog"), F.size("soft").cast("bigint").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_recovery(spark, folder):
    """The object inside fenced, chatty or broken answers."""
    e = table(spark, folder, "events")
    m = F.col("event_id") % 4
    answer = (F.when(m == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
              .when(m == 1, F.concat(F.lit("Sure, here: "), F.col("props"), F.lit(" done.")))
              .when(m == 2, F.col("props")).otherwise(F.concat(F.lit("no object "), F.col("event_type"))))
    return e.select("event_id", X.lenient_json(answer, "k BIGINT")["k"].alias("k"))


EVENT_RULES = [(r"purchase", "verdict.malicious", 5.0), (r"error", "verdict.suspicious", 4.0), (r"view|click", "verdict.benign", 3.0),
               (r"purchase", "action.exfiltrate", 2.0), (r"click", "action.download", 2.0), (r"\"k\": 9", "action.system_probe", 2.0)]


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'verdict.malicious' WHEN 'error' THEN 'verdict.suspicious' ELSE 'verdict.benign' END AS verdict,
 array_to_string(list_filter([CASE WHEN event_type = 'click' THEN 'action.download' END, CASE WHEN event_type = 'purchase' THEN 'action.exfiltrate' END,
  CASE WHEN props LIKE '%"k": 9%' THEN 'action.system_probe' END], lambda x: x IS NOT NULL), ',') AS actions FROM events""")
def stream_score(spark, folder):
    """Events as a file stream, scored statelessly, committed, read back."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    lines = events.select("event_id", F.concat("event_type", F.lit(" "), "props", F.lit("\r\n")).alias("value"))
    decided = stream.score_lines(lines, rules=EVENT_RULES).select("event_id", "verdict", "actions")
    out = scratch_path(spark, "stream-out")
    stream.run_available(decided, out, scratch_path(spark, "stream-check")).awaitTermination()
    return spark.read.schema("event_id BIGINT, verdict STRING, actions ARRAY<STRING>").parquet(out).select("event_id", "verdict", csv("actions").alias("actions"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, folder):
    """Events as a growing file stream with repeats and late rows; each event once.

    Three runs from one checkpoint: the events, every third of them again, and old
    copies under new ids, which come after the watermark and are left out.
    """
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    late = events.filter(F.col("event_id") % 5 == 0).withColumns({"event_id": F.col("event_id") + 10**12, "ts": F.col("ts") - F.expr("INTERVAL 400 DAYS")})
    parts = [events, events.filter(F.col("event_id") % 3 == 0), late]
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    out = run_in_parts(spark, parts, lambda s: stateful.distinct_within(s, text, "ts", "60 days").drop("ts"))
    return out.select("event_id", "user_id", "event_type")


def run_in_parts(spark, parts, build):
    """Append each part to a stream's folder and run ``build`` of the stream over it, each run going on from the one before."""
    source, out, check = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    for part in parts:
        part.write.mode("append").parquet(source)
        result = build(spark.readStream.schema(parts[0].schema).parquet(source))
        stateful.run_appended(result, out, check).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query(SESSION_SQL)
def stream_sessions(spark, folder):
    """The sessions of ``session_rollup`` from a file stream in three runs: even events, odd events, and one far row that closes all days."""
    c = event_commands(spark, folder).select("user_id", "ts", "verdict", V.mask_of_name("action").alias("action_mask"), "event_id")
    far = c.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(
        F.lit(None).cast("bigint").alias("user_id"), "ts", F.lit(BENIGN).alias("verdict"), F.lit(0).cast("bigint").alias("action_mask"),
        F.lit(None).cast("bigint").alias("event_id"))
    parts = [c.filter(F.col("event_id") % 2 == 0), c.filter(F.col("event_id") % 2 == 1), far]
    out = run_in_parts(spark, parts, lambda s: stateful.fold_sessions(s, ["user_id"], "ts", "60 days", length="1 day"))
    return out.select("user_id", F.to_date("start").alias("day"), "n_commands", csv("hit_chains").alias("hit_chains"), "verdict",
                      csv("all_actions").alias("all_actions"))


def _length_and_capitals():
    """Stand-in model: what a text looks like when it arrives."""
    def score(texts):
        return [[len(t), sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), *[0.0] * (TAXONOMY.size - 2)] for t in texts]
    return score


_CHUNK = f"(?:[{X.PUNCT}]|[^{X.PUNCT} {X.UNICODE_WS}]+)[ {X.UNICODE_WS}]*"


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_CHUNK}') AS c FROM documents),
 w AS (SELECT *, unnest(CASE WHEN len(c) <= 120 THEN [0] ELSE range(0, CAST(ceil((len(c) - 120) / 90.0) AS BIGINT) * 90 + 1, 90) END) AS s FROM t),
 p AS (SELECT doc_id, CASE WHEN len(c) <= 120 THEN text ELSE array_to_string(c[s + 1:s + 120], '') END AS piece FROM w)
SELECT doc_id, count(*) AS n_segments, max(length(piece))::DOUBLE AS longest, max(length(regexp_replace(piece, '[^A-Z]', '', 'g')))::DOUBLE AS capitals
FROM p GROUP BY doc_id""")
def score_records_text(spark, folder):
    """The text that reaches the scorer: whole up to the limit, windows of its own characters beyond."""
    docs = scans.spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    out = jobs.score_records(docs, ["doc_id"], "text", _length_and_capitals, verdict_merge="max_logit")
    return out.select("doc_id", "n_segments", F.col("logits")[0].alias("longest"), F.col("logits")[1].alias("capitals"))
