"""Evaluation queries: set metrics, confusion, rates, curves, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellsieve.functions import decide as D
from shellsieve.functions import vectors as V
from shellsieve.operators import curves, filters, lookups, metrics, thresholds
from shellsieve.plans.catalogue import query, r6, score_vectors, table, truth_verdicts
from shellsieve.session import materialise
from shellsieve.sources import scans
from shellsieve.taxonomy import TAXONOMY


def evaluated(spark, folder):
    """Score vectors with decision and true actions."""
    decided = D.with_attck(D.decide(score_vectors(spark, folder)))
    return decided.withColumn("true_mask", V.mask_of_names("true_actions"))


def judged(spark, folder):
    """Labelled documents that also have a score vector: truth and decision."""
    truth = truth_verdicts(spark, folder).withColumnRenamed("verdict", "truth")
    scored = evaluated(spark, folder).withColumnRenamed("vec_id", "doc_id")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(truth, "doc_id").join(scored, "doc_id")


JUDGED = """$TRUTH$, $DECIDED$, j AS (SELECT documents.doc_id, lang, source, n_chars, text, toxic, quality, truth.verdict AS truth, v.verdict, v.p2, v.act, v.tact, v.lg
 FROM documents JOIN truth USING (doc_id) JOIN v ON v.vec_id = documents.doc_id)"""

PRF = """round(tp / greatest(1, tp + fp)::DOUBLE, 6) AS precision, round(tp / greatest(1, tp + fn)::DOUBLE, 6) AS recall,
 round(2 * (tp / greatest(1, tp + fp)::DOUBLE) * (tp / greatest(1, tp + fn)::DOUBLE) / greatest(1e-9, tp / greatest(1, tp + fp)::DOUBLE + tp / greatest(1, tp + fn)::DOUBLE), 6) AS f1"""


def rounded(df):
    """Every double column at six digits."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


@query("WITH $DECIDED$, s AS (SELECT len(list_intersect(act, tact)) AS tp, len(act) - len(list_intersect(act, tact)) AS fp, len(tact) - len(list_intersect(act, tact)) AS fn FROM v), "
       "t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s) SELECT tp, fp, fn, " + PRF + " FROM t")
def micro_prf(spark, folder):
    return rounded(metrics.micro(evaluated(spark, folder)))


@query("WITH $DECIDED$, s AS (SELECT label, len(list_intersect(act, tact)) AS tp, len(act) - len(list_intersect(act, tact)) AS fp, len(tact) - len(list_intersect(act, tact)) AS fn FROM v), "
       "t AS (SELECT label::BIGINT AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY label) SELECT label, tp, fp, fn, " + PRF + " FROM t")
def micro_prf_by_group(spark, folder):
    """The set form (array intersect/except) grouped by a column."""
    rows = evaluated(spark, folder)
    counted = rows.withColumns(metrics.set_counts(F.col("true_actions"), F.col("actions"))).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return rounded(metrics.with_prf(counted))


LABEL_COUNTS = """$DECIDED$, a AS (SELECT i, unnest($ACTIONS$) AS label FROM (SELECT 1 AS i)), n AS (SELECT label, row_number() OVER () AS i FROM (SELECT unnest($ACTIONS$) AS label)),
 t AS (SELECT n.i + 2 AS pos, n.label, count(*) FILTER (WHERE list_contains(act, n.i) AND list_contains(tact, n.i)) AS tp,
  count(*) FILTER (WHERE list_contains(act, n.i) AND NOT list_contains(tact, n.i)) AS fp, count(*) FILTER (WHERE NOT list_contains(act, n.i) AND list_contains(tact, n.i)) AS fn
  FROM n CROSS JOIN v GROUP BY n.i, n.label)"""


@query("WITH " + LABEL_COUNTS + " SELECT pos, label, tp, fp, fn, tp + fn AS support, " + PRF + " FROM t")
def per_label_prf(spark, folder):
    return rounded(metrics.per_label(evaluated(spark, folder), "true_actions", "actions"))


@query("WITH " + LABEL_COUNTS + ", m AS (SELECT " + PRF.replace("round(", "(").replace(", 6)", ")") + """ FROM t)
SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, count(*) AS n_labels FROM m""")
def macro_f1(spark, folder):
    return rounded(metrics.macro_f1(metrics.per_label(evaluated(spark, folder), "true_actions", "actions")))


@query("WITH $DECIDED$, x AS (SELECT unnest(range(1, 29)) AS i, ap, tv FROM d), t AS (SELECT count(*) FILTER (WHERE ap[i] > 0.5 AND tv[i] > 0.1) AS tp, "
       "count(*) FILTER (WHERE ap[i] > 0.5 AND NOT tv[i] > 0.1) AS fp, count(*) FILTER (WHERE NOT ap[i] > 0.5 AND tv[i] > 0.1) AS fn FROM x) SELECT tp, fp, fn, " + PRF + " FROM t")
def flat_micro(spark, folder):
    """Element-wise micro metrics over the flattened vectors."""
    rows = evaluated(spark, folder).withColumn("targets", F.expr(V.array([f"cast(array_contains(true_actions, {V.lit(a)}) AS double)" for a in TAXONOMY.action_ids])))
    return rounded(metrics.flat_micro(rows, "action_probs", "targets", size=28))


@query("WITH " + JUDGED + " SELECT count(*) AS n, count(*) FILTER (WHERE truth = verdict) AS n_right, round(count(*) FILTER (WHERE truth = verdict) / count(*)::DOUBLE, 6) AS verdict_acc FROM j")
def verdict_accuracy(spark, folder):
    return rounded(metrics.verdict_accuracy(judged(spark, folder), "truth", "verdict"))


@query("WITH " + JUDGED + """ SELECT truth, count(*) FILTER (WHERE verdict = 'verdict.benign') AS pred_benign, count(*) FILTER (WHERE verdict = 'verdict.suspicious') AS pred_suspicious,
 count(*) FILTER (WHERE verdict = 'verdict.malicious') AS pred_malicious, count(*) AS n FROM j GROUP BY truth""")
def confusion_matrix(spark, folder):
    return metrics.confusion(judged(spark, folder), "truth", "verdict")


@query("WITH " + JUDGED + """, c AS (SELECT count(*) FILTER (WHERE truth = 'verdict.malicious') AS mt, count(*) FILTER (WHERE truth = 'verdict.malicious' AND verdict = 'verdict.malicious') AS ms,
 count(*) FILTER (WHERE truth = 'verdict.malicious' AND verdict <> 'verdict.benign') AS ml, count(*) FILTER (WHERE truth = 'verdict.suspicious') AS st,
 count(*) FILTER (WHERE truth = 'verdict.suspicious' AND verdict <> 'verdict.benign') AS sh FROM j)
SELECT mt AS malicious_total, ms AS malicious_strict, ml AS malicious_loose, st AS suspicious_total, sh AS suspicious_hit, round(ms / greatest(1, mt)::DOUBLE, 6) AS strict_recall,
 round(ml / greatest(1, mt)::DOUBLE, 6) AS loose_recall, CASE WHEN st > 0 THEN round(sh / st::DOUBLE, 6) END AS suspicious_recall FROM c""")
def strict_loose_recall(spark, folder):
    return rounded(metrics.recalls(judged(spark, folder), "truth", "verdict"))


RATES = ["precision", "recall", "f1", "accuracy", "fpr"]


def nan_apart(df):
    """NaN as (null, flag): plain SQL engines print NaN differently."""
    return df.withColumns({**{f"{c}_nan": F.isnan(c) for c in RATES}, **{c: F.when(~F.isnan(c), r6(c)) for c in RATES}})


@query("WITH " + JUDGED + """, y AS (SELECT source, toxic = 1 AS y, verdict = 'verdict.malicious' AS p FROM j),
 c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn,
  count(*) FILTER (WHERE NOT p AND NOT y) AS tn, count(*) FILTER (WHERE y) AS positive, count(*) FILTER (WHERE NOT y) AS negative FROM y GROUP BY source),
 r AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS pr, tp / nullif(tp + fn, 0)::DOUBLE AS rc FROM c)
SELECT source, n, tp, fp, fn, tn, positive, negative, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / nullif(pr + rc, 0), 6) AS f1,
 round((tp + tn) / nullif(n, 0)::DOUBLE, 6) AS accuracy, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr,
 pr IS NULL AS precision_nan, rc IS NULL AS recall_nan, (2 * pr * rc / nullif(pr + rc, 0)) IS NULL AS f1_nan, n = 0 AS accuracy_nan, fp + tn = 0 AS fpr_nan FROM r""")
def binary_metrics_nan(spark, folder):
    """Strict alerts per source; small sources have empty denominators."""
    rows = judged(spark, folder).select("source", "toxic", D.strict_alert(F.col("verdict")).alias("alert"))
    return nan_apart(metrics.binary(rows, "toxic", "alert", ["source"]))


@query("WITH " + JUDGED + """, a AS (SELECT 'strict' AS rule, toxic, (verdict = 'verdict.malicious') AS p FROM j UNION ALL SELECT 'loose', toxic, verdict <> 'verdict.benign' FROM j
 UNION ALL SELECT 'score_0.34', toxic, p2 >= 0.34::DOUBLE FROM j)
SELECT rule, count(*) AS n, count(*) FILTER (WHERE p AND toxic = 1) AS tp, count(*) FILTER (WHERE p AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT p AND toxic = 1) AS fn,
 count(*) FILTER (WHERE NOT p AND toxic = 0) AS tn FROM a GROUP BY rule""")
def alert_rules(spark, folder):
    """Strict, loose and score-threshold alerts in one pass."""
    rows = judged(spark, folder)
    alerts = F.map_from_arrays(F.array(F.lit("strict"), F.lit("loose"), F.lit("score_0.34")),
                               F.array(D.strict_alert(F.col("verdict")), D.loose_alert(F.col("verdict")), D.score_alert(F.col("verdict_probs")[2], 0.34)))
    long = rows.select("toxic", F.explode(alerts).alias("rule", "alert"))
    return metrics.binary(long, "toxic", "alert", ["rule"]).select("rule", "n", "tp", "fp", "fn", "tn")


@query("WITH " + JUDGED + """, g AS (SELECT source, CASE truth WHEN 'verdict.malicious' THEN 'malicious' WHEN 'verdict.benign' THEN 'benign' ELSE 'attack_session' END AS label, verdict, act FROM j),
 c AS (SELECT source, label, count(*)::DOUBLE AS n, count(*) FILTER (WHERE verdict = 'verdict.benign') AS b, count(*) FILTER (WHERE verdict = 'verdict.suspicious') AS s,
  count(*) FILTER (WHERE verdict = 'verdict.malicious') AS m, avg(len(act)) AS mean_actions, avg(CASE WHEN len(act) > 0 THEN 1 ELSE 0 END) AS hit FROM g GROUP BY 1, 2)
SELECT source, label, n::BIGINT AS n, b AS n_benign, s AS n_suspicious, m AS n_malicious, round(mean_actions, 6) AS mean_actions_active, round(hit, 6) AS attck_rule_hit_rate,
 round(b / n, 6) AS share_benign, round(s / n, 6) AS share_suspicious, round(m / n, 6) AS share_malicious,
 CASE WHEN label = 'malicious' THEN round(m / n, 6) END AS malicious_recall, CASE WHEN label = 'malicious' THEN round((m + s) / n, 6) END AS nonbenign_recall,
 CASE WHEN label = 'benign' THEN round(b / n, 6) END AS benign_accuracy, CASE WHEN label = 'benign' THEN round(m / n, 6) END AS malicious_fpr,
 CASE WHEN label = 'benign' THEN round(s / n, 6) END AS suspicious_rate FROM c""")
def source_report(spark, folder):
    label = (F.when(F.col("truth") == "verdict.malicious", "malicious").when(F.col("truth") == "verdict.benign", "benign").otherwise("attack_session"))
    rows = judged(spark, folder).drop("label").withColumn("label", label)
    return rounded(metrics.source_report(rows))


@query("""SELECT CASE WHEN regexp_matches(html, '(?i)attacker\\.com|/dev/tcp|/dev/udp|nc\\s+-e|busybox\\s+nc|exec\\s+bash\\s+-i|>&\\s*/dev/tcp|curl\\s+.*attacker|wget\\s+.*attacker') THEN 'definite_payload'
 WHEN regexp_matches(html, '(?i)curl|wget') AND regexp_matches(html, '(?i)\\|\\s*(sh|bash)|;\\s*(sh|bash)|-o\\s+/tmp|--output') THEN 'definite_payload'
 WHEN regexp_matches(html, '(?i)system\\(|exec\\s+/bin/sh|/bin/sh\\s*</dev|/bin/sh\\s*1>&|!sh\\b|!/bin/sh|-e\\s*[''"]system|rsh-command') THEN 'shell_escape' ELSE 'dual_use' END AS category,
 count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def categorize_rules(spark, folder):
    pages = scans.spread(table(spark, folder, "pages").select("page_id", "html"), "page_id").withColumn("category", filters.rule_category(F.col("html")))
    return pages.groupBy("category").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("WITH " + JUDGED + """ SELECT CASE WHEN n_chars >= 3000 THEN 'long' WHEN n_chars >= 1000 THEN 'middle' ELSE 'short' END AS category, count(*) AS n,
 round(avg(CASE WHEN verdict = 'verdict.malicious' THEN 1 ELSE 0 END), 6) AS malicious_recall, round(avg(CASE WHEN verdict <> 'verdict.benign' THEN 1 ELSE 0 END), 6) AS nonbenign_recall,
 round(avg(p2), 6) AS mean_p_malicious FROM j GROUP BY 1""")
def category_stats(spark, folder):
    size = F.when(F.col("n_chars") >= 3000, "long").when(F.col("n_chars") >= 1000, "middle").otherwise("short")
    rows = judged(spark, folder).withColumn("category", size)
    return rounded(metrics.category_stats(rows, "category", "verdict", F.col("verdict_probs")[2]))


CURVE = """y AS (SELECT n_chars::DOUBLE AS score, toxic = 1 AS y FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM y GROUP BY score),
 c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s)"""


def scored_truth(spark, folder):
    """labels with a score: the length of the document."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")


@query("WITH " + CURVE + " SELECT any_value(np)::BIGINT AS n_pos, any_value(nn)::BIGINT AS n_neg, round(sum(pos * (below + 0.5 * neg)) / (any_value(np)::DOUBLE * any_value(nn)), 6) AS roc_auc FROM c")
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(scored_truth(spark, folder), "toxic", "n_chars"))


@query("WITH " + CURVE + " SELECT any_value(np)::BIGINT AS n_pos, any_value(nn)::BIGINT AS n_neg, round(sum(pos * tp / (tp + fp)::DOUBLE) / any_value(np), 6) AS pr_auc FROM c")
def pr_auc(spark, folder):
    return rounded(curves.pr_auc(scored_truth(spark, folder), "toxic", "n_chars"))


@query("WITH " + CURVE + " SELECT score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c")
def curve_points(spark, folder):
    """Cumulated true and false positives at every distinct score."""
    rows = scored_truth(spark, folder)
    points = curves.running_counts(curves.ranged_counts(rows, "toxic", "n_chars"))
    return points.select("score", "pos", "neg", "tp", "fp")


GRID_SQL = "[" + ", ".join(f"{t}::DOUBLE" for t in thresholds.GRID) + "]"

SWEEP_SQL = f"""$DECIDED$, n AS (SELECT label, row_number() OVER () AS i FROM (SELECT unnest($ACTIONS$) AS label)), g AS (SELECT unnest({GRID_SQL}) AS threshold),
 sw AS (SELECT n.i - 1 AS pos, n.label AS action, threshold, count(*) FILTER (WHERE ap[n.i] >= threshold AND tv[n.i] > 0.1) AS tp, count(*) FILTER (WHERE ap[n.i] >= threshold) AS predicted,
  count(*) FILTER (WHERE tv[n.i] > 0.1) AS support FROM v CROSS JOIN n CROSS JOIN g GROUP BY 1, 2, 3)"""


@query("WITH " + SWEEP_SQL + " SELECT pos::BIGINT AS pos, action, threshold, tp, predicted, support FROM sw")
def threshold_table(spark, folder):
    return rounded(thresholds.sweep(evaluated(spark, folder), "action_probs", "true_actions")).select(
        "pos", "action", "threshold", "tp", "predicted", "support")


def _ascent_sql(passes: int = 2) -> str:
    """One step per (pass, action); each keeps the running totals and its pick."""
    def f1(tp, guesses):
        p, r = f"({tp}) / greatest(1, {guesses})::DOUBLE", f"({tp}) / greatest(1, sup)::DOUBLE"
        return f"2 * ({p}) * ({r}) / greatest(1e-9, {p} + {r})"
    steps = ["""s0 AS MATERIALIZED (SELECT sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted,
  (SELECT sum(support)::BIGINT FROM sw WHERE threshold = 0.5) AS sup, NULL::DOUBLE AS threshold FROM sw WHERE threshold = 0.5)"""]
    n = 0
    for p in range(passes):
        for a in range(28):
            n += 1
            now = "0.5" if p == 0 else f"(SELECT threshold FROM s{n - 28})"
            steps.append(f"""s{n} AS MATERIALIZED (
 SELECT tp, predicted, sup, threshold FROM (
  SELECT rest_tp + c.tp AS tp, rest_pr + c.predicted AS predicted, sup, c.threshold,
   row_number() OVER (ORDER BY {f1('rest_tp + c.tp', 'rest_pr + c.predicted')} DESC, CASE WHEN c.threshold = now THEN 0 ELSE 1 END, c.threshold) AS rn
  FROM (SELECT s.tp - o.tp AS rest_tp, s.predicted - o.predicted AS rest_pr, s.sup, o.threshold AS now FROM s{n - 1} s, sw o WHERE o.pos = {a} AND o.threshold = {now}) b, sw c WHERE c.pos = {a})
 WHERE rn = 1)""")
    last = " UNION ALL ".join(f"SELECT {a}::BIGINT AS pos, threshold FROM s{28 * (passes - 1) + a + 1}" for a in range(28))
    return ", ".join(steps) + f""" SELECT x.pos, ($ACTIONS$)[x.pos + 1] AS action, x.threshold,
 (SELECT round({f1('tp', 'predicted')}, 6) FROM s{n}) AS micro_f1 FROM ({last}) x"""


@query("WITH " + SWEEP_SQL.replace("sw AS (", "sw AS MATERIALIZED (") + ", " + _ascent_sql())
def threshold_tune(spark, folder):
    """Greedy per-action thresholds from the sweep table."""
    table_ = thresholds.sweep(evaluated(spark, folder), "action_probs", "true_actions")
    return rounded(thresholds.tune(table_))


@query("""WITH $EVENTS$, g AS (SELECT action, max(value) / 100 AS threshold FROM cmds GROUP BY action), n AS (SELECT label, row_number() OVER () AS i FROM (SELECT unnest($ACTIONS$) AS label))
SELECT n.i + 2 AS pos, n.label AS action, round(coalesce(g.threshold, 0.5), 6) AS threshold FROM n LEFT JOIN g ON g.action = n.label""")
def threshold_defaults(spark, folder):
    """Given thresholds (here per action of the events) completed by the default."""
    from shellsieve.plans.catalogue import event_commands
    given = event_commands(spark, folder).groupBy("action").agg((F.max("value") / 100).cast("string").alias("threshold"))
    return rounded(thresholds.with_defaults(given))


@query("WITH " + JUDGED + " SELECT truth, count(*) AS n, count(*) FILTER (WHERE truth = 'verdict.malicious' AND verdict <> 'verdict.malicious') AS n_hard, "
       "count(*) FILTER (WHERE truth <> verdict) AS n_disagree, count(*) FILTER (WHERE truth = 'verdict.malicious' AND quality = 0) AS n_double FROM j GROUP BY truth")
def redteam_selections(spark, folder):
    """Hard negatives, disagreements and doubly confirmed rows per truth."""
    rows = judged(spark, folder).withColumns({"gt": filters.bare(F.col("truth")), "arb_verdict": F.when(F.col("quality") == 0, "malicious").otherwise("benign")})
    # the selections are tagged and counted in one aggregation of the decided table
    rows = materialise(rows.select("doc_id", "truth", "gt", "verdict", "arb_verdict"), "judged")
    parts = {"n": rows, "n_hard": filters.hard_negatives(rows), "n_disagree": filters.disagreements(rows), "n_double": filters.double_confirmed(rows)}
    tagged = None
    for name, part in parts.items():
        own = part.select("truth", F.lit(name).alias("_part"))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy("truth").agg(*[F.count_if(F.col("_part") == name).alias(name) for name in parts])


@query("WITH " + JUDGED + """ SELECT doc_id, verdict, round(p2, 6) AS p_malicious, source FROM j WHERE truth = 'verdict.malicious' AND verdict <> 'verdict.malicious'""")
def hard_negative_rows(spark, folder):
    rows = judged(spark, folder).withColumns({"gt": filters.bare(F.col("truth")), "p_malicious": r6(F.col("verdict_probs")[2])})
    return filters.hard_negatives(materialise(rows.select("doc_id", "gt", "verdict", "p_malicious", "source"), "judged")).drop("gt")


@query("WITH " + JUDGED + """, o AS (SELECT text, max_by(CASE WHEN n_chars >= 1500 THEN 'malicious' ELSE 'benign' END, doc_id) AS opinion FROM documents WHERE lang = 'en' GROUP BY text)
SELECT replace(truth, 'verdict.', '') AS gt, replace(verdict, 'verdict.', '') AS teacher, coalesce(opinion, 'unknown') AS arbiter, count(*) AS n FROM j LEFT JOIN o USING (text)
WHERE truth <> verdict GROUP BY 1, 2, 3""")
def arbiter_agreement(spark, folder):
    """How an arbiter table decides the disagreements; texts it lacks are unknown."""
    rows = judged(spark, folder).withColumn("gt", filters.bare(F.col("truth"))).select("doc_id", "text", "gt", "verdict")
    rows = materialise(rows, "judged")
    docs = table(spark, folder, "documents").filter("lang = 'en'")
    opinions = lookups.last_per_key(docs.select("text", "doc_id", F.when(F.col("n_chars") >= 1500, "malicious").otherwise("benign").alias("arb_verdict")), "text", ["doc_id"])
    return lookups.arbiter_counts(filters.disagreements(rows), opinions)


@query("""WITH $TRUTH$, $DECIDED$, a AS (SELECT sha256(text) AS h, max_by(v.verdict, doc_id) AS mv FROM documents JOIN v ON v.vec_id = documents.doc_id GROUP BY 1)
SELECT replace(truth.verdict, 'verdict.', '') AS gt, replace(mv, 'verdict.', '') AS model, count(*) AS n FROM documents JOIN truth USING (doc_id) JOIN a ON a.h = sha256(documents.text) GROUP BY 1, 2""")
def truth_vs_model(spark, folder):
    """Truth joined to the model verdict of the same text by sha256."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    truth = docs.join(truth_verdicts(spark, folder), "doc_id").select("doc_id", F.col("text").alias("command"), filters.bare(F.col("verdict")).alias("gt"))
    scored = D.decide(score_vectors(spark, folder)).select(F.col("vec_id").alias("doc_id"), F.col("verdict").alias("model_verdict"))
    annotated = docs.join(scored, "doc_id").select(F.sha2("text", 256).alias("_command_sha256"), "model_verdict", F.col("doc_id").alias("_order"))
    joined = lookups.truth_with_verdict(truth, annotated)
    return joined.groupBy("gt", filters.bare(F.col("model_verdict")).alias("model")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT text, max_by(lang, doc_id) AS lang FROM documents GROUP BY text), d AS (SELECT doc_id, text, source FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE b.lang = 'en') AS n_en, count(*) FILTER (WHERE b.text IS NULL) AS n_missing FROM d LEFT JOIN (SELECT * FROM b WHERE lang <> 'de') b USING (text) GROUP BY source""")
def teacher_lookup(spark, folder):
    """Many-to-one lookup by text; what has no entry is counted."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    answers = lookups.last_per_key(docs.select("text", "lang", "doc_id"), "text", ["doc_id"]).filter("lang <> 'de'")
    out = lookups.lookup(docs.select("doc_id", "text", "source"), answers.withColumnRenamed("doc_id", "_o"), "text", ["_o"])
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(~F.col("found")).alias("n_missing"))


@query("""WITH $TRUTH$, $DECIDED$, n AS (SELECT label, row_number() OVER () AS i FROM (SELECT unnest($IDS$) AS label)),
 r AS (SELECT truth.doc_id, truth.verdict, list_concat([truth.verdict], list_transform(coalesce(v.tact, []), lambda i: ($ACTIONS$)[i])) AS labs, v.lg FROM truth LEFT JOIN v ON v.vec_id = truth.doc_id),
 x AS (SELECT n.label, CASE WHEN lg IS NULL THEN CASE WHEN list_contains(labs, n.label) THEN 1.0 ELSE 0.0 END ELSE lg[n.i] END::DOUBLE AS target, lg IS NOT NULL AS soft FROM r CROSS JOIN n)
SELECT label, count(*) AS n, count(*) FILTER (WHERE soft) AS n_soft, round(sum(target), 6) AS target_sum, round(sum(CASE WHEN label = 'verdict.malicious' AND target > 0.5 THEN 1.3 ELSE 1.0 END), 6) AS weight_sum FROM x GROUP BY label""")
def soft_targets_and_weights(spark, folder):
    """Training targets per label: soft where a vector exists, else hard, and
    the loss weight of malicious positives."""
    vectors = score_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "logits", "true_actions")
    rows = truth_verdicts(spark, folder).join(vectors, "doc_id", "left").withColumn(
        "true_labels", F.concat(F.array("verdict"), F.coalesce("true_actions", F.array().cast("array<string>"))))
    long = rows.select(F.col("logits").isNotNull().alias("soft"), F.explode(V.soft_targets("logits", "true_labels")).alias("label", "target"))
    out = long.groupBy("label").agg(F.count("*").alias("n"), F.count_if("soft").alias("n_soft"), F.sum("target").alias("target_sum"),
                                    F.sum(D.malicious_weight(F.col("label"), F.col("target"))).alias("weight_sum"))
    return rounded(out)
