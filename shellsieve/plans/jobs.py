"""End-to-end jobs over folders: what a user runs instead of the scripts.

A scorer is given as ``load`` (see ``operators.scoring.batch_score``): it is
called once per task and returns ``texts -> vectors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.functions import decide as D
from shellsieve.functions import text as X
from shellsieve.functions import vectors as V
from shellsieve.operators import (audit, curves, dedup, filters, lookups, metrics, ranking, scoring, segments, sessions, splits,
                                  thresholds)
from shellsieve.session import materialise
from shellsieve.sources import scans, schemas, sinks
from shellsieve.taxonomy import TAXONOMY


def build_splits(spark: SparkSession, corpus: str, out: str, min_test: int = 20, seed: int = 42) -> DataFrame:
    """Labelled JSONL folder -> validated, deduplicated, stratified splits on disk.

    Of rows with the same text the first line of the first file stays.
    """
    rows = filters.valid_rows(scans.numbered_jsonl(spark, corpus))
    unique = dedup.by_exact_text(rows, ["_source_file", "_source_line"])
    ready = filters.to_split_rows(unique).withColumn("_hash", ranking.hash_order(F.col("text"), seed))
    kept = materialise(ready.select("text", "verdict", "actions", "true_labels", "soft_v2", "_hash"), "corpus")
    assigned = materialise(splits.stratified(kept, seed=seed, hashed="_hash"), "assigned")
    final = splits.claim_floor(assigned, min_test=min_test, seed=seed, hashed="_hash")
    sinks.write_splits(final.select("text", "true_labels", "soft_v2", "split"), out)
    return metrics.split_sizes(read_splits(spark, out))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.SPLIT}, split STRING").json(f"{path}/rows")


def score_records(df: DataFrame, key: list[str], text: str, load: Callable[[], Callable], limit: int = segments.BATCH_LIMIT,
                  verdict_merge: str = "most_malicious", chunks: Callable[[Column], Column] = X.token_chunks) -> DataFrame:
    """Records -> ``key, n_segments, logits``: windows, batches, merge.

    ``chunks`` cuts a text into an array of parts, one per token, that join to the
    text again; give the model's own tokens where they differ. A text of at most
    ``limit`` tokens reaches the scorer as it is, a longer one in windows of its
    own characters. Null texts are scored as empty.
    """
    parts = df.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_whole"), chunks(F.col(text)).alias("tokens"))
    fits = F.size("tokens") <= limit
    placed = segments.windows(parts.withColumn("_whole", F.when(fits, F.col("_whole"))), limit=limit,
                              part=lambda own: F.array_join(own, ""))
    pieces = placed.withColumn("_piece", F.coalesce("_whole", "seg_tokens")).drop("seg_tokens", "start", "_whole")
    scored = scoring.batch_score(pieces, load, text="_piece")
    return segments.merge_scores(scored, key, verdict_merge=verdict_merge)


def predict(df: DataFrame, key: list[str], text: str, load: Callable[[], Callable], limits: dict[str, float] | None = None) -> DataFrame:
    """The single-command decision for every row: whole text up to the prediction
    limit, verdicts compared at four digits."""
    scored = score_records(df, key, text, load, limit=segments.PREDICT_LIMIT)
    return D.with_attck(D.decide(scored, thresholds=limits, verdict_digits=4))


def redteam_run(spark: SparkSession, raw: str, out: str, load: Callable[[], Callable], model: str, limits: dict[str, float] | None = None,
                verdict_merge: str = "max_logit") -> DataFrame:
    """Strict scan, dedup, windowed scoring, annotation, fan-out, summary."""
    candidates = materialise(scans.redteam_candidates(spark, raw), "candidates")
    key = ["_source_file", "_source_line"]
    scored = score_records(candidates, key, "command", load, verdict_merge=verdict_merge)
    annotated = D.annotate(candidates.join(scored, key), thresholds=limits).withColumn("model_dir", F.lit(model))
    sinks.write_annotated(annotated, f"{out}/annotated")
    done = spark.read.schema(annotated.schema).parquet(f"{out}/annotated")
    groups = metrics.evasion_summary(done, {"category": "category", "strategy": "evasion_strategy", "verdict": "verdict", "file": "_source_file"}, actions="actions")
    groups.write.parquet(f"{out}/counts")
    total = done.agg(F.count("*").alias("unique_candidates"), F.count_if("verdict_bypass").alias("bypasses_non_malicious"),
                     F.count_if("strict_bypass").alias("strict_benign_bypasses"), F.count_if("partial_evasion").alias("partial_suspicious_evasions"),
                     F.count_if(~F.col("verdict_bypass")).alias("detected_malicious"))
    n = F.greatest(F.lit(1), F.col("unique_candidates"))
    used = limits or {}
    summary = total.withColumns({
        "bypass_rate_non_malicious": F.round(F.col("bypasses_non_malicious") / n, 6),
        "strict_benign_bypass_rate": F.round(F.col("strict_benign_bypasses") / n, 6),
        "model_dir": F.lit(model), "raw_dir": F.lit(raw),
        "thresholds_used": F.create_map(*[x for a in TAXONOMY.action_ids for x in (F.lit(a), F.lit(float(used.get(a, 0.5))))])})
    sinks.write_summary(summary, f"{out}/summary")
    run_files(spark, raw, "raw").write.json(f"{out}/manifest")
    return spark.read.schema(summary.schema).json(f"{out}/summary")


MANIFEST = "part STRING, file STRING, bytes BIGINT, sha256 STRING"


def run_files(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Name within the folder, size and digest of every file of one part of a run."""
    name = F.regexp_replace("file", "^[a-z0-9]*:/*", "/")
    root = path.partition(":")[2] if ":" in path.split("/")[0] else path
    return scans.checksums(spark, path).select(F.lit(part).alias("part"), F.replace(name, F.lit(f"/{root.strip('/')}/"), F.lit("")).alias("file"), "bytes", "sha256")


def compare_files(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """Every raw file with its state against the manifest that the run left: same, changed, missing or new."""
    then = spark.read.schema(MANIFEST).json(f"{out}/manifest").select("file", F.col("sha256").alias("recorded"))
    now = run_files(spark, raw, "raw").select("file", "bytes", "sha256")
    state = (F.when(F.col("recorded").isNull(), "new").when(F.col("sha256").isNull(), "missing")
             .when(F.col("recorded") == F.col("sha256"), "same").otherwise("changed"))
    return now.join(then, "file", "full").withColumn("state", state)


def verify_run(spark: SparkSession, raw: str, out: str, model: str, at_least: int = 1000) -> DataFrame:
    """One row: row errors, key coverage, split counts and gates of a run, and how many raw files are no longer those it read."""
    annotated = spark.read.parquet(f"{out}/annotated")
    errors = audit.row_errors(F.col("verdict"), "verdict_probs", F.col("verdict_bypass"), "action_probs", "map_values(raw_logits)", F.col("model_dir"), model)
    bad = annotated.agg(F.coalesce(F.sum(F.size(errors)), F.lit(0)).alias("row_errors"))
    report = audit.gates(annotated, scans.redteam_candidates(spark, raw), "_command_sha256", at_least=at_least)
    files = compare_files(spark, raw, out).agg(F.count("*").alias("n"), F.count_if(F.col("state") != "same").alias("altered")).first()
    both = report.withColumns({"row_errors": bad.scalar(), "n_files": F.lit(files["n"]), "altered_files": F.lit(files["altered"])})
    ok = (F.col("row_errors") == 0) & (F.col("altered_files") == 0) & F.col("all_detected") & F.col("split_sum_ok")
    return both.withColumn("status", F.when(ok, "verified").otherwise("failed"))


def merge_candidates(base: DataFrame, candidates: DataFrame, within_batch: list[str] | None = None, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add labelled candidates to train/val splits.

    The anti-join against all three splits comes last, so no test text can enter
    train whatever its source. Candidates: ``text, true_labels`` (+ ``soft_v2``).
    """
    order = within_batch or [c for c in ("source", "true_labels", "text") if c in candidates.columns]
    fresh = dedup.without_leakage(candidates, base.select("text"), X.fingerprint(F.col("text")), within_batch=order)
    fresh = materialise(fresh, "additions")
    return splits.merge_additions(base, fresh, val_ratio=val_ratio, seed=seed)


def hard_negative_additions(arbitrated: DataFrame, labelled: DataFrame, source: str = "hard_negative") -> DataFrame:
    """Doubly confirmed rows with the teacher's actions; rows the teacher never
    labelled are skipped. ``labelled`` needs ``text, verdict, actions``."""
    confirmed = filters.double_confirmed(arbitrated).select("text")
    teacher = labelled.groupBy("text").agg(F.max_by(F.struct("verdict", "actions"), F.struct(*_line_order(labelled))).alias("_t"))
    joined = confirmed.distinct().join(teacher, "text")
    labels = F.concat(F.array(F.lit("verdict.malicious")), filters.known_labels(F.col("_t.actions"), TAXONOMY.action_ids))
    return joined.select("text", labels.alias("true_labels"), F.lit(source).alias("source"), F.col("_t.verdict").alias("teacher_verdict"))


def _line_order(df: DataFrame) -> list[str]:
    return [c for c in ("_source_file", "_source_line") if c in df.columns] or ["verdict"]


def relabel_splits(base: DataFrame, also_test: bool = False) -> tuple[DataFrame, DataFrame]:
    """(splits without noisy labels, report per split)."""
    out = filters.drop_noisy_labels(base.withColumn("labels_before", F.col("true_labels")), also_test=also_test)
    return out.drop("labels_before", "dropped"), metrics.relabel_report(out, also_test=also_test)


def evaluate(df: DataFrame, limits: dict[str, float] | None = None, score_space: str = "logit") -> dict[str, DataFrame]:
    """Test-split reports from ``logits, true_labels``."""
    decided = D.with_attck(D.decide(df, thresholds=limits, score_space=score_space))
    rows = decided.withColumns({
        "true_mask": V.mask_of_names("true_labels"), "true_actions": filters.known_labels(F.col("true_labels"), TAXONOMY.action_ids),
        "truth": F.get(filters.known_labels(F.col("true_labels"), TAXONOMY.verdict_ids), F.lit(0))})
    rows = materialise(rows, "decided")  # five reports, one run of the scorer
    labels = metrics.per_label(rows, "true_actions", "actions")
    return {"verdict_acc": metrics.verdict_accuracy(rows, "truth", "verdict"), "micro": metrics.micro(rows), "per_label": labels,
            "macro": metrics.macro_f1(labels), "confusion": metrics.confusion(rows, "truth", "verdict")}


def tune_thresholds(df: DataFrame, score_space: str = "logit") -> DataFrame:
    """Per-action thresholds from a validation split (``logits, true_labels``)."""
    scores = "slice(logits, 4, 28)" if score_space == "logit" else V.array([V.sigmoid(x) for x in V.items("logits", 3, 31)])
    rows = df.select(F.expr(scores).alias("scores"), "true_labels")
    return thresholds.tune(thresholds.sweep(rows, "scores", "true_labels"))


def external_report(df: DataFrame) -> dict[str, DataFrame]:
    """Per-source report and global curves from ``source, label, logits``; only
    rows with a clear label enter the curves."""
    decided = materialise(D.decide(df).withColumn("p_malicious", F.get("verdict_probs", F.lit(2))), "decided")
    clear = decided.filter(F.col("label").isin("malicious", "benign")).select((F.col("label") == "malicious").cast("int").alias("y"), "p_malicious")
    counts = curves.ranged_counts(clear, "y", "p_malicious")
    return {"sources": metrics.source_report(decided), "roc": curves.roc_of_counts(counts),
            "pr": curves.pr_of_counts(counts)}


def score_sessions(df: DataFrame, load: Callable[[], Callable], limits: dict[str, float] | None = None) -> DataFrame:
    """``session_id, commands`` -> one verdict, action set and chains per session."""
    commands = sessions.explode_sessions(df.select("session_id", "commands"))
    decided = predict(commands, ["session_id", "pos"], "command", load, limits)
    return sessions.roll_up(decided, ["session_id"])


def risk_bench_report(df: DataFrame, weights: DataFrame, n_min: int, n_max: int, intercept: float, cut_offs=(0.0, 0.40)) -> DataFrame:
    """``id, command, y`` scored by the n-gram table at several thresholds."""
    scored = df.join(scoring.ngram_linear_score(df, weights, ["id"], "command", n_min, n_max, intercept), "id")
    alerts = F.explode(F.create_map(*[x for t in cut_offs for x in (F.lit(f"thr={t:.2f}"), D.score_alert(F.col("score"), t))]))
    return metrics.binary(scored.select("y", alerts.alias("rule", "alert")), "y", "alert", ["rule"])


def truth_report(spark: SparkSession, raw: str, runs: str) -> DataFrame:
    """Recalls of the latest run against the raw ground truth.

    ``runs`` is the path of the annotated table with ``*`` for the run name; only
    the files of the run whose name sorts last are read as rows.
    """
    every = spark.read.option("recursiveFileLookup", "true").parquet(runs)
    newest = every.agg(F.max(scans.run_id(F.col("_metadata.file_path")))).first()[0]
    annotated = spark.read.parquet(runs.replace("*", newest, 1))
    verdicts = annotated.select("_command_sha256", F.col("verdict").alias("model_verdict"), F.lit(0).alias("_order"))
    rows = scans.parsed_lines(scans.numbered_lines(spark, raw), schemas.REDTEAM).filter(F.col("_reject").isNull())
    truth = rows.select("command", F.col("ground_truth").alias("gt")).filter(F.col("gt").isin("malicious", "suspicious", "benign"))
    return metrics.recalls(lookups.truth_with_verdict(truth, verdicts), "gt", "model_verdict")
