"""Declared row schemas; nothing is inferred."""

RAW = "text STRING, source STRING, hint STRING, label STRING, tool STRING"
LABELED = "text STRING, source STRING, verdict STRING, actions ARRAY<STRING>, soft ARRAY<DOUBLE>, model STRING"
SPLIT = "text STRING, true_labels ARRAY<STRING>, soft_v2 ARRAY<DOUBLE>, source STRING, teacher_verdict STRING"
CANDIDATE = "text STRING, action STRING, target STRING, source_seed_sha256 STRING, generator_model STRING"
REDTEAM = ("id STRING, category STRING, attack_family STRING, intent STRING, command STRING, evasion_strategy STRING, "
           "rationale STRING, severity_expected STRING, synthetic BOOLEAN, ground_truth STRING")
SESSION = "session_id STRING, commands ARRAY<STRING>, attack_chain STRING, ground_truth STRING"
HONEYPOT = "command STRING, frequency BIGINT"
EXTERNAL = "text STRING, source STRING, label STRING, period STRING, frequency BIGINT"
THRESHOLD = "action STRING, threshold STRING"
CACHE = "text STRING, soft ARRAY<DOUBLE>"
ANSWERS = "MAP<STRING, STRUCT<probabilities: MAP<STRING, DOUBLE>, noul: DOUBLE>>"
ANNOTATED = (REDTEAM + ", _source_file STRING, _source_line BIGINT, _command_sha256 STRING, model_dir STRING, model_verdict STRING, "
             "model_verdict_probs MAP<STRING, DOUBLE>, model_action_probs MAP<STRING, DOUBLE>, model_actions ARRAY<STRING>, "
             "model_tactics ARRAY<STRING>, model_techniques ARRAY<STRING>, verdict_bypass BOOLEAN, bypass_type STRING, "
             "model_raw_logits MAP<STRING, DOUBLE>, n_segments INT")
SAMPLE = "text STRING, labels ARRAY<STRING>, source STRING, parent STRING, meta MAP<STRING, STRING>, id STRING"
