"""Queries: validation, quarantine, privacy, unnesting of run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import jsonvals as J
from assaylake.functions import privacy as P
from assaylake.functions.plan import computed_once
from assaylake.functions.reasons import code_list, let
from assaylake.operators import grading as G
from assaylake.operators import unnest as U
from assaylake.operators import validate as VD
from assaylake.plans.catalog import query
from assaylake.plans.oracle import cte, sql
from assaylake.schemas import FEATURE_SCHEMA_VERSION
from assaylake.sources import views as V

# every injected fault, and the code it must produce, one row per (run, code)
cte("faults", """
 SELECT * FROM (
 SELECT k, CASE WHEN k % 191 = 37 THEN 'run.invalid_run_id' END AS code FROM runs
 UNION ALL SELECT k, CASE WHEN k % 103 = 5 THEN 'run.missing_tier' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 179 = 33 THEN 'run.feature_schema_mismatch' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 167 = 29 THEN 'run.invalid_started_at' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 101 = 3 THEN 'routing_context.invalid_tool_count' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 173 = 31 THEN 'routing_context.negative_estimated_input_tokens' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 107 = 7 THEN 'routing_context.ratio_out_of_range' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 103 = 5 THEN 'routing_context.run_mismatch' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 157 = 25 THEN 'outcome.invalid_completed' END FROM runs
 UNION ALL SELECT k, CASE WHEN k % 163 = 27 THEN 'outcome.invalid_final_cost_or_currency' END FROM runs
 UNION ALL SELECT k, code FROM decision_faults UNION ALL SELECT k, code FROM child_faults) WHERE code IS NOT NULL""", "runs", "decision_faults", "child_faults")
cte("decision_faults0", """
 SELECT k, 'decisions[0].missing_created_at' AS code FROM runs WHERE k % 127 = 13
 UNION ALL SELECT k, 'decisions[1].missing_created_at' FROM runs WHERE k % 127 = 13 AND k % 2 = 0
 UNION ALL SELECT k, 'decisions[0].invalid_selection_probability' FROM runs WHERE k % 109 = 9 AND k % 127 <> 13
 UNION ALL SELECT k, 'decisions[0].invalid_eligible_models' FROM runs WHERE k % 113 = 11 AND k % 127 <> 13
 UNION ALL SELECT k, 'decisions[0].selected_not_eligible' FROM runs WHERE k % 137 = 17 AND k % 127 <> 13 AND k % 109 <> 9 AND k % 113 <> 11""", "runs")
cte("decision_faults", """
 SELECT * FROM decision_faults0
 UNION ALL SELECT k, 'decisions.exactly_one_live_required' FROM runs WHERE k % 2 = 0 AND k % 131 IN (15, 16) AND k NOT IN (SELECT k FROM decision_faults0)""", "runs", "decision_faults0")
cte("child_faults", """
 SELECT k, 'tool_events.not_list_of_objects' AS code FROM runs WHERE k % 139 = 19
 UNION ALL SELECT k, 'attempts[0].missing_success' FROM runs WHERE k % 149 = 21 AND k % 4 > 0
 UNION ALL SELECT k, 'feedback[0].unknown_type' FROM runs WHERE k % 151 = 23 AND k % 5 IN (0, 3)""", "runs")
cte("doc_ids", """
 SELECT k, k // 50 AS b, k % 50 AS idx, CASE WHEN k % 191 = 37 THEN 'bad id!' WHEN k % 89 = 1 AND k % 50 <> 0 THEN 'run-' || (k - 1) ELSE run_id END AS doc_run_id FROM runs""", "runs")
cte("doc_reasons0", """
 SELECT k, code FROM faults
 UNION ALL SELECT k, 'decisions.model_not_in_registry' FROM runs WHERE k % 181 = 35 AND k NOT IN (SELECT k FROM faults)""", "runs", "faults")
cte("doc_reasons", """
 SELECT k, code FROM doc_reasons0
 UNION ALL SELECT d.k, 'run.duplicate_run_id_in_batch' FROM doc_ids d WHERE d.k NOT IN (SELECT k FROM doc_reasons0)
  AND EXISTS (SELECT 1 FROM doc_ids e WHERE e.b = d.b AND e.doc_run_id = d.doc_run_id AND e.idx < d.idx AND e.k NOT IN (SELECT k FROM doc_reasons0))""", "doc_ids", "doc_reasons0")
cte("doc_privacy", """
 SELECT k, CASE WHEN k % 61 = 2 THEN 'pii_email' ELSE 'authorization_header' END AS code FROM runs WHERE k % 5 IN (0, 3) AND (k % 61 = 2 OR k % 67 = 4)""", "runs")
cte("records", """
 SELECT d.k, d.b, d.idx, d.doc_run_id, CASE WHEN p.code IS NOT NULL THEN 'rejected' ELSE 'clean' END AS privacy_status,
  CASE WHEN p.code IS NOT NULL OR r.k IS NOT NULL THEN 'quarantined' ELSE 'accepted' END AS status,
  list_aggregate(list_sort(list_distinct(list_concat(coalesce(r.codes, []), CASE WHEN p.code IS NULL THEN [] ELSE [p.code] END))), 'string_agg', ',') AS reasons
 FROM doc_ids d LEFT JOIN (SELECT k, list(DISTINCT code) AS codes FROM doc_reasons GROUP BY k) r ON d.k = r.k LEFT JOIN doc_privacy p ON d.k = p.k""", "doc_ids", "doc_reasons", "doc_privacy")
cte("accepted", "SELECT r.*, c.b, c.idx, c.doc_run_id FROM runs r JOIN records c ON r.k = c.k WHERE c.status = 'accepted'", "runs", "records")

def registry_array():
    return F.array(F.lit("lab/m0"), F.lit("lab/m1"), F.lit("lab/m2"))


def parsed(t):
    return computed_once(V.run_documents(t), "run", F.try_parse_json("raw"))


def checked(t):
    """Documents with every schema code, registry check and in-batch duplicates."""
    d = VD.check_actions_in_registry(parsed(t).withColumn("registry_actions", registry_array()))
    unknown = F.when(F.size("unknown_actions") > 0, F.array(F.lit("decisions.model_not_in_registry"))).otherwise(F.array().cast("array<string>"))
    codes = let(VD.run_reasons(F.col("run"), FEATURE_SCHEMA_VERSION), lambda c: F.when(F.size(c) > 0, c).otherwise(unknown))
    d = computed_once(d, "reasons", codes).withColumn("run_id", F.try_variant_get("run", "$.run_id", "string"))
    return VD.quarantine_duplicate_runs(d)


def records(t):
    d = computed_once(checked(t), "_scan", P.scan_document(F.col("raw")))
    return VD.split_accept_quarantine(d, P.reasons_of(F.col("_scan")), F.col("_scan.redacted")).drop("_scan")


def accepted(t):
    return records(t).filter("status = 'accepted'").select("k", "batch_id", "idx", "run_id", "run")


def _exploded(df, col="reasons"):
    return df.select("k", F.explode(col).alias("code"))


@query("validate_envelope", """
 SELECT b, CASE WHEN len(x) > 0 THEN array_to_string(x, ',') ELSE '' END AS reasons, len(x) = 0 AS accepted FROM (
 SELECT b, list_filter([CASE WHEN b % 11 = 1 THEN 'batch.unsupported_schema' END, CASE WHEN b % 13 = 2 THEN 'batch.unsupported_schema_version' END,
  CASE WHEN b % 17 = 3 THEN 'batch.invalid_batch_id' END, CASE WHEN b % 19 = 4 THEN 'batch.invalid_generated_at' END,
  CASE WHEN b % 23 = 5 THEN 'batch.invalid_producer' END, CASE WHEN b % 29 = 6 THEN 'batch.missing_feature_schema' END,
  CASE WHEN b % 31 = 7 THEN 'batch.invalid_window' END, CASE WHEN b % 37 = 8 THEN 'batch.empty_model_registry' END,
  CASE WHEN b % 43 = 10 AND b % 37 <> 8 AND b % 41 <> 9 THEN 'batch.invalid_registry_entry' END,
  CASE WHEN b % 41 = 9 AND b % 37 <> 8 THEN 'batch.duplicate_registry_action' END, CASE WHEN b % 47 = 11 THEN 'batch.runs_not_list' END], lambda c: c IS NOT NULL) AS x
 FROM (SELECT DISTINCT o_orderkey // 50 AS b FROM orders))""")
def _(t):
    d = computed_once(computed_once(V.batch_envelopes(t), "doc", F.try_parse_json("raw")), "reasons", VD.envelope_reasons(F.col("doc")))
    return d.select("b", code_list("reasons").alias("reasons"), (F.size("reasons") == 0).alias("accepted"))


@query("validate_runs", sql("SELECT DISTINCT k, code FROM faults", "faults"))
def _(t):
    return _exploded(computed_once(parsed(t), "reasons", VD.run_reasons(F.col("run"), FEATURE_SCHEMA_VERSION)))


@query("validate_decisions", sql("SELECT DISTINCT k, code FROM decision_faults", "decision_faults"))
def _(t):
    return _exploded(computed_once(parsed(t), "reasons", VD.decision_reasons(F.col("run"))))


@query("validate_child_events", sql("SELECT DISTINCT k, code FROM child_faults", "child_faults"))
def _(t):
    return _exploded(computed_once(parsed(t), "reasons", VD.child_reasons(F.col("run"))))


@query("check_actions_in_registry", sql("""
 SELECT DISTINCT k, a AS unknown_action FROM (
  SELECT k, 'lab/m9' AS a FROM runs WHERE k % 137 = 17 UNION ALL SELECT k, 'lab/m7' FROM runs WHERE k % 181 = 35 AND (k % 113 <> 11 OR k % 2 = 0))""", "runs"))
def _(t):
    return VD.check_actions_in_registry(parsed(t).withColumn("registry_actions", registry_array())).select("k", F.explode("unknown_actions").alias("unknown_action"))


@query("quarantine_duplicate_runs", sql("SELECT k FROM doc_reasons WHERE code = 'run.duplicate_run_id_in_batch'", "doc_reasons"))
def _(t):
    return checked(t).filter(F.array_contains("reasons", "run.duplicate_run_id_in_batch")).select("k")


@query("split_accept_quarantine", sql("SELECT k, status, privacy_status, coalesce(reasons, '') AS reasons FROM records", "records"))
def _(t):
    return records(t).select("k", "status", "privacy_status", code_list("reasons").alias("reasons"))


@query("quarantine_summary", sql("""
 SELECT 'b-' || b AS batch_id, 'status:' || status AS item, count(*) AS n FROM records GROUP BY ALL
 UNION ALL SELECT 'b-' || b, 'reason:' || x, count(*) FROM (SELECT b, unnest(string_split(reasons, ',')) AS x FROM records WHERE reasons <> '') GROUP BY ALL""", "records"))
def _(t):
    return VD.quarantine_summary(records(t), "batch_id")


@query("unnest_reasons", sql("""
 SELECT k, CASE WHEN coalesce(reasons, '') = '' THEN NULL ELSE unnest(string_split(reasons, ',')) END AS reason FROM (SELECT k, reasons FROM records WHERE reasons <> '')
 UNION ALL SELECT k, NULL FROM records WHERE coalesce(reasons, '') = ''""", "records"))
def _(t):
    return records(t).select("k", F.explode_outer("reasons").alias("reason"))


@query("router_observations", sql("""
 SELECT 'obs-d' || s.tag || '-' || k AS observation_id, k, CASE s.tag WHEN 'l' THEN action ELSE shadow_action END AS chosen_action,
  s.tag = 's' AS shadow, round(CASE s.tag WHEN 'l' THEN propensity ELSE 1 END, 6) AS propensity, len(eligible) AS eligible_count, tier, task_domain
 FROM accepted, (SELECT unnest(['l','s']) AS tag) s WHERE s.tag = 'l' OR shadow_action IS NOT NULL""", "accepted"))
def _(t):
    o = U.router_observations(accepted(t))
    return o.select("observation_id", "k", "chosen_action", "shadow", F.round("propensity", 6).alias("propensity"),
                    F.size("eligible_actions").alias("eligible_count"), "tier", "task_domain")


@query("trajectories", sql("""
 SELECT 'traj-' || doc_run_id AS trajectory_id, tier, task_domain, 'obs-dl-' || k AS routing_context_id, policy_version, completed,
  (k % 200) / 10000.0::DOUBLE AS final_cost FROM accepted""", "accepted"))
def _(t):
    return U.trajectories(accepted(t)).select("trajectory_id", "tier", "task_domain", "routing_context_id", "policy_version", "completed", "final_cost")


cte("steps", """
 SELECT k, 'model_attempt' AS step_type, i AS step_index, 'lab/m' || ((k + i) % 3) AS action, (k + i) % 5 <> 0 AS validation_result, 100.0::DOUBLE * (1 + (k * 7 + i * 13) % 50) AS latency_ms
 FROM (SELECT k, unnest(range(0, k % 4)) AS i FROM accepted)
 UNION ALL SELECT k, 'tool_call', k % 4 + i, 'tool-' || ((k + i) % 7), (k + i) % 4 <> 0, NULL FROM (SELECT k, unnest(range(0, CASE WHEN tools THEN k % 3 + 1 ELSE 0 END)) AS i FROM accepted)
 UNION ALL SELECT k, 'validation', k % 4 + CASE WHEN tools THEN k % 3 + 1 ELSE 0 END + i, 'check-' || ((k + i) % 3), (k + i) % 6 <> 0, NULL
  FROM (SELECT k, tools, unnest(range(0, CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END)) AS i FROM accepted)""", "accepted")


@query("trajectory_steps", sql("SELECT k, step_index, step_type, action, validation_result, latency_ms FROM steps", "steps"))
def _(t):
    return U.trajectory_steps(accepted(t)).select("k", "step_index", "step_type", "action", "validation_result", "latency_ms")


@query("clean_step_metadata", sql("""
 SELECT k, step_index, CASE step_type WHEN 'model_attempt' THEN CASE WHEN validation_result THEN 'attempt_id,currency,estimated_cost,latency_ms,model,provider,retry_number,success' ELSE 'attempt_id,currency,error_type,estimated_cost,latency_ms,model,provider,retry_number,success' END
  WHEN 'tool_call' THEN 'attempt_number,error_class,event_id,execution_success,schema_valid,tool_name' ELSE 'event_id,passed,validator' END AS kept_keys FROM steps""", "steps"))
def _(t):
    s = U.trajectory_steps(accepted(t))
    return s.select("k", "step_index", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("kept_keys"))


# ---- flat contracts ------------------------------------------------------------------
@query("validate_attempts", sql("""
 SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN line_no = 3 AND k % 37 = 0 THEN 'invalid_status' END AS reason FROM attempts
  UNION ALL SELECT CASE WHEN cost_minor IS NOT NULL AND currency IS NULL THEN 'missing_currency' END FROM attempts
  UNION ALL SELECT CASE WHEN k % 41 = 0 AND latency_ms IS NOT NULL THEN 'invalid_completion_latency_ms' END FROM attempts
  UNION ALL SELECT CASE WHEN prompt_hash = 'stale' THEN 'prompt_hash_mismatch' END FROM attempts
  UNION ALL SELECT CASE WHEN ck % 53 = 0 THEN 'case_not_in_run' END FROM attempts
  UNION ALL SELECT CASE WHEN k % 59 = 0 THEN 'model_mismatch' END FROM attempts
  UNION ALL SELECT CASE WHEN line_no = 1 AND NOT (line_no = 3 AND k % 37 = 0) AND NOT (cost_minor IS NOT NULL AND currency IS NULL)
    AND NOT (k % 41 = 0 AND latency_ms IS NOT NULL) AND prompt_hash <> 'stale' AND ck % 53 <> 0 AND k % 59 <> 0 THEN 'duplicate_attempt' END FROM attempts)
 WHERE reason IS NOT NULL GROUP BY reason""", "attempts").replace("prompt_hash = 'stale' THEN", "prompt_hash = 'stale' AND ck % 53 <> 0 THEN"))
def _(t):
    a = V.attempts(t).selectExpr(
        "attempt_id", "CASE WHEN ck % 53 = 0 THEN concat('gone-', ck) ELSE case_id END AS case_id", "prompt_hash",
        "CASE WHEN k % 59 = 0 THEN 'other' ELSE provider END AS provider", "model",
        "CASE WHEN line_no = 3 AND k % 37 = 0 THEN 'weird' ELSE status END AS status",
        "CASE WHEN k % 41 = 0 THEN concat('-', latency_ms) ELSE cast(latency_ms AS string) END AS completion_latency_ms",
        "cast(input_tokens AS string) AS input_tokens", "cast(output_tokens AS string) AS output_tokens",
        "cast(cost_minor AS string) AS cost_minor", "currency",
        "explode(CASE WHEN line_no = 1 THEN array(0, 1) ELSE array(0) END) AS position")
    # the second copy of a line-1 attempt is the duplicate; other codes count both copies once
    checked_rows = VD.validate_attempts(a, V.cases(t), "lab")
    return (checked_rows.filter("position = 0 OR array_contains(reasons, 'duplicate_attempt')").select(F.explode("reasons").alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def case_rows(t):
    return V.cases(t).selectExpr(
        "ck", "case_id", "family_id", "CASE WHEN ck % 43 = 1 THEN 'dev' ELSE split END AS split",
        "CASE WHEN ck % 47 = 2 THEN 5L ELSE complexity_level END AS complexity_level", "CASE WHEN ck % 53 = 3 THEN 'magic' ELSE domain END AS domain",
        "'en' AS language", "tags",
        "CASE WHEN ck % 59 = 4 THEN array() WHEN ck % 61 = 5 THEN array(named_struct('role', 'robot', 'content', prompt_text)) ELSE array(named_struct('role', 'user', 'content', prompt_text)) END AS messages",
        "named_struct('method', method, 'reference_answer', reference_answer, 'rubric', array(named_struct('criterion', 'correct', 'weight', CASE WHEN ck % 67 = 6 THEN 0D ELSE 1D END)), 'critical_failures', array('leak')) AS evaluation",
        "'synthetic' AS fixture_policy", "'0.1' AS suite_version", "named_struct('origin', 'parts', 'real_personal_data', real_personal_data) AS provenance",
        "named_struct('max_output_tokens', CASE WHEN ck % 71 = 7 THEN 0L ELSE 256L END, 'max_tool_calls', 0L) AS limits")


@query("validate_cases", """
 SELECT ck, array_to_string(list_filter([CASE WHEN ck % 43 = 1 THEN 'invalid_split' END, CASE WHEN ck % 47 = 2 THEN 'invalid_complexity_level' END,
  CASE WHEN ck % 53 = 3 THEN 'invalid_domain' END, CASE WHEN ck % 59 = 4 THEN 'empty_messages' END, CASE WHEN ck % 61 = 5 AND ck % 59 <> 4 THEN 'invalid_message' END,
  CASE WHEN ck % 67 = 6 THEN 'invalid_rubric' END, CASE WHEN ck % 71 = 7 THEN 'invalid_max_output_tokens' END], lambda c: c IS NOT NULL), ',') AS reasons
 FROM (SELECT p_partkey AS ck FROM part)""")
def _(t):
    return case_rows(t).select("ck", code_list(VD.case_reasons()).alias("reasons"))


@query("validate_suite_integrity", sql("""
 SELECT 'duplicate_case_id' AS finding, case_id AS subject, count(*) AS n FROM cc GROUP BY case_id HAVING count(*) > 1
 UNION ALL SELECT 'family_in_several_splits', family_id, count(DISTINCT split) FROM cc GROUP BY family_id HAVING count(DISTINCT split) > 1
 UNION ALL SELECT 'several_suite_versions', 'suite', count(DISTINCT v) FROM cc HAVING count(DISTINCT v) > 1""".replace("FROM cc", """FROM (
   SELECT CASE WHEN ck % 101 = 9 THEN 'case-' || (ck - 1) ELSE case_id END AS case_id, family_id, CASE WHEN ck % 89 = 8 THEN 'dev' ELSE split END AS split,
   CASE WHEN ck % 97 = 5 THEN '0.2' ELSE '0.1' END AS v FROM cases)"""), "cases"))
def _(t):
    c = V.cases(t).selectExpr("CASE WHEN ck % 101 = 9 THEN concat('case-', ck - 1) ELSE case_id END AS case_id", "family_id",
                              "CASE WHEN ck % 89 = 8 THEN 'dev' ELSE split END AS split", "CASE WHEN ck % 97 = 5 THEN '0.2' ELSE '0.1' END AS suite_version")
    return VD.validate_suite_integrity(c)


@query("validate_run_contract", """
 SELECT run_key, array_to_string(list_filter([CASE WHEN run_key % 13 = 1 THEN 'invalid_run_id' END, CASE WHEN run_key % 17 = 2 THEN 'duplicate_case_ids' END,
  CASE WHEN run_key % 23 = 4 AND run_key % 17 <> 2 OR run_key % 17 = 2 AND run_key % 23 <> 4 AND false THEN 'hashes_do_not_cover_cases' END,
  CASE WHEN run_key % 29 = 5 THEN 'invalid_prompt_hash' END, CASE WHEN run_key % 19 = 3 THEN 'invalid_status' END], lambda c: c IS NOT NULL), ',') AS reasons
 FROM (SELECT o_orderkey AS run_key FROM orders)""")
def _(t):
    h = "sha2(concat('p', {}), 256)"
    r = t.orders.selectExpr(
        "o_orderkey AS run_key", "CASE WHEN o_orderkey % 13 = 1 THEN concat('run ', o_orderkey) ELSE concat('run-', o_orderkey) END AS run_id",
        "CASE WHEN o_orderkey % 17 = 2 THEN array('c0', 'c1', 'c0') WHEN o_orderkey % 23 = 4 THEN array('c0', 'c1', 'c2') ELSE array('c0', 'c1') END AS case_ids",
        f"map('c0', CASE WHEN o_orderkey % 29 = 5 THEN 'xyz' ELSE {h.format('o_orderkey')} END, 'c1', {h.format('o_custkey')}) AS prompt_hashes",
        "CASE WHEN o_orderkey % 19 = 3 THEN 'paused' ELSE 'completed' END AS status")
    return VD.validate_run_contract(r).select("run_key", code_list("reasons").alias("reasons"))


@query("validate_grades", sql("""
 SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN ck % 31 = 1 THEN 'unsupported_method' END, CASE WHEN ck % 37 = 2 AND passed IS NOT NULL THEN 'score_out_of_range' END,
  CASE WHEN ck % 41 = 3 AND passed IS NULL THEN 'abstention_without_reason' END], lambda c: c IS NOT NULL), ',') AS reasons FROM grades) GROUP BY reasons""", "grades"))
def _(t):
    g = G.grade_attempts(V.attempts_with_text(t)).withColumns({
        "method": F.expr("CASE WHEN ck % 31 = 1 THEN 'vibes' ELSE method END"), "score": F.expr("CASE WHEN ck % 37 = 2 THEN score + 1.5 ELSE score END"),
        "failure_reason": F.expr("CASE WHEN ck % 41 = 3 AND passed IS NULL THEN null ELSE failure_reason END")})
    return VD.validate_grades(g).groupBy(code_list("reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_reviews", sql("""
 SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN ck % 31 = 1 THEN 'invalid_decision' END, CASE WHEN ck % 37 = 2 AND score IS NOT NULL THEN 'score_out_of_range' END,
  CASE WHEN ck % 41 = 3 THEN 'confidence_out_of_range' END], lambda c: c IS NOT NULL), ',') AS reasons FROM reviews) GROUP BY reasons""", "reviews"))
def _(t):
    r = V.reviews(t).withColumns({"decision": F.expr("CASE WHEN ck % 31 = 1 THEN 'maybe' ELSE decision END"), "score": F.expr("CASE WHEN ck % 37 = 2 THEN -0.5 - score ELSE score END"),
                                  "confidence": F.expr("CASE WHEN ck % 41 = 3 THEN 2D ELSE 0.5D END")})
    return VD.validate_reviews(r).groupBy(code_list("reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_events", """
 SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 31 = 1 THEN 'invalid_event_type' END, CASE WHEN event_id % 37 = 2 THEN 'invalid_run_id' END,
  CASE WHEN event_id % 41 = 3 AND value > 0 THEN 'invalid_duration' END, CASE WHEN event_id % 43 = 4 THEN 'invalid_cost' END], lambda c: c IS NOT NULL), ',') AS reasons FROM events""")
def _(t):
    e = t.events.selectExpr("event_id", "ts AS timestamp", "CASE WHEN event_id % 31 = 1 THEN upper(event_type) ELSE event_type END AS event_type", "props AS message",
                            "CASE WHEN event_id % 37 = 2 THEN '-x' ELSE concat('run-', user_id) END AS run_id",
                            "CASE WHEN event_id % 41 = 3 THEN -value ELSE value END AS duration_ms", "CASE WHEN event_id % 43 = 4 THEN -1L ELSE 1L END AS cost_minor")
    return VD.validate_events(e).select("event_id", code_list("reasons").alias("reasons"))


@query("validate_exploration", sql("""
 SELECT tier, count(*) AS n, round(sum(0.9 + 0.1 / len(eligible)), 6) AS greedy_mass FROM runs GROUP BY tier""", "runs"))
def _(t):
    _mode, eps = VD.validate_exploration("epsilon_greedy", 0.1)
    return V.runs(t).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.lit(1 - eps) + F.lit(eps) / F.size("eligible")), 6).alias("greedy_mass"))


FIXTURE = {
    "type": "object", "required": ["brand", "size"], "additionalProperties": False,
    "properties": {"brand": {"type": "string", "enum": [f"Brand#{i}" for i in range(1, 21)]}, "size": {"type": "integer", "minimum": 3},
                   "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}}},
}
PART_JSON = """CASE WHEN p_partkey % 11 = 1 THEN concat('{"size":', p_size, '}') WHEN p_partkey % 11 = 2 THEN concat('{"brand":"', p_brand, '","size":"', p_size, '"}')
  WHEN p_partkey % 11 = 3 THEN concat('{"brand":"', p_brand, '","size":', p_size, ',"color":1}') WHEN p_partkey % 11 = 4 THEN concat('{"brand":"', p_brand, '","size":', p_size, ',"tags":["a",7]}')
  WHEN p_partkey % 11 = 5 THEN '[1]' WHEN p_partkey % 11 = 6 THEN 'oops' ELSE concat('{"brand":"', p_brand, '","size":', p_size, '}') END"""
cte("part_faults", """
 SELECT k, v FROM (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 11 NOT IN (1, 5, 6) AND substr(p_brand, 7)::INT > 20 THEN '$.brand is not an allowed value' END AS v FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 1 THEN '$.brand is required' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 2 THEN '$.size must be integer' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 NOT IN (2, 5, 6) AND p_size < 3 THEN '$.size is below the minimum' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 3 THEN '$.color is not permitted' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 4 THEN '$.tags[1] must be string' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 5 THEN '$ must be object' END FROM part) WHERE v IS NOT NULL""")


@query("json_schema_conformance", sql("SELECT k AS p_partkey, v AS violation FROM part_faults", "part_faults"))
def _(t):
    d = t.part.selectExpr("p_partkey", f"{PART_JSON} AS doc")
    d = computed_once(d, "v", J.parse_strict(F.col("doc")))
    return d.filter("v IS NOT NULL").select("p_partkey", F.explode(J.schema_violations(F.col("v"), FIXTURE)).alias("violation"))


@query("grade_schema", sql("""
 SELECT p_partkey, CASE WHEN p_partkey % 11 = 6 THEN NULL ELSE n IS NULL END AS passed,
  CASE WHEN p_partkey % 11 = 6 THEN 'candidate output is not valid JSON' WHEN n IS NOT NULL THEN 'violations' END AS outcome
 FROM part LEFT JOIN (SELECT k, count(*) AS n FROM part_faults GROUP BY k) ON k = p_partkey""", "part_faults"))
def _(t):
    d = t.part.selectExpr("p_partkey", f"{PART_JSON} AS doc").withColumn("g", G.grade_schema(F.col("doc"), FIXTURE))
    return d.selectExpr("p_partkey", "g.passed", "CASE WHEN g.passed IS NULL THEN g.failure_reason WHEN NOT g.passed THEN 'violations' END AS outcome")


cte("fixture_findings", """
 SELECT 'art-' || (p_partkey % 60) AS artifact_id, 'case-' || p_partkey AS case_id,
  CASE WHEN p_partkey % 60 < 30 THEN NULL WHEN p_partkey % 97 = 1 THEN 'missing_result' WHEN p_partkey % 101 = 2 THEN 'prompt_hash_mismatch' WHEN p_partkey % 103 = 3 THEN 'output_not_text' END AS finding FROM part
 UNION ALL SELECT 'art-' || (p_partkey % 60), 'case-' || p_partkey, 'duplicate_case' FROM part WHERE p_partkey % 60 >= 30 AND p_partkey % 107 = 4 AND p_partkey % 97 <> 1
 UNION ALL SELECT 'art-' || (p_partkey % 60), 'zcase-' || p_partkey, 'unknown_case' FROM part WHERE p_partkey % 60 >= 30 AND p_partkey % 109 = 5 AND p_partkey % 97 <> 1""")


@query("reconcile_fixture_results", sql("""
 SELECT 'art-' || (p_partkey % 60) AS artifact_id, count(*) AS cases, coalesce(max(e), 0) AS errors, coalesce(max(e), 0) = 0 AS accepted
 FROM part LEFT JOIN (SELECT artifact_id, count(*) AS e FROM fixture_findings WHERE finding IS NOT NULL GROUP BY 1) f ON f.artifact_id = 'art-' || (p_partkey % 60) GROUP BY 1""", "fixture_findings"))
def _(t):
    manifest, results = fixture_tables(t)
    return VD.fixture_verdict(manifest, VD.reconcile_fixture_results(manifest, results))


def fixture_tables(t):
    base = V.cases(t).selectExpr("ck", "concat('art-', ck % 60) AS artifact_id", "case_id", "prompt_hash", "ck % 60 >= 30 AS faulty")
    results = (base.filter("NOT (faulty AND ck % 97 = 1)")
               .withColumn("position", F.explode(F.expr("CASE WHEN faulty AND ck % 107 = 4 AND faulty AND ck % 109 = 5 THEN array(0, 1, 2) WHEN faulty AND ck % 107 = 4 THEN array(0, 1) WHEN faulty AND ck % 109 = 5 THEN array(0, 2) ELSE array(0) END")))
               .selectExpr("artifact_id", "CASE WHEN position = 2 THEN concat('z', case_id) ELSE case_id END AS case_id",
                           "CASE WHEN faulty AND ck % 101 = 2 THEN 'other' ELSE prompt_hash END AS prompt_hash",
                           "CASE WHEN faulty AND ck % 103 = 3 THEN 'other' ELSE 'text' END AS output_kind", "position"))
    return base.select("artifact_id", "case_id", "prompt_hash"), results


@query("evaluate_constraint_rows", """
 SELECT 'map-' || (s_suppkey % 9) AS map_id, count(*) AS evaluated, count(*) FILTER (s_nationkey % 3 = 0) AS satisfied, count(*) FILTER (s_nationkey % 3 = 1) AS unavailable,
  count(*) FILTER (s_nationkey % 3 = 2) AS blocking, count(*) FILTER (s_acctbal > 8000 AND s_nationkey % 3 <> 0) AS required_blockers,
  bool_and(NOT (s_acctbal > 8000 AND s_nationkey % 3 <> 0)) AS activation_ready FROM supplier GROUP BY 1""")
def _(t):
    rows = t.supplier.selectExpr("concat('map-', s_suppkey % 9) AS map_id", "concat('con-', s_suppkey) AS id", "s_acctbal > 8000 AS required_for_activation",
                                 "CASE s_nationkey % 3 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'unavailable' ELSE 'blocking' END AS status")
    return VD.evaluate_constraint_rows(rows, ["map_id"])
