"""Queries: rewards and trajectory grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import grading as G
from assaylake.operators import rewards as R
from assaylake.plans.catalog import query
from assaylake.plans.oracle import cte, sql
from assaylake.sources import views as V

CFG = V.REWARDS
HASH8 = CFG.digest()[:8]

cte("det", """
 SELECT *, CASE WHEN structured THEN CASE WHEN structured_output_valid THEN 1.0 WHEN NOT structured_output_valid THEN 0.0 END END::DOUBLE AS schema_correct,
  CASE WHEN n_tools > 0 THEN n_tools_good::DOUBLE / n_tools END AS tool_correct,
  CASE WHEN completed THEN 1.0 WHEN NOT completed THEN 0.0 END::DOUBLE AS task_completed FROM facts""", "facts")
cte("sig", """
 SELECT *, (coalesce(schema_correct,0) + coalesce(tool_correct,0) + coalesce(task_completed,0))
   / nullif((schema_correct IS NOT NULL)::INT + (tool_correct IS NOT NULL)::INT + (task_completed IS NOT NULL)::INT, 0) AS deterministic,
  CASE WHEN user_correction THEN CASE WHEN correction_category = 'factual_correction' THEN 0.0 END
   WHEN user_abandon THEN 0.0 WHEN user_retry THEN 0.2 WHEN user_accept THEN 1.0 END::DOUBLE AS user_signal,
  CASE WHEN user_correction THEN CASE WHEN correction_category = 'factual_correction' THEN 'medium' END
   WHEN user_abandon OR user_retry THEN 'weak' WHEN user_accept THEN 'medium' END AS user_strength FROM det""", "det")
cte("wts", """
 SELECT *, CASE WHEN user_signal IS NULL THEN 0 WHEN user_strength = 'weak' THEN 0.15 * 0.3 ELSE 0.15 * 0.6 END::DOUBLE AS wu FROM sig""", "sig")
cte("qual", """
 SELECT *, CASE WHEN deterministic IS NOT NULL THEN (greatest(0.6, wu) * deterministic + wu * coalesce(user_signal, 0)) / (greatest(0.6, wu) + wu)
   WHEN user_signal IS NOT NULL THEN user_signal END AS quality,
  CASE WHEN deterministic IS NOT NULL THEN 1.0 WHEN user_strength = 'medium' THEN 0.6 WHEN user_strength = 'weak' THEN 0.3 ELSE 0.0 END::DOUBLE AS base_conf,
  CASE WHEN currency = 'USD' AND final_cost >= 0 THEN least(final_cost / CASE tier WHEN 't1' THEN 0.005 WHEN 't2' THEN 0.01 WHEN 't3' THEN 0.02 WHEN 't4' THEN 0.04 ELSE 0.02 END::DOUBLE, 1.5) END AS cost_normalized,
  CASE WHEN final_latency_ms >= 0 THEN least(final_latency_ms / CASE WHEN slo > 0 THEN slo ELSE 8000 END::DOUBLE, 1.5) END AS latency_normalized,
  least(1.0, CASE WHEN n_tools > 0 THEN 1 - tool_correct ELSE 0 END + CASE WHEN structured AND structured_output_valid = false THEN 1 ELSE 0 END)::DOUBLE AS tool_failure_penalty,
  least(retry_count, 3) / 3.0::DOUBLE AS retry_penalty FROM wts""", "wts")
cte("rewards", f"""
 SELECT *, CASE WHEN critical_failure THEN -1.0 WHEN quality IS NOT NULL THEN quality - 0.2 * coalesce(cost_normalized, 0) - 0.1 * coalesce(latency_normalized, 0)
   - 0.2 * tool_failure_penalty - 0.1 * retry_penalty END::DOUBLE AS scalar,
  CASE WHEN NOT critical_failure AND quality IS NULL THEN 'no_quality_signal' END AS excluded_reason,
  base_conf * CASE WHEN cost_normalized IS NULL THEN 0.8 ELSE 1 END * CASE WHEN latency_normalized IS NULL THEN 0.8 ELSE 1 END AS confidence,
  'rew-' || run_id || '-reward.v1-{HASH8}' AS reward_id FROM qual""", "qual")


def rewards_of(t):
    return R.reward_run(V.run_facts(t), CFG)


@query("reward_by_segment", sql("""
 SELECT tier, task_domain, count(*) AS n, count(*) FILTER (excluded_reason IS NOT NULL) AS excluded, round(avg(scalar), 6) AS mean_reward
 FROM rewards GROUP BY tier, task_domain""", "rewards"))
def _(t):
    return rewards_of(t).groupBy("tier", "task_domain").agg(
        F.count(F.lit(1)).alias("n"), F.count("excluded_reason").alias("excluded"), F.round(F.avg("scalar"), 6).alias("mean_reward"))


@query("deterministic_quality", sql("""
 SELECT run_id, schema_correct, round(tool_correct, 6) AS tool_correct, task_completed, round(deterministic, 6) AS deterministic FROM sig""", "sig"))
def _(t):
    return R.deterministic_quality(V.run_facts(t)).select(
        "run_id", "schema_correct", F.round("tool_correct", 6).alias("tool_correct"), "task_completed", F.round("deterministic", 6).alias("deterministic"))


@query("user_signal", sql("SELECT run_id, user_signal, user_strength FROM sig", "sig"))
def _(t):
    return R.user_signal(V.run_facts(t)).select("run_id", "user_signal", "user_strength")


@query("composite_quality", sql("SELECT run_id, round(quality, 6) AS quality, base_conf AS base_confidence FROM qual", "qual"))
def _(t):
    df = R.user_signal(R.deterministic_quality(V.run_facts(t))).withColumn("rubric", F.lit(None).cast("double"))
    return R.composite_quality(df, CFG).select("run_id", F.round("quality", 6).alias("quality"), "base_confidence")


@query("normalize_cost", sql("SELECT run_id, round(cost_normalized, 6) AS cost_normalized FROM qual", "qual"))
def _(t):
    return R.normalize_cost(V.run_facts(t), CFG).select("run_id", F.round("cost_normalized", 6).alias("cost_normalized"))


@query("normalize_latency", sql("SELECT run_id, round(latency_normalized, 6) AS latency_normalized FROM qual", "qual"))
def _(t):
    return R.normalize_latency(V.run_facts(t), CFG).select("run_id", F.round("latency_normalized", 6).alias("latency_normalized"))


@query("reward_run", sql("""
 SELECT run_id, round(quality, 6) AS quality, round(scalar, 6) AS scalar, excluded_reason, round(confidence, 6) AS confidence,
  round(tool_failure_penalty, 6) AS tool_failure_penalty, round(retry_penalty, 6) AS retry_penalty,
  CASE WHEN retry_count > 0 THEN completed END AS recovery_success FROM rewards""", "rewards"))
def _(t):
    return rewards_of(t).select(
        "run_id", F.round("quality", 6).alias("quality"), F.round("scalar", 6).alias("scalar"), "excluded_reason",
        F.round("confidence", 6).alias("confidence"), F.round("tool_failure_penalty", 6).alias("tool_failure_penalty"),
        F.round("retry_penalty", 6).alias("retry_penalty"), "recovery_success")


@query("reward_versioning", sql(f"""
 SELECT reward_id, run_id AS subject_id FROM rewards
 UNION ALL SELECT 'rew-' || run_id || '-reward.v1-{R.RewardConfig.merged({"cost_cap": 2.0}, CFG).digest()[:8]}', run_id FROM rewards""", "rewards"))
def _(t):
    facts = V.run_facts(t)
    both = R.reward_run(facts, CFG).unionByName(R.reward_run(facts, R.RewardConfig.merged({"cost_cap": 2.0}, CFG)))
    return both.select("reward_id", "subject_id")


@query("validate_reward_config", sql(f"""
 SELECT '{R.RewardConfig.merged({"weights": {"cost": 0.5}}, CFG).digest()}' AS config_hash, round(sum(CASE WHEN critical_failure THEN -1.0 WHEN quality IS NOT NULL THEN quality
  - 0.5 * coalesce(cost_normalized, 0) - 0.1 * coalesce(latency_normalized, 0) - 0.2 * tool_failure_penalty - 0.1 * retry_penalty END), 4) AS total_reward,
  count(*) AS n FROM qual""", "qual"))
def _(t):
    cfg = R.RewardConfig.merged({"weights": {"cost": 0.5}}, CFG)
    return R.reward_run(V.run_facts(t), cfg).groupBy("config_hash").agg(
        F.round(F.sum("scalar"), 4).alias("total_reward"), F.count(F.lit(1)).alias("n"))


@query("deterministic_from_grade", sql("SELECT attempt_id, CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END::DOUBLE AS deterministic FROM grades", "grades"))
def _(t):
    return R.deterministic_from_grade(G.grade_attempts(V.attempts_with_text(t))).select("attempt_id", "deterministic")


cte("rubric", "SELECT attempt_id, avg(score) FILTER (decision IN ('accept','reject')) AS rubric FROM reviews GROUP BY attempt_id", "reviews")


@query("rubric_quality", sql("SELECT attempt_id, round(rubric, 6) AS rubric FROM rubric", "rubric"))
def _(t):
    return R.rubric_quality(V.reviews(t), ["attempt_id"]).select("attempt_id", F.round("rubric", 6).alias("rubric"))


cte("attrew", """
 SELECT *, CASE WHEN quality IS NOT NULL THEN quality - 0.2 * coalesce(cn, 0) - 0.1 * coalesce(ln, 0) END AS scalar,
  (CASE WHEN d IS NOT NULL THEN 1.0 WHEN rubric IS NOT NULL THEN 0.6 ELSE 0.0 END * CASE WHEN cn IS NULL THEN 0.8 ELSE 1 END * CASE WHEN ln IS NULL THEN 0.8 ELSE 1 END)::DOUBLE AS confidence
 FROM (SELECT *, CASE WHEN d IS NOT NULL AND rubric IS NOT NULL THEN (0.6 * d + 0.15 * rubric) / 0.75 WHEN d IS NOT NULL THEN d ELSE rubric END AS quality
  FROM (SELECT g.*, r.rubric, CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END::DOUBLE AS d,
    CASE WHEN currency = 'USD' AND cost_minor IS NOT NULL THEN least(cost_minor / 100.0::DOUBLE / 0.01, 1.5) END AS cn, CASE WHEN latency_ms IS NOT NULL THEN least(latency_ms / 8000.0, 1.5) END AS ln
   FROM grades g LEFT JOIN rubric r USING (attempt_id)))""", "grades", "rubric")


def attempt_rewards(t):
    graded = G.grade_attempts(V.attempts_with_text(t))
    return R.reward_attempt(graded, R.rubric_quality(V.reviews(t), ["attempt_id"]), CFG)


@query("reward_attempt", sql("""
 SELECT attempt_id, round(quality, 6) AS quality, round(scalar, 6) AS scalar, round(confidence, 6) AS confidence,
  CASE WHEN quality IS NULL THEN 'no_quality_signal' END AS excluded_reason FROM attrew""", "attrew"))
def _(t):
    return attempt_rewards(t).select("attempt_id", F.round("quality", 6).alias("quality"), F.round("scalar", 6).alias("scalar"),
                                     F.round("confidence", 6).alias("confidence"), "excluded_reason")


@query("union_reward_subjects", sql("""
 SELECT 'telemetry_run' AS subject_type, run_id AS subject_id, round(scalar, 6) AS scalar, tier, NULL AS case_id FROM rewards
 UNION ALL SELECT 'benchmark_attempt', attempt_id, round(scalar, 6), NULL, case_id FROM attrew""", "rewards", "attrew"))
def _(t):
    a = rewards_of(t).select("subject_type", "subject_id", F.round("scalar", 6).alias("scalar"), "tier")
    b = attempt_rewards(t).select("subject_type", "subject_id", F.round("scalar", 6).alias("scalar"), "case_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("reward_rollup", sql("""
 SELECT coalesce(excluded_reason, 'computed') AS outcome, count(*) AS n, round(avg(scalar), 6) AS mean_scalar FROM rewards GROUP BY 1""", "rewards"))
def _(t):
    return R.reward_rollup(rewards_of(t)).withColumn("mean_scalar", F.round("mean_scalar", 6))


cte("loops", """
 SELECT DISTINCT k FROM (SELECT k, tool_name, coalesce(error_class, 'error') AS e, count(*) AS c FROM lines
 WHERE kind = 'tool' AND (NOT ok OR NOT executed OR error_class IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3)""", "lines")


@query("tool_loop_detection", sql("""
 SELECT k, tool_name, coalesce(error_class, 'error') AS error, count(*) AS times FROM lines
 WHERE kind = 'tool' AND (NOT ok OR NOT executed OR error_class IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3""", "lines"))
def _(t):
    return R.tool_loops(V.lines(t))


@query("first_attempt_precision", sql("""
 SELECT k, round(CASE WHEN n_tools_first > 0 THEN n_tools_first_valid::DOUBLE / n_tools_first ELSE n_tools_valid::DOUBLE / n_tools END, 6) AS tool_precision
 FROM run_lines WHERE n_tools > 0""", "run_lines"))
def _(t):
    return V.run_lines(t).filter("n_tools > 0").selectExpr(
        "k", "round(CASE WHEN n_tools_first > 0 THEN n_tools_first_valid / n_tools_first ELSE n_tools_valid / n_tools END, 6) AS tool_precision")


@query("grade_trajectory", sql("""
 SELECT run_id, CASE WHEN NOT memory AND n_memory = 0 THEN NULL WHEN ratio > 0.9 OR n_memory_failed > 0 THEN 0 ELSE 1 END::DOUBLE AS state_retention,
  round(CASE WHEN n_tools = 0 THEN NULL WHEN n_tools_first > 0 THEN n_tools_first_valid::DOUBLE / n_tools_first ELSE n_tools_valid::DOUBLE / n_tools END, 6) AS tool_precision,
  greatest(n_tools - tool_count, 0) AS unnecessary_calls,
  CASE WHEN n_validations_failed = 0 AND n_tools_good = n_tools THEN 1 WHEN completed AND retry_count BETWEEN 1 AND 3 AND l.k IS NULL THEN 1 ELSE 0 END::DOUBLE AS error_recovery,
  CASE WHEN completed IS NULL THEN NULL WHEN completed AND n_validations_failed = 0 THEN 1 ELSE 0 END::DOUBLE AS execution_correctness
 FROM facts f LEFT JOIN loops l ON f.k = l.k""", "facts", "loops"))
def _(t):
    g = R.grade_trajectory(V.run_facts(t), R.tool_loops(V.lines(t)).select("k").distinct())
    return g.select("run_id", "state_retention", F.round("tool_precision", 6).alias("tool_precision"), "unnecessary_calls",
                    "error_recovery", "execution_correctness")
