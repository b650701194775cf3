"""Flywheel metrics: each one states its numerator and denominator, and no data is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.schemas import CRITICAL_GATES


def _row(df: DataFrame, metric: str, value: Column, num: Column, den: Column) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), value.cast("double").alias("value"), num.cast("double").alias("numerator"), den.cast("double").alias("denominator"))


def first_shot_recovery(facts: DataFrame) -> DataFrame:
    """First-shot rate, clean recovery, mean retries and unrecovered rate, each with its own denominator."""
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    retried = F.col("retry_count") > 0
    clean = retried & t("completed") & ~t("user_retry") & ~t("user_abandon")
    a = facts.agg(
        F.count_if("first_shot_success").alias("fs"), F.count("first_shot_success").alias("fsn"), F.count_if(clean).alias("rc"), F.count_if(retried).alias("rn"),
        F.sum(F.when(retried, F.col("retry_count"))).alias("rs"), F.count_if(~F.col("completed")).alias("un"), F.count("completed").alias("cn"))
    out = None
    for m, n, d in (("first_shot_success_rate", "fs", "fsn"), ("recovered_without_user_visible_failure", "rc", "rn"), ("average_recovery_attempts", "rs", "rn"), ("unrecovered_failure_rate", "un", "cn")):
        r = _row(a, m, F.try_divide(n, d), F.col(n), F.col(d))
        out = r if out is None else out.unionByName(r)
    return out


def live_shadow_pairs(obs: DataFrame) -> DataFrame:
    """Each shadow decision beside its run's live action."""
    live = obs.filter("NOT shadow").select("run_id", F.col("chosen_action").alias("live_action"))
    return obs.filter("shadow").select("run_id", "policy_version", F.col("chosen_action").alias("shadow_action")).join(live, "run_id")


def shadow_disagreement_rate(obs: DataFrame) -> DataFrame:
    return live_shadow_pairs(obs).groupBy("policy_version").agg(F.avg((F.col("shadow_action") != F.col("live_action")).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def unit_economics(rewarded: DataFrame, by: list[str]) -> DataFrame:
    """Cost per success, reward per dollar and per second; unknown when any part is unknown."""
    usd = (F.col("currency") == "USD") & F.col("final_cost").isNotNull()
    ok = F.coalesce(usd, F.lit(False))
    has = F.col("scalar").isNotNull()
    all_cost = F.bool_and(ok & F.col("completed").isNotNull())
    r_cost, r_lat = F.bool_and(F.when(has, ok)), F.bool_and(F.when(has, F.col("final_latency_ms").isNotNull()))
    g = rewarded.groupBy(*by).agg(
        all_cost.alias("_a"), r_cost.alias("_b"), r_lat.alias("_c"), F.sum("final_cost").alias("_cost"), F.count_if("completed").alias("successes"),
        F.sum("scalar").alias("_r"), F.sum(F.when(has, F.col("final_cost"))).alias("_rc"), F.sum(F.when(has, F.col("final_latency_ms"))).alias("_rl"), F.avg("scalar").alias("mean_reward"))
    pos = lambda c: F.when(F.col(c) != 0, F.col(c))
    return g.select(*by, F.when(F.col("_a"), F.col("_cost") / pos("successes")).alias("cost_per_successful_run"), F.when(F.col("_b"), F.col("_r") / pos("_rc")).alias("reward_per_dollar"),
                    F.when(F.col("_c"), F.col("_r") / (pos("_rl") / 1000.0)).alias("reward_per_second"), "mean_reward", "successes")


def tier_action_coverage(obs: DataFrame) -> DataFrame:
    return obs.filter("NOT shadow").groupBy("tier", "chosen_action").agg(F.count(F.lit(1)).alias("n"))


def propensity_support(obs: DataFrame, floor: float = 0.01) -> DataFrame:
    """Share of (tier, domain, eligible action) cells with a logged choice at the floor or above.

    Both sides are distinct cells, so their size follows the catalogue and not the log.
    """
    live = obs.filter("NOT shadow")
    cell = ["tier", "task_domain", "action"]
    eligible = live.select("tier", "task_domain", F.explode("eligible_actions").alias("action")).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    logged = live.filter(F.col("obs_propensity") >= floor).select("tier", "task_domain", F.col("chosen_action").alias("action")).groupBy(*cell).agg(F.lit(True).alias("_hit"))
    j = eligible.join(logged, cell, "left")
    return j.agg(F.count("_hit").alias("supported_cells"), F.count(F.lit(1)).alias("eligible_cells")).withColumn("value", F.try_divide("supported_cells", "eligible_cells"))


def critical_regression_rate(gates: DataFrame, report: str = "report_id") -> DataFrame:
    """Reports with any failed critical gate over all reports."""
    bad = F.bool_or(F.col("gate").isin(*CRITICAL_GATES) & ~F.col("passed")).alias("bad")
    return gates.groupBy(report).agg(bad).agg(F.count_if("bad").alias("critical_failed"), F.count(F.lit(1)).alias("reports")).withColumn("value", F.try_divide("critical_failed", "reports"))


def data_efficiency(candidates: DataFrame) -> DataFrame:
    ok = F.col("duplicate_of").isNull() & F.coalesce(F.col("state").isin("APPROVED", "TRAIN_ONLY", "REGRESSION", "VALIDATION", "HOLDOUT", "ADVERSARIAL"), F.lit(False))
    return candidates.agg(F.count_if(ok).alias("approved"), F.count(F.lit(1)).alias("imported_candidates")).withColumn("ratio", F.try_divide("approved", "imported_candidates"))


def metrics_scorecard(facts: DataFrame, obs: DataFrame, rewarded: DataFrame, candidates: DataFrame, gates: DataFrame) -> DataFrame:
    """The scorecard as one tidy table (metric, value, numerator, denominator)."""
    none = F.lit(None).cast("double")
    e = data_efficiency(candidates)
    s = propensity_support(obs)
    c = critical_regression_rate(gates)
    u = unit_economics(rewarded, [])
    d = live_shadow_pairs(obs).agg(F.count_if(F.col("shadow_action") != F.col("live_action")).alias("x"), F.count(F.lit(1)).alias("n"))
    out = (first_shot_recovery(facts)
           .unionByName(_row(e, "data_efficiency_ratio", F.col("ratio"), F.col("approved"), F.col("imported_candidates")))
           .unionByName(_row(s, "propensity_support_coverage", F.col("value"), F.col("supported_cells"), F.col("eligible_cells")))
           .unionByName(_row(c, "critical_regression_rate", F.col("value"), F.col("critical_failed"), F.col("reports")))
           .unionByName(_row(d, "shadow_disagreement", F.try_divide("x", "n"), F.col("x"), F.col("n"))))
    for m in ("cost_per_successful_run", "reward_per_dollar", "reward_per_second", "mean_reward"):
        out = out.unionByName(_row(u, m, F.col(m), none, none))
    return out
