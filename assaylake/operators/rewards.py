"""Multi-objective rewards as one projection over flat run facts; no shuffle anywhere."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.schemas import REWARD_SCHEMA_VERSION

# ---- fixed values ---------------------------------------------------------------
WEIGHTS = {"quality": 1.0, "cost": 0.2, "latency": 0.1, "tool_failure": 0.2, "retry": 0.1}
QUALITY_WEIGHTS = {"deterministic": 0.6, "rubric": 0.25, "user": 0.15}
STRENGTH = {"strong": 1.0, "medium": 0.6, "weak": 0.3}
NEGATIVE_CORRECTIONS = ("true_correction", "factual_correction", "execution_repair")


@dataclass(frozen=True)
class RewardConfig:
    """Parameters of a reward version; overrides are merged over the defaults."""

    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    quality_weights: dict = field(default_factory=lambda: dict(QUALITY_WEIGHTS))
    cost_envelope: dict = field(default_factory=dict)  # tier -> USD a run; "default" serves every other tier
    default_slo_ms: float = 8000.0
    cost_cap: float = 1.5
    latency_cap: float = 1.5
    critical_reward: float = -1.0

    @classmethod
    def merged(cls, overrides: dict | None = None, base: "RewardConfig | None" = None) -> "RewardConfig":
        o = dict(overrides or {})
        unknown = set(o) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown reward parameters: {sorted(unknown)}")
        base = base or cls()
        for name in ("weights", "quality_weights", "cost_envelope"):
            if name in o:
                o[name] = {**getattr(base, name), **o[name]}
        return replace(base, **o)

    def digest(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


def _dbl(flag: Column) -> Column:
    return F.when(flag, 1.0).when(~flag, 0.0)


def _mean_known(*cols: Column) -> Column:
    known = F.array_compact(F.array(*cols))
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def deterministic_quality(facts: DataFrame) -> DataFrame:
    """Adds schema_correct, tool_correct, task_completed and their mean where any is known."""
    df = facts.withColumns({
        "schema_correct": F.when(~F.coalesce(F.col("structured"), F.lit(True)), F.lit(None).cast("double"))
        .otherwise(_dbl(F.col("structured_output_valid"))),
        "tool_correct": F.when(F.col("n_tools") > 0, F.col("n_tools_good") / F.col("n_tools")),
        "task_completed": _dbl(F.col("completed")),
    })
    return df.withColumn("deterministic", _mean_known(F.col("schema_correct"), F.col("tool_correct"), F.col("task_completed")))


def deterministic_from_grade(graded: DataFrame) -> DataFrame:
    return graded.withColumn("deterministic", _dbl(F.col("passed")))


def rubric_quality(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Mean accept/reject review score per subject; a medium-strength signal."""
    return reviews.groupBy(*keys).agg(
        F.avg(F.when(F.col("decision").isin("accept", "reject"), F.col("score"))).alias("rubric"))


def user_signal(facts: DataFrame) -> DataFrame:
    """First matching signal wins: labelled correction, other correction, abandon, retry, accept."""
    labelled = F.coalesce(F.col("correction_category").isin(*NEGATIVE_CORRECTIONS), F.lit(False))
    c, a, r, y = (F.coalesce(F.col(f"user_{n}"), F.lit(False)) for n in ("correction", "abandon", "retry", "accept"))
    none = F.lit(None)
    return facts.withColumns({
        "user_signal": F.when(c & labelled, 0.0).when(c, none).when(a, 0.0).when(r, 0.2).when(y, 1.0),
        "user_strength": F.when(c & labelled, "medium").when(c, none).when(a, "weak").when(r, "weak").when(y, "medium"),
    })


def _factor(strength: Column) -> Column:
    return F.when(strength == "strong", STRENGTH["strong"]).when(strength == "medium", STRENGTH["medium"]).when(strength == "weak", STRENGTH["weak"])


def composite_quality(df: DataFrame, config: RewardConfig) -> DataFrame:
    """Weighted mean of the known signals; a known deterministic signal weighs at least half.

    Expects deterministic, rubric and user_signal (any may be null) and user_strength.
    """
    q = config.quality_weights
    zero = F.lit(0.0)
    h = F.when(F.col("rubric").isNotNull(), q["rubric"] * STRENGTH["medium"]).otherwise(zero)
    u = F.when(F.col("user_signal").isNotNull(), q["user"] * _factor(F.col("user_strength"))).otherwise(zero)
    d = F.when(F.col("deterministic").isNotNull(), F.greatest(F.lit(q["deterministic"] * STRENGTH["strong"]), h + u)).otherwise(zero)
    df = df.withColumns({"_wd": d, "_wh": h, "_wu": u}).withColumn("_w", F.col("_wd") + F.col("_wh") + F.col("_wu"))
    value = (F.col("_wd") / F.col("_w") * F.coalesce("deterministic", zero)
             + F.col("_wh") / F.col("_w") * F.coalesce("rubric", zero)
             + F.col("_wu") / F.col("_w") * F.coalesce("user_signal", zero))
    strength = F.greatest(
        F.when(F.col("deterministic").isNotNull(), STRENGTH["strong"]).otherwise(0.0),
        F.when(F.col("rubric").isNotNull(), STRENGTH["medium"]).otherwise(0.0),
        F.when(F.col("user_signal").isNotNull(), _factor(F.col("user_strength"))).otherwise(0.0))
    return df.withColumns({"quality": F.when(F.col("_w") > 0, value), "base_confidence": strength}).drop("_wd", "_wh", "_wu", "_w")


def normalize_cost(df: DataFrame, config: RewardConfig, cost: str = "final_cost", currency: str = "currency", tier: str = "tier") -> DataFrame:
    """USD cost over the tier's envelope, capped; any other currency, and a tier without an envelope, stays unknown."""
    env = F.lit(config.cost_envelope.get("default")).cast("double")
    for name, value in config.cost_envelope.items():
        if name != "default":
            env = F.when(F.col(tier) == name, float(value)).otherwise(env)
    c = F.col(cost)
    known = env.isNotNull() & (F.col(currency) == "USD") & c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0) & (c < F.lit(float("inf")))
    scaled = F.when(env <= 0, F.lit(config.cost_cap)).otherwise(F.least(c / env, F.lit(config.cost_cap)))
    return df.withColumn("cost_normalized", F.when(known, scaled))


def normalize_latency(df: DataFrame, config: RewardConfig, latency: str = "final_latency_ms", slo: str | None = "slo") -> DataFrame:
    """Latency over its SLO where one above zero is set, else over the default; capped."""
    target = F.lit(config.default_slo_ms)
    if slo is not None:
        target = F.when(F.col(slo) > 0, F.col(slo).cast("double")).otherwise(target)
    v = F.col(latency)
    known = v.isNotNull() & ~F.isnan(v.cast("double")) & (v >= 0) & (v < F.lit(float("inf")))
    return df.withColumn("latency_normalized", F.when(known, F.least(v / target, F.lit(config.latency_cap))))


def _scalar(df: DataFrame, config: RewardConfig) -> DataFrame:
    w = config.weights
    value = (w["quality"] * F.col("quality") - w["cost"] * F.coalesce("cost_normalized", F.lit(0.0))
             - w["latency"] * F.coalesce("latency_normalized", F.lit(0.0))
             - w["tool_failure"] * F.col("tool_failure_penalty") - w["retry"] * F.col("retry_penalty"))
    conf = (F.col("base_confidence") * F.when(F.col("cost_normalized").isNull(), 0.8).otherwise(1.0)
            * F.when(F.col("latency_normalized").isNull(), 0.8).otherwise(1.0))
    return df.withColumns({
        "scalar": F.when(F.col("critical_failure"), F.lit(config.critical_reward)).otherwise(value),
        "excluded_reason": F.when(~F.col("critical_failure") & F.col("quality").isNull(), "no_quality_signal"),
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)),
        "schema_version": F.lit(REWARD_SCHEMA_VERSION),
        "config_hash": F.lit(config.digest()),
    })


def reward_versioning(df: DataFrame, subject: str) -> DataFrame:
    """The record key: a new schema or config gives a new key, so re-scoring appends."""
    return df.withColumn("reward_id", F.concat_ws("-", F.lit("rew"), F.col(subject), F.col("schema_version"), F.substring("config_hash", 1, 8)))


def reward_run(facts: DataFrame, config: RewardConfig) -> DataFrame:
    """Reward per telemetry run from flat facts."""
    df = user_signal(deterministic_quality(facts)).withColumn("rubric", F.lit(None).cast("double"))
    df = normalize_latency(normalize_cost(composite_quality(df, config), config), config)
    broken = F.col("structured") & ~F.col("structured_output_valid")
    tool = F.when(F.col("n_tools") > 0, 1.0 - F.coalesce("tool_correct", F.lit(0.0))).otherwise(0.0)
    retries = F.greatest(F.coalesce(F.col("retry_count"), F.lit(0)), F.lit(0))
    df = df.withColumns({
        "tool_failure_penalty": F.least(F.lit(1.0), tool + F.when(F.coalesce(broken, F.lit(False)), 1.0).otherwise(0.0)),
        "retry_penalty": F.least(retries, F.lit(3)) / 3.0,
        "recovery_success": F.when(retries > 0, F.col("completed")),
    })
    df = _scalar(df, config).withColumns({"subject_type": F.lit("telemetry_run"), "subject_id": F.col("run_id")})
    return reward_versioning(df, "subject_id")


def reward_attempt(graded: DataFrame, rubric: DataFrame, config: RewardConfig) -> DataFrame:
    """Reward per benchmark attempt: grade, reviews, cost in minor units, default envelope."""
    df = deterministic_from_grade(graded).join(rubric, "attempt_id", "left").withColumns({
        "user_signal": F.lit(None).cast("double"), "user_strength": F.lit(None).cast("string"),
        "cost_raw": F.col("cost_minor") / 100.0, "_tier": F.lit("default"),
        "tool_failure_penalty": F.lit(0.0), "retry_penalty": F.lit(0.0),
        "critical_failure": F.coalesce(F.col("failure_reason") == "critical_failure", F.lit(False)),
    })
    df = normalize_cost(composite_quality(df, config), config, "cost_raw", "currency", "_tier")
    df = normalize_latency(df, config, "latency_ms", None)
    df = _scalar(df, config).drop("_tier").withColumns({"subject_type": F.lit("benchmark_attempt"), "subject_id": F.col("attempt_id")})
    return reward_versioning(df, "subject_id")


def grade_trajectory(facts: DataFrame, loops: DataFrame) -> DataFrame:
    """Four trajectory grades per run; ``loops`` holds the runs with a detected tool loop."""
    df = facts.join(loops.select("k", F.lit(True).alias("loop_detected")), "k", "left").withColumn(
        "loop_detected", F.coalesce("loop_detected", F.lit(False)))
    malformed = (F.col("n_validations_failed") > 0) | (F.col("n_tools_good") < F.col("n_tools"))
    recovered = F.coalesce(F.col("completed"), F.lit(False)) & (F.col("retry_count") > 0)
    first_n = F.when(F.col("n_tools_first") > 0, F.col("n_tools_first")).otherwise(F.col("n_tools"))
    first_ok = F.when(F.col("n_tools_first") > 0, F.col("n_tools_first_valid")).otherwise(F.col("n_tools_valid"))
    return df.withColumns({
        "state_retention": F.when(~F.col("memory") & (F.col("n_memory") == 0), F.lit(None).cast("double"))
        .when((F.col("ratio") > 0.9) | (F.col("n_memory_failed") > 0), 0.0).otherwise(1.0),
        "tool_precision": F.when(F.col("n_tools") > 0, first_ok / first_n),
        "unnecessary_calls": F.greatest(F.col("n_tools") - F.col("tool_count"), F.lit(0)),
        "error_recovery": F.when(~malformed, 1.0)
        .when(recovered & (F.col("retry_count") <= 3) & ~F.col("loop_detected"), 1.0).otherwise(0.0),
        "execution_correctness": F.when(F.col("completed").isNull(), F.lit(None).cast("double"))
        .when(F.col("completed") & (F.col("n_validations_failed") == 0), 1.0).otherwise(0.0),
    })


def tool_loops(events: DataFrame) -> DataFrame:
    """Runs in which one (tool, error) fails three times or more."""
    bad = events.filter("kind = 'tool' AND (NOT ok OR NOT executed OR error_class IS NOT NULL)")
    return (bad.groupBy("k", "tool_name", F.coalesce("error_class", F.lit("error")).alias("error"))
            .agg(F.count(F.lit(1)).alias("times")).filter("times >= 3"))


def reward_rollup(rewards: DataFrame) -> DataFrame:
    """Computed, excluded by reason, and mean over the rest."""
    return rewards.groupBy(F.coalesce("excluded_reason", F.lit("computed")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("scalar").alias("mean_scalar"))
