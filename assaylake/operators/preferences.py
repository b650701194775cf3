"""Feedback classification and preference pairs, as one projection over feedback joined with its run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.hashing import content_hash
from assaylake.functions.privacy import preference_privacy_hit

# ---- fixed values -----------------------------------------------------------------
HINTS = {
    "factual": "factual_correction", "factual_correction": "factual_correction", "style": "style_preference",
    "style_preference": "style_preference", "schedule": "schedule_detail_change", "schedule_detail_change": "schedule_detail_change",
    "repair": "execution_repair", "execution_repair": "execution_repair", "intent_change": "changed_intent", "intent": "changed_intent",
    "true_correction": "true_correction", "correction": "true_correction",
}
TRAINABLE = ("true_correction", "factual_correction", "execution_repair")
EXCLUDED = ("changed_intent", "style_preference", "schedule_detail_change")
REVIEW_RULES = [("propose", "NEEDS_REVIEW", "PROPOSED"), ("reject", "NEEDS_REVIEW", "EXCLUDED"), ("exclude", "NEEDS_REVIEW", "EXCLUDED"),
                ("approve", "PROPOSED", "APPROVED"), ("reject", "PROPOSED", "REJECTED"), ("reject", "APPROVED", "REJECTED")]


def classify_feedback(feedback: DataFrame) -> DataFrame:
    """Adds category, confidence and reasons; expects run_failed from the run's events."""
    hint = F.lower(F.trim(F.coalesce("hint", F.lit(""))))
    mapped = F.lit(None).cast("string")
    for k, v in HINTS.items():
        mapped = F.when(hint == k, v).otherwise(mapped)
    failed = F.coalesce("run_failed", F.lit(False))
    other = F.coalesce("same_request", F.lit(True)) == F.lit(False)
    intent = F.coalesce(F.col("feedback_type") == "intent_change", F.lit(False))
    repair = failed & F.coalesce(F.col("feedback_type").isin("edit", "correction"), F.lit(False))
    cases = [
        (other, "changed_intent", 0.9, F.lit("same_request_false")), (intent, "changed_intent", 0.9, F.lit("feedback_type_intent_change")),
        (mapped.isNotNull(), None, 0.75, F.concat(F.lit("hint_"), hint)), (hint != "", "ambiguous", 0.4, F.concat(F.lit("unknown_hint_"), hint)),
        (repair, "execution_repair", 0.75, F.lit("run_failures_with_edit"))]
    category, conf, why = F.lit("ambiguous"), F.lit(0.35), F.lit("no_hint_or_evidence")
    for cond, cat, c, reason in reversed(cases):
        category = F.when(cond, mapped if cat is None else F.lit(cat)).otherwise(category)
        conf = F.when(cond, F.lit(c)).otherwise(conf)
        why = F.when(cond, reason).otherwise(why)
    df = feedback.withColumns({"category": category, "_c": conf, "_why": why})
    support = (F.col("category") == "execution_repair") & failed
    drift = F.coalesce(F.col("minutes_after_output") > 60, F.lit(False))
    far = F.coalesce((F.col("correction_distance") >= 0.8) & ~F.isnan("correction_distance") & (F.col("correction_distance") < F.lit(float("inf"))), F.lit(False))
    value = F.col("_c") + F.when(support, 0.1).otherwise(0.0) - F.when(drift, 0.2).otherwise(0.0) - F.when(far, 0.15).otherwise(0.0)
    value = F.when(F.col("category") == "ambiguous", F.least(value, F.lit(0.4))).otherwise(value)
    reasons = F.array_compact(F.array(F.col("_why"), F.when(support, "supports_execution_repair"), F.when(drift, "context_drift_gt_60m"), F.when(far, "high_correction_distance")))
    return df.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(value, 4))), "reasons": reasons}).drop("_c", "_why")


def extract_preference_pairs(classified: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Initial state of each pair; the first gate that applies decides."""
    chosen = F.coalesce("sanitized_corrected_value", F.lit(""))
    rejected = F.coalesce("sanitized_original_value", F.lit(""))
    low = F.col("confidence") < min_confidence
    amb = F.col("category") == "ambiguous"
    state = (F.when(preference_privacy_hit(chosen) | preference_privacy_hit(rejected), "EXCLUDED:privacy").when(F.trim(chosen) == "", "EXCLUDED:missing_chosen_text")
             .when(F.trim(rejected) == "", "EXCLUDED:missing_rejected_text").when(F.col("category").isin(*EXCLUDED), F.concat(F.lit("EXCLUDED:excluded_category_"), "category"))
             .when(amb | low, F.concat(F.lit("NEEDS_REVIEW:"), F.concat_ws("+", F.when(amb, "ambiguous_category"), F.when(low, "low_confidence"))))
             .when(F.col("category").isin(*TRAINABLE), "PROPOSED:high_confidence_trainable").otherwise("EXCLUDED:unknown_category"))
    df = classified.withColumns({"chosen": chosen, "rejected": rejected, "_s": state})
    return df.withColumns({
        "pair_id": F.concat(F.lit("pair-"), F.substring(content_hash("feedback_id", "run_id"), 1, 20)), "prompt_or_context_ref": F.concat(F.lit("traj-"), "run_id"),
        "initial_state": F.substring_index("_s", ":", 1), "gate": F.substring_index("_s", ":", -1)}).drop("_s")


def preference_readiness(pairs: DataFrame, min_pairs: int = 500, target: str | None = None) -> DataFrame:
    """Counts by state and category, and one verdict row with its reasons."""
    counts = (pairs.select(F.explode(F.array(F.struct(F.lit("state").alias("kind"), F.col("state").alias("key")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")))).alias("x"))
              .groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("n")))
    has_target = bool(target and target.strip())
    v = pairs.agg(F.count_if(F.col("state") == "APPROVED").alias("n"))
    few = F.col("n") < min_pairs
    text = F.concat_ws(",", F.when(few, "approved_below_minimum"), F.lit(None if has_target else "missing_trainable_target").cast("string"))
    return counts.unionByName(v.select(F.lit("verdict").alias("kind"), F.when(few | F.lit(not has_target), text).otherwise("justified").alias("key"), "n"))
