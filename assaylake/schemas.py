"""Contracts: fixed values that results depend on, and the table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------
DOMAINS = (
    "ambiguity", "automation", "calendar", "communication", "conversation_memory", "document_extraction",
    "expenses", "multilingual", "privacy", "shopping", "source_reasoning", "support", "tabular_analysis",
    "task_planning", "travel",
)
SPLITS = ("train", "calibration", "holdout")
SPLIT_ROLES = {"train": "train", "calibration": "validation", "holdout": "holdout"}
ADVERSARIAL_TAGS = ("adversarial", "red_team")
EVALUATION_METHODS = ("exact_json", "exact_text", "rubric", "schema", "imported")
ATTEMPT_STATUSES = (
    "success", "refusal", "provider_failure", "timeout", "invalid_provider_response", "malformed_output",
    "cancelled", "partial", "imported_invalid", "grading_failure", "infrastructure_failure",
)
RUN_STATUSES = ("created", "running", "completed", "partial", "failed", "cancelled")
REVIEW_DECISIONS = ("accept", "reject", "tie", "abstain")
MESSAGE_ROLES = ("system", "user", "assistant", "tool")
FEEDBACK_TYPES = ("edit", "correction", "rating", "retry", "abandon", "accept", "intent_change", "other")
CANDIDATE_ROLES = ("TRAIN_ONLY", "REGRESSION", "VALIDATION", "HOLDOUT", "ADVERSARIAL")
CRITICAL_DOMAINS = ("privacy", "automation", "expenses")
CRITICAL_GATES = ("oracle_isolation", "harness_oracle_isolation", "core_regression", "critical_failures", "holdout")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
EVENT_TYPE_PATTERN = r"^[a-z][a-z_]{1,63}$"
TELEMETRY_SCHEMA = "TelemetryBatchV1"
TELEMETRY_MAJOR = "1"
FEATURE_SCHEMA_VERSION = "routing-features.v1"
REWARD_SCHEMA_VERSION = "reward.v1"

# Lifecycle edges per entity kind; an empty from-state is the first transition.
STATE_EDGES = {
    "evaluation_candidate": [
        ("", "NEW"), ("NEW", "VALIDATED"), ("NEW", "REJECTED"), ("VALIDATED", "REJECTED"), ("VALIDATED", "APPROVED"),
        ("APPROVED", "REJECTED"),
    ] + [("APPROVED", role) for role in CANDIDATE_ROLES],
    "preference_pair": [
        ("", "PROPOSED"), ("", "NEEDS_REVIEW"), ("", "EXCLUDED"), ("NEEDS_REVIEW", "PROPOSED"),
        ("NEEDS_REVIEW", "EXCLUDED"), ("PROPOSED", "APPROVED"), ("PROPOSED", "REJECTED"), ("APPROVED", "REJECTED"),
    ],
    "policy_candidate": [
        ("", "DRAFT"), ("DRAFT", "TRAINED"), ("TRAINED", "VERIFIED"), ("TRAINED", "REJECTED"),
        ("VERIFIED", "APPROVED"), ("VERIFIED", "REJECTED"), ("APPROVED", "EXPORTED"), ("APPROVED", "REJECTED"),
    ],
}

# ---- table schemas --------------------------------------------------------------
ATTEMPT_TEXT = (
    "attempt_id", "case_id", "prompt_hash", "response_text", "provider", "model", "status", "started_at",
    "completed_at", "error", "completion_latency_ms", "input_tokens", "output_tokens", "cost_minor", "currency",
)
ATTEMPT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ATTEMPT_TEXT])

CASE_SCHEMA = ("""
 case_id string, family_id string, split string, complexity_level bigint, domain string, language string,
 tags array<string>, messages array<struct<role:string,content:string>>,
 evaluation struct<method:string,reference_answer:string,rubric:array<struct<criterion:string,weight:double>>,critical_failures:array<string>>,
 fixture_policy string, suite_version string, provenance struct<origin:string,real_personal_data:boolean>,
 limits struct<max_output_tokens:bigint,max_tool_calls:bigint>
""")

CATALOG_SCHEMA = ("""
 id string, name string, context_length bigint, supported_parameters array<string>,
 pricing struct<prompt:string,completion:string>
""")
# criteria that say nothing about a case (fixed values)
GENERIC_CRITERIA = ("valid json", "valid exact json", "parses as json array")
