"""Validation as reason codes: rows are labelled and quarantined, never dropped or coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaylake import schemas as S
from assaylake.functions import jsonvals as J
from assaylake.functions.reasons import let, reasons
from assaylake.functions.variants import Doc

RUN_TEXTS = ("request_id", "task_domain", "tier", "harness_version", "prompt_version", "policy_version",
             "feature_schema_version", "status")
CONTEXT_FIELDS = {
    "tier": "string", "task_domain": "string", "estimated_input_tokens": "integer", "context_utilization_ratio": "number",
    "tool_count": "integer", "requires_structured_output": "boolean", "requires_tools": "boolean",
    "requires_memory": "boolean", "requires_external_data": "boolean", "conversation_depth": "integer",
    "retry_number": "integer", "previous_tool_failure": "boolean",
}
CONTEXT_OPTIONAL = {"latency_slo_ms": "integer", "previous_structured_output_failure": "boolean"}
OUTCOME_FLAGS = ("completed", "first_shot_success", "structured_output_valid", "tool_success", "user_retry_signal",
                 "user_abandon_signal", "user_accept_signal", "user_correction_signal", "critical_failure")
DECISION_KEYS = ("decision_id", "selected_provider", "selected_model", "policy_version", "selection_probability",
                 "exploration", "shadow", "eligible_models", "feature_schema_version", "created_at")
CHILD_KEYS = {
    "attempts": ("attempt_id", "provider", "model", "success", "retry_number"),
    "tool_events": ("event_id", "tool_name", "schema_valid", "execution_success"),
    "validation_events": ("event_id", "validator", "passed"),
    "feedback": ("feedback_id", "feedback_type", "created_at"),
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _id_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(S.ID_PATTERN), F.lit(False))


def envelope_reasons(doc: Column) -> Column:
    """Batch-level reject codes of a batch document."""
    d = Doc(doc)
    p = d["producer"]
    registry = d.items("model_registry")

    def entry_ok(e: Column) -> Column:
        m = Doc(e)
        price = lambda n: m.is_(n, "number") & (m.num(n) >= 0)
        return F.coalesce(
            m.text("provider") & m.text("model") & m.is_("max_context_tokens", "integer") & (m.num("max_context_tokens") > 0)
            & m.is_("supports_tools", "boolean") & m.is_("supports_structured_output", "boolean")
            & price("estimated_input_cost_per_token") & price("estimated_output_cost_per_token"), F.lit(False))

    actions = F.transform(registry, lambda e: F.concat_ws("/", Doc(e).str("provider"), Doc(e).str("model")))
    version = F.split(F.coalesce(d.str("schema_version"), F.lit("")), r"\.")[0]
    return reasons([
        ("batch.unsupported_schema", ~F.coalesce(d.str("schema") == S.TELEMETRY_SCHEMA, F.lit(False))),
        ("batch.unsupported_schema_version", version != S.TELEMETRY_MAJOR),
        ("batch.invalid_batch_id", ~_id_ok(d.str("batch_id"))),
        ("batch.invalid_generated_at", ~d.timestamp("generated_at")),
        ("batch.invalid_producer", ~(p.text("repo") & p.text("version"))),
        ("batch.missing_feature_schema", ~d.text("feature_schema_version")),
        ("batch.invalid_window", d.given("window") & ~d.is_("window", "object")),
        ("batch.empty_model_registry", registry.isNull() | (F.size(registry) == 0)),
        ("batch.invalid_registry_entry", F.exists(registry, lambda e: ~entry_ok(e))),
        ("batch.duplicate_registry_action", F.size(F.array_distinct(actions)) < F.size(registry)),
        ("batch.runs_not_list", ~d.is_("runs", "array")),
    ])


def decision_reasons(run: Column) -> Column:
    """Codes of a run's decisions, indexed, and the exactly-one-live rule."""
    d = Doc(run)
    decisions = d.items("decisions")

    def shape_codes(item: Column, i: Column) -> Column:
        return Doc.bind(item, "$", DECISION_KEYS, lambda m: codes_of(m, i))

    def codes_of(m: Doc, i: Column) -> Column:
        at = lambda code: F.concat(F.lit("decisions["), i.cast("string"), F.lit("]."), F.lit(code))
        missing = F.array_compact(F.array(*[F.when(~m.present(k), at(f"missing_{k}")) for k in DECISION_KEYS]))
        prob, elig = m.num("selection_probability"), m.items("eligible_models")
        names = F.transform(elig, lambda e: F.when(J.is_kind(e, "string"), F.try_variant_get(e, "$", "string")))
        bad_elig = let(names, lambda ns: ns.isNull() | (F.size(ns) == 0) | F.exists(ns, lambda n: n.isNull() | (F.trim(n) == ""))
                       | (F.size(F.array_distinct(ns)) < F.size(ns)))
        rules = [(at("invalid_selection_probability"), let(prob, lambda x: x.isNull() | (x <= 0) | (x > 1))),
                 (at("invalid_eligible_models"), bad_elig)]
        rules += [(at(f"invalid_{k}"), ~m.text(k)) for k in ("decision_id", "selected_provider", "selected_model", "policy_version", "feature_schema_version")]
        rules += [(at(f"invalid_{k}"), ~m.is_(k, "boolean")) for k in ("exploration", "shadow")]
        rules += [(at("invalid_created_at"), ~m.timestamp("created_at"))]
        codes = reasons(rules)
        chosen = F.concat_ws("/", m.str("selected_provider"), m.str("selected_model"))
        last = F.when(~F.array_contains(names, chosen), F.array(at("selected_not_eligible"))).otherwise(_none())
        # shape first, then values, then eligibility: each stage only where the one before found nothing
        found = let(missing, lambda a: F.when(F.size(a) > 0, a).otherwise(let(codes, lambda b: F.when(F.size(b) > 0, b).otherwise(last))))
        return F.when(~m.is_object(), F.array(at("not_object"))).otherwise(found)

    live = lambda ds: F.size(F.filter(ds, lambda e: Doc(e).bool("shadow") == F.lit(False)))
    one_live = lambda ds: F.when(live(ds) != 1, F.array(F.lit("decisions.exactly_one_live_required"))).otherwise(_none())
    codes = lambda ds: let(F.flatten(F.transform(ds, shape_codes)), lambda c: F.when(F.size(c) > 0, c).otherwise(one_live(ds)))
    return let(decisions, lambda ds: F.when(ds.isNull() | (F.size(ds) == 0), F.array(F.lit("decisions.missing"))).otherwise(codes(ds)))


def child_reasons(run: Column) -> Column:
    """Codes of the nested event lists: lists of objects with their required keys."""
    d = Doc(run)
    out = []
    for name, required in CHILD_KEYS.items():
        out.append(_list_reasons(d, name, required))
    return F.concat(*out)


def _list_reasons(d: Doc, name: str, required: tuple[str, ...]) -> Column:
    def codes(m: Doc, i: Column) -> Column:
        at = lambda code: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{code}"))
        found = [F.when(~m.present(k), at(f"missing_{k}")) for k in required]
        if name == "feedback":
            found.append(F.when(~F.coalesce(m.str("feedback_type").isin(*S.FEEDBACK_TYPES), F.lit(False)), at("unknown_type")))
        return F.array_compact(F.array(*found))

    not_objects = F.array(F.lit(f"{name}.not_list_of_objects"))
    # one array of codes per item; null marks an item that is not an object
    each = lambda items: F.transform(items, lambda e, i: Doc.bind(e, "$", required, lambda m: F.when(m.is_object(), codes(m, i))))
    joined = lambda items: let(each(items), lambda cs: F.when(F.exists(cs, lambda c: c.isNull()), not_objects).otherwise(F.flatten(cs)))
    return let(d.items(name), lambda items: F.when(items.isNotNull(), joined(items)).when(d.present(name), not_objects).otherwise(_none()))


RUN_FIELDS = ("run_id", *RUN_TEXTS, "started_at", "completed_at")


def run_field_reasons(d: Doc, c: Doc, feature_schema: Column | str) -> Column:
    """Codes of a run's own fields and its routing context."""
    fs = F.lit(feature_schema) if isinstance(feature_schema, str) else feature_schema
    rules: list = [("run.invalid_run_id", ~_id_ok(d.str("run_id")))]
    rules += [(f"run.missing_{n}", ~d.text(n)) for n in RUN_TEXTS]
    rules += [
        ("run.feature_schema_mismatch", d.given("feature_schema_version") & ~F.coalesce(d.str("feature_schema_version") == fs, F.lit(False))),
        ("run.invalid_started_at", ~d.timestamp("started_at")),
        ("run.invalid_completed_at", d.given("completed_at") & ~d.timestamp("completed_at")),
        ("routing_context.missing", ~c.is_object()),
    ]
    for n, kind in CONTEXT_FIELDS.items():
        rules += [(f"routing_context.missing_{n}", ~c.present(n)), (f"routing_context.invalid_{n}", c.present(n) & ~c.is_(n, kind))]
    rules += [(f"routing_context.invalid_{n}", c.given(n) & ~c.is_(n, kind)) for n, kind in CONTEXT_OPTIONAL.items()]
    rules += [(f"routing_context.negative_{n}", c.num(n) < 0) for n in ("estimated_input_tokens", "tool_count", "conversation_depth", "retry_number")]
    ratio = c.num("context_utilization_ratio")
    same = lambda n: c.str(n).eqNullSafe(d.str(n))
    rules += [("routing_context.ratio_out_of_range", (ratio < 0) | (ratio > 1)),
              ("routing_context.run_mismatch", c.is_object() & ~(same("tier") & same("task_domain")))]
    return reasons(rules)


def outcome_reasons(o: Doc) -> Column:
    rules = [("outcome.missing", ~o.is_object())]
    rules += [(f"outcome.invalid_{n}", o.given(n) & ~o.is_(n, "boolean")) for n in OUTCOME_FLAGS]
    rules += [(f"outcome.invalid_{n}", o.given(n) & (o.num(n).isNull() | (o.num(n) < 0))) for n in ("retry_count", "final_latency_ms")]
    cost = o.num("final_cost")
    rules += [("outcome.invalid_final_cost_or_currency", o.given("final_cost") & (cost.isNull() | (cost < 0) | ~o.text("currency")))]
    return reasons(rules)


def run_reasons(run: Column, feature_schema: Column | str) -> Column:
    """Every schema code of a run document, deduplicated in order."""
    context = (*CONTEXT_FIELDS, *CONTEXT_OPTIONAL)
    outcome = (*OUTCOME_FLAGS, "retry_count", "final_latency_ms", "final_cost", "currency")
    head = lambda d: Doc.bind(run, "$.routing_context", context, lambda c: run_field_reasons(d, c, feature_schema))
    tail = Doc.bind(run, "$.outcome", outcome, outcome_reasons)
    codes = lambda d: F.array_distinct(F.concat(head(d), decision_reasons(run), child_reasons(run), tail))
    return Doc.bind(run, "$", RUN_FIELDS, lambda d: F.when(d.is_object(), codes(d)).otherwise(F.array(F.lit("run.not_object"))))


def actions_of(run: Column) -> Column:
    """Every action a run names, chosen or eligible."""
    decisions = Doc(run).items("decisions")
    chosen = F.transform(decisions, lambda e: F.concat_ws("/", Doc(e).str("selected_provider"), Doc(e).str("selected_model")))
    eligible = F.flatten(F.transform(decisions, lambda e: F.transform(
        Doc(e).items("eligible_models"), lambda a: F.try_variant_get(a, "$", "string"))))
    return F.array_distinct(F.concat(chosen, eligible))


def check_actions_in_registry(runs: DataFrame) -> DataFrame:
    """Adds the unknown actions of a run, given the batch's ``registry_actions`` array."""
    return runs.withColumn("unknown_actions", F.array_except(actions_of(F.col("run")), F.col("registry_actions")))


def quarantine_duplicate_runs(runs: DataFrame, order: str = "idx") -> DataFrame:
    """Second and later valid runs with one id in a batch get a code.

    A window group lies inside one batch document, so its size has the document's bound,
    and the expensive codes are computed once.
    """
    valid = F.size("reasons") == 0
    first = F.min(F.when(valid, F.col(order))).over(W.partitionBy("batch_id", "run_id"))
    dup = valid & (F.col(order) > F.col("_first"))
    return (runs.withColumn("_first", first)
            .withColumn("reasons", F.when(dup, F.array(F.lit("run.duplicate_run_id_in_batch"))).otherwise(F.col("reasons"))).drop("_first"))


def split_accept_quarantine(runs: DataFrame, privacy_reasons: Column, redacted: Column) -> DataFrame:
    """Merge schema and privacy verdicts; a rejected record is stored only in redacted form."""
    merged = F.array_sort(F.array_distinct(F.concat("reasons", privacy_reasons)))
    rejected = F.size(privacy_reasons) > 0
    return runs.withColumns({
        "status": F.when(F.size(merged) > 0, "quarantined").otherwise("accepted"),
        "privacy_status": F.when(rejected, "rejected").otherwise("clean"),
        "raw_sha256": F.sha2(F.col("raw"), 256),
        "record": F.when(rejected, redacted).otherwise(F.col("raw")),
        "reasons": merged,
    })


def quarantine_summary(records: DataFrame, by: str = "import_id") -> DataFrame:
    """Counts per import and reason, plus one line each for accepted and quarantined."""
    status = F.concat(F.lit("status:"), F.col("status"))
    lines = F.concat(F.array(status), F.transform("reasons", lambda r: F.concat(F.lit("reason:"), r)))
    return records.select(by, F.explode(lines).alias("item")).groupBy(by, "item").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- flat contracts
def attempt_reasons(df: DataFrame, expected_provider: str | None = None) -> DataFrame:
    """Codes of imported attempts; every value arrives as text and is tested, not coerced."""
    def num(n: str) -> Column:
        return F.col(n).try_cast("double")

    rules = [(f"missing_{n}", F.col(n).isNull()) for n in ("attempt_id", "case_id", "prompt_hash")]
    rules += [(f"invalid_{n}", F.col(n).isNotNull() & ~_id_ok(F.col(n))) for n in ("attempt_id", "case_id", "prompt_hash")]
    rules += [("missing_model", F.col("provider").isNull() | F.col("model").isNull())]
    if expected_provider is not None:
        rules += [("model_mismatch", F.col("provider") != expected_provider)]
    rules += [("invalid_status", ~F.coalesce("status", F.lit("success")).isin(*S.ATTEMPT_STATUSES))]
    for n in ("completion_latency_ms", "input_tokens", "output_tokens", "cost_minor"):
        rules += [(f"invalid_{n}", F.col(n).isNotNull() & (num(n).isNull() | (num(n) < 0)))]
    rules += [("missing_currency", F.col("cost_minor").isNotNull() & (F.coalesce("currency", F.lit("")) == ""))]
    return df.withColumn("reasons", reasons(rules))


def validate_attempts(df: DataFrame, run_cases: DataFrame, expected_provider: str | None = None) -> DataFrame:
    """Attempt codes, case membership, prompt hash against the run's case, and duplicates."""
    j = attempt_reasons(df, expected_provider).join(run_cases.select("case_id", F.col("prompt_hash").alias("_expected")), "case_id", "left")
    extra = reasons([("case_not_in_run", F.col("_expected").isNull()),
                     ("prompt_hash_mismatch", F.col("_expected").isNotNull() & (F.col("_expected") != F.col("prompt_hash")))])
    j = j.withColumn("reasons", F.concat("reasons", extra)).drop("_expected")
    first = j.filter(F.size("reasons") == 0).groupBy("attempt_id").agg(F.min("position").alias("_first"))
    dup = (F.size("reasons") == 0) & (F.col("position") > F.col("_first"))
    return (j.join(first, "attempt_id", "left")
            .withColumn("reasons", F.when(dup, F.array(F.lit("duplicate_attempt"))).otherwise(F.col("reasons"))).drop("_first"))


def case_reasons() -> Column:
    """Codes of a benchmark case with the case schema."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    msg_ok = lambda m: m["role"].isin(*S.MESSAGE_ROLES) & ~blank(m["content"])
    return reasons([
        ("invalid_case_id", ~_id_ok(F.col("case_id"))), ("invalid_family_id", ~_id_ok(F.col("family_id"))),
        ("missing_suite_version", blank(F.col("suite_version"))),
        ("invalid_split", ~F.coalesce(F.col("split").isin(*S.SPLITS), F.lit(False))),
        ("invalid_complexity_level", ~F.coalesce(F.col("complexity_level").between(1, 4), F.lit(False))),
        ("invalid_domain", ~F.coalesce(F.col("domain").isin(*S.DOMAINS), F.lit(False))),
        ("missing_language", blank(F.col("language"))),
        ("empty_messages", F.coalesce(F.size("messages"), F.lit(0)) <= 0),
        ("invalid_message", F.exists("messages", lambda m: ~F.coalesce(msg_ok(m), F.lit(False)))),
        ("unsupported_method", ~F.coalesce(F.col("evaluation.method").isin(*S.EVALUATION_METHODS), F.lit(False))),
        ("empty_rubric", F.coalesce(F.size("evaluation.rubric"), F.lit(0)) <= 0),
        ("invalid_rubric", F.exists("evaluation.rubric", lambda r: blank(r["criterion"]) | ~F.coalesce(r["weight"] > 0, F.lit(False)))),
        ("blank_critical_failure", F.exists("evaluation.critical_failures", blank)),
        ("missing_fixture_policy", blank(F.col("fixture_policy"))),
        ("missing_origin", blank(F.col("provenance.origin"))),
        ("invalid_real_personal_data", F.col("provenance.real_personal_data").isNull()),
        ("invalid_max_output_tokens", ~F.coalesce(F.col("limits.max_output_tokens") > 0, F.lit(False))),
        ("invalid_max_tool_calls", ~F.coalesce(F.col("limits.max_tool_calls") >= 0, F.lit(False))),
    ])


def validate_suite_integrity(cases: DataFrame) -> DataFrame:
    """Duplicate case ids, families spread over splits, and mixed suite versions, one row per finding."""
    dup = cases.groupBy("case_id").count().filter("count > 1").select(F.lit("duplicate_case_id").alias("finding"), F.col("case_id").alias("subject"), F.col("count").alias("n"))
    fam = (cases.groupBy("family_id").agg(F.count_distinct("split").alias("n")).filter("n > 1")
           .select(F.lit("family_in_several_splits").alias("finding"), F.col("family_id").alias("subject"), "n"))
    ver = (cases.agg(F.count_distinct("suite_version").alias("n")).filter("n > 1")
           .select(F.lit("several_suite_versions").alias("finding"), F.lit("suite").alias("subject"), "n"))
    return dup.unionByName(fam).unionByName(ver)


def validate_run_contract(runs: DataFrame) -> DataFrame:
    """Codes of run rows with case ids and a case id -> prompt hash map."""
    keys = F.map_keys("prompt_hashes")
    return runs.withColumn("reasons", reasons([
        ("invalid_run_id", ~_id_ok(F.col("run_id"))),
        ("no_cases", F.coalesce(F.size("case_ids"), F.lit(0)) <= 0),
        ("duplicate_case_ids", F.size(F.array_distinct("case_ids")) < F.size("case_ids")),
        ("invalid_case_id", F.exists("case_ids", lambda c: ~_id_ok(c))),
        ("hashes_do_not_cover_cases", (F.size("prompt_hashes") > 0) & ((F.size(F.array_except(keys, "case_ids")) > 0) | (F.size(F.array_except("case_ids", keys)) > 0))),
        ("invalid_prompt_hash", F.exists(F.map_values("prompt_hashes"), lambda h: ~F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False)))),
        ("invalid_status", ~F.coalesce(F.col("status").isin(*S.RUN_STATUSES), F.lit(False))),
    ]))


def validate_grades(grades: DataFrame) -> DataFrame:
    methods = S.EVALUATION_METHODS + ("human", "model_judge")
    return grades.withColumn("reasons", reasons([
        ("invalid_grade_id", ~_id_ok(F.col("grade_id"))), ("invalid_attempt_id", ~_id_ok(F.col("attempt_id"))),
        ("unsupported_method", ~F.coalesce(F.col("method").isin(*methods), F.lit(False))),
        ("score_out_of_range", F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)),
        ("abstention_without_reason", F.col("passed").isNull() & F.col("score").isNull() & (F.coalesce("failure_reason", F.lit("")) == "")),
    ]))


def validate_reviews(reviews: DataFrame) -> DataFrame:
    out = lambda n: F.isnan(n) | (F.col(n) < 0) | (F.col(n) > 1)
    return reviews.withColumn("reasons", reasons(
        [(f"invalid_{n}", ~_id_ok(F.col(n))) for n in ("review_id", "case_id", "reviewer_pseudonym")]
        + [("invalid_decision", ~F.coalesce(F.col("decision").isin(*S.REVIEW_DECISIONS), F.lit(False))),
           ("score_out_of_range", out("score")), ("confidence_out_of_range", out("confidence"))]))


def validate_events(events: DataFrame) -> DataFrame:
    return events.withColumn("reasons", reasons([
        ("invalid_event_type", ~F.coalesce(F.col("event_type").rlike(S.EVENT_TYPE_PATTERN), F.lit(False))),
        ("missing_timestamp", F.col("timestamp").isNull()), ("missing_message", F.col("message").isNull()),
        ("invalid_run_id", F.col("run_id").isNotNull() & ~_id_ok(F.col("run_id"))),
        ("invalid_duration", F.isnan("duration_ms") | (F.col("duration_ms") < 0)),
        ("invalid_cost", F.col("cost_minor") < 0),
    ]))


def validate_exploration(mode: str, epsilon: float) -> tuple[str, float]:
    """Driver-side check of exploration settings before a plan is built."""
    if mode not in ("none", "epsilon_greedy") or isinstance(epsilon, bool) or not 0.0 <= float(epsilon) <= 1.0:
        raise ValueError("exploration needs mode none or epsilon_greedy and epsilon between 0 and 1")
    return mode, float(epsilon)


def reconcile_fixture_results(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Returned results against the exported manifest, per artifact; any finding rejects the artifact.

    manifest(artifact_id, case_id, prompt_hash), results(artifact_id, case_id, prompt_hash, output_kind, position). All three
    sides have a row per case, so they are merged: Spark takes derived texts for smaller than they are and would send them
    through the driver.
    """
    first = results.groupBy("artifact_id", "case_id").agg(F.min("position").alias("_first"))
    j = (results.join(first.hint("merge"), ["artifact_id", "case_id"])
         .join(manifest.select("artifact_id", "case_id", F.col("prompt_hash").alias("_expected")).hint("merge"), ["artifact_id", "case_id"], "left"))
    code = (F.when(F.col("_expected").isNull(), "unknown_case").when(F.col("position") > F.col("_first"), "duplicate_case")
            .when(F.col("prompt_hash") != F.col("_expected"), "prompt_hash_mismatch").when(F.col("output_kind") == "other", "output_not_text"))
    found = j.select("artifact_id", "case_id", code.alias("finding")).filter("finding IS NOT NULL")
    missing = manifest.join(results.hint("merge"), ["artifact_id", "case_id"], "left_anti").select("artifact_id", "case_id", F.lit("missing_result").alias("finding"))
    return found.unionByName(missing)


def fixture_verdict(manifest: DataFrame, findings: DataFrame) -> DataFrame:
    per = findings.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("errors"))
    return (manifest.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("cases")).join(per, "artifact_id", "left")
            .withColumn("errors", F.coalesce("errors", F.lit(0))).withColumn("accepted", F.col("errors") == 0))


def evaluate_constraint_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per map: counts by status, required rows that are not satisfied, and the ready flag."""
    blocking = F.col("required_for_activation") & (F.col("status") != "satisfied")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated"), *[F.count_if(F.col("status") == s).alias(s) for s in ("satisfied", "unavailable", "blocking")],
        F.count_if(blocking).alias("required_blockers"), F.bool_and(~blocking).alias("activation_ready"))
