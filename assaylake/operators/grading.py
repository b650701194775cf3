"""Deterministic graders as column expressions; semantic methods abstain with a reason."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import jsonvals as J
from assaylake.functions import text as X
from assaylake.functions.hashing import content_hash
from assaylake.functions.plan import computed_once
from assaylake.functions.reasons import let


Grader = Callable[[Column, Column], Column]  # (response text, reference answer) -> verdict
_GRADERS: dict[str, Grader] = {}


def register_grader(method: str, build: Grader) -> None:
    """Grade every attempt whose case names ``method`` by a builder of verdict columns; it may call an Arrow function.

    The builder gives ``verdict(passed, reason)``; a null ``passed`` abstains. An Arrow function sees every
    row, null texts and other methods too. A method has one grader.
    """
    if method in _GRADERS or method == "schema":
        raise ValueError(f"method {method} already has a grader")
    _GRADERS[method] = build


def verdict(passed: Column, reason: Column) -> Column:
    """struct(passed, score, failure_reason)"""
    score = F.when(passed, 1.0).when(~passed, 0.0)
    return F.struct(passed.alias("passed"), score.alias("score"), reason.alias("failure_reason"))


def _fail(passed: Column, text: str) -> Column:
    """Verdict of a condition that is evaluated once per row."""
    return let(passed, lambda p: verdict(p, F.when(~p, text)))


def _abstain(text: str | Column) -> Column:
    return verdict(F.lit(None).cast("boolean"), F.lit(text) if isinstance(text, str) else text)


def grade_exact_text(candidate: Column, reference: Column) -> Column:
    return _fail(X.strip(candidate) == X.strip(reference), "text does not exactly match reference")


def grade_normalized_text(candidate: Column, reference: Column) -> Column:
    return _fail(X.normalize_text(candidate) == X.normalize_text(reference), "normalized text does not match reference")


def grade_exact_json(candidate: Column, reference: Column, tolerance: float = 0.0) -> Column:
    return grade_canonical_json(candidate, J.canonical_json(reference), tolerance)


def grade_canonical_json(candidate: Column, reference: Column, tolerance: float = 0.0) -> Column:
    """``grade_exact_json`` against a reference in canonical form, null if it is not valid JSON."""
    def judge(pair: Column) -> Column:
        return (F.when(pair["c"].isNull(), verdict(F.lit(False), F.lit("candidate output is not valid JSON")))
                .when(pair["r"].isNull(), _abstain("reference answer is not valid JSON"))
                .otherwise(_fail(J.canonical_equal(pair["c"], pair["r"], tolerance), "JSON value differs from reference")))

    return let(F.struct(J.canonical_json(candidate).alias("c"), reference.alias("r")), judge)


def grade_schema(candidate: Column, schema: dict | None, extra_keys: bool = False) -> Column:
    invalid = _abstain("candidate output is not valid JSON")
    if schema is None:
        return F.when(J.parse_strict(candidate).isNull(), invalid).otherwise(_abstain("schema definition is unavailable"))
    by_size = lambda bad: verdict(F.size(bad) == 0, F.when(F.size(bad) > 0, F.array_join(bad, "; ")))
    judge = lambda v: F.when(v.isNull(), invalid).otherwise(let(J.schema_violations(v, schema, extra_keys=extra_keys), by_size))
    return let(J.parse_strict(candidate), judge)


def grade_arithmetic(candidate: Column, expected: Column, tolerance: float = 0.0) -> Column:
    last = F.try_element_at(X.numbers(candidate), F.lit(-1)).try_cast("decimal(38,10)")
    passed = F.abs((last - expected.cast("decimal(38,10)")).cast("double")) <= tolerance
    return F.when(last.isNull(), _abstain("no numeric result found")).otherwise(_fail(passed, "reported numeric result is incorrect"))


def grade_required_fields(candidate: Column, required: list[str]) -> Column:
    def judge(v: Column) -> Column:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        has_all = lambda f: F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(f))) == 0
        return F.when(v.isNull(), _abstain("candidate output is not valid JSON")).otherwise(
            let(fields, lambda f: F.when(f.isNull(), verdict(F.lit(False), F.lit("candidate JSON is not an object")))
                .otherwise(_fail(has_all(f), "required fields are missing"))))

    return let(J.parse_strict(candidate), judge)


for _method, _build in (("exact_json", grade_exact_json), ("exact_text", grade_exact_text),
                        ("rubric", lambda _text, _reference: _abstain("semantic rubric requires blind human review or calibrated judge"))):
    register_grader(_method, _build)


def grade_attempts(attempts: DataFrame, schemas: dict[str, dict] | None = None, graders: Mapping[str, Grader] | None = None) -> DataFrame:
    """Dispatch on the case's method; adds passed, score, failure_reason, grader_id, grade_id.

    ``schemas`` maps a value of the ``schema_name`` column to its JSON schema. ``graders`` add to the registered ones, or
    take their place, for this call. A column ``reference_json`` holds the canonical form of exact_json's references, worked out
    once per case; without it every attempt works out its own.
    """
    method, text, ref = F.col("method"), F.col("response_text"), F.col("reference_answer")
    by_schema = grade_schema(text, None)
    for name, schema in (schemas or {}).items():
        by_schema = F.when(F.col("schema_name") == name, grade_schema(text, schema)).otherwise(by_schema)
    known = {**_GRADERS, **(graders or {})}
    if "reference_json" in attempts.columns and known.get("exact_json") is grade_exact_json:
        known["exact_json"] = lambda candidate, _reference: grade_canonical_json(candidate, F.col("reference_json"))
    found = F.when(F.col("status") != "success", _abstain(F.concat(F.lit("attempt status is "), F.col("status")))).when(text.isNull(), _abstain("successful attempt has no response text"))
    for name, build in known.items():
        found = found.when(method == name, build(text, ref))
    if "schema" not in known:
        found = found.when(method == "schema", by_schema)
    found = found.otherwise(_abstain(F.concat(F.lit("evaluation method "), method, F.lit(" is not deterministic"))))
    grader = (F.when(F.col("status") != "success", "attempt_status").when(text.isNull(), "missing_output")
              .when(method.isin("schema", *known), method).otherwise("unsupported_method"))
    return (computed_once(attempts, "_v", found).withColumn("grader_id", grader).select("*", "_v.*").drop("_v", "reference_json")
            .withColumn("grade_id", F.concat(F.lit("grade-"), F.substring(content_hash("attempt_id", "grader_id", "failure_reason"), 1, 32))))


def ungraded_attempts(attempts: DataFrame, grades: DataFrame, cases: DataFrame) -> DataFrame:
    """Attempts of known cases that have no grade yet."""
    return attempts.join(grades.select("attempt_id"), "attempt_id", "left_anti").join(cases.select("case_id"), "case_id", "left_semi")


def classify_failure(df: DataFrame) -> DataFrame:
    """Coarse failure category from grade and status; the first matching rule wins."""
    r = F.lower(F.coalesce("failure_reason", F.lit("")))

    def has(*words: str) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | r.contains(w)
        return cond

    return df.withColumn("failure_category", F.when(F.col("passed"), F.lit(None))
                         .when(F.col("passed").isNull(), "abstained")
                         .when(F.col("status") != "success", "provider_error")
                         .when(has("not valid json", "invalid json", "parse_error"), "invalid_json")
                         .when(has("json"), "json_mismatch")
                         .when(has("match reference", "text"), "text_mismatch")
                         .when(has("provider", "status", "timeout"), "provider_error")
                         .otherwise("other"))


def grade_label(passed: Column, has_grade: Column) -> Column:
    return (F.when(~has_grade, "ungraded").when(passed.isNull(), "needs review").when(passed, "passed").otherwise("failed"))
