"""Declarative routing features, compiled to one array expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.schemas import DOMAINS

OPTIONAL = ("slo",)


def feature_spec(tiers: Sequence[str], domains: Sequence[str] = DOMAINS) -> list[tuple]:
    """(name, source column, transform, argument) in vector order; a label that is not listed counts as "other"."""
    return (
        [("bias", None, "constant", 1.0)]
        + [(f"tier={v}", "tier", "equals", v) for v in tiers] + [("tier=other", "tier", "not_in", tuple(tiers))]
        + [(f"task_domain={v}", "task_domain", "equals", v) for v in domains] + [("task_domain=other", "task_domain", "not_in", tuple(domains))]
        + [("log_input_tokens", "tokens", "log1p_scaled", 200_000), ("context_utilization", "ratio", "clip01", None), ("tool_count", "tool_count", "capped_ratio", 10)]
        + [(n, c, "bool", None) for n, c in (("requires_structured_output", "structured"), ("requires_tools", "tools"), ("requires_memory", "memory"), ("requires_external_data", "external"))]
        + [("conversation_depth", "depth", "capped_ratio", 50), ("retry_number", "retry_number", "capped_ratio", 5), ("previous_tool_failure", "prev_tool_failure", "bool", None),
           ("has_latency_slo", "slo", "present", None), ("latency_slo", "slo", "capped_ratio", 30_000)]
    )


def _one(source: str | None, transform: str, arg) -> Column:
    if transform == "constant":
        return F.lit(float(arg))
    c = F.col(source)
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    out = {
        "equals": lambda: flag(c == arg), "not_in": lambda: flag(~c.isin(*arg)), "bool": lambda: flag(c), "present": lambda: flag(c.isNotNull()),
        "clip01": lambda: clip(c.cast("double")), "capped_ratio": lambda: clip(c.cast("double") / float(arg or 1)),
        "log1p_scaled": lambda: F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), c.cast("double"))) / F.log1p(F.lit(float(arg or 1)))),
    }[transform]()
    return F.when(c.isNull(), 0.0).otherwise(out) if source in OPTIONAL and transform != "present" else out


def routing_features(spec: list[tuple]) -> Column:
    """Feature vector of a spec; null where a required source is missing."""
    required = sorted({s for _n, s, _t, _a in spec if s and s not in OPTIONAL})
    missing = F.lit(False)
    for r in required:
        missing = missing | F.col(r).isNull()
    return F.when(~missing, F.array(*[_one(s, tr, a) for _n, s, tr, a in spec]))
