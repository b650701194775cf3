"""Lifecycle logs: current state, history, transition checks, and decisions applied in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaylake.functions.reasons import reasons
from assaylake.schemas import STATE_EDGES


def edge_allowed(kind: str, from_state: Column, to_state: Column) -> Column:
    """Whether an edge is in the machine of an entity kind; null from-state means the first one."""
    edge = F.concat_ws(">", F.coalesce(from_state, F.lit("")), to_state)
    return edge.isin(*[f"{a}>{b}" for a, b in STATE_EDGES[kind]])


def latest_state(transitions: DataFrame, key: str = "entity_id", order: str = "transition_id") -> DataFrame:
    """Current state per entity: one struct maximum, combined before the shuffle."""
    return transitions.groupBy(key).agg(F.max(F.struct(order, "to_state")).alias("m")).select(key, F.col("m.to_state").alias("state"))


def state_history(transitions: DataFrame, key: str = "entity_id", order: str = "transition_id") -> DataFrame:
    """Each transition with the state before it; an entity's history is short by its machine."""
    w = W.partitionBy(key).orderBy(order)
    return transitions.withColumn("previous_state", F.lag("to_state").over(w)).withColumn("step", F.row_number().over(w))


def validate_transitions(transitions: DataFrame, kind: str, key: str = "entity_id", order: str = "transition_id") -> DataFrame:
    h = state_history(transitions, key, order)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return h.withColumn("reasons", reasons([
        ("edge_not_allowed", ~edge_allowed(kind, F.col("from_state"), F.col("to_state"))),
        ("from_is_not_previous", ~F.col("from_state").eqNullSafe(F.col("previous_state"))),
        ("missing_actor", blank("actor")), ("missing_reason", blank("reason"))]))


def filter_by_state(entities: DataFrame, transitions: DataFrame, key: str, state: str | None = None) -> DataFrame:
    s = latest_state(transitions).withColumnRenamed("entity_id", key)
    out = entities.join(s, key, "left")
    return out if state is None else out.filter(F.col("state") == state)


def apply_decisions(states: DataFrame, decisions: DataFrame, rules: list[tuple[str, str, str]], depth: int, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """Apply review decisions in order; an illegal one is reported and changes nothing.

    rules are (decision, from_state, to_state) and ``depth`` is the longest path through them.
    Each round finds, per entity, the first decision that is legal in its present state: a
    minimum that combines before the shuffle, so an entity with very many decisions is never
    gathered anywhere. Afterwards each decision is placed between these few state changes.
    """
    cur = states.select(key, F.col("state").alias("s0"), F.lit(-1).cast("bigint").alias("t0"))
    for r in range(depth):
        state, since = F.col(f"s{r}"), F.col(f"t{r}")
        legal = decisions.join(cur, key).filter(F.col(order) > since).withColumn("_to", _next(rules, state, F.col("decision"))).filter("_to IS NOT NULL")
        first = legal.groupBy(key).agg(F.min(F.struct(F.col(order).cast("bigint").alias("t"), F.col("_to").alias("s"))).alias("m"))
        cur = cur.join(first.select(key, F.col("m.t").alias(f"t{r + 1}"), F.col("m.s").alias(f"s{r + 1}")), key, "left")
    j = decisions.join(cur, key, "left")
    met, hit = F.col("s0"), F.lit(False)
    new = F.lit(None).cast("string")
    for r in range(1, depth + 1):
        met = F.when(F.col(f"t{r}") < F.col(order), F.col(f"s{r}")).otherwise(met)
        new = F.when(F.col(f"t{r}") == F.col(order), F.col(f"s{r}")).otherwise(new)
        hit = hit | F.coalesce(F.col(f"t{r}") == F.col(order), F.lit(False))
    return j.select(key, order, "decision", met.alias("met_state"), F.coalesce(new, met).alias("new_state"), hit.alias("accepted"))


def _next(rules: list[tuple[str, str, str]], state: Column, decision: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, a, b in rules:
        out = F.when((decision == name) & (state == a), b).otherwise(out)
    return out
