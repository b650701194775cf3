"""Append with idempotence, import ledgers, usage reconciliation and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def classify_append(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Outcome per incoming key: insert, identical, conflict (also inside the batch).

    One aggregation brings the batch to one row per key, one join compares with what is stored.
    """
    batch = incoming.groupBy(key).agg(F.min(content).alias("content"), (F.min(content) != F.max(content)).alias("_mixed"), F.count(F.lit(1)).alias("copies"))
    old = existing.select(key, F.col(content).alias("_old"))
    return batch.join(old, key, "left").withColumn(
        "outcome", F.when(F.col("_mixed"), "conflict").when(F.col("_old").isNull(), "insert")
        .when(F.col("_old") == F.col("content"), "identical").otherwise("conflict")).drop("_mixed", "_old")


def append_evidence(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append (one per new key) and the outcome table; conflicts are never written."""
    outcome = classify_append(existing, incoming, key, content)
    new = outcome.filter("outcome = 'insert'").select(key)
    return incoming.dropDuplicates([key]).join(new, key, "left_semi"), outcome


def import_outcome(ledger: DataFrame, batches: DataFrame) -> DataFrame:
    """Per incoming batch: imported, duplicate, or conflict against the import ledger."""
    out = classify_append(ledger, batches, "batch_id", "checksum")
    return out.withColumn("outcome", F.when(F.col("outcome") == "insert", "imported").when(F.col("outcome") == "identical", "duplicate").otherwise("conflict"))


def usage_reconciliation(attempts: DataFrame, usage: DataFrame, run: str) -> DataFrame:
    """Provider usage against local attempts, per run; totals only when nothing is missing or ambiguous."""
    u = usage.groupBy(run, "attempt_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("cost_minor", "currency")).alias("_u")).select(run, "attempt_id", "copies", F.col("_u.cost_minor").alias("u_cost"), F.col("_u.currency").alias("u_cur"))
    a = attempts.select(run, "attempt_id", F.lit(1).alias("local"))
    j = a.join(u, [run, "attempt_id"], "full_outer")
    matched = F.col("local").isNotNull() & F.col("copies").isNotNull()
    g = j.groupBy(run).agg(
        F.count("local").alias("attempts"), F.count_if(matched).alias("matched"), F.count_if(F.col("copies").isNull()).alias("missing"),
        F.count_if(F.col("copies") > 1).alias("duplicate"), F.count_if(F.col("local").isNull()).alias("unknown"),
        F.count_if(matched & F.col("u_cur").isNull()).alias("missing_currency"),
        F.min(F.when(matched, F.col("u_cur"))).alias("_c0"), F.max(F.when(matched, F.col("u_cur"))).alias("_c1"),
        F.count_if(matched & F.col("u_cost").isNull()).alias("_nocost"), F.sum(F.when(matched, F.col("u_cost"))).alias("_sum"))
    one = F.coalesce(F.col("_c0") == F.col("_c1"), F.lit(True))
    known = F.when(F.col("_nocost") == 0, F.col("_sum"))
    complete = (F.col("missing") + F.col("duplicate") + F.col("unknown") + F.col("missing_currency") == 0) & one
    return g.select(run, "attempts", "matched", "missing", "duplicate", "unknown", "missing_currency", one.alias("currency_consistent"), complete.alias("complete"),
                    F.when(one & (F.col("missing_currency") == 0), known).alias("observed_cost_minor"), F.when(complete, known).alias("provider_cost_minor"))


def effective_cost() -> Column:
    """Released counts nothing, settled its actual cost, anything else its reservation."""
    return (F.when(F.col("state") == "released", F.lit(0)).when(F.col("state") == "settled", F.coalesce("actual_cost_minor", "reserved_cost_minor"))
            .otherwise(F.coalesce("reserved_cost_minor", F.lit(0))))


def budget_ledger_rollup(reservations: DataFrame, caps: DataFrame, run: str) -> DataFrame:
    g = reservations.groupBy(run).agg(
        F.count(F.lit(1)).alias("reservations"), F.count_if(F.col("state") != "released").alias("active"), F.sum(effective_cost()).alias("used_minor"),
        F.count_if(F.col("state") == "unknown").alias("unknown"))
    return g.join(caps, run).withColumn("remaining_minor", F.col("max_cost_minor") - F.col("used_minor")).withColumn("overrun", F.col("used_minor") > F.col("max_cost_minor"))


def budget_admission_replay(requests: DataFrame, run: str, order: str, released: Column | None = None) -> DataFrame:
    """In reservation order, whether each request fits its run's caps beside those admitted before it.

    A refused request uses nothing, so a later smaller one may fit. A null cap is no cap; under a cost cap an unknown
    cost is refused. ``released`` requests are judged but use nothing. Columns needed: cost_minor (not negative),
    max_requests, max_cost_minor; rows of equal ``order`` are judged by cost, unknown costs first.

    Every verdict depends on the one before, so a run is one chain: its rows are sorted by Spark (spilling if need be)
    and streamed through Arrow batches with two numbers as state. Memory does not depend on the length of a run.
    """
    gone = F.coalesce(released, F.lit(False)) if released is not None else F.lit(False)
    rows = requests.select("*", F.struct(F.col(run).alias("run"), F.col("cost_minor").cast("long").alias("cost"), F.col("max_requests").cast("long").alias("slots"),
                                         F.col("max_cost_minor").cast("long").alias("room"), gone.alias("gone")).alias("_asked"))
    names = [*requests.columns, "admitted"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, used = None, 0, 0
        for batch in batches:
            admitted = []
            for asked in batch.column(len(names) - 1).to_pylist():
                if asked["run"] != held:
                    held, count, used = asked["run"], 0, 0
                cost, slots, room = asked["cost"], asked["slots"], asked["room"]
                fits = (slots is None or count < slots) and (room is None or (cost is not None and used + cost <= room))
                if fits and not asked["gone"]:
                    count, used = count + 1, used + (cost or 0)
                admitted.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(admitted, pa.bool_())], names)

    out = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])
    return rows.repartition(run).sortWithinPartitions(run, order, "cost_minor").mapInArrow(fold, out)
