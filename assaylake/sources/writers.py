"""Writers. Every job writes partitioned files in parallel; a retried task rewrites its own file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import frozen

PREFERENCE_FIELDS = ("pair_id", "prompt_or_context_ref", "chosen", "rejected", "confidence", "reason", "source_run_id", "approval_state")


def csv_safe(c: Column) -> Column:
    """Null as empty text, and a quote before anything a spreadsheet would run as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_replace(text, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_report_csv_safe(df: DataFrame, path: str) -> None:
    name = lambda c: ("'" + c) if c.lstrip()[:1] in ("=", "+", "-", "@") else c
    df.select(*[csv_safe(F.col(f"`{c}`")).alias(name(c)) for c in sorted(df.columns)]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_candidate_jsonl(cases: DataFrame, path: str) -> None:
    """Candidate-safe columns only."""
    cases.select("case_id", "limits", "messages", "prompt_hash").write.json(path)


def write_preference_jsonl(pairs: DataFrame, states: DataFrame, path: str) -> None:
    """Pairs whose current state is APPROVED, in the contract's fields, ordered by pair id."""
    ok = pairs.join(states.filter("state = 'APPROVED'").select("pair_id"), "pair_id", "left_semi").withColumn("approval_state", F.lit("APPROVED"))
    ok.select(*PREFERENCE_FIELDS).orderBy("pair_id").write.json(path)


def write_json_documents(records: DataFrame, path: str, field: str, per_document: int = 500, compression: str | None = None) -> None:
    """Records as JSON documents of bounded size ({field: [...]}), one document per file.

    Row numbers are taken over kept files, so a task that runs again after a lost
    executor numbers the same rows the same way.
    """
    records = frozen(records, "numbered")
    rec = F.struct(*records.columns)
    chunk = F.expr(f"monotonically_increasing_id() div {per_document}")
    docs = records.withColumn("_c", chunk).groupBy("_c").agg(F.collect_list(rec).alias(field)).select(F.to_json(F.struct(field)).alias("value"), "_c")
    # one document per file: the folder name is the chunk
    docs.repartition(F.col("_c")).write.partitionBy("_c").text(path, compression=compression)
