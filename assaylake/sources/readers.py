"""Readers of evidence files. Text stays text: nothing is inferred or coerced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.plan import computed_once
from assaylake.schemas import ATTEMPT_SCHEMA, CASE_SCHEMA, CATALOG_SCHEMA
from assaylake.sources.ranges import csv_records, json_records


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One row per file, each file one bounded JSON document; or one row per line that is not blank."""
    docs = spark.read.text(path, wholetext=not lines).select(F.trim("value").alias("doc"))
    return docs.filter("doc <> ''") if lines else docs


def _records(spark: SparkSession, path: str, field: str, bare_list: bool) -> DataFrame:
    r = json_records(spark, path, field)
    if not bare_list:
        r = r.filter(~F.col("bare"))
    return r.select(F.from_json("record", ATTEMPT_SCHEMA).alias("r")).select("r.*")


def read_attempts(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Attempts from jsonl, json (list or {"attempts": [...]}), csv with header, or an aggregate report ({"rows": [...]}).

    Every format is read by byte ranges, so one large file is spread over many tasks.
    """
    if fmt == "jsonl":
        return spark.read.schema(ATTEMPT_SCHEMA).option("mode", "FAILFAST").json(path)
    if fmt == "json":
        return _records(spark, path, "attempts", True)
    if fmt in ("aggregate-report", "aggregate_report"):
        return _records(spark, path, "rows", False)
    if fmt == "csv":
        return csv_records(spark, path)
    raise ValueError("format must be jsonl, json, csv, or aggregate-report")


def read_telemetry(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch documents as envelopes, runs with their index, and registry entries.

    A file is one batch document. Many small batches are better kept with ``lines``: one document a line, any number in a
    file, so that files and their listing do not grow with the batches.
    """
    d = computed_once(_documents(spark, path, lines), "batch", F.try_parse_json("doc"))
    field = lambda n, kind: F.try_variant_get("batch", f"$.{n}", kind)
    batch_id = field("batch_id", "string").alias("batch_id")
    envelopes = d.select(batch_id, *[field(n, "string").alias(n) for n in ("schema", "schema_version", "generated_at", "feature_schema_version")],
                         F.sha2("doc", 256).alias("checksum"), F.size(field("runs", "array<variant>")).alias("record_count"))
    runs = d.select(batch_id, F.posexplode(field("runs", "array<variant>")).alias("idx", "run"))
    registry = d.select(batch_id, F.posexplode(field("model_registry", "array<variant>")).alias("pos", "m")).select(
        "batch_id", "pos", *[F.try_variant_get("m", f"$.{n}", "string").alias(n) for n in ("provider", "model")],
        F.try_variant_get("m", "$.max_context_tokens", "bigint").alias("max_context_tokens"))
    return envelopes, runs, registry


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases of one suite version from JSON lines, and the content digest of the raw lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cases = lines.select(F.from_json("value", CASE_SCHEMA, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    row = F.conv(F.substring(F.sha2("value", 256), 1, 8), 16, 10).cast("bigint")
    digest = lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(row).alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))
    versions = cases.agg(F.count_distinct("suite_version").alias("suite_versions"))
    return cases, digest.join(versions)


def free_models(catalog: DataFrame, snapshot_date: str) -> DataFrame:
    """Catalog rows whose prompt and completion price both parse and are zero; a missing price is not free."""
    price = lambda n: F.coalesce(F.col(f"pricing.{n}"), F.lit("1")).try_cast("double")
    return catalog.filter((price("prompt") == 0) & (price("completion") == 0)).select(
        "id", F.coalesce("name", "id").alias("name"), F.coalesce("context_length", F.lit(0)).alias("context_length"), "supported_parameters",
        F.lit("unknown").alias("data_terms"), F.lit(False).alias("private_data_allowed"), F.lit(snapshot_date).alias("snapshot_date"))


def read_catalog_free(spark: SparkSession, path: str, snapshot_date: str) -> DataFrame:
    return free_models(spark.read.schema(CATALOG_SCHEMA).json(path), snapshot_date)
