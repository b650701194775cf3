"""Incremental jobs as Structured Streaming queries.

Each job takes a streaming DataFrame, writes to a folder with a checkpoint, and can be run
until the available input is used up. Sinks are safe to retry: a batch writes below its
own epoch, so a repeated epoch replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assaylake.functions.hashing import canonical
from assaylake.session import cut_lineage, shared_dir


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 16).parquet(folder)


def run_available(df: DataFrame, writer, mode: str, checkpoint: str) -> None:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(writer).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def epoch_sink(path: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def latest_epoch(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Update-mode output: the newest row per key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*key, "epoch")]
    return df.groupBy(*key).agg(F.max(F.struct("epoch", *rest)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])


# ---- intake ----------------------------------------------------------------------------------
#: Folders that the import ledger is dealt into by a hash of the batch id.
LEDGER_PARTS = 64
_DIGEST = ("d0", "d1", "d2", "d3")


def record_digest(*columns: str) -> list[Column]:
    """The sha256 of a record as four numbers of 60 bits; sums of them do not depend on the order of records."""
    text = F.sha2(canonical(*columns), 256)
    return [F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("long").alias(n) for i, n in enumerate(_DIGEST)]


def gather_batches(records: DataFrame) -> DataFrame:
    """``(batch_id, delivery, checksum, n)`` of every batch whose last record has come.

    records(batch_id, delivery, size, d0..d3), from ``record_digest``. A batch may come in any number of micro-batches and
    in any order: the state per delivery is a count and four sums, and goes when the batch is whole.
    """
    def gather(key, parts, state):
        n, sums = (state.get[0], list(state.get[1:])) if state.exists else (0, [0] * len(_DIGEST))
        size = None
        for part in parts:
            n += len(part)
            size = int(part["size"].iloc[0]) if len(part) else size
            sums = [(t + sum(part[d].tolist())) % (1 << 60) for t, d in zip(sums, _DIGEST, strict=True)]
        if size is not None and n >= size:
            state.remove()
            checksum = "-".join(f"{x:015x}" for x in sums) + f"-{n}"
            yield pd.DataFrame({"batch_id": [key[0]], "delivery": [key[1]], "checksum": [checksum], "n": [n]})
        else:
            state.update((n, *sums))

    sums = ", ".join(f"{d} long" for d in _DIGEST)
    return records.groupBy("batch_id", "delivery").applyInPandasWithState(gather, "batch_id string, delivery long, checksum string, n long", f"n long, {sums}", "append", "NoTimeout")


def stream_import(records: DataFrame, ledger: str, checkpoint: str) -> None:
    """Intake of batches: ``imported`` for a new id, ``duplicate`` for known content, ``conflict`` for other content under a known id.

    Of several deliveries of an id that become whole together, the first by ``delivery`` is judged first. Outcomes are rows
    of the ledger, in folders by a hash of the batch id, and only folders that a micro-batch touches are read. An epoch
    writes its own folder and does not read it, so a repeated epoch comes to the same result.
    """
    name = checkpoint.rstrip("/").split("/")[-1]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        whole = cut_lineage(batch.withColumn("part", F.pmod(F.xxhash64("batch_id"), F.lit(LEDGER_PARTS)).cast("int")))
        parts = [r[0] for r in whole.select("part").distinct().collect()]  # LEDGER_PARTS at most
        if not parts:
            return
        known = spark.createDataFrame([], "batch_id string, known string")
        try:
            seen = spark.read.parquet(ledger)
            own = (F.col("run") == name) & (F.col("epoch") == epoch)
            known = seen.filter((F.col("outcome") == "imported") & F.col("part").isin(parts) & ~own).select("batch_id", F.col("checksum").alias("known"))
        except AnalysisException as exc:  # no ledger yet
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        first = whole.groupBy("batch_id").agg(F.min(F.struct("delivery", "checksum")).alias("first"))
        j = whole.join(first, "batch_id").join(known, "batch_id", "left")
        valid = F.coalesce("known", "first.checksum")
        new = F.col("known").isNull() & (F.col("delivery") == F.col("first.delivery"))
        outcome = F.when(new, "imported").when(F.col("checksum") == valid, "duplicate").otherwise("conflict")
        j.select("batch_id", "delivery", "checksum", "n", outcome.alias("outcome"), "part").write.mode("overwrite").partitionBy("part").parquet(f"{ledger}/run={name}/epoch={epoch}")

    run_available(gather_batches(records), write, "append", checkpoint)


# ---- novelty ---------------------------------------------------------------------------------
class PriorCounts(StatefulProcessor):
    """Per key the number of rows so far; each row gets the number before it. A micro-batch's rows of a key come in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[["kind", "k", "seq"]] for part in rows]).sort_values("seq", ignore_index=True)
        before = self.count.get()[0] if self.count.exists() else 0
        self.count.update((before + len(new),))
        yield new.assign(prior=range(before, before + len(new)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.count.update((int(initialState["n"].iloc[0]),))

    def close(self) -> None:
        pass


def novelty_keys(facts: DataFrame) -> DataFrame:
    """What novelty looks up of a run, as rows ``(kind, key, k, seq)``: domain, failure signature and tools."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = F.array(pair("domain", F.col("task_domain")), pair("failure", canonical("error_key", "completed")), pair("tools", F.col("tool_key")))
    return facts.select("k", "seq", F.explode(keys).alias("x")).select("x.kind", "x.key", "k", "seq")


def prior_counts(keys: DataFrame, start: DataFrame) -> DataFrame:
    """``(kind, k, seq, prior)`` for a stream of ``novelty_keys``, from the counts ``start(kind, key, n)`` of stored evidence.

    Runs must arrive in the order of ``seq`` between micro-batches; inside one they may be in any order. Keeps its state in
    RocksDB: ``spark.sql.streaming.stateStore.providerClass`` must name that provider.
    """
    return keys.groupBy("kind", "key").transformWithStateInPandas(PriorCounts(), "kind string, k long, seq long, prior long", "append", "none", start.groupBy("kind", "key"))


def novelty_flags(facts: DataFrame, priors: DataFrame) -> DataFrame:
    """Domain rarity, new failure signature and new tool combination of each run from its prior counts."""
    wide = priors.groupBy("k").agg(*[F.max(F.when(F.col("kind") == kind, F.col("prior"))).alias(f"prior_{kind}") for kind in ("domain", "failure", "tools")])
    clean = (F.col("error_key") == "") & F.coalesce("completed", F.lit(False))
    flag = lambda yes: F.when(yes, 1.0).otherwise(0.0)
    return facts.join(wide, "k").select("k", (5.0 / (F.col("prior_domain") + 5.0)).alias("domain_rarity"), flag(~clean & (F.col("prior_failure") == 0)).alias("new_failure_signature"),
                                        flag((F.col("tool_key") != "") & (F.col("prior_tools") == 0)).alias("new_tool_combination"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state provider that arbitrary state needs, set for the queries started inside."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    last = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, last) if last else spark.conf.unset(setting)


# ---- events ----------------------------------------------------------------------------------
def event_progress(events: DataFrame) -> DataFrame:
    """Per subject: events, failures, spent value and the last message, kept in streaming state."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max(F.struct("event_id", "event_type")).alias("_last"),
        F.min("ts").alias("started"), F.max("ts").alias("latest")).select("user_id", "n", "failures", F.col("_last.event_type").alias("last_event"), "started", "latest")


def window_metrics(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark: count, errors, value."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value"))
            .select(F.col("window.start").alias("window_start"), "n", "errors", "value"))


def event_tail(events: DataFrame, cursor: int) -> DataFrame:
    return events.filter(F.col("event_id") > cursor)


def folders(spark: SparkSession, purpose: str) -> tuple[str, str]:
    base = shared_dir(spark, purpose)
    return f"{base}/data", f"{base}/checkpoint"
