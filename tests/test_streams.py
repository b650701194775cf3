"""Streaming jobs: results do not depend on how the input is split, and repeated runs change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import novelty as N
from assaylake.streaming import jobs as ST


def records(spark, rows):
    df = spark.createDataFrame(rows, "batch_id string, delivery long, k long, content string, size long")
    return df.select("batch_id", "delivery", "size", *ST.record_digest("k", "content"))


def outcomes(spark, ledger):
    return {(r["batch_id"], r["delivery"]): (r["outcome"], r["n"]) for r in spark.read.parquet(ledger).collect()}


@pytest.mark.parametrize("files", [1, 3])
def test_batches_are_judged_when_whole(spark, tmp_path, files):
    batch = lambda b, d, n, other=False, only=None: [(b, d, k, f"c{k}" + ("!" if other and k == 1 else ""), n) for k in range(n) if only is None or k in only]
    first = batch("a", 1, 5) + batch("b", 1, 3) + batch("c", 1, 4, only={0, 2})  # c is not whole yet
    later = batch("a", 2, 5) + batch("b", 2, 3, other=True) + batch("d", 2, 2) + batch("d", 3, 2) + batch("e", 4, 2, other=True) + batch("e", 3, 2)
    ledger, check = str(tmp_path / "ledger"), str(tmp_path / "job")
    for rows in (first, later, batch("c", 1, 4, only={1, 3}) + batch("a", 5, 4)):
        random.Random(files).shuffle(rows)
        for part in range(files):  # neighbours of a batch come in different micro-batches
            records(spark, rows[part::files]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = records(spark, rows).schema
        ST.stream_import(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ledger, check)
        if rows and ("c", 1) not in outcomes(spark, ledger):
            assert all(r[0] != "c" for r in outcomes(spark, ledger))
    got = outcomes(spark, ledger)
    assert {k: v[0] for k, v in got.items() if k[0] != "e"} == {("a", 1): "imported", ("a", 2): "duplicate", ("a", 5): "conflict", ("b", 1): "imported", ("b", 2): "conflict", ("c", 1): "imported",
                                                              ("d", 2): "imported", ("d", 3): "duplicate"} and got["c", 1][1] == 4
    assert sorted(v[0] for k, v in got.items() if k[0] == "e") == ["conflict", "imported"]  # the one that becomes whole first is kept
    assert (got["e", 3][0] == "imported") or files > 1


def test_an_epoch_that_is_repeated_comes_to_the_same_result(spark, tmp_path):
    rows = records(spark, [("a", 1, k, "c", 2) for k in range(2)])
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ledger = str(tmp_path / "ledger")
    ST.stream_import(read(), ledger, str(tmp_path / "x" / "job"))
    ST.stream_import(read(), ledger, str(tmp_path / "y" / "job"))  # the same job without its checkpoint: epoch 0 again
    assert outcomes(spark, ledger) == {("a", 1): ("imported", 2)}


def test_the_content_hash_does_not_depend_on_the_order(spark):
    digest = lambda rows: tuple(records(spark, rows).agg(*[F.sum(F.col(d).cast("decimal(38,0)")) for d in ("d0", "d1", "d2", "d3")]).first())
    rows = [("a", 1, k, f"c{k}", 9) for k in range(9)]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:-1] + [("a", 1, 8, "c9", 9)])


def facts(spark, n=240):
    r = random.Random(2)
    rows = [(i, i * 10 + r.randrange(10), r.choice(["hot", "hot", "hot", "x", "y"]), r.choice(["", "", "e1", "e2", f"e{i}"]), r.choice([True, False, None]), r.choice(["", "t1", "t2", f"t{i % 50}"]),
             r.choice("pq"), r.choice([None, 1.0, 2.0, 900.0]), float(r.randrange(9))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, seq long, task_domain string, error_key string, completed boolean, tool_key string, action string, final_cost double, final_latency_ms double").repartition(4)


@pytest.mark.parametrize("cuts", [(), (100,), (30, 31, 150)])
def test_streamed_flags_equal_the_batch_for_any_split(spark, tmp_path, cuts):
    rows = facts(spark)
    stored, new = rows.filter("k < 80"), rows.filter("k >= 80")
    start = ST.novelty_keys(stored).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    borders = [80, *[80 + c for c in cuts], 10_000]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        keys = ST.novelty_keys(new.filter((F.col("k") >= a) & (F.col("k") < b)))
        keys.write.mode("append").parquet(str(tmp_path / "in"))
        with ST.rocksdb_state(spark):
            ST.run_available(ST.prior_counts(spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in")), start), ST.epoch_sink(str(tmp_path / "out")), "append", str(tmp_path / "check"))
    got = {r["k"]: tuple(r)[1:] for r in ST.novelty_flags(rows, spark.read.parquet(str(tmp_path / "out"))).collect()}
    batch = N.first_seen_tool_combo(N.first_seen_failure_signature(N.first_seen_domain_rarity(rows))).filter("k >= 80")
    assert got == {r["k"]: (r["domain_rarity"], r["new_failure_signature"], r["new_tool_combination"]) for r in batch.collect()}


def test_history_from_stored_evidence_equals_one_table(spark):
    """If every stored run became a candidate, the context stands for all of them."""
    rows = facts(spark)
    stored, new = rows.filter("k < 120"), rows.filter("k >= 120")
    start = N.stored_context(stored, stored, stored)

    def flags(df, start=None):
        f = N.first_seen_tool_combo(N.first_seen_failure_signature(N.first_seen_domain_rarity(df, start), start), start)
        f = N.running_outlier(f, "final_cost", "unusual_cost", min_prior=10, z=1.5, start=start, kind="cost")
        f = N.running_outlier(f, "final_latency_ms", "unusual_latency", min_prior=10, z=1.5, start=start, kind="latency")
        return {r["k"]: tuple(r)[1:] for r in f.filter("k >= 120").select("k", "domain_rarity", "new_failure_signature", "new_tool_combination", "unusual_cost", "unusual_latency").collect()}

    assert flags(new, start) == flags(rows)
    few = N.stored_context(stored, stored, stored.filter("k < 3"))  # signatures count only through candidates
    assert sum(v[1] for v in flags(new, few).values()) > sum(v[1] for v in flags(rows).values())
