"""Small tests of what was mended when the third review's open findings were taken up again."""

import json
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from assaylake.functions import privacy as P
from assaylake.operators import bandit as B
from assaylake.operators import grading as G
from assaylake.operators import nearest as NN
from assaylake.operators import validate as VD
from assaylake.plans import bandit as PB
from assaylake.plans import reports as RP
from assaylake.plans import validation
from assaylake.sources import readers as RD
from assaylake.sources import views as V
from assaylake.sources.tables import Tables


def test_numbers_of_fields_are_not_taken_apart(spark, monkeypatch):
    """A long number as a field's value is no finding, and its document is not cut into tokens; strings still are."""
    plain = json.dumps({"p": 0.7999999999999999, "n": [{"cost": -12345678901234567890.5e-3}], "note": "plain"}, separators=(",", ":"))
    found = ['{"a":":0.79999999999,4111 1111 1111 1111"}', '{"a":"1","b":":9876543210"}', '{"b":"x","PassWord":1234567890123}', '{"a":["0.1",1],"b":"+91 98765 43210"}',
             '{"a":"p\\":9876543210"}', 'no json":9876543210', '{"to\u212aen":1,"secret":0.7999999999999999}']
    with monkeypatch.context() as m:
        m.setattr(P, "_TOKENS", None)
        assert P.redacted_document(plain) == (plain, [])
    assert all(P.redacted_document(f)[1] for f in found)
    df = spark.createDataFrame([(i, r) for i, r in enumerate([plain, *found, None, ""])], "i int, raw string")
    got = df.select("i", P._suspect_document(F.col("raw")).alias("s"), F.col("raw").rlike(P.SUSPECT_DOCUMENT).alias("one"), P.scan_document(F.col("raw"))["reasons"].alias("r")).orderBy("i").collect()
    assert [r.s for r in got] == [r.one for r in got]
    assert [bool(r.r) for r in got] == [False] + [True] * len(found) + [False, False]


def test_documents_are_dealt_out_to_all_tasks(spark):
    """Few small orders stay in as many partitions as a shuffle has, whatever their size in bytes."""
    folder = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    t = SimpleNamespace(spark=spark, orders=read("orders").coalesce(1), customer=read("customer"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        tasks = validation.parsed(t).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", before)
    assert tasks == n


def test_scores_multiply_only_places_with_a_value(spark):
    """the same scores as numpy's on the places with a value; what the model holds elsewhere is not touched."""
    rng, dim = np.random.default_rng(11), 7
    theta, inv = rng.random(dim), rng.random((dim, dim))
    x = np.where(rng.random((20, dim)) < 0.5, rng.random((20, dim)) - 0.3, 0.0)
    x[:, 3], x[0] = 0.0, 0.0
    inv[3, :] = inv[:, 3] = theta[3] = np.inf
    examples = spark.createDataFrame([(f"o{i}", v.tolist(), ["a", "z"]) for i, v in enumerate(x)], "observation_id string, features array<double>, eligible_actions array<string>")
    model = spark.createDataFrame([("a", theta.tolist(), inv.ravel().tolist())], "action string, theta array<double>, a_inv array<double>")
    got = {r.observation_id: r.score for r in B.linucb_score(examples, model, alpha=0.5, dim=dim).collect()}
    on = [i for i in range(dim) if i != 3]
    want = {f"o{i}": v[on] @ theta[on] + 0.5 * np.sqrt(max(0.0, v[on] @ inv[np.ix_(on, on)] @ v[on])) for i, v in enumerate(x)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_only_last_attempts_are_graded(spark, monkeypatch):
    """What a report takes from the last attempt of a case alone is graded after that choice."""
    t, seen = Tables(spark, "/root/testdata/sf0.001"), []
    real = G.grade_attempts
    monkeypatch.setattr(G, "grade_attempts", lambda df, *a, **k: (seen.append(df.count()), real(df, *a, **k))[1])
    a = V.attempts(t)
    per_run, per_action = a.select("eval_run_id", "case_id").distinct().count(), a.select("case_id", "model").distinct().count()
    RP.final(t), RP.run_sum(t), PB.evidence(t)
    assert seen == [per_run, per_run, per_action] and per_run < a.count()


def test_telemetry_batches_are_read_by_line_and_by_file(spark, tmp_path):
    """the same batches as lines of one file and as a file each give the same rows."""
    docs = [json.dumps({"schema": "TelemetryBatchV1", "batch_id": f"b-{i}", "model_registry": [{"provider": "lab", "model": "m0"}], "runs": [{"tier": "t1", "text": "a\nb"}] * i}) for i in range(4)]
    (tmp_path / "files").mkdir()
    for i, d in enumerate(docs):
        (tmp_path / "files" / f"{i}.json").write_text(d)
    (tmp_path / "lines.jsonl").write_text("\n".join([*docs, "", " "]))
    rows = lambda path, lines: [sorted(str(r) for r in df.collect()) for df in RD.read_telemetry(spark, str(path), lines=lines)]
    one, two = rows(tmp_path / "files", False), rows(tmp_path / "lines.jsonl", True)
    assert one == two and [len(x) for x in one] == [4, 6, 4]


def test_fixture_results_do_not_pass_through_the_driver(spark):
    """no side that has a row per case is broadcast."""
    manifest, results = validation.fixture_tables(Tables(spark, "/root/testdata/sf0.001"))
    found = VD.reconcile_fixture_results(manifest, results)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_that_ask_are_worked_out_once(spark, monkeypatch):
    """rows that are counted and then compared are kept before, and signs of zero do not part equal vectors."""
    plans, real = [], NN._solve
    monkeypatch.setattr(NN, "_solve", lambda rows, how, leaf: (plans.append((how, rows._jdf.queryExecution().executedPlan().toString())), real(rows, how, leaf))[1])
    x = np.random.default_rng(4).random((60, 2)).round(1)
    x[:, 1] = np.where(np.arange(60) % 2, x[:, 1], -0.0)
    df = spark.createDataFrame([(i, "b", v.tolist()) for i, v in enumerate(x)], "seq bigint, bucket string, v array<double>")
    got = {r.seq: r.feature_distance for r in NN.nearest_prior_vector(df, ["bucket"], "v", "seq", leaf=7, fan=2).collect()}
    want = {i: min(1.0, np.sqrt(((x[:i] - x[i]) ** 2).sum(1).min() / 2)) if i else 1.0 for i in range(60)}
    assert len(got) == 60 and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    across = [p for how, p in plans if how is NN._across]
    assert across and not any("Join" in p for p in across)
