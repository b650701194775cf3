"""Faults of the fourth review: what moved more rows, or worked more, than the job needs."""

import datetime
import gzip

import pytest

from assaylake.functions.prefix import first_seen
from assaylake.operators import novelty as N
from assaylake.plans import catalog, storage
from assaylake.sources.ranges import json_records


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_of_few_keys_moves_no_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(40)], "seq long, key string")
    out = first_seen(df, ["key"], "seq", "new")
    assert "hashpartitioning" not in _plan(out)
    assert {r["seq"] for r in out.filter("new").collect()} == {0, 1, 2}
    assert out.count() == 40


def test_outliers_of_two_values_deal_rows_out_once(spark):
    rows = [(i, f"a{i % 2}", 1.0 + i % 3 if i != 70 else 99.0, None if i % 7 == 0 else 5.0 + i % 4 if i != 75 else -50.0) for i in range(90)]
    df = spark.createDataFrame(rows, "seq long, action string, cost double, latency double")
    both = N.running_outliers(df, {"c": "cost", "l": "latency"})
    apart = N.running_outlier(N.running_outlier(df, "cost", "c"), "latency", "l")
    assert sorted(both.collect()) == sorted(apart.select(both.columns).collect())
    assert [r["seq"] for r in both.filter("c = 1").collect()] == [70] and [r["seq"] for r in both.filter("l = 1").collect()] == [75]
    windows = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert 0 < windows(both) < windows(apart)


def _tables(spark, folder):
    tables = {
        "customer": ([(i, ("AUTOMOBILE", "BUILDING")[i % 2]) for i in range(6)], "c_custkey long, c_mktsegment string"),
        "part": ([(i, f"part {i}", "Brand#11", i + 1, 900.0 + i) for i in range(7)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
        "orders": ([(k, k % 6, "FOP"[k % 3], 1000.0 * k, datetime.date(1995, 1, 1 + k % 9)) for k in range(50)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"),
        "lineitem": ([(k, k % 7, k % 4, n, 5.0, 900.0, 0.05, 0.01, "RAN"[k % 3], "FO"[n % 2], datetime.date(1995, 2, 1)) for k in range(50) for n in (1, 2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_build_candidates_scores_runs_once(spark, tmp_path):
    """what follows the choice of candidates reads a copy of their keys, not the runs."""
    df = catalog.queries()["build_candidates"](spark, _tables(spark, tmp_path))
    assert "lineitem" not in _plan(df) and "Scan parquet" not in _plan(df)
    got = df.collect()
    assert got and len(got) == 2 * len({r["candidate_id"] for r in got})
    assert {"cand-0-1", "cand-40-1"} <= {r["candidate_id"] for r in got if r["to_state"] == "REJECTED"}


def test_records_do_not_move_to_meet_their_file(spark, tmp_path):
    """what is known of a file is a small table; the texts of its records stay where they are."""
    docs = ['{"note":"a}b","attempts":[{"attempt_id":"1","case_id":"x"},{"attempt_id":"2"}],"more":{"a":1}}', '[{"attempt_id":"3"}]', '{"attempts":[]}']
    for i, doc in enumerate(docs):
        with gzip.open(tmp_path / f"{i}.txt.gz", "wt") if i else open(tmp_path / f"{i}.txt", "w") as f:
            f.write(doc)
    r = json_records(spark, str(tmp_path), "attempts")
    assert "hashpartitioning" not in _plan(r)
    assert sorted((x["bare"], x["record"]) for x in r.collect()) == [(False, '{"attempt_id":"1","case_id":"x"}'), (False, '{"attempt_id":"2"}'), (True, '{"attempt_id":"3"}')]
    (tmp_path / "3.txt").write_text('{"attempts":[{"attempt_id":"4"}')
    with pytest.raises(Exception, match="cannot parse import"):
        json_records(spark, str(tmp_path), "attempts").collect()


@pytest.mark.parametrize("name, rows", [("read_attempts", 4), ("read_telemetry", 1)])
def test_files_of_readers_are_compressed(spark, tmp_path, monkeypatch, name, rows):
    """the files that the readers read are kept compressed, in bounded parts, and are read whole."""
    made = tmp_path / "made"
    monkeypatch.setattr(storage, "shared_dir", lambda spark, purpose: str(made))
    monkeypatch.setattr(storage, "PER_FILE", 10)
    got = catalog.queries()[name](spark, _tables(spark, tmp_path)).collect()
    files = [f for f in made.rglob("part-*") if not f.name.endswith(".crc")]
    assert files and all(f.name.endswith(".gz") for f in files)
    assert len(got) == rows and sum(r["n"] if name == "read_attempts" else 2 * r["runs"] for r in got) == 100
