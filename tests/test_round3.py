"""Small tests of the faults that the third review found."""

from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from assaylake.functions import privacy as P
from assaylake.operators import bandit as B
from assaylake.operators import selection as SEL
from assaylake.sources import views as V

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_final_cost_does_not_follow_the_order_of_rows(spark):
    """The same prices in other orders; their sums are ties of the sixth digit."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(200):
        cents = [int(c) for c in rng.integers(90_000, 9_000_000, 5)]
        cents.append(100_500 - sum(cents) % 1000)  # the sum ends in 500: a tie
        assert sum(cents) % 1000 == 500
        for copy in range(3):
            k = g * 3 + copy
            rows += [(k, i, 1, 1, 1.0, c / 100, 0.0, 0.0, "N", "F", datetime(2024, 1, 1)) for i, c in enumerate(rng.permutation(cents).tolist())]
            want[k] = float((Decimal(sum(cents)) / 10**9).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    t = SimpleNamespace(lineitem=spark.createDataFrame(rows, LINE).coalesce(1))
    assert {r.k: r.final_cost for r in V.run_lines(t).select("k", "final_cost").collect()} == want


def test_linucb_fit_solves_large_sums(spark):
    """F16: nearly dependent features over many examples; theta still solves the system."""
    dim = 12
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3)) @ rng.random((3, dim)) + 1e-4 * rng.random((4000, dim))
    a, b = x.T @ x * 500, x.T @ rng.random(4000) * 500
    cells = [("a", i, j, float(a[i, j])) for i in range(dim) for j in range(i, dim)] + [("a", i, -1, float(b[i])) for i in range(dim)] + [("a", 0, -2, 2e6), ("a", 1, -2, 2e6)]
    theta = np.array(B.linucb_fit(spark.createDataFrame(cells, "action string, i int, j int, v double"), dim=dim).first()["theta"])
    sym = np.triu(a) + np.triu(a, 1).T + np.eye(dim)
    assert np.abs(sym.astype(np.longdouble) @ theta - b).max() < 1e-6


def test_reviews_find_their_attempt_under_a_shared_label(spark, monkeypatch):
    """labels of two cases are equal; each review names its case and keeps its attempt."""
    monkeypatch.setattr(SEL, "blind_label_of", lambda *names: F.lit("candidate-0"))
    attempts = spark.createDataFrame([("er-1", "case-1", "a1"), ("er-1", "case-2", "a2"), ("er-1", "case-3", "a3"), ("er-2", "case-3", "a4")], "eval_run_id string, case_id string, attempt_id string")
    bindings = SEL.review_bindings(attempts)
    reviews = spark.createDataFrame([(f"r{i}", f"case-{i}", "candidate-0", "p", "accept", 0) for i in (1, 2, 3, 4)], "review_id string, case_id string, blind_label string, reviewer_pseudonym string, decision string, position int")
    assert sorted((r.review_id, r.attempt_id) for r in SEL.bind_reviews(reviews, bindings).collect()) == [("r1", "a1"), ("r2", "a2")]
    assert sorted((r.review_id, r.reason) for r in SEL.validate_blind_reviews(reviews, bindings).collect()) == [("r1", "accepted"), ("r2", "accepted"), ("r3", "ambiguous_label"), ("r4", "case_id_mismatch")]


def test_only_documents_that_can_hold_a_finding_are_searched(spark):
    """Dates and short numbers are no findings, and a document that has no other digits stays in the JVM."""
    plain = '{"run_id":"run-17","started_at":"2024-01-02T00:00:00Z","n":12345,"note":"call 12-34 or 5678"}'
    found = ['{"a":"call +91 (22) 4567 8901"}', '{"a":"ABCDE1234F"}', '{"a":"4111 1111 1111 1111"}', '{"a":"1234 5678 9012"}', '{"a":"022-2345-6789"}', '{"a":"\\u0041BCDE1234F"}', '{"a":"x@y.org"}']
    texts = [plain, *found]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, raw string")
    sent = {r.i for r in df.filter(F.col("raw").rlike(P.SUSPECT_DOCUMENT)).collect()}
    assert sent == set(range(1, len(texts)))
    got = df.select("i", P.scan_document(F.col("raw")).alias("s")).orderBy("i").collect()
    assert got[0]["s"]["redacted"] == plain and not got[0]["s"]["reasons"]
    assert all(r["s"]["reasons"] and "[REDACTED:" in r["s"]["redacted"] for r in got[1:])


def test_numbers_before_and_after_the_cheap_test():
    """the cheap test for numbers loses no finding."""
    import random

    rng = random.Random(4)
    every = P.re.compile(r"\d")
    for _ in range(4000):
        text = "".join(rng.choice("0123456789" * 3 + " -.()+\tA٣ABCDE") for _ in range(rng.randint(5, 40)))
        with_test = P.spans_of(text)
        kept, P._NUMBERS = P._NUMBERS, every
        try:
            assert P.spans_of(text) == with_test, text
        finally:
            P._NUMBERS = kept


def test_run_documents_of_a_small_file_are_dealt_out(spark):
    """One file is read by few tasks; its orders are dealt out before the costly documents are made."""
    from assaylake.sources.tables import Tables

    plan = V.run_documents(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_records_are_dealt_out_once(spark, tmp_path):
    """the texts of a document cross the network once for the running counts, not once for each."""
    from assaylake.functions.prefix import prior_sums

    df = spark.range(1000).selectExpr("'f' AS file", "id div 100 AS start", "id AS at", "uuid() AS value")
    twice = prior_sums(prior_sums(df, ["file"], "at", {"a": F.col("at") % 3}, bucket="start"), ["file"], "at", {"b": F.col("a") % 5}, bucket="start")
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(file" in line and "start" in line for line in plan.splitlines()) <= 4
    rows = sorted(twice.select("at", "a", "b").collect())
    a = [sum(x % 3 for x in range(i)) for i in range(1000)]
    assert [(r["a"], r["b"]) for r in rows] == [(a[i], sum(v % 5 for v in a[:i])) for i in range(1000)]
