"""Small tests of what was mended in the fourth pass over the third review's findings."""

import json

from pyspark.sql import functions as F

from assaylake.functions import jsonvals as J
from assaylake.functions import privacy as P
from assaylake.operators import grading as G
from assaylake.plans import catalog


def test_long_numbers_of_fields_stay_in_the_jvm(spark):
    """a JSON document whose long numbers are all values of fields is not sent to Python; every other one is, with the same findings."""
    plain = [json.dumps({"p": 0.7999999999999999, "n": [{"cost": -12345678901234567890.5e-3}], "at": "2024-01-02T00:00:00Z"}, separators=s) for s in ((",", ":"), (", ", ": "))]
    found = ['{"a":":0.79999999999,4111 1111 1111 1111"}', '{"a":"1","b":":9876543210"}', '{"b":"x","PassWord":1}', '{"b":"x","toKen":1,"api_Key":12}', '{"a":["0.1",1],"b":"+91 98765 43210"}',
             'no json":9876543210', '{"a":9876543210} x', '{"a":9876543210', '{"a":9876543210,"a":1,}', '[{"a":1},"ABCDE1234F"]', '{"a":"x":9876543210}', '{"Cookie" : "c"}', 'x@y.org', '"sk-' + "a" * 20 + '"']
    rows = [(i, r) for i, r in enumerate([*plain, *found, None, ""])]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = df.select("i", P._searched_document(F.col("raw")).alias("s"), P.scan_document(F.col("raw")).alias("r")).orderBy("i").collect()
    assert [r.s for r in got] == [False] * len(plain) + [True] * len(found) + [None, False]
    for (_, raw), r in zip(rows, got):
        text, why = P.redacted_document(raw) if raw is not None else (None, [])
        assert (r.r.redacted, r.r.reasons or []) == (text, why)


def test_references_are_made_canonical_once_per_case(spark):
    """an attempt is graded against its case's canonical reference; the joined attempts work out their own text only."""
    ref = '{"b":1,"a":"x"}'
    said = [('{ "a": "x", "b": 1 }', True), ('{"a":"x","b":1.0}', False), ('{"a":"x","b":1} more', False), ("[1", False)]
    rows = [(f"a{i}", "exact_json", "success", text, ref) for i, (text, _) in enumerate(said)]
    df = spark.createDataFrame(rows, "attempt_id string, method string, status string, response_text string, reference_answer string")
    given = df.withColumn("reference_json", J.canonical_json(F.col("reference_answer"))).withColumn("reference_answer", F.lit("not looked at"))
    want = {f"a{i}": passed for i, (_, passed) in enumerate(said)}
    for attempts in (df, given):
        got = G.grade_attempts(attempts)
        assert {r.attempt_id: r.passed for r in got.collect()} == want and "reference_json" not in got.columns
    plan = catalog.queries()["run_breakdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    graded = plan[:plan.index("Join ")]  # what stands above the join with the cases
    assert graded.count("regexp_extract_all") == 1


def test_canonical_text_of_odd_values(spark):
    """a value is parsed once where its length tells that nothing follows it, and twice more where it does not; the results stay."""
    same = [('{"b": 1, "a": [1.50, "x"]}', '{"sa":["f1.5","sx"],"sb":"i1"}'), ("-0", '"i0"'), ("1e3", '"f1000.0"'), ('"\\u0041\\/"', '"sA/"'),
            (' [ ]\n', "[]"), ("\x0b1\f", '"i1"'), ("true", "true"), ('"\u2028\x7f"', '"s\u2028\x7f"')]
    none = ["", " ", "{} {}", "[1]]", '"a"]', '{"a":1}}', "1 2", "[1],[2]", '1],"x":[2', "01", "+1", "nul", '"a\nb"', '"a\x01b"]', '"\x01]', '{"a":1,"a":2}', "name of a part", '"a\\u0041"xxxxx']
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in same] + none)], "i int, t string")
    got = df.select("i", J.canonical_json(F.col("t")).alias("c"), J.parse_strict(F.col("t")).isNotNull().alias("p")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, c in same] + [None] * len(none)
    assert [r.p for r in got] == [not set(t) & set("\x0b\f") for t, _ in same] + [False] * len(none)


def test_pairs_are_unsupported_without_grading(spark):
    """whether a pair was tried at all asks for no grade and no last attempt."""
    plan = catalog.queries()["unsupported_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "response_text" not in plan and "text does not exactly match reference" not in plan and "Window " not in plan
