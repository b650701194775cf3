"""Operators on small hand-made or random rows, against expected values or brute force."""

import csv
import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import jsonvals as J
from assaylake.functions import privacy as P
from assaylake.functions import text as X
from assaylake.functions.prefix import prior_sums
from assaylake.operators import bandit as B
from assaylake.operators import grading as G
from assaylake.operators import ledger as LG
from assaylake.operators import lifecycle as L
from assaylake.operators import lineage as LN
from assaylake.operators import nearest as NN
from assaylake.operators import novelty as N
from assaylake.operators import ope as O
from assaylake.operators import report as RPT
from assaylake.operators import rewards as R
from assaylake.operators import routing as RT
from assaylake.operators import similar as SM
from assaylake.operators import validate as VD
from assaylake.sources import ranges as RG
from assaylake.sources import readers as RD
from assaylake.sources import writers as WR

CFG = R.RewardConfig(cost_envelope={"t1": 0.002, "t2": 0.01, "default": 0.01})
RUN = dict(run_id="r1", k=1, tier="t2", structured=False, structured_output_valid=None, n_tools=0, n_tools_good=0, completed=True, correction_category=None, user_correction=False,
           user_abandon=False, user_retry=False, user_accept=False, final_cost=0.001, currency="USD", final_latency_ms=800.0, slo=None, critical_failure=False, retry_count=0)
RUN_DDL = ("run_id string, k bigint, tier string, structured boolean, structured_output_valid boolean, n_tools bigint, n_tools_good bigint, completed boolean, correction_category string, "
           "user_correction boolean, user_abandon boolean, user_retry boolean, user_accept boolean, final_cost double, currency string, final_latency_ms double, slo bigint, critical_failure boolean, retry_count bigint")


def reward(spark, **over):
    row = {**RUN, **over}
    return R.reward_run(spark.createDataFrame([tuple(row.values())], RUN_DDL), CFG).first()


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_weak_abandon_does_not_outweigh_a_correct_run(spark):
    assert reward(spark, user_abandon=True)["quality"] >= 0.7


def test_foreign_currency_and_missing_latency_stay_unknown(spark):
    r = reward(spark, currency="EUR", final_latency_ms=None)
    assert r["cost_normalized"] is None and r["latency_normalized"] is None
    assert r["confidence"] == pytest.approx(0.8 * 0.8)


def test_critical_failure_is_minus_one_even_without_quality(spark):
    r = reward(spark, completed=None, critical_failure=True)
    assert r["scalar"] == -1.0 and r["excluded_reason"] is None
    assert reward(spark, completed=None)["excluded_reason"] == "no_quality_signal"


def test_invalid_structure_and_retries_are_penalised(spark):
    r = reward(spark, structured=True, structured_output_valid=False, retry_count=2)
    assert r["tool_failure_penalty"] == 1.0 and r["retry_penalty"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("a,b,equal", [
    ('{"a":1,"b":[1,2]}', '{ "b": [1, 2], "a": 1 }', True), ('{"a":1}', '{"a":1.0}', False), ('{"a":true}', '{"a":1}', False), ("[1,2]", "[2,1]", False),
    ('{"a":9007199254740993}', '{"a":9007199254740992}', False), ("1.50", "1.5", True), ('"1"', "1", False), ("null", "null", True)])
def test_json_equality_is_type_strict(spark, a, b, equal):
    assert one(spark, a, lambda c: J.json_equal(c, F.lit(b))) is equal


def test_json_tolerance_and_invalid_documents(spark):
    assert one(spark, '{"a":1.0004}', lambda c: J.json_equal(c, F.lit('{"a":1.0}'), 0.001)) is True
    assert one(spark, '{"a":1}', lambda c: J.json_equal(c, F.lit('{"a":1.0}'), 0.001)) is False
    for bad in ('{"a":NaN}', '{"a":1} x', "", "1],[2", "01", "1 2", "tru"):
        assert one(spark, bad, J.canonical_json) is None, bad
        assert one(spark, bad, lambda c: F.schema_of_variant(J.parse_strict(c))) is None, bad


def test_graders(spark):
    passed = lambda text, fn: one(spark, text, lambda c: fn(c)["passed"])
    assert passed("The  total is INR 250.", lambda c: G.grade_normalized_text(c, F.lit("the total is inr 250"))) is True
    assert passed("Total = 12 + 8 = 20", lambda c: G.grade_arithmetic(c, F.lit(20))) is True
    assert passed("Total = 12 + 8 = 21", lambda c: G.grade_arithmetic(c, F.lit(20))) is False
    assert passed("no number", lambda c: G.grade_arithmetic(c, F.lit(20))) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}
    assert passed('{"a":[1,2]}', lambda c: G.grade_schema(c, schema)) is True
    assert one(spark, '{"a":[1,true]}', lambda c: G.grade_schema(c, schema)["failure_reason"]) == "$.a[1] must be integer"
    assert passed("[]", lambda c: G.grade_required_fields(c, ["a"])) is False


@pytest.mark.parametrize("a,b,value", [("red blue", "Blue red", 1.0), ("red blue", "red", 0.5), ("red", "blue", 0.0), ("", "", 1.0), ("!!", "??", 0.0)])
def test_jaccard(spark, a, b, value):
    assert one(spark, a, lambda c: X.jaccard(c, F.lit(b))) == pytest.approx(value)


@pytest.mark.parametrize("text,reason", [
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "private_key"), ("x Bearer abc.def-123 y", "authorization_header"),
    ("eyJabcdefghij.eyJabcdefghij.sig", "jwt"), ("use sk-live-abcdefghijklmnop1 now", "secret_token"), ("write a.b@example.com", "pii_email"), ("id ABCDE1234F.", "pii_pan"),
    ("card 4111 1111 1111 1111.", "pii_card"), ("uid 1234 5678 9012", "pii_aadhaar"), ("call +91 98765 43210", "pii_phone")])
def test_each_kind_of_finding(spark, text, reason):
    red = one(spark, text, lambda c: P.scan(c)["redacted"])
    assert f"[REDACTED:{reason}]" in red
    assert one(spark, text, lambda c: P.reasons_of(P.scan(c))) == [reason]


def test_text_without_findings_and_documents(spark):
    assert one(spark, "order 4111 1111 1111 1112 at 12:30", lambda c: F.array_contains(P.reasons_of(P.scan(c)), "pii_card")) is False
    assert one(spark, "[REDACTED:pii_email] is no finding", lambda c: P.scan(c)["reasons"]) == []
    assert one(spark, None, lambda c: P.scan(c)["redacted"]) is None
    doc = '{"n":4111111111111111,"note":"line\\nBearer abcdef123","api_key":"zzz","ok":"plain"}'
    red = one(spark, doc, lambda c: P.scan_document(c)["redacted"])
    assert "4111111111111111" in red and "abcdef123" not in red and "zzz" not in red
    assert one(spark, doc, lambda c: P.reasons_of(P.scan_document(c))) == ["authorization_header", "credential_field"]


def test_earlier_findings_win_and_later_ones_that_overlap_are_dropped_whole():
    assert P.redacted_text("Bearer 12345 67890 12345") == ("[REDACTED:authorization_header] 67890 12345", ["authorization_header"])
    assert P.spans_of("mail a@b.com-x@y.org, 4111 1111 1111 1111 and 98765 43210") == [(5, 12, "pii_email"), (12, 20, "pii_email"), (22, 41, "pii_card"), (46, 57, "pii_phone")]
    # every span list against a plain fold over all matches in priority order
    r = random.Random(4)
    parts = ["Bearer ", "sk-", "abcdefgh12345678", "eyJabcdefgh.", "@", "x.org", "a-b", " ", "4111 1111 1111 1111", "1234-5678-9012", "+91 ", "98765", "ABCDE1234F", "\n", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "é", "."]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 12)))
        want = []
        for reason, pattern in P.PATTERNS.items():
            for m in re.finditer(pattern, text):
                digits = re.sub(r"\D", "", m[0])
                if (reason == "pii_card" and not P.luhn(digits)) or (reason == "pii_phone" and len(digits) < 10):
                    continue
                if all(m.end() <= a or m.start() >= b for a, b, _ in want):
                    want.append((*m.span(), reason))
        assert P.spans_of(text) == sorted(want)


def test_documents_keep_what_is_no_finding():
    same = '{ "a" : [1.50, 1e3, true, null, {"b@c.de": "x"}], "password": "", "secret": null, "cookie": [], "api_key": {} }'
    assert P.redacted_document(same) == (same, [])
    doc = '{"Password": {"deep": ["a@b.com", 1]}, "list": ["a@b.com", "\\u0042earer abc"], "secret": 0}'
    assert P.redacted_document(doc) == ('{"Password": "[REDACTED:credential_field]", "list": ["[REDACTED:pii_email]", "[REDACTED:authorization_header]"], "secret": "[REDACTED:credential_field]"}',
                                        ["credential_field", "pii_email", "authorization_header", "credential_field"])
    assert P.redacted_document("no json a@b.com")[1] == ["pii_email"]


def test_long_texts_are_scanned_in_linear_time():
    start = time.time()
    for text in ("a." * 200_000, "a.b@" * 50_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "1 " * 200_000, "Bearer " * 50_000):
        P.spans_of(text)
    assert time.time() - start < 20


def test_prior_sums_with_one_hot_key_equal_a_running_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", i * 3, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, seq bigint, v bigint")
    got = {r["seq"]: r["s"] for r in prior_sums(df, ["key"], "seq", {"s": F.col("v")}, width=64).collect()}
    seen = {}
    for key, seq, v in rows:
        assert got[seq] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + v


@pytest.mark.parametrize("leaf,fan", [(8192, 16), (20, 4), (7, 2)])
def test_nearest_prior_vector_is_exact_with_many_copies(spark, leaf, fan):
    """One bucket is crowded and cut many times over, with most vectors at one value of a coordinate; copies, a null vector."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        v = [0.5, 0.0, 1.0] if i % 3 == 0 else [round(rng.random() ** 3, 3), float(rng.randrange(2)), rng.choice([0.0, 0.0, 0.0, rng.random()])]
        rows.append(("crowd" if i % 5 else f"b{i % 2}", i, v))
    df = spark.createDataFrame([*rows, ("crowd", 1000, None)], "bucket string, seq bigint, v array<double>").repartition(6)
    got = {r["seq"]: r["feature_distance"] for r in NN.nearest_prior_vector(df, ["bucket"], "v", "seq", leaf=leaf, fan=fan).collect()}
    assert len(got) == len(rows) + 1 and got[1000] == 1.0
    for b, i, v in rows:
        want = min((math.dist(v, w) for c, j, w in rows[:i] if c == b), default=None)
        assert got[i] == pytest.approx(1.0 if want is None else min(1.0, want / math.sqrt(3)), abs=1e-12)
    assert NN.nearest_prior_vector(df.limit(0), ["bucket"], "v", "seq").count() == 0


def test_cells_stay_small_and_pairs_are_pruned(spark):
    rng = random.Random(8)
    rows = [("one", i, [rng.gauss(rng.choice([0, 5, 50]), 1), rng.gauss(0, 1)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "bucket string, first bigint, v array<double>")
    cut, levels = NN._cut_cells(df.select("first", "v", F.array("bucket").alias("path")), 2, 100, 8)
    sizes = cut.groupBy(F.element_at("path", -1).alias("c")).count()
    n, most = sizes.agg(F.count("c"), F.max("count")).first()
    assert most <= 100 and n >= 30 and levels > 1
    bounds = NN._solve(cut.select(F.element_at("path", -1).alias("node"), F.lit(False).alias("asks"), "first", "v"), NN._within, 100)
    assert NN._follow(cut, bounds.groupBy("first").agg(F.min("d").alias("d")), 2, levels).count() < n * n / 3


def test_leakage_equals_brute_force_for_all_target_lengths(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    texts = [(f"t{i}", " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(60)]
    targets = []
    for i in range(60):
        src = texts[rng.randrange(60)][1]
        a = rng.randrange(len(src))
        targets.append((f"g{i}", src[a:a + rng.choice([1, 2, 3, 6, 7, 8, 22, 23, 40, 62, 63, 64, 150])].upper() if i % 3 else word() * 4))
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    want = {(a, g) for a, t in texts for g, s in targets if norm(s) and norm(s) in norm(t)}
    got = {tuple(r) for r in LN.leakage_scan(spark.createDataFrame(texts, "text_id string, text string"), spark.createDataFrame(targets, "target_id string, target string")).collect()}
    assert got == want and want


def test_decisions_fold_like_a_loop(spark):
    rng = random.Random(11)
    from assaylake.operators.preferences import REVIEW_RULES
    states = {f"e{i}": rng.choice(["NEEDS_REVIEW", "PROPOSED", "APPROVED", "REJECTED"]) for i in range(20)}
    ds = [(f"e{rng.randrange(20)}", i, rng.choice(["propose", "approve", "reject"])) for i in range(300)]
    got = {r["seq"]: (r["met_state"], r["new_state"], r["accepted"]) for r in L.apply_decisions(
        spark.createDataFrame(list(states.items()), "entity_id string, state string"), spark.createDataFrame(ds, "entity_id string, seq bigint, decision string"), REVIEW_RULES, 3).collect()}
    rules = {(d, a): b for d, a, b in REVIEW_RULES}
    for e, s, d in ds:
        nxt = rules.get((d, states[e]))
        assert got[s] == (states[e], nxt or states[e], nxt is not None)
        states[e] = nxt or states[e]


def test_ancestors_of_a_long_chain_and_a_cycle(spark):
    nodes = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x")]
    rows = LN.ancestors(spark.createDataFrame(nodes, "id string, parent_id string")).collect()
    chain = {r["ancestor"]: r["depth"] for r in rows if r["id"] == "n39"}
    assert chain == {f"n{39 - d}": d for d in range(40)}
    assert {r["root"] for r in rows if r["id"] == "n39"} == {"n0"}
    assert all(r["cyclic"] == (r["id"] in ("x", "y")) for r in rows)


def test_append_twice_changes_nothing_and_conflicts_are_reported(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "3"), ("c", "4")], "id string, content string")
    none = spark.createDataFrame([], "id string, content string")
    rows, outcome = LG.append_evidence(none, new, "id", "content")
    assert {r["id"]: r["outcome"] for r in outcome.collect()} == {"a": "insert", "b": "insert", "c": "conflict"}
    again, outcome = LG.append_evidence(rows, new.filter("id <> 'c'"), "id", "content")
    assert again.count() == 0 and {r["outcome"] for r in outcome.collect()} == {"identical"}
    _, outcome = LG.append_evidence(rows, spark.createDataFrame([("a", "9")], "id string, content string"), "id", "content")
    assert outcome.first()["outcome"] == "conflict"


def test_usage_with_one_duplicate_and_one_missing(spark):
    a = spark.createDataFrame([("r", "a1", 5), ("r", "a2", 7), ("r", "a3", 1)], "run string, attempt_id string, cost_minor bigint")
    u = spark.createDataFrame([("r", "a1", 5, "USD"), ("r", "a2", 7, "USD"), ("r", "a2", 7, "USD")], "run string, attempt_id string, cost_minor bigint, currency string")
    r = LG.usage_reconciliation(a, u, "run").first()
    assert (r["observed_cost_minor"], r["provider_cost_minor"], r["missing"], r["duplicate"]) == (12, None, 1, 1)


def logged(spark, n=400, reward=lambda a, i: 0.8 if a == "good" else 0.2):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        a = "good" if rng.random() < 0.5 else "bad"
        rows.append((f"o{i}", a, 0.5, float(reward(a, i)), "d", "t1", ["bad", "good"], 1.0, 10.0, 1.0, False, [1.0, float(i % 2)]))
    return spark.createDataFrame(rows, "observation_id string, action string, propensity double, reward double, task_domain string, tier string, eligible_actions array<string>, "
                                       "cost double, latency_ms double, success double, critical boolean, features array<double>")


def verdicts(spark, df, policies, draws=100):
    w = O.with_policies(df, policies)
    return {r["policy"]: r for r in O.paired_difference(w, ["policy"], "observation_id", margin=0.02, draws=draws).collect()}


def test_paired_difference_tells_good_from_bad(spark):
    v = verdicts(spark, logged(spark), {"good": B.ranked_policy(["good"]), "bad": B.ranked_policy(["bad"]), "none": B.ranked_policy(["other"])})
    assert v["good"]["verdict"] == "non_inferior" and 0.25 < v["good"]["difference"] < 0.35
    assert v["bad"]["verdict"] == "worse"
    assert v["none"]["verdict"] == "inconclusive" and v["none"]["difference"] is None


def test_resampled_sums_equal_plain_python(spark):
    rows = [(None if i % 50 == 0 else f"g{i % 3}", f"k{i % 40}", float(i % 7), None if i % 11 == 0 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k string, x double, y double")
    sums = {"sx": F.col("x"), "sy": F.col("y")}
    got = {(r["g"], r["b"]): (r["rows"], r["sx"], r["sy"]) for r in O.resample(df.repartition(5), "k", ["g"], sums, draws=20, seed=3).collect()}
    want = {}
    for g, k, x, y in rows:
        d = hashlib.sha256(f"3|{k}".encode()).hexdigest()
        for b in range(1, 21):
            u = pow(int(d[:8], 16) % O.PRIME + b * (int(d[8:16], 16) % O.PRIME), 5, O.PRIME) / O.PRIME
            m = sum(c <= u for c in O.POISSON_CDF)
            a = want.setdefault((g, b), [0, 0.0, 0.0])
            a[0], a[1], a[2] = a[0] + m, a[1] + m * x, a[2] + m * (y or 0.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(v)) for k, v in want.items())
    assert O.resample(df.limit(0), "k", ["g"], sums, draws=20).count() == 0


def test_draws_are_poisson_and_unrelated():
    first, second = np.random.default_rng(1).integers(0, O.PRIME, (2, 4000))
    w = O.poisson_weights(first, second, 200).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    between = np.corrcoef(w.T) - np.eye(200)
    assert np.abs(between).max() < 0.1 and between.std() == pytest.approx(4000 ** -0.5, rel=0.1)


def test_few_noisy_rows_are_inconclusive_and_draws_repeat(spark):
    df = logged(spark, 12, lambda a, i: (i * 7 % 10) / 10)
    p = {"uniform": B.uniform_policy(), "good": B.ranked_policy(["good"])}
    a, b = verdicts(spark, df, p), verdicts(spark, df, p)
    assert a["good"]["verdict"] == "inconclusive" and a["good"]["lower"] == b["good"]["lower"]


def test_logging_policy_gives_the_mean_and_full_support(spark):
    df = logged(spark)
    e = O.diagnostics(O.with_policies(df, {"u": B.uniform_policy()}), ["policy"]).first()
    assert e["snips"] == pytest.approx(e["logging_value"]) and e["ess"] == pytest.approx(400) and e["support"] == pytest.approx(1.0) and e["reliable"]


def test_linucb_and_direct_method_equal_numpy(spark):
    df = logged(spark, 60, lambda a, i: (0.7 if a == "good" else 0.1) + 0.2 * (i % 2))
    model = B.linucb_fit(B.linucb_gram(df, weighted=False), dim=2)
    rows = df.collect()
    theta = {}
    for a in ("good", "bad"):
        x = np.array([r["features"] for r in rows if r["action"] == a])
        y = np.array([r["reward"] for r in rows if r["action"] == a])
        theta[a] = np.linalg.solve(np.eye(2) + x.T @ x, x.T @ y)
    for r in model.collect():
        assert np.allclose(r["theta"], theta[r["action"]], atol=1e-9)
        assert r["n"] == sum(q["action"] == r["action"] for q in rows)
    w = O.with_policies(df, {"u": B.uniform_policy(), "good": B.ranked_policy(["good"])})
    got = {r["policy"]: r for r in O.direct_method(w, model, ["policy"]).collect()}
    for name, probs in (("u", {"good": 0.5, "bad": 0.5}), ("good", {"good": 1.0})):
        dm = [sum(p * theta[a] @ np.array(r["features"]) for a, p in probs.items()) for r in rows]
        dr = [d + probs.get(r["action"], 0) / r["propensity"] * (r["reward"] - theta[r["action"]] @ np.array(r["features"])) for d, r in zip(dm, rows)]
        assert got[name]["dm"] == pytest.approx(np.mean(dm)) and got[name]["dr"] == pytest.approx(np.mean(dr))


def test_policy_probabilities_sum_to_one_and_ties_go_to_the_smaller_name(spark):
    s = spark.createDataFrame([("o", "b", 1.0), ("o", "a", 1.0), ("o", "c", 0.5)], "observation_id string, action string, score double")
    p = B.policy_probabilities(s, mode="epsilon_greedy", epsilon=0.3).first()["probs"]
    assert sum(p.values()) == pytest.approx(1.0) and p["a"] == pytest.approx(0.8)


def test_sealed_split_and_parameters(spark):
    ex = spark.createDataFrame([("test",)], "split string")
    with pytest.raises(PermissionError):
        B.examples_for(ex, "test")
    assert B.examples_for(ex, "test", "verification").count() == 1
    with pytest.raises(ValueError):
        VD.validate_exploration("epsilon_greedy", 1.5)
    with pytest.raises(ValueError):
        R.RewardConfig.merged({"surprise": 1})


def test_attempt_files_in_every_format(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i}", "c", "h", 'say "hi", ok\nbye' if i % 2 else None, str(i)) for i in range(7)], "attempt_id string, case_id string, prompt_hash string, response_text string, cost_minor string")
    rows.write.json(f"{tmp_path}/jsonl")
    WR.write_json_documents(rows, f"{tmp_path}/json", "attempts", 3)
    WR.write_json_documents(rows, f"{tmp_path}/agg", "rows", 3)
    rows.write.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    want = {(r["attempt_id"], r["response_text"], r["cost_minor"]) for r in rows.collect()}
    for fmt, name in (("jsonl", "jsonl"), ("json", "json"), ("csv", "csv"), ("aggregate-report", "agg")):
        got = {(r["attempt_id"], r["response_text"], r["cost_minor"]) for r in RD.read_attempts(spark, f"{tmp_path}/{name}", fmt).collect()}
        assert got == want, fmt
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{oops")
    with pytest.raises(Exception, match="cannot parse import"):
        RD.read_attempts(spark, f"{tmp_path}/bad", "json").collect()


def test_refused_requests_use_nothing(spark):
    from assaylake.operators.ledger import budget_admission_replay

    rows = [("a", 1, 60, None, 100), ("a", 2, 50, None, 100), ("a", 3, 40, None, 100), ("a", 4, 0, None, 100), ("b", 5, 10**9, 1, None), ("b", 6, 1, 1, None),
            ("c", 7, None, 3, 100), ("c", 8, 1, 3, 100), ("d", 9, None, None, None), ("e", 10, 1, 0, None)]
    df = spark.createDataFrame(rows, "run string, at long, cost_minor long, max_requests int, max_cost_minor long")
    got = {r["at"]: r["admitted"] for r in budget_admission_replay(df, "run", "at").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False, 8: True, 9: True, 10: False}
    freed = {r["at"]: r["admitted"] for r in budget_admission_replay(df, "run", "at", F.col("at").isin(1, 5)).collect()}
    assert freed == got | {2: True, 6: True, 3: True}
    # alternating sizes, against a plain fold
    costs = [1 if i % 2 == 0 else 40 - i // 2 for i in range(60)]
    df = spark.createDataFrame([("x", i, c, None, 40) for i, c in enumerate(costs)], df.schema)
    used, want = 0, {}
    for i, c in enumerate(costs):
        want[i] = used + c <= 40
        used += c if want[i] else 0
    assert {r["at"]: r["admitted"] for r in budget_admission_replay(df, "run", "at").collect()} == want
    r = random.Random(6)
    caps = {k: (r.choice([None, 0, 5, 40]), r.choice([None, 0, 60, 900])) for k in range(12)}
    rows = [(f"r{k}", i, r.choice([None, 0, 1, r.randint(2, 80)]), *caps[k], r.random() < 0.1) for i, k in enumerate(r.choices(range(12), weights=[30, *[1] * 11], k=3000))]
    df = spark.createDataFrame(rows, "run string, at long, cost_minor long, max_requests int, max_cost_minor long, gone boolean").repartition(5)
    state, want = {}, {}
    for run, at, cost, slots, room, gone in rows:
        n, used = state.get(run, (0, 0))
        want[at] = (slots is None or n < slots) and (room is None or (cost is not None and used + cost <= room))
        if want[at] and not gone:
            state[run] = n + 1, used + (cost or 0)
    assert {x["at"]: x["admitted"] for x in budget_admission_replay(df, "run", "at", F.col("gone")).collect()} == want
    assert budget_admission_replay(df.limit(0), "run", "at").count() == 0


def test_tiers_and_envelopes_are_parameters(spark):
    rows = spark.createDataFrame([("gold", 0.5, "USD"), ("tin", 0.5, "USD")], "tier string, final_cost double, currency string")
    cost = lambda envelope: [r["cost_normalized"] for r in R.normalize_cost(rows, R.RewardConfig(cost_envelope=envelope)).collect()]
    assert cost({"gold": 1.0}) == [0.5, None]  # a tier without an envelope stays unknown
    assert cost({"gold": 1.0, "default": 2.0}) == [0.5, 0.25] and cost({}) == [None, None]
    from assaylake.functions.features import feature_spec
    names = [n for n, *_ in feature_spec(("gold", "tin"), ("law",))]
    assert names[1:6] == ["tier=gold", "tier=tin", "tier=other", "task_domain=law", "task_domain=other"]
    facts = spark.sql("SELECT tier, 31000 AS tokens, array('a') AS eligible, 'a' AS action, 'a' AS shadow_action, 0D AS correction_distance, 0 AS retry_count, 0.1D AS ratio FROM VALUES ('gold'), ('tin') v(tier)")
    edge = lambda low: [r["tier_edge"] for r in N.row_components(facts, {"a": 32000}, low).collect()]
    assert edge(("tin",)) == [0.0, 1.0] and edge(()) == [0.0, 0.0]


def test_roots_of_long_chains_cycles_and_missing_parents(spark):
    nodes = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(150)] + [("x", "y"), ("y", "x"), ("z", "x"), ("me", "me"), ("o", "gone"), ("oo", "o")]
    rows = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in LN.roots(spark.createDataFrame(nodes, "id string, parent_id string")).collect()}
    assert len(rows) == len(nodes) and all(rows[f"n{i:03}"] == ("n000", i, False) for i in range(150))
    assert all(rows[i] == (None, None, True) for i in ("x", "y", "z", "me"))
    assert rows["o"] == ("gone", 1, False) and rows["oo"] == ("gone", 2, False)
    assert LN.roots(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_leakage_in_blocks_of_patterns_with_crowded_grams(spark):
    texts = [(i, ("the quick brown fox " * 30 + f"item number {i} of the list") if i % 3 else f"item number {i} of the list" + " lorem" * 20) for i in range(80)] + [(98, None), (99, "")]
    targets = [(f"g{i}", "the quick brown fox the quick brown fox item number %d of the" % i) for i in range(40)] + [(f"h{i}", f"number {i} of") for i in range(40)] + [("e", " "), ("n", None)]
    norm = lambda s: re.sub(r"\s+", " ", (s or "").lower()).strip()
    want = {(a, g) for a, t in texts for g, s in targets if norm(s) and norm(s) in norm(t)}
    got = [tuple(r) for r in LN.leakage_scan(spark.createDataFrame(texts, "text_id bigint, text string"), spark.createDataFrame(targets, "target_id string, target string"), patterns=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leakage_targets_of_a_nested_reference(spark):
    cases = spark.createDataFrame([("a", "exact_json", '{"z": ["long leaf text", {"k": "short"}], "b": 1}', ["Valid JSON", " names the river "]), ("b", "rubric", "plain", ["valid json", None]),
                                   ("c", "exact_text", " ", []), ("d", "exact_text", None, None)], "case_id string, method string, reference_answer string, criteria array<string>")
    got = {tuple(r) for r in LN.leakage_targets(cases).collect()}
    assert got == {("a", '{"b": 1, "z": ["long leaf text", {"k": "short"}]}'), ("a", '{"b":1,"z":["long leaf text",{"k":"short"}]}'), ("a", "long leaf text"), ("a", "names the river"),
                   ("b", "plain"), ("b", "valid json")}


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (1, 1)])
def test_similar_texts_equal_all_pairs(spark, num, den):
    rng = random.Random(num)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14))] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["new"]) for b in base] + [" ".join(reversed(base[0]))] * 3 + ["", None, "!!", "!!", "common"] + ["common word"] * 9
    rows = [(i, x) for i, x in enumerate(texts)]
    toks = {i: frozenset(re.findall(r"\w+", (x or "").lower())) for i, x in rows}
    same = lambda i, j: i == j or (toks[i] == toks[j] and (bool(toks[i]) or (not texts[i] and not texts[j])))
    cls = {i: min(j for j in toks if same(i, j)) for i in toks}
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and toks[a] and toks[b] and len(toks[a] & toks[b]) * den >= len(toks[a] | toks[b]) * num}
    members, links = SM.similar_texts(spark.createDataFrame(rows, "text_id bigint, text string"), num, den)
    assert {r["text_id"]: r["class_id"] for r in members.collect()} == cls
    got = {(r["a"], r["b"]): r["similarity"] for r in links.collect()}
    assert set(got) == want and all(v == pytest.approx(len(toks[a] & toks[b]) / len(toks[a] | toks[b])) for (a, b), v in got.items())


@pytest.mark.parametrize("spread", [1e-9, 1.0, 1e12])
def test_percentiles_at_any_scale_with_crowding_and_null_groups(spark, spread):
    rng = random.Random(3)
    groups = {"a": [rng.lognormvariate(0, 3) * spread for _ in range(3000)], "b": [spread] * 500 + [2 * spread], None: [rng.random() * spread for _ in range(9)], "none": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {r["g"]: r for r in RPT.latency_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], parts=16).collect()}
    for g, vs in groups.items():
        known = sorted(v for v in vs if v is not None)
        r = got[g]
        assert (r["known_count"], r["unknown_count"]) == (len(known), len(vs) - len(known))
        if known:
            assert r["median"] == pytest.approx(float(np.median(known)), rel=1e-12)
            assert [r["p90"], r["p95"]] == [known[math.ceil(len(known) * q) - 1] for q in (0.9, 0.95)]
        else:
            assert r["median"] is None


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _odd_records(n):
    rng = random.Random(n)
    odd = ['}', '{"', '\\', '"', '],', '"rows":[{', "é\n", "x" * 300, "", "[", "\u2028"]
    return [{"id": i, "t": "".join(rng.choice(odd) for _ in range(rng.randrange(6))), "deep": [{"a": {"b": rng.choice(odd)}}, [1, {}]]} for i in range(n)]


@pytest.mark.parametrize("form", ["list", "wrapped", "indented", "others"])
def test_json_records_by_byte_ranges_equal_the_whole_parse(small_ranges, tmp_path, form):
    rows = _odd_records(60)
    doc = {"list": rows, "indented": rows, "wrapped": {"rows": rows}, "others": {"meta": {"n": {"x": 1}}, "first": [{"no": 1}, {"no": 2}], "rows": rows, "last": [{"no": 3}, {"no": 4}], "end": {}}}[form]
    for name, part in (("a", doc), ("b", [] if form == "list" else {"rows": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, ensure_ascii=False, indent=2 if form == "indented" else None) + ("\n" if form != "wrapped" else ""), encoding="utf-8")
    assert small_ranges.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = RG.json_records(small_ranges, str(tmp_path), "rows").orderBy("no").collect()
    assert [json.loads(r["record"]) for r in got] == rows


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a"', '[{"a": 1}', '{"rows": [{"a": 1}', "plain", '[{"a": nope}]'])
def test_broken_json_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON document"):
        RG.json_records(spark, str(tmp_path), "rows").collect()


def test_csv_records_by_byte_ranges_equal_the_whole_parse(small_ranges, tmp_path):
    rng = random.Random(5)
    cell = lambda: rng.choice(["plain", 'a "quoted" word', "two\nlines", "comma, here", "é" * 50, "x,\n\"\n", ""])
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "one", "two, named"])
            w.writerows([[f"{name}{i}", cell(), cell()] for i in range(50)])
    want = small_ranges.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    got = RG.csv_records(small_ranges, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 100


def test_a_grader_and_a_chooser_are_added_from_outside(spark):
    @F.pandas_udf("boolean")
    def palindrome(x):
        return x.map(lambda v: None if v is None else v == v[::-1])

    if "palindrome" not in G._GRADERS:
        G.register_grader("palindrome", lambda text, _ref: G.verdict(palindrome(text), F.when(~palindrome(text), "does not read the same backwards")))
    with pytest.raises(ValueError):
        G.register_grader("exact_text", G.grade_exact_text)
    rows = [("a1", "success", "anna", "palindrome", None), ("a2", "success", "bob!", "palindrome", None), ("a3", "success", None, "palindrome", None), ("a4", "failed", "x", "palindrome", None),
            ("a5", "success", "x", "exact_text", "x"), ("a6", "success", "x", "longer", "ab"), ("a7", "success", "x", "else", "ab")]
    df = spark.createDataFrame(rows, "attempt_id string, status string, response_text string, method string, reference_answer string").withColumn("schema_name", F.lit(None).cast("string"))
    longer = {"longer": lambda text, ref: G.verdict(F.length(text) > F.length(ref), F.lit("too short"))}
    got = {r["attempt_id"]: (r["passed"], r["grader_id"]) for r in G.grade_attempts(df, graders=longer).collect()}
    assert got == {"a1": (True, "palindrome"), "a2": (False, "palindrome"), "a3": (None, "missing_output"), "a4": (None, "attempt_status"), "a5": (True, "exact_text"), "a6": (False, "longer"),
                   "a7": (None, "unsupported_method")}
    for name, build in (("last", lambda e: F.try_element_at(e, F.lit(-1))), ("always_x", lambda e: F.lit("x"))):
        if name not in RT._CHOOSERS:
            RT.register_chooser(name, build)
    c = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"]), (3, [])], "id int, eligible array<string>")
    assert {(r["id"], r["chooser"]): r["choice"] for r in RT.choose(c, ["last", "always_x"]).collect()} == {(1, "last"): "b", (2, "last"): "x", (3, "last"): None, (1, "always_x"): None, (2, "always_x"): "x", (3, "always_x"): None}
    with pytest.raises(ValueError):
        RT.choose(c, ["nobody"])
