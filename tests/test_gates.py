"""Promotion gates, each of which can fail; LinUCB sums and models that are the same for any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import bandit as B
from assaylake.operators import gates as GT
from assaylake.operators import ope as O

VERSION = "v1"


def examples(spark, n=1200, **change):
    r = random.Random(3)
    rows = []
    for i in range(n):
        action = r.choice("ab")
        row = {"observation_id": f"o{i}", "action": action, "eligible_actions": ["a", "b"], "propensity": 0.5, "reward": (0.9 if action == "a" else 0.4) + r.random() / 50,
               "tier": f"t{i % 2}", "task_domain": f"d{i % 3}", "critical": False, "tool_failure_penalty": 0.0, "cost": 1.0, "latency_ms": 10.0, "success": True}
        rows.append(row | {k: f(row) for k, f in change.items()})
    return spark.createDataFrame(rows, "observation_id string, action string, eligible_actions array<string>, propensity double, reward double, tier string, task_domain string, "
                                       "critical boolean, tool_failure_penalty double, cost double, latency_ms double, success boolean")


def verdicts(spark, validation=None, holdout=None, leaks=0, version=VERSION, same=True, findings=0):
    weigh = lambda df, segments: O.with_policies(O.with_segments(df, segments), {"new": B.ranked_policy(["a", "b"])})
    good = examples(spark)
    model = spark.createDataFrame([("a", [1.0], [2.0])], "action string, theta array<double>, a_inv array<double>")
    other = model if same else model.withColumn("theta", F.array(F.lit(1.0 + 1e-13)))
    few = lambda n, name: spark.createDataFrame([(str(i),) for i in range(n)], f"{name} string")
    out = GT.promotion_gates(weigh(validation if validation is not None else good, ["task_domain", "tier"]), weigh(holdout if holdout is not None else good, []), "observation_id", GT.GateConfig(draws=60),
                             leaks=few(leaks, "text_id"), feature_versions=spark.createDataFrame([(version,)], "feature_schema_version string"), current_version=VERSION,
                             reproduce=B.reproduce_check(model, other), core_regressions=few(findings, "key"))
    return {x["gate"] for x in out.collect() if not x["passed"]}


def test_a_good_candidate_passes_every_gate(spark):
    assert verdicts(spark) == set()


@pytest.mark.parametrize("gate,broken", [
    ("oracle_isolation", {"leaks": 1}), ("feature_schema_compatible", {"version": "v0"}), ("reproducible", {"same": False}), ("core_regression", {"findings": 1})])
def test_gates_on_tables_beside_the_examples(spark, gate, broken):
    assert verdicts(spark, **broken) == {gate}


WORSE = {"reward": lambda row: 0.2 if row["action"] == "a" else 0.9}
ON_A = lambda good, bad: lambda row: bad if row["action"] == "a" else good


@pytest.mark.parametrize("gate,change", [
    ("critical_failures", {"critical": ON_A(False, True)}), ("tool_schema_failures", {"tool_failure_penalty": ON_A(0.0, 1.0)}), ("tier_budget", {"cost": ON_A(1.0, 9.0)}),
    ("tier_latency", {"latency_ms": ON_A(1.0, None)}), ("ope_non_inferior", WORSE), ("segment_non_inferior", {"reward": lambda row: 0.1 if (row["action"], row["tier"]) == ("a", "t1") else 0.5})])
def test_gates_on_the_validation_split(spark, gate, change):
    assert gate in verdicts(spark, validation=examples(spark, **change))


def test_support_and_holdout_gates(spark):
    assert "ope_support" in verdicts(spark, validation=examples(spark, n=20))
    assert verdicts(spark, holdout=examples(spark, **WORSE)) == {"holdout"}


# ---- exact sums ------------------------------------------------------------------------------
def vectors(spark, n, dim, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["x", "y", "z"]) if i % 7 else "x", r.choice([0.05, 0.3, 0.5, 1.0]), r.uniform(-1, 1), [r.choice([0.0, 0.0, 1.0, round(r.random(), 6)]) for _ in range(dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "action string, propensity double, reward double, features array<double>")


def test_gram_does_not_depend_on_the_partitioning(spark):
    rows, df = vectors(spark, 3000, 9)
    runs = [{(x["action"], x["i"], x["j"]): x["v"] for x in B.linucb_gram(df.repartition(k)).collect()} for k in (1, 3, 17)]
    assert runs[0] == runs[1] == runs[2]
    for action in "xyz":
        own = [q for q in rows if q[0] == action]
        w = np.minimum(1 / np.array([q[1] for q in own]), 10)
        x, r = np.array([q[3] for q in own]), np.array([q[2] for q in own])
        gram, rhs = (w[:, None] * x).T @ x, (w * r) @ x
        for i in range(9):
            assert runs[0][action, i, -1] == pytest.approx(rhs[i], abs=1e-7)
            for j in range(i, 9):
                assert runs[0].get((action, i, j), 0.0) == pytest.approx(gram[i, j], abs=1e-7)
        assert runs[0][action, 1, -2] == len(own) and runs[0][action, 0, -2] == pytest.approx(w.sum())
    assert B.linucb_gram(df.limit(0)).count() == 0


def test_models_are_reproduced_to_the_last_digit(spark):
    _, df = vectors(spark, 2000, 6)
    fit = lambda rows: B.linucb_fit(B.linucb_gram(rows), dim=6)
    same = B.reproduce_check(fit(df), fit(df.repartition(11))).first()
    assert same["reproducible"] and same["checksum_match"] and same["max_abs_diff"] == 0 and same["unmatched"] == 0
    other = B.reproduce_check(fit(df), fit(df.filter("reward < 0.9"))).first()
    assert not other["reproducible"] and not other["checksum_match"] and other["max_abs_diff"] > 0
    gone = B.reproduce_check(fit(df), fit(df.filter("action <> 'z'"))).first()
    assert not gone["reproducible"] and gone["unmatched"] == 1


def test_values_beyond_exact_sums_are_refused(spark):
    df = spark.createDataFrame([("x", 1.0, 0.5, [1e9])], "action string, propensity double, reward double, features array<double>")
    with pytest.raises(Exception, match="beyond exact sums"):
        B.linucb_gram(df).collect()


def test_an_observation_without_reward_is_excluded(spark):
    DIM = 4
    from assaylake.schemas import FEATURE_SCHEMA_VERSION, REWARD_SCHEMA_VERSION

    obs = spark.createDataFrame([(f"o{i}", f"r{i}", i, None, [0.0] * DIM, ["a"], "a", 0.5, False, "t", "d", "p", FEATURE_SCHEMA_VERSION) for i in range(3)],
                                "observation_id string, run_id string, k long, session_id string, features array<double>, eligible_actions array<string>, chosen_action string, obs_propensity double, shadow boolean, tier string, task_domain string, policy_version string, feature_schema_version string")
    rewards = spark.createDataFrame([("r0", REWARD_SCHEMA_VERSION, 0.5, None), ("r1", "old", 0.5, None)], "run_id string, reward_schema string, scalar double, excluded_reason string")
    for c in ("cost_usd", "latency", "success", "critical", "tool_failure_penalty"):
        rewards = rewards.withColumn(c, F.lit(None).cast("double"))
    rows, excluded = B.bandit_dataset(B.observation_reward_join(obs, rewards), seed=7, dim=DIM)
    assert [x["observation_id"] for x in rows.collect()] == ["o0"]
    assert {x["exclusion"]: x["n"] for x in excluded.collect()} == {"no_reward": 1, "reward_schema_mismatch": 1}
