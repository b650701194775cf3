"""Contextual-bandit dataset, LinUCB by sufficient statistics, and policy distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.hashing import canonical, digest_aggs, hash32
from assaylake.functions.plan import computed_once
from assaylake.operators.validate import validate_exploration
from assaylake.schemas import FEATURE_SCHEMA_VERSION, REWARD_SCHEMA_VERSION


def observation_reward_join(observations: DataFrame, rewards: DataFrame) -> DataFrame:
    """Each observation with its run's reward, if any."""
    r = rewards.select("run_id", F.lit(True).alias("has_reward"), F.col("reward_schema"), "scalar", "excluded_reason", "cost_usd", "latency", "success", "critical", "tool_failure_penalty")
    return observations.join(r, "run_id", "left")


def exclusion_reason(min_propensity: float, dim: int) -> Column:
    """First exclusion that applies to a joined observation, in the stated order; null keeps the row."""
    p = F.col("obs_propensity")
    return (F.when(F.col("shadow"), "shadow_decision_not_executed").when(p.isNull() | (p <= 0) | (p > 1), "invalid_propensity")
            .when(p < min_propensity, "below_min_propensity").when(~F.array_contains("eligible_actions", F.col("chosen_action")), "action_not_eligible")
            .when((F.col("feature_schema_version") != FEATURE_SCHEMA_VERSION) | F.col("features").isNull() | (F.size("features") != dim), "feature_schema_mismatch")
            .when(F.col("has_reward").isNull(), "no_reward").when(F.col("reward_schema") != REWARD_SCHEMA_VERSION, "reward_schema_mismatch")
            .when(F.col("scalar").isNull(), F.concat(F.lit("reward_excluded:"), F.coalesce("excluded_reason", F.lit("unknown")))))


def hash_split(group: Column, seed: int, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> Column:
    """Split by a hash of the group, so rows of one group stay together."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError("split fractions must sum to 1")
    frac = hash32(F.concat_ws("|", group, F.lit(str(seed)))) % 1000 / 1000.0
    return F.when(frac < fractions[0], "train").when(frac < fractions[0] + fractions[1], "validation").otherwise("test")


def bandit_dataset(joined: DataFrame, *, seed: int, dim: int, min_propensity: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Examples with their split, and the count of every exclusion."""
    df = joined.withColumn("exclusion", exclusion_reason(min_propensity, dim))
    examples = df.filter("exclusion IS NULL").select(
        "observation_id", "run_id", "k", hash_split(F.coalesce("session_id", "run_id"), seed).alias("split"), "features", "eligible_actions",
        F.col("chosen_action").alias("action"), F.col("obs_propensity").alias("propensity"), F.col("scalar").alias("reward"), "tier", "task_domain", "policy_version",
        "success", F.col("cost_usd").alias("cost"), F.col("latency").alias("latency_ms"), "critical", "tool_failure_penalty")
    return examples, df.filter("exclusion IS NOT NULL").groupBy("exclusion").agg(F.count(F.lit(1)).alias("n"))


def dataset_digest(examples: DataFrame) -> DataFrame:
    """Order-free checksum per split; equal content gives equal rows."""
    row = hash32(canonical("observation_id", "split", "action", F.round("propensity", 9).cast("decimal(12,9)"), F.round("reward", 6).cast("decimal(12,6)")))
    return examples.groupBy("split").agg(*digest_aggs(row))


def examples_for(examples: DataFrame, split: str, purpose: str | None = None) -> DataFrame:
    """Rows of a split; the test split opens for verification only."""
    if split == "test" and purpose != "verification":
        raise PermissionError("the test split is readable for verification only")
    return examples.filter(F.col("split") == split)


def _gram_cells(bits: int, actions: int = 1000):
    """Sums of a task as whole multiples of 2 ** -bits, in two halves: integers add up alike in any order and grouping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for action, (high, low, met) in held.items():
                i, j = np.nonzero(met)
                dim = len(met)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([action] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(np.where(j < dim, j, dim - 1 - j).astype(np.int32)), pa.array(high[i, j]), pa.array(low[i, j])],
                    ["action", "i", "j", "high", "low"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column(0).to_pylist(), object)
            w, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            dim = x.shape[1]
            wide = max(dim, 2)  # two cells hold the weight and the count
            bound = max(float(np.abs(w).max()), 1.0) * max(float(np.abs(x).max()), float(np.abs(r).max()), 1.0) ** 2
            step = 2.0**62 / (bound * 2.0**bits)
            if not step >= 1:
                raise ValueError(f"products up to {bound:g} are beyond exact sums of {bits} bits")
            step = int(min(step, 1 << 16))
            for action in sorted(set(names)):
                of = np.flatnonzero(names == action)
                if action not in held:
                    held[action] = [np.zeros((wide, wide + 2), np.int64), np.zeros((wide, wide + 2), np.int64), np.zeros((wide, wide + 2), bool)]
                high, low, met = held[action]
                for at in range(0, len(of), step):
                    rows = of[at : at + step]
                    total = np.zeros(high.shape, np.int64)
                    wx, nonzero = w[rows, None] * x[rows], x[rows] != 0
                    whole = lambda v: np.rint(v * 2.0**bits).astype(np.int64).sum(0)
                    for i in range(dim):
                        total[i, i:dim] = whole(wx[:, i : i + 1] * x[rows, i:])
                    total[:dim, wide] = whole(wx * r[rows, None])
                    total[:2, wide + 1] = whole(w[rows]), len(rows) << bits
                    high += total >> 32
                    low += total & 0xFFFFFFFF
                    together = np.triu(nonzero.T.astype(np.float32) @ nonzero.astype(np.float32)) > 0
                    met[:dim, :dim] |= together
                    met[:dim, wide] |= nonzero.any(0)
                    met[:2, wide + 1] = True
            if len(held) > actions:
                yield from emit()
        yield from emit()

    return run


def linucb_gram(examples: DataFrame, *, weighted: bool = True, clip: float = 10.0, bits: int = 40) -> DataFrame:
    """Per action and cell: sum of w x_i x_j (i <= j), with j = -1 the sum of w r x_i, j = -2 weight (i = 0) and count (i = 1).

    Each product is rounded to a multiple of 2 ** -bits once, and the multiples are added as integers: the sums are the
    same for any partitioning. A task keeps one matrix per action and sends its cells, so rows are never fanned out.
    Cells that no example has are left out; no examples give no rows.
    """
    w = F.least(1.0 / F.col("propensity"), F.lit(clip)) if weighted else F.lit(1.0)
    df = examples.select("action", w.cast("double").alias("w"), F.col("reward").cast("double").alias("r"), "features")
    cells = df.mapInArrow(_gram_cells(bits), "action string, i int, j int, high long, low long").groupBy("action", "i", "j")
    big = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).cast("decimal(27,0)")
    total = big("high") * F.lit(1 << 32).cast("decimal(10,0)") + big("low")
    return cells.agg((total.cast("double") / F.lit(2.0**bits)).alias("v"))


def linucb_fit(gram: DataFrame, *, dim: int, lam: float = 1.0) -> DataFrame:
    """theta and the inverse of lambda I + Gram per action.

    Each group is the fixed-size statistic of one action (at most dim * dim / 2 + dim + 2
    rows), never the examples themselves.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.eye(dim) * lam, np.zeros(dim)
        n = weight = 0.0
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
            if j == -1:
                b[i] += v
            elif j == -2:
                weight, n = (v, n) if i == 0 else (weight, v)
            else:
                a[i, j] += v
                if i != j:
                    a[j, i] += v
        inv = np.linalg.inv(a)
        theta = np.linalg.solve(a, b)
        for _ in range(2):  # sums grow with the examples; the residual in extended precision keeps theta a solution
            theta = theta + np.linalg.solve(a, (b - a.astype(np.longdouble) @ theta).astype(float))
        return pd.DataFrame({"action": [pdf["action"].iloc[0]], "theta": [theta.tolist()], "a_inv": [inv.ravel().tolist()], "n": [int(n)], "weight_sum": [weight]})

    return gram.groupBy("action").applyInPandas(solve, "action string, theta array<double>, a_inv array<double>, n bigint, weight_sum double")


def linucb_score(examples: DataFrame, model: DataFrame, *, alpha: float, dim: int, key: str = "observation_id") -> DataFrame:
    """(key, action, score) for the eligible actions the model knows.

    The model has one row per action; it is joined by action, and Spark broadcasts it while
    it is small. Without exploration bonus the inverse is not even read.
    """
    vectors = computed_once(examples.select(key, "features", "eligible_actions"), "at", F.filter(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get("features", i) != 0))
    e = vectors.select(key, "features", "at", F.explode("eligible_actions").alias("action"))
    cols = ["action", "theta"] + (["a_inv"] if alpha else [])
    j = e.join(model.select(*cols), "action")
    # zeros add nothing: only places with a value are multiplied, in their order
    dot = lambda weight: F.aggregate("at", F.lit(0.0), lambda s, i: s + weight(i) * F.get("features", i))
    score = dot(lambda i: F.get("theta", i))
    if alpha:
        spread = dot(lambda i: dot(lambda j: F.get("a_inv", i * dim + j)))
        score = score + alpha * F.sqrt(F.greatest(F.lit(0.0), spread))
    return j.select(key, "action", score.alias("score"))


def linucb_greedy(scores: DataFrame, key: str = "observation_id") -> DataFrame:
    """Best action per key; equal scores go to the smaller name."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), "action")).alias("b")
    return scores.groupBy(key).agg(best, F.count(F.lit(1)).alias("k")).select(key, F.col("b.action").alias("greedy"), "k")


def policy_probabilities(scores: DataFrame, *, mode: str, epsilon: float, key: str = "observation_id") -> DataFrame:
    """(key, probs) with probs a map action -> probability over eligible known actions."""
    mode, eps = validate_exploration(mode, epsilon)
    g = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("neg"), "action"))["action"].alias("greedy"), F.sort_array(F.collect_set("action")).alias("actions"))
    if mode == "none":
        return g.select(key, F.create_map("greedy", F.lit(1.0)).alias("probs"))
    k = F.size("actions")
    probs = F.map_from_entries(F.transform("actions", lambda a: F.struct(a.alias("key"), (F.lit(eps) / k + F.when(a == F.col("greedy"), 1.0 - eps).otherwise(0.0)).alias("value"))))
    return g.select(key, probs.alias("probs"))


def ranked_policy(ranking: list[str], eligible: str = "eligible_actions") -> Column:
    """Deterministic policy as a map column: all mass on the first eligible action of a ranking."""
    order = F.array(*[F.lit(a) for a in ranking])
    choice = F.filter(order, lambda a: F.array_contains(F.col(eligible), a))
    return F.when(F.size(choice) > 0, F.create_map(F.get(choice, 0), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))


def uniform_policy(eligible: str = "eligible_actions") -> Column:
    return F.map_from_entries(F.transform(eligible, lambda a: F.struct(a.alias("key"), (F.lit(1.0) / F.size(eligible)).alias("value"))))


def train_metrics(train: DataFrame) -> DataFrame:
    return train.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


def parameter_checksum(model: DataFrame) -> DataFrame:
    """One row ``checksum`` over all actions' parameters to the last digit; one line per action is gathered."""
    digits = F.array_join(F.transform(F.concat("theta", "a_inv"), lambda x: x.cast("string")), ",")
    line = F.concat_ws("|", "action", F.sha2(digits, 256))
    return model.agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(line))), 256).alias("checksum"))


def reproduce_check(stored: DataFrame, refit: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Checksums and largest parameter difference of a stored and a refitted model, and the verdict: equal checksums, nearly equal parameters."""
    diff = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    j = stored.select("action", F.col("theta").alias("t0"), F.col("a_inv").alias("i0")).join(refit.select("action", F.col("theta").alias("t1"), F.col("a_inv").alias("i1")), "action", "full_outer")
    alike = (F.size("t0") == F.size("t1")) & (F.size("i0") == F.size("i1"))
    d = F.when(F.coalesce(alike, F.lit(False)), F.greatest(diff("t0", "t1"), diff("i0", "i1")))
    g = j.agg(F.max(d).alias("max_abs_diff"), F.count_if(d.isNull()).alias("unmatched"))
    sums = parameter_checksum(stored).join(parameter_checksum(refit).withColumnRenamed("checksum", "_refit"))
    g = g.join(sums.select((F.col("checksum") == F.col("_refit")).alias("checksum_match")))
    return g.withColumn("reproducible", F.col("checksum_match") & (F.col("unmatched") == 0) & F.coalesce(F.col("max_abs_diff") < tolerance, F.lit(False)))
