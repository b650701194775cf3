"""Off-policy evaluation and bootstrap intervals, for many policies and segments in one pass."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.hashing import hash32
from assaylake.functions.reasons import reasons

# Cumulative Poisson(1) probabilities until the tail is below what 32 bits resolve
POISSON_CDF = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))
#: Draws are numbers below this prime; x -> x**5 permutes them and its steps stay within 63 bits.
PRIME = (1 << 31) - 1
#: Rows whose draws are held as one matrix, and sums a task holds before it hands them on.
ROWS_AT_ONCE = 1024
HELD_SUMS = 8_000_000


def with_segments(examples: DataFrame, segments: list[str]) -> DataFrame:
    """Each example once overall and once per segment column."""
    parts = [F.struct(F.lit("all").alias("segment"), F.lit("all").alias("value"))] + [F.struct(F.lit(s).alias("segment"), F.col(s).alias("value")) for s in segments]
    return examples.select("*", F.explode(F.array(*parts)).alias("_s")).select("*", "_s.segment", "_s.value").drop("_s").filter("value IS NOT NULL")


def with_policies(examples: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """Each example once per policy, with the policy's distribution as a map and the weight."""
    parts = [F.struct(F.lit(n).alias("policy"), c.cast("map<string,double>").alias("probs")) for n, c in policies.items()]
    df = examples.select("*", F.explode(F.array(*parts)).alias("_p")).select("*", "_p.policy", "_p.probs").drop("_p")
    return importance_weights(df)


def importance_weights(df: DataFrame) -> DataFrame:
    return df.withColumn("w", F.coalesce(F.try_element_at("probs", F.col("action")), F.lit(0.0)) / F.col("propensity"))


def ope_aggs() -> list[Column]:
    w, r = F.col("w"), F.col("reward")
    out = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2"), F.sum(w * r).alias("sum_wr"), F.max(w).alias("max_weight"),
           F.avg((w > 10).cast("double")).alias("share_weights_above_10"), F.avg(r).alias("logging_value")]
    for f in ("cost", "latency_ms", "success", "critical"):
        v = F.col(f).cast("double")
        lacking = F.coalesce(F.bool_or((w > 0) & v.isNull()), F.lit(False))
        out.append(F.when(~lacking, F.sum(w * v) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))).alias(f"expected_{f}"))
    return out


def estimates(weighted: DataFrame, by: list[str]) -> DataFrame:
    """IPS, SNIPS, ESS and the weighted fields."""
    g = weighted.groupBy(*by).agg(*ope_aggs())
    return g.withColumns({
        "ips": F.col("sum_wr") / F.col("n"), "snips": F.when(F.col("sum_w") > 0, F.col("sum_wr") / F.col("sum_w")),
        "ess": F.when(F.col("sum_w2") > 0, F.col("sum_w") * F.col("sum_w") / F.col("sum_w2")).otherwise(0.0)})


def action_mass(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Share of probability per action, and whether the action was ever logged in the group."""
    probs = weighted.select(*by, F.explode("probs").alias("a", "p")).groupBy(*by, "a").agg(F.sum("p").alias("_m"))
    n = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    logged = weighted.groupBy(*by, F.col("action").alias("a")).agg(F.lit(True).alias("logged"))
    return probs.join(n, by).join(logged, [*by, "a"], "left").select(*by, F.col("a").alias("action"), (F.col("_m") / F.col("_n")).alias("share"), F.coalesce("logged", F.lit(False)).alias("logged"))


def support_mass(weighted: DataFrame, by: list[str], floor: float = 0.01) -> DataFrame:
    """Mean mass on actions that the same domain logged at the floor or above.

    The supported cells (group, domain, action) are a small aggregate. The mass is summed
    per (group, domain, action) first and only then joined with them.
    """
    mass = weighted.select(*by, "task_domain", F.explode("probs").alias("a", "p")).groupBy(*by, "task_domain", "a").agg(F.sum("p").alias("m"))
    cells = weighted.filter(F.col("propensity") >= floor).groupBy(*by, "task_domain", F.col("action").alias("a")).agg(F.lit(1).alias("_ok"))
    hit = mass.join(cells, [*by, "task_domain", "a"], "left_semi").groupBy(*by).agg(F.sum("m").alias("m"))
    n = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return n.join(hit, by, "left").select(*by, (F.coalesce("m", F.lit(0.0)) / F.col("_n")).alias("support"))


def diagnostics(weighted: DataFrame, by: list[str], *, min_ess: float = 30.0, min_support: float = 0.95, floor: float = 0.01) -> DataFrame:
    """Estimates with support, warnings and the reliable flag."""
    e = estimates(weighted, by).join(support_mass(weighted, by, floor), by)
    un = action_mass(weighted, by).filter("share > 0.05 AND NOT logged").groupBy(*by).agg(F.concat_ws(",", F.sort_array(F.collect_set("action"))).alias("unsupported"))
    e = e.join(un, by, "left")
    warn = reasons([
        ("no_logged_action_overlap", F.col("sum_w") == 0), ("bootstrap_no_support", F.col("sum_w") == 0), ("low_effective_sample_size", F.col("ess") < min_ess),
        ("insufficient_support", F.col("support") < min_support), (F.concat(F.lit("unsupported_actions:"), "unsupported"), F.col("unsupported").isNotNull()),
        ("extreme_weights", F.col("max_weight") > 20)])
    return e.withColumn("warnings", warn).withColumn("reliable", F.size("warnings") == 0)


def direct_method(weighted: DataFrame, model: DataFrame, by: list[str], key: str = "observation_id") -> DataFrame:
    """DM and DR with a linear reward model per action (rows: action, theta)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    theta = model.select(F.col("action").alias("a"), "theta")
    e = weighted.select(*by, key, "features", "action", "w", "reward", F.explode_outer("probs").alias("a", "p"))
    j = e.join(theta, "a", "left").withColumn("rhat", F.coalesce(dot(F.col("theta"), F.col("features")), F.lit(0.0)))
    # sums over all (row, action) pairs; the logged action's term carries the correction
    p, w = F.coalesce(F.col("p"), F.lit(0.0)), F.col("w")
    own = F.col("a") == F.col("action")
    n = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    g = j.groupBy(*by).agg(F.sum(p * F.col("rhat")).alias("dm"), F.sum(F.when(own, w * (F.col("reward") - F.col("rhat"))).otherwise(0.0)).alias("corr"))
    return g.join(n, by).select(*by, (F.col("dm") / F.col("n")).alias("dm"), ((F.col("dm") + F.col("corr")) / F.col("n")).alias("dr"))


# ---- bootstrap -----------------------------------------------------------------------------
def poisson_weights(first: np.ndarray, second: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights, a row per pair of hashes and a column per draw b: first + b * second, to the fifth power modulo the prime."""
    x = (first[:, None] + np.arange(1, draws + 1) * second[:, None]) % PRIME
    square = x * x % PRIME
    return np.searchsorted(POISSON_CDF, square * square % PRIME * x % PRIME / PRIME, side="right")


def _draw_sums(by: int, sums: int, draws: int, schema: T.StructType):
    """Per task: the resampled sums of each group. Columns come as group columns, two hashes, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def emit() -> pa.RecordBatch:
            block = np.stack(list(held.values()))  # groups, rows and sums, draws
            labels = [pa.array([g[i] for g in held], t).take(pa.array(np.repeat(np.arange(len(held)), draws))) for i, t in enumerate(types)]
            numbers = [pa.array(np.tile(np.arange(1, draws + 1, dtype=np.int32), len(held))), pa.array(block[:, 0].ravel().astype(np.int64))]
            return pa.RecordBatch.from_arrays([*labels, *numbers, *[pa.array(block[:, 1 + j].ravel()) for j in range(sums)]], schema.names)

        for batch in batches:
            types = [batch.column(i).type for i in range(by)]
            number: dict[tuple, int] = {}
            code = np.fromiter((number.setdefault(g, len(number)) for g in zip(*[batch.column(i).to_pylist() for i in range(by)], strict=True)), np.int64, batch.num_rows)
            groups = list(number)
            first, second = (batch.column(by + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            values = [batch.column(by + 2 + j).fill_null(0.0).to_numpy(zero_copy_only=False) for j in range(sums)]
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                keys, which = np.unique((first[part] << 32) | second[part], return_inverse=True)  # a key's rows share its draws
                order = np.argsort(code[part], kind="stable")
                mine = code[part][order]
                starts = np.flatnonzero(np.diff(mine, prepend=-1))
                weight = poisson_weights(keys >> 32, keys & 0xFFFFFFFF, draws).astype(np.float64)[which[order]]
                added = np.stack([np.add.reduceat(weight, starts, axis=0), *[np.add.reduceat(weight * v[part][order][:, None], starts, axis=0) for v in values]], axis=1)
                for g, more in zip(mine[starts].tolist(), added, strict=True):
                    held[groups[g]] = held[groups[g]] + more if groups[g] in held else more
                if len(held) * draws * (1 + sums) > HELD_SUMS:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    return run


def resample(df: DataFrame, key: str, by: list[str], sums: dict[str, Column], *, draws: int, seed: int = 0) -> DataFrame:
    """Resampled sums per group and draw, one row per (group, draw).

    A row's draws follow from two hashes of (seed, key); they are made as a matrix and summed per group inside
    the task, so what is exchanged is draws x groups rows per task however many rows there are. Rows of one key
    have the same draws in every group. A null value adds nothing to its sum; an empty table gives no rows.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    base = df.select(*by, (hash32(text) % PRIME).alias("_first"), (hash32(text, 9) % PRIME).alias("_second"), *[c.cast("double").alias(n) for n, c in sums.items()])
    schema = T.StructType([T.StructField(n, base.schema[n].dataType) for n in by] + [T.StructField("b", T.IntegerType()), T.StructField("rows", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in sums])
    partial = base.mapInArrow(_draw_sums(len(by), len(sums), draws, schema), schema)
    return partial.groupBy(*by, "b").agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in sums])


def interval(draw_values: DataFrame, by: list[str], value: Column, lower, upper) -> DataFrame:
    """Order statistics of the usable draws (at most ``draws`` values per group) at given 0-based positions."""
    g = draw_values.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_vals"))
    n = F.size("_vals")
    return g.select(*by, n.alias("usable"), F.get("_vals", lower(n).cast("int")).alias("lower"), F.get("_vals", upper(n).cast("int")).alias("upper"))


def bootstrap_ci(weighted: DataFrame, by: list[str], key: str, *, draws: int = 500, seed: int = 0) -> DataFrame:
    """95% interval of the self-normalised estimate; draws without weight are left out."""
    d = resample(weighted, key, by, {"sw": F.col("w"), "swr": F.col("w") * F.col("reward")}, draws=draws, seed=seed)
    est = F.when(F.col("sw") > 0, F.col("swr") / F.col("sw"))
    return interval(d, by, est, lambda n: F.floor((n - 1) * 0.025), lambda n: F.floor((n - 1) * 0.975))


def on_policy_value(examples: DataFrame, by: list[str], key: str, *, draws: int = 500, seed: int = 0) -> DataFrame:
    """Mean logged reward with its interval."""
    m = examples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("value"))
    d = resample(examples, key, by, {"sr": F.col("reward")}, draws=draws, seed=seed)
    ci = interval(d, by, F.when(F.col("rows") > 0, F.col("sr") / F.col("rows")), lambda n: F.floor((n - 1) * 0.025), lambda n: F.floor((n - 1) * 0.975))
    return m.join(ci, by)


def paired_difference(weighted: DataFrame, by: list[str], key: str, *, margin: float, draws: int = 400, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Policy minus logging on the same draws, with a verdict; too few usable draws are inconclusive."""
    w, r = F.col("w"), F.col("reward")
    point = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), (F.sum(w * r)).alias("_wr"), F.avg(r).alias("_m"))
    point = point.withColumn("difference", F.when(F.col("_w") > 0, F.col("_wr") / F.col("_w") - F.col("_m")))
    d = resample(weighted, key, by, {"sw": w, "swr": w * r, "sr": r}, draws=draws, seed=seed)
    tail = (1.0 - confidence) / 2.0
    est = F.when((F.col("sw") > 0) & (F.col("rows") > 0), F.col("swr") / F.col("sw") - F.col("sr") / F.col("rows"))
    ci = interval(d, by, est, lambda n: F.floor(tail * (n - 1)), lambda n: F.floor((1 - tail) * (n - 1)))
    j = point.join(ci, by, "left")
    ok = F.col("difference").isNotNull() & (F.coalesce("usable", F.lit(0)) >= draws * 0.9)
    lower, upper = F.when(ok, F.col("lower")), F.when(ok, F.col("upper"))
    return j.select(*by, "n", "difference", lower.alias("lower"), upper.alias("upper"),
                    F.when(lower >= -margin, "non_inferior").when(upper < -margin, "worse").otherwise("inconclusive").alias("verdict"))


def paired_non_inferiority(pairs: DataFrame, by: list[str], key: str, *, margin: float, draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Bootstrap of the mean per-item difference (column ``diff``)."""
    m = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_difference"))
    d = resample(pairs, key, by, {"sd": F.col("diff")}, draws=draws, seed=seed)
    low = int((1 - confidence) / 2 * draws)
    ci = interval(d, by, F.when(F.col("rows") > 0, F.col("sd") / F.col("rows")), lambda n: F.least(F.lit(low), n - 1), lambda n: n - 1)
    return m.join(ci, by).select(*by, "n", "mean_difference", F.col("lower").alias("lower_bound"), (F.col("lower") >= -margin).alias("non_inferior"))


def cluster_bootstrap_diff(pairs: DataFrame, by: list[str], family: str, *, draws: int = 1000, seed: int = 17) -> DataFrame:
    """Families are resampled, not rows: rows are averaged per family before anything else."""
    both = pairs.filter(F.col("left_score").isNotNull() & F.col("right_score").isNotNull())
    fam = both.groupBy(*by, family).agg(F.avg(F.col("left_score") - F.col("right_score")).alias("d"))
    m = fam.groupBy(*by).agg(F.count(F.lit(1)).alias("families"), F.avg("d").alias("estimate"))
    r = resample(fam, family, by, {"sd": F.col("d")}, draws=draws, seed=seed)
    ci = interval(r, by, F.when(F.col("rows") > 0, F.col("sd") / F.col("rows")), lambda n: F.least(F.lit(int(draws * 0.025)), n - 1), lambda n: F.least(F.lit(int(draws * 0.975)), n - 1))
    j = m.join(ci, by)
    two = F.col("families") >= 2
    return j.select(*by, "families", "estimate", F.when(two, F.col("lower")).alias("lower"), F.when(two, F.col("upper")).alias("upper"))


def frontier_migration(per_domain: DataFrame, masses: DataFrame, prices: DataFrame, candidate: str, baseline: str, margin: float = 0.02) -> DataFrame:
    """Per domain: is the candidate cheaper than the baseline and not worse, with both reliable.

    per_domain(value, policy, snips, reliable), masses(value, policy, action, share), prices(action, price).
    """
    cost = (masses.join(prices, "action", "left").groupBy("value", "policy")
            .agg(F.bool_and(F.col("price").isNotNull() | (F.col("share") <= 0)).alias("known"), F.sum(F.col("share") * F.col("price")).alias("cost")))
    j = per_domain.join(cost, ["value", "policy"], "left")
    side = lambda name, tag: j.filter(F.col("policy") == name).select("value", *[F.col(c).alias(f"{tag}_{c}") for c in ("snips", "reliable", "known", "cost")])
    x = side(candidate, "c").join(side(baseline, "b"), "value")
    known = F.coalesce(F.col("c_known") & F.col("b_known"), F.lit(False))
    ni = F.coalesce(F.col("c_reliable") & F.col("b_reliable") & (F.col("c_snips") >= F.col("b_snips") - margin), F.lit(False))
    return x.select("value", F.col("c_snips").alias("candidate_value"), F.col("b_snips").alias("baseline_value"), ni.alias("non_inferior"),
                    F.when(known, F.col("c_cost") < F.col("b_cost")).alias("shifted_to_cheaper"), known.alias("cost_known"))
