"""Evidence tables derived from the given parquet tables.

Each view is one declarative projection, join or aggregation, so a query that uses
only a few of its columns reads only those (column pruning reaches the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.features import feature_spec
from assaylake.functions.hashing import hash32
from assaylake.functions.jsonvals import canonical_json
from assaylake.functions.plan import computed_once
from assaylake.operators.rewards import RewardConfig
from assaylake.schemas import DOMAINS, FEATURE_SCHEMA_VERSION
from assaylake.sources.tables import Tables

DOMAIN_ARRAY = "array(" + ",".join(f"'{d}'" for d in DOMAINS) + ")"

# ---- example parameters of the derived tables: a label per market segment, envelopes doubling from half a cent (quotients stay short decimals) ----
TIERS = ("t1", "t2", "t3", "t4")
LOW_TIERS = TIERS[:2]
REWARDS = RewardConfig(cost_envelope={**{tier: 0.005 * 2**i for i, tier in enumerate(TIERS)}, "default": 0.02})
FEATURES = feature_spec(TIERS)


def runs(t: Tables) -> DataFrame:
    """One telemetry run per order, with its routing context and logged decision."""
    c = t.customer.select("c_custkey", "c_mktsegment")
    r = (
        t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .selectExpr(
            "o_orderkey AS k",
            "concat('run-', o_orderkey) AS run_id",
            "concat('s-', o_custkey) AS session_id",
            "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 't1' WHEN 'BUILDING' THEN 't2' WHEN 'FURNITURE' THEN 't3' "
            "WHEN 'HOUSEHOLD' THEN 't4' ELSE 'tx' END AS tier",
            f"CASE WHEN o_orderkey % 31 = 5 THEN 'unlisted' ELSE element_at({DOMAIN_ARRAY}, cast(o_orderkey % 15 + 1 AS int)) END AS task_domain",
            "cast(floor(o_totalprice) AS bigint) % 64000 AS tokens",
            "o_orderkey % 5 < 2 AS structured",
            "o_orderkey % 3 = 0 AS tools",
            "o_orderkey % 10 < 3 AS memory",
            "o_orderkey % 7 = 0 AS external",
            "o_custkey % 13 AS depth",
            "o_orderkey % 6 AS tool_count",
            "o_orderkey % 4 AS retry_number",
            "o_orderkey % 11 = 0 AS prev_tool_failure",
            "CASE o_orderkey % 3 WHEN 0 THEN cast(null AS bigint) WHEN 1 THEN 4000L ELSE 10000L END AS slo",
            "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS completed",
            "CASE WHEN o_orderkey % 20 = 0 THEN 'EUR' WHEN o_orderkey % 50 = 7 THEN null ELSE 'USD' END AS currency",
            "o_orderdate AS started_at",
            "datediff(o_orderdate, DATE'1970-01-01') * 1099511627776L + o_orderkey AS seq",
        )
        .withColumn("ratio", F.expr("(tokens * 10000 div 64000) / 10000D"))
    )
    r = (
        r.withColumn("eligible", F.expr(
            "CASE WHEN tier IN ('t3','t4') AND tokens <= 32000 THEN array('lab/m0','lab/m1','lab/m2') "
            "WHEN tier IN ('t3','t4') THEN array('lab/m1','lab/m2') "
            "WHEN tokens <= 32000 THEN array('lab/m0','lab/m1') ELSE array('lab/m1') END"))
        .withColumn("explore", hash32(F.expr("concat('explore|', k)")) % 10000 < 3000)
        .withColumn("pick", hash32(F.expr("concat('pick|', k)")) % F.size("eligible"))
        .withColumn("action", F.expr("CASE WHEN explore THEN element_at(eligible, cast(pick + 1 AS int)) ELSE 'lab/m1' END"))
        .withColumn("propensity", F.expr(
            "CASE WHEN action = 'lab/m1' THEN 0.7D + 0.3D / size(eligible) ELSE 0.3D / size(eligible) END"))
        .withColumn("shadow_action", F.expr("CASE WHEN k % 2 = 0 THEN element_at(eligible, 1) END"))
        .withColumn("policy_version", F.expr("concat('pv-', k % 3)"))
    )
    return r


def lines(t: Tables) -> DataFrame:
    """Attempt, tool and validation events of a run, one row per lineitem."""
    return t.lineitem.selectExpr(
        "l_orderkey AS k",
        "l_linenumber AS line_no",
        "CASE WHEN l_linestatus = 'F' THEN 'attempt' WHEN l_linenumber >= 6 THEN 'validation' ELSE 'tool' END AS kind",
        "concat('lab/m', l_suppkey % 3) AS line_action",
        "concat('tool-', l_partkey % 7) AS tool_name",
        "element_at(array('memory_check','state_check','json_check','schema_check'), cast(l_partkey % 4 + 1 AS int)) AS validator",
        "l_linenumber % 3 + 1 AS attempt_number",
        "l_quantity * 100 AS latency_ms",
        "l_extendedprice / 1e7 AS cost",
        "l_returnflag <> 'R' AS ok",
        "l_discount < 0.08 AS executed",
        "CASE WHEN l_returnflag = 'R' THEN concat('err-', l_suppkey % 5) END AS error_class",
    )


def run_lines(t: Tables) -> DataFrame:
    """Per-run aggregates of the events: one partial + final aggregation on the run key."""
    ln = lines(t)
    a, tl, v = "kind = 'attempt'", "kind = 'tool'", "kind = 'validation'"
    return ln.groupBy("k").agg(
        F.expr(f"count_if({a})").alias("n_attempts"),
        F.expr(f"count_if({tl})").alias("n_tools"),
        F.expr(f"count_if({tl} AND ok AND executed)").alias("n_tools_good"),
        F.expr(f"count_if({tl} AND ok)").alias("n_tools_valid"),
        F.expr(f"count_if({tl} AND attempt_number = 1)").alias("n_tools_first"),
        F.expr(f"count_if({tl} AND attempt_number = 1 AND ok)").alias("n_tools_first_valid"),
        F.expr(f"count_if({v})").alias("n_validations"),
        F.expr(f"count_if({v} AND NOT ok)").alias("n_validations_failed"),
        F.expr(f"count_if({v} AND validator IN ('memory_check','state_check'))").alias("n_memory"),
        F.expr(f"count_if({v} AND validator IN ('memory_check','state_check') AND NOT ok)").alias("n_memory_failed"),
        F.expr(f"sum(CASE WHEN {a} THEN latency_ms END)").alias("final_latency_ms"),
        # summed as decimals: a sum of doubles follows the order of its rows, and a tie of the rounding would change with it
        F.expr(f"cast(round(sum(CASE WHEN {a} THEN cast(cost AS decimal(20,12)) END), 6) AS double)").alias("final_cost"),
        # distinct names and classes come from small fixed catalogues (7 and 5 values)
        F.expr(f"concat_ws(',', array_sort(collect_set(CASE WHEN {tl} THEN tool_name END)))").alias("tool_key"),
        F.expr("concat_ws(',', array_sort(collect_set(error_class)))").alias("error_key"),
    )


def run_facts(t: Tables) -> DataFrame:
    """Runs with outcome, user signals and event counts: the flat form the reward operators take."""
    j = runs(t).join(run_lines(t), "k", "left")
    zero = ["n_attempts", "n_tools", "n_tools_good", "n_tools_valid", "n_tools_first", "n_tools_first_valid",
            "n_validations", "n_validations_failed", "n_memory", "n_memory_failed"]
    j = j.fillna(0, subset=zero).fillna("", subset=["tool_key", "error_key"])
    return j.selectExpr(
        "*",
        "greatest(n_attempts - 1, 0) AS retry_count",
        "CASE k % 9 WHEN 0 THEN false WHEN 1 THEN cast(null AS boolean) ELSE true END AS structured_output_valid",
        "k % 8 = 1 AS user_accept", "k % 8 = 2 AS user_retry", "k % 8 = 3 AS user_abandon", "k % 8 = 4 AS user_correction",
        "CASE WHEN k % 8 = 4 THEN (k % 100) / 100D END AS correction_distance",
        "CASE WHEN k % 16 = 4 THEN 'factual_correction' WHEN k % 8 = 4 THEN 'style_preference' END AS correction_category",
        "coalesce(task_domain = 'privacy' AND NOT coalesce(completed, false) AND k % 7 = 0, false) AS critical_failure",
        "CASE WHEN completed IS NULL THEN cast(null AS boolean) ELSE completed AND n_attempts <= 1 END AS first_shot_success",
    )


def observations(t: Tables, facts: DataFrame | None = None) -> DataFrame:
    """Live and shadow decisions as rows, with a few faulty ones so every exclusion occurs."""
    r = runs(t) if facts is None else facts
    base = r.select(
        "*",
        F.explode(F.expr("CASE WHEN shadow_action IS NULL THEN array(struct(false AS shadow, action AS chosen_action)) "
                         "ELSE array(struct(false AS shadow, action AS chosen_action), struct(true AS shadow, shadow_action AS chosen_action)) END")
                  ).alias("d"),
    ).select("*", "d.shadow", "d.chosen_action").drop("d")
    return base.selectExpr(
        "*",
        "concat(CASE WHEN shadow THEN 'obs-s-' ELSE 'obs-l-' END, k) AS observation_id",
        "CASE WHEN k % 113 = 1 THEN 0D WHEN shadow THEN 1D ELSE propensity END AS obs_propensity",
        "CASE WHEN k % 137 = 1 THEN array('lab/m9') ELSE eligible END AS eligible_actions",
        f"CASE WHEN k % 127 = 1 THEN 'routing-features.v0' ELSE '{FEATURE_SCHEMA_VERSION}' END AS feature_schema_version",
    )


def feedback(t: Tables) -> DataFrame:
    """User feedback, one row per product event."""
    return t.events.selectExpr(
        "event_id AS fk",
        "concat('fb-', event_id) AS feedback_id",
        "concat('run-', event_id) AS run_id",
        "event_id AS k",
        "CASE event_type WHEN 'error' THEN 'correction' WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'edit' "
        "WHEN 'signup' THEN 'retry' ELSE 'intent_change' END AS feedback_type",
        "CASE event_id % 8 WHEN 0 THEN 'factual' WHEN 1 THEN 'Style ' WHEN 2 THEN 'schedule' WHEN 3 THEN 'repair' "
        "WHEN 4 THEN 'weird' WHEN 5 THEN 'correction' END AS hint",
        "event_id % 13 <> 0 AS same_request",
        "cast(get_json_object(props, '$.k') AS bigint) AS minutes_after_output",
        "value / 50D AS correction_distance",
        "CASE WHEN event_id % 10 = 3 THEN '' WHEN event_id % 17 = 0 THEN concat('write to user', event_id, '@example.com') "
        "ELSE concat('better answer ', event_id % 50) END AS sanitized_corrected_value",
        "CASE WHEN event_id % 23 = 0 THEN null WHEN event_id % 29 = 0 THEN concat('key sk-abcdefgh', event_id) "
        "ELSE concat('first answer ', event_id % 70) END AS sanitized_original_value",
    )


def cases(t: Tables) -> DataFrame:
    """Benchmark cases, one per part; the reference answer follows the evaluation method."""
    return t.part.selectExpr(
        "p_partkey AS ck",
        "concat('case-', p_partkey) AS case_id",
        "concat('fam-', p_partkey % 97) AS family_id",
        "CASE p_partkey % 97 % 5 WHEN 0 THEN 'calibration' WHEN 1 THEN 'holdout' ELSE 'train' END AS split",
        "cast(p_size % 4 + 1 AS bigint) AS complexity_level",
        f"element_at({DOMAIN_ARRAY}, cast(p_partkey % 15 + 1 AS int)) AS domain",
        "element_at(array('exact_text','exact_json','schema','rubric','exact_text','exact_json','imported'), cast(p_partkey % 7 + 1 AS int)) AS method",
        "CASE p_partkey % 7 WHEN 1 THEN concat('{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}') "
        "WHEN 5 THEN concat('{\"brand\":\"', p_brand, '\",\"size\":', p_size, '}') ELSE p_name END AS reference_answer",
        "p_name", "p_brand", "cast(p_size AS bigint) AS p_size",
        "sha2(concat('prompt|', p_partkey), 256) AS prompt_hash",
        "CASE WHEN p_partkey % 19 = 0 THEN array('adversarial') WHEN p_partkey % 23 = 0 THEN array('red_team','long') ELSE array('plain') END AS tags",
        "concat('Answer about ', p_name, CASE WHEN p_partkey % 7 IN (1,5) THEN ' as JSON' ELSE ' in words' END) AS prompt_text",
        "p_partkey % 41 = 0 AS real_personal_data",
    )


def attempts(t: Tables) -> DataFrame:
    """Benchmark attempts, one per lineitem; the response is derived in :func:`attempts_with_text`."""
    return t.lineitem.selectExpr(
        "concat_ws('-', 'att', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int), datediff(l_shipdate, DATE'1970-01-01')) AS attempt_id",
        "concat('er-', l_suppkey) AS eval_run_id",
        "l_suppkey AS rk", "l_partkey AS ck", "l_orderkey AS k", "l_linenumber AS line_no",
        "concat('case-', l_partkey) AS case_id",
        "'lab' AS provider", "concat('m', l_suppkey % 3) AS model",
        "CASE WHEN l_discount >= 0.095 THEN 'timeout' WHEN l_discount >= 0.085 THEN 'refusal' ELSE 'success' END AS status",
        "l_returnflag AS flavour",
        "CASE WHEN l_linenumber = 7 THEN null ELSE l_quantity * 100 END AS latency_ms",
        "CASE WHEN l_tax > 0.075 THEN null ELSE cast(floor(l_extendedprice / 100) AS bigint) END AS cost_minor",
        "CASE WHEN l_suppkey % 10 = 3 AND l_linenumber % 2 = 1 THEN 'EUR' WHEN l_suppkey % 10 = 4 AND l_linenumber = 2 THEN null ELSE 'USD' END AS currency",
        "cast(l_quantity * 20 AS bigint) AS input_tokens",
        "CASE WHEN l_linenumber = 6 THEN null ELSE cast(l_quantity * 5 AS bigint) END AS output_tokens",
        "CASE WHEN l_orderkey % 83 = 0 THEN 'stale' ELSE sha2(concat('prompt|', l_partkey), 256) END AS prompt_hash",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'long' ELSE 'short' END AS context_condition",
        "datediff(l_shipdate, DATE'1970-01-01') AS ship_day",
        "l_shipdate AS completed_at",
        "l_discount AS discount", "l_tax AS tax",
    )


def attempts_with_text(t: Tables, some: DataFrame | None = None) -> DataFrame:
    """Attempts, all or ``some``, joined with their case, with a response text in right, wrong and malformed flavours."""
    c = cases(t).select("ck", "family_id", "split", "complexity_level", "domain", "method", "reference_answer",
                        "p_name", "p_brand", "p_size")
    c = computed_once(c, "reference_json", F.when(F.col("method") == "exact_json", canonical_json(F.col("reference_answer"))))
    return (attempts(t) if some is None else some).join(c, "ck").withColumn("response_text", F.expr("""
      CASE WHEN line_no = 5 AND flavour = 'N' THEN null
           WHEN method = 'exact_json' THEN CASE
             WHEN flavour = 'A' THEN concat('{ "size": ', p_size, ', "brand": "', p_brand, '" }')
             WHEN flavour = 'N' AND line_no % 2 = 0 THEN concat('{"brand":"', p_brand, '","size":', p_size, '.0}')
             WHEN flavour = 'N' THEN concat('{"brand":"', p_brand, '","size":', p_size, '} trailing')
             WHEN line_no % 2 = 0 THEN concat('{"brand":"', p_brand, '","size":"', p_size, '"}')
             ELSE concat('{"brand":"', p_brand, '","size":', p_size, ',"extra":1}') END
           WHEN flavour = 'A' THEN p_name
           WHEN flavour = 'N' THEN concat('  ', upper(p_name), '. ')
           WHEN line_no % 2 = 0 THEN concat(' ', p_name, ' ')
           ELSE concat('not ', p_name) END"""))


def reviews(t: Tables) -> DataFrame:
    """Blind reviews: line 1 of an order is reviewed twice, line 2 once."""
    a = attempts(t).filter("line_no <= 2")
    return a.select(
        "attempt_id", "eval_run_id", "case_id", "ck", "model",
        F.explode(F.expr("CASE WHEN line_no = 1 THEN array(0, 1) ELSE array(0) END")).alias("rv"),
        "discount", "tax", "flavour",
    ).selectExpr(
        "concat('rev-', attempt_id, '-', rv) AS review_id", "attempt_id", "eval_run_id", "case_id", "ck", "model",
        "concat('rv-', rv) AS reviewer_pseudonym",
        "CASE WHEN rv = 0 AND flavour = 'A' THEN 'accept' WHEN rv = 0 AND flavour = 'R' THEN 'reject' "
        "WHEN rv = 1 AND tax < 0.035 THEN 'accept' WHEN rv = 1 AND tax < 0.065 THEN 'reject' WHEN rv = 1 THEN 'tie' ELSE 'abstain' END AS decision",
        "CASE WHEN rv = 0 THEN round(discount * 10, 2) WHEN tax > 0.055 THEN null ELSE round(tax * 12, 2) END AS score",
    )


def texts(t: Tables) -> DataFrame:
    """Every text of the corpus with its source table."""
    d = t.documents.selectExpr("concat('d-', doc_id) AS text_id", "source", "text")
    c = t.conversations.selectExpr("concat('c-', conv_id, '-', turn) AS text_id", "concat('chat-', role) AS source", "text")
    p = t.pages.selectExpr("concat('p-', page_id) AS text_id", "'pages' AS source", "html AS text")
    return d.unionByName(c).unionByName(p)


def registry(t: Tables) -> DataFrame:
    """Model registry: one entry per action, with prices from the part table's price range."""
    agg = t.part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return agg.select("lo", "hi", F.explode(F.expr("array(0, 1, 2)")).alias("m")).selectExpr(
        "concat('lab/m', m) AS action", "'lab' AS provider", "concat('m', m) AS model",
        "CASE m WHEN 0 THEN 32000L WHEN 1 THEN 128000L ELSE 200000L END AS max_context_tokens",
        "m > 0 AS supports_tools", "m <> 1 OR lo > 0 AS supports_structured_output",
        "round(lo * (m + 1) * (m + 1) / 1e9, 9) AS input_price", "round(hi * (m + 1) * (m + 1) / 1e9, 9) AS output_price",
    )


def run_documents(t: Tables) -> DataFrame:
    """Raw run documents as JSON text, 50 to a batch, with faulty ones of every kind.

    Every nested list is a short fixed-length expression of its own order row, so no
    grouping happens and no document grows with the data. Runs are dealt out by batch before their documents are made: a
    small file is read by few tasks, too few for costly rows, and what is asked of a batch later moves no documents. The
    number of partitions is given, as Spark would put small rows back into few tasks.
    """
    r = runs(t).withColumn("batch_id", F.expr("concat('b-', k div 50)"))
    r = r.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    ts = "concat(date_format(started_at, 'yyyy-MM-dd'), 'T00:00:00Z')"
    few = lambda n: f"slice(array(0,1,2,3), 1, cast({n} AS int))"
    decision = lambda shadow, action, tag: f"""named_struct(
        'decision_id', concat('d{tag}-', k), 'selected_provider', 'lab',
        'selected_model', CASE WHEN k % 137 = 17 AND {'true' if tag == 'l' else 'false'} THEN 'm9' ELSE substring_index({action}, '/', -1) END,
        'policy_version', policy_version,
        'selection_probability', CASE WHEN k % 109 = 9 AND {'true' if tag == 'l' else 'false'} THEN 0D ELSE {'propensity' if tag == 'l' else '1D'} END,
        'exploration', explore, 'shadow', {shadow},
        'eligible_models', CASE WHEN k % 113 = 11 AND {'true' if tag == 'l' else 'false'} THEN cast(array() AS array<string>)
            WHEN k % 181 = 35 THEN array_append(eligible, 'lab/m7') ELSE eligible END,
        'feature_schema_version', '{FEATURE_SCHEMA_VERSION}',
        'created_at', CASE WHEN k % 127 = 13 THEN null ELSE {ts} END)"""
    doc = f"""to_json(named_struct(
      'run_id', CASE WHEN k % 191 = 37 THEN 'bad id!' WHEN k % 89 = 1 AND k % 50 <> 0 THEN concat('run-', k - 1) ELSE run_id END,
      'request_id', concat('req-', k), 'session_id_hash', session_id,
      'started_at', CASE WHEN k % 167 = 29 THEN 'yesterday' ELSE {ts} END,
      'task_domain', task_domain, 'tier', CASE WHEN k % 103 = 5 THEN null ELSE tier END,
      'harness_version', 'h1', 'prompt_version', 'p1', 'policy_version', policy_version,
      'feature_schema_version', CASE WHEN k % 179 = 33 THEN 'routing-features.v0' ELSE '{FEATURE_SCHEMA_VERSION}' END,
      'status', 'finished',
      'routing_context', named_struct(
        'tier', tier, 'task_domain', task_domain,
        'estimated_input_tokens', CASE WHEN k % 173 = 31 THEN -1L ELSE tokens END,
        'context_utilization_ratio', CASE WHEN k % 107 = 7 THEN 1.5D ELSE ratio END,
        'tool_count', CASE WHEN k % 101 = 3 THEN cast(true AS variant) ELSE cast(tool_count AS variant) END,
        'requires_structured_output', structured, 'requires_tools', tools, 'requires_memory', memory,
        'requires_external_data', external, 'conversation_depth', depth, 'retry_number', retry_number,
        'previous_tool_failure', prev_tool_failure, 'latency_slo_ms', slo),
      'decisions', CASE WHEN shadow_action IS NULL THEN array({decision('false', 'action', 'l')})
        ELSE array({decision('false', 'action', 'l')}, {decision('NOT (k % 131 = 15 OR k % 131 = 16)', 'shadow_action', 's')}) END,
      'attempts', transform({few('k % 4')}, i -> named_struct(
        'attempt_id', concat('at-', k, '-', i), 'provider', 'lab', 'model', concat('m', (k + i) % 3),
        'latency_ms', 100D * (1 + (k * 7 + i * 13) % 50), 'estimated_cost', ((k * 3 + i) % 40) / 10000D, 'currency', 'USD',
        'success', CASE WHEN k % 149 = 21 AND i = 0 THEN null ELSE (k + i) % 5 <> 0 END,
        'error_type', CASE WHEN (k + i) % 5 = 0 THEN concat('err-', k % 5) END, 'retry_number', i, 'note', 'free text')),
      'tool_events', CASE WHEN k % 139 = 19 THEN to_variant_object(named_struct('x', 1)) ELSE to_variant_object(transform({few('CASE WHEN tools THEN k % 3 + 1 ELSE 0 END')}, i -> named_struct(
        'event_id', concat('te-', k, '-', i), 'tool_name', concat('tool-', (k + i) % 7), 'attempt_number', i % 2 + 1,
        'schema_valid', (k + 2 * i) % 6 <> 0, 'execution_success', (k + i) % 4 <> 0,
        'error_class', CASE WHEN (k + i) % 4 = 0 THEN concat('terr-', k % 3) END))) END,
      'validation_events', transform({few('CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END')}, i -> named_struct(
        'event_id', concat('ve-', k, '-', i), 'validator', concat('check-', (k + i) % 3), 'passed', (k + i) % 6 <> 0)),
      'outcome', named_struct(
        'completed', CASE WHEN k % 157 = 25 THEN cast('yes' AS variant) ELSE cast(completed AS variant) END,
        'retry_count', k % 4, 'final_latency_ms', 100D * (k % 90), 'final_cost', (k % 200) / 10000D,
        'currency', CASE WHEN k % 163 = 27 THEN null ELSE 'USD' END, 'critical_failure', k % 97 = 0),
      'feedback', transform({few('CASE WHEN k % 5 IN (0, 3) THEN 1 ELSE 0 END')}, i -> named_struct(
        'feedback_id', concat('f-', k, '-', i), 'feedback_type', CASE WHEN k % 151 = 23 THEN 'shout' ELSE 'edit' END,
        'sanitized_original_value', CASE WHEN k % 61 = 2 THEN concat('ask user', k, '@example.com now') WHEN k % 67 = 4 THEN 'Authorization: Bearer abc.def-123' ELSE 'plain words' END,
        'created_at', {ts}))))"""
    return computed_once(r, "raw", F.expr(doc)).selectExpr("k", "batch_id", "k % 50 AS idx", "raw")


def batch_envelopes(t: Tables) -> DataFrame:
    """Batch documents without their runs, some of them faulty."""
    b = t.orders.groupBy(F.expr("o_orderkey div 50").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    entry = lambda m, bad: f"""named_struct('provider', 'lab', 'model', '{m}', 'max_context_tokens', CASE WHEN {bad} THEN 0L ELSE 32000L END,
      'supports_tools', true, 'supports_structured_output', true, 'estimated_input_cost_per_token', 1e-6D, 'estimated_output_cost_per_token', 2e-6D)"""
    doc = f"""to_json(named_struct(
      'schema', CASE WHEN b % 11 = 1 THEN 'Other' ELSE 'TelemetryBatchV1' END,
      'schema_version', CASE WHEN b % 13 = 2 THEN '2.0' ELSE '1.1' END,
      'batch_id', CASE WHEN b % 17 = 3 THEN ' b' ELSE concat('b-', b) END,
      'generated_at', CASE WHEN b % 19 = 4 THEN 'soon' ELSE '2024-01-02T03:04:05Z' END,
      'producer', CASE WHEN b % 23 = 5 THEN named_struct('repo', ' ', 'version', '1') ELSE named_struct('repo', 'app', 'version', '1') END,
      'feature_schema_version', CASE WHEN b % 29 = 6 THEN null ELSE '{FEATURE_SCHEMA_VERSION}' END,
      'window', CASE WHEN b % 31 = 7 THEN cast('all' AS variant) END,
      'model_registry', CASE WHEN b % 37 = 8 THEN array() WHEN b % 41 = 9 THEN array({entry('m0', 'false')}, {entry('m0', 'false')})
         ELSE array({entry('m0', 'b % 43 = 10')}, {entry('m1', 'false')}, {entry('m2', 'false')}) END,
      'runs', CASE WHEN b % 47 = 11 THEN cast(1 AS variant) ELSE to_variant_object(cast(array() AS array<int>)) END))"""
    return computed_once(b, "raw", F.expr(doc))
