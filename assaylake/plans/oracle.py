"""The derived views again, written by hand in plain SQL for the side-by-side check."""

from __future__ import annotations

from assaylake.functions.features import OPTIONAL
from assaylake.schemas import DOMAINS, FEATURE_SCHEMA_VERSION
from assaylake.sources import views as V

_DOM = "[" + ",".join(f"'{d}'" for d in DOMAINS) + "]"
H = "('0x' || substr(sha256({x}), 1, 8))::BIGINT"


def h32(x: str) -> str:
    return H.format(x=x)


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def sql(body: str, *deps: str) -> str:
    """``WITH`` the named views (and what they need) in front of a body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body


cte("runs0", f"""
 SELECT o_orderkey AS k, 'run-' || o_orderkey AS run_id, 's-' || o_custkey AS session_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 't1' WHEN 'BUILDING' THEN 't2' WHEN 'FURNITURE' THEN 't3' WHEN 'HOUSEHOLD' THEN 't4' ELSE 'tx' END AS tier,
  CASE WHEN o_orderkey % 31 = 5 THEN 'unlisted' ELSE {_DOM}[(o_orderkey % 15 + 1)::INT] END AS task_domain,
  floor(o_totalprice)::BIGINT % 64000 AS tokens,
  o_orderkey % 5 < 2 AS structured, o_orderkey % 3 = 0 AS tools, o_orderkey % 10 < 3 AS memory, o_orderkey % 7 = 0 AS external,
  o_custkey % 13 AS depth, o_orderkey % 6 AS tool_count, o_orderkey % 4 AS retry_number, o_orderkey % 11 = 0 AS prev_tool_failure,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 4000 ELSE 10000 END::BIGINT AS slo,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS completed,
  CASE WHEN o_orderkey % 20 = 0 THEN 'EUR' WHEN o_orderkey % 50 = 7 THEN NULL ELSE 'USD' END AS currency,
  o_orderdate AS started_at,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 1099511627776 + o_orderkey AS seq,
  ((floor(o_totalprice)::BIGINT % 64000) * 10000 // 64000) / 10000.0::DOUBLE AS ratio,
  'pv-' || (o_orderkey % 3) AS policy_version
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
cte("runs1", f"""
 SELECT *, CASE WHEN tier IN ('t3','t4') AND tokens <= 32000 THEN ['lab/m0','lab/m1','lab/m2']
  WHEN tier IN ('t3','t4') THEN ['lab/m1','lab/m2'] WHEN tokens <= 32000 THEN ['lab/m0','lab/m1'] ELSE ['lab/m1'] END AS eligible,
  {h32("'explore|' || k")} % 10000 < 3000 AS explore FROM runs0""", "runs0")
cte("runs2", f"""
 SELECT *, CASE WHEN explore THEN eligible[({h32("'pick|' || k")} % len(eligible) + 1)::INT] ELSE 'lab/m1' END AS action FROM runs1""", "runs1")
cte("runs", """
 SELECT *, CASE WHEN action = 'lab/m1' THEN 0.7::DOUBLE + 0.3::DOUBLE / len(eligible) ELSE 0.3::DOUBLE / len(eligible) END AS propensity,
  CASE WHEN k % 2 = 0 THEN eligible[1] END AS shadow_action FROM runs2""", "runs2")
cte("lines", """
 SELECT l_orderkey AS k, l_linenumber AS line_no,
  CASE WHEN l_linestatus = 'F' THEN 'attempt' WHEN l_linenumber >= 6 THEN 'validation' ELSE 'tool' END AS kind,
  'lab/m' || (l_suppkey % 3) AS line_action, 'tool-' || (l_partkey % 7) AS tool_name,
  ['memory_check','state_check','json_check','schema_check'][(l_partkey % 4 + 1)::INT] AS validator,
  l_linenumber % 3 + 1 AS attempt_number, l_quantity * 100 AS latency_ms, l_extendedprice / 1e7 AS cost,
  l_returnflag <> 'R' AS ok, l_discount < 0.08 AS executed,
  CASE WHEN l_returnflag = 'R' THEN 'err-' || (l_suppkey % 5) END AS error_class FROM lineitem""")
cte("run_lines", """
 SELECT k, count(*) FILTER (kind='attempt') AS n_attempts, count(*) FILTER (kind='tool') AS n_tools,
  count(*) FILTER (kind='tool' AND ok AND executed) AS n_tools_good, count(*) FILTER (kind='tool' AND ok) AS n_tools_valid,
  count(*) FILTER (kind='tool' AND attempt_number=1) AS n_tools_first, count(*) FILTER (kind='tool' AND attempt_number=1 AND ok) AS n_tools_first_valid,
  count(*) FILTER (kind='validation') AS n_validations, count(*) FILTER (kind='validation' AND NOT ok) AS n_validations_failed,
  count(*) FILTER (kind='validation' AND validator IN ('memory_check','state_check')) AS n_memory,
  count(*) FILTER (kind='validation' AND validator IN ('memory_check','state_check') AND NOT ok) AS n_memory_failed,
  sum(latency_ms) FILTER (kind='attempt') AS final_latency_ms, round(sum(cost) FILTER (kind='attempt'), 6) AS final_cost,
  string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) FILTER (kind='tool') AS tool_key,
  string_agg(DISTINCT error_class, ',' ORDER BY error_class) FILTER (error_class IS NOT NULL) AS error_key
 FROM lines GROUP BY k""", "lines")
cte("facts", """
 SELECT r.*, coalesce(n_attempts,0) AS n_attempts, coalesce(n_tools,0) AS n_tools, coalesce(n_tools_good,0) AS n_tools_good,
  coalesce(n_tools_valid,0) AS n_tools_valid, coalesce(n_tools_first,0) AS n_tools_first, coalesce(n_tools_first_valid,0) AS n_tools_first_valid,
  coalesce(n_validations,0) AS n_validations, coalesce(n_validations_failed,0) AS n_validations_failed,
  coalesce(n_memory,0) AS n_memory, coalesce(n_memory_failed,0) AS n_memory_failed, final_latency_ms, final_cost,
  coalesce(tool_key,'') AS tool_key, coalesce(error_key,'') AS error_key,
  greatest(coalesce(n_attempts,0) - 1, 0) AS retry_count,
  CASE r.k % 9 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS structured_output_valid,
  r.k % 8 = 1 AS user_accept, r.k % 8 = 2 AS user_retry, r.k % 8 = 3 AS user_abandon, r.k % 8 = 4 AS user_correction,
  CASE WHEN r.k % 8 = 4 THEN (r.k % 100) / 100.0::DOUBLE END AS correction_distance,
  CASE WHEN r.k % 16 = 4 THEN 'factual_correction' WHEN r.k % 8 = 4 THEN 'style_preference' END AS correction_category,
  coalesce(task_domain = 'privacy' AND NOT coalesce(completed, false) AND r.k % 7 = 0, false) AS critical_failure,
  CASE WHEN completed IS NULL THEN NULL ELSE completed AND coalesce(n_attempts,0) <= 1 END AS first_shot_success
 FROM runs r LEFT JOIN run_lines l ON r.k = l.k""", "runs", "run_lines")
cte("obs", f"""
 SELECT r.*, false AS shadow, action AS chosen_action, 'obs-l-' || k AS observation_id,
  CASE WHEN k % 113 = 1 THEN 0 ELSE propensity END AS obs_propensity,
  CASE WHEN k % 137 = 1 THEN ['lab/m9'] ELSE eligible END AS eligible_actions,
  CASE WHEN k % 127 = 1 THEN 'routing-features.v0' ELSE '{FEATURE_SCHEMA_VERSION}' END AS feature_schema_version FROM runs r
 UNION ALL
 SELECT r.*, true, shadow_action, 'obs-s-' || k, CASE WHEN k % 113 = 1 THEN 0 ELSE 1 END,
  CASE WHEN k % 137 = 1 THEN ['lab/m9'] ELSE eligible END,
  CASE WHEN k % 127 = 1 THEN 'routing-features.v0' ELSE '{FEATURE_SCHEMA_VERSION}' END FROM runs r WHERE shadow_action IS NOT NULL""", "runs")
cte("feedback", """
 SELECT event_id AS k, 'fb-' || event_id AS feedback_id, 'run-' || event_id AS run_id,
  CASE event_type WHEN 'error' THEN 'correction' WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'retry' ELSE 'intent_change' END AS feedback_type,
  CASE event_id % 8 WHEN 0 THEN 'factual' WHEN 1 THEN 'Style ' WHEN 2 THEN 'schedule' WHEN 3 THEN 'repair' WHEN 4 THEN 'weird' WHEN 5 THEN 'correction' END AS hint,
  event_id % 13 <> 0 AS same_request, (props->>'k')::BIGINT AS minutes_after_output, value / 50.0 AS correction_distance,
  CASE WHEN event_id % 10 = 3 THEN '' WHEN event_id % 17 = 0 THEN 'write to user' || event_id || '@example.com' ELSE 'better answer ' || (event_id % 50) END AS sanitized_corrected_value,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'key sk-abcdefgh' || event_id ELSE 'first answer ' || (event_id % 70) END AS sanitized_original_value
 FROM events""")
cte("cases", f"""
 SELECT p_partkey AS ck, 'case-' || p_partkey AS case_id, 'fam-' || (p_partkey % 97) AS family_id,
  CASE p_partkey % 97 % 5 WHEN 0 THEN 'calibration' WHEN 1 THEN 'holdout' ELSE 'train' END AS split,
  (p_size % 4 + 1)::BIGINT AS complexity_level, {_DOM}[(p_partkey % 15 + 1)::INT] AS domain,
  ['exact_text','exact_json','schema','rubric','exact_text','exact_json','imported'][(p_partkey % 7 + 1)::INT] AS method,
  CASE WHEN p_partkey % 7 IN (1,5) THEN '{{"brand":"' || p_brand || '","size":' || p_size || '}}' ELSE p_name END AS reference_answer,
  p_name, p_brand, p_size::BIGINT AS p_size, sha256('prompt|' || p_partkey) AS prompt_hash,
  CASE WHEN p_partkey % 19 = 0 THEN ['adversarial'] WHEN p_partkey % 23 = 0 THEN ['red_team','long'] ELSE ['plain'] END AS tags,
  'Answer about ' || p_name || CASE WHEN p_partkey % 7 IN (1,5) THEN ' as JSON' ELSE ' in words' END AS prompt_text,
  p_partkey % 41 = 0 AS real_personal_data FROM part""")
cte("attempts", """
 SELECT 'att-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || '-' || date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS attempt_id,
  'er-' || l_suppkey AS eval_run_id, l_suppkey AS rk, l_partkey AS ck, l_orderkey AS k, l_linenumber AS line_no, 'case-' || l_partkey AS case_id,
  'lab' AS provider, 'm' || (l_suppkey % 3) AS model,
  CASE WHEN l_discount >= 0.095 THEN 'timeout' WHEN l_discount >= 0.085 THEN 'refusal' ELSE 'success' END AS status,
  l_returnflag AS flavour, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 100 END AS latency_ms,
  CASE WHEN l_tax > 0.075 THEN NULL ELSE floor(l_extendedprice / 100)::BIGINT END AS cost_minor,
  CASE WHEN l_suppkey % 10 = 3 AND l_linenumber % 2 = 1 THEN 'EUR' WHEN l_suppkey % 10 = 4 AND l_linenumber = 2 THEN NULL ELSE 'USD' END AS currency,
  (l_quantity * 20)::BIGINT AS input_tokens, CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_quantity * 5)::BIGINT END AS output_tokens,
  CASE WHEN l_orderkey % 83 = 0 THEN 'stale' ELSE sha256('prompt|' || l_partkey) END AS prompt_hash,
  CASE WHEN l_linenumber % 2 = 0 THEN 'long' ELSE 'short' END AS context_condition,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS ship_day, l_shipdate AS completed_at, l_discount AS discount, l_tax AS tax FROM lineitem""")
cte("att", """
 SELECT a.*, family_id, split, complexity_level, domain, method, reference_answer, p_name, p_brand, p_size,
  CASE WHEN line_no = 5 AND flavour = 'N' THEN NULL
   WHEN method = 'exact_json' THEN CASE
     WHEN flavour = 'A' THEN '{ "size": ' || p_size || ', "brand": "' || p_brand || '" }'
     WHEN flavour = 'N' AND line_no % 2 = 0 THEN '{"brand":"' || p_brand || '","size":' || p_size || '.0}'
     WHEN flavour = 'N' THEN '{"brand":"' || p_brand || '","size":' || p_size || '} trailing'
     WHEN line_no % 2 = 0 THEN '{"brand":"' || p_brand || '","size":"' || p_size || '"}'
     ELSE '{"brand":"' || p_brand || '","size":' || p_size || ',"extra":1}' END
   WHEN flavour = 'A' THEN p_name WHEN flavour = 'N' THEN '  ' || upper(p_name) || '. '
   WHEN line_no % 2 = 0 THEN ' ' || p_name || ' ' ELSE 'not ' || p_name END AS response_text
 FROM attempts a JOIN cases c ON a.ck = c.ck""", "attempts", "cases")
cte("grades", """
 SELECT attempt_id, case_id, ck, eval_run_id, rk, model, family_id, split, complexity_level, domain, method, status, latency_ms, cost_minor, currency,
  prompt_hash, context_condition, response_text, line_no, flavour, ship_day, completed_at, k,
  CASE WHEN status <> 'success' OR response_text IS NULL OR method IN ('rubric','imported','schema') THEN NULL
   WHEN method = 'exact_json' THEN flavour = 'A'
   ELSE trim(response_text) = trim(reference_answer) END AS passed,
  CASE WHEN status <> 'success' THEN 'attempt status is ' || status
   WHEN response_text IS NULL THEN 'successful attempt has no response text'
   WHEN method = 'rubric' THEN 'semantic rubric requires blind human review or calibrated judge'
   WHEN method = 'imported' THEN 'evaluation method imported is not deterministic'
   WHEN method = 'schema' THEN 'candidate output is not valid JSON'
   WHEN method = 'exact_json' AND flavour = 'A' THEN NULL
   WHEN method = 'exact_json' AND flavour = 'N' AND line_no % 2 = 1 THEN 'candidate output is not valid JSON'
   WHEN method = 'exact_json' THEN 'JSON value differs from reference'
   WHEN trim(response_text) = trim(reference_answer) THEN NULL ELSE 'text does not exactly match reference' END AS failure_reason,
  CASE WHEN status <> 'success' THEN 'attempt_status' WHEN response_text IS NULL THEN 'missing_output'
   WHEN method = 'imported' THEN 'unsupported_method' ELSE method END AS grader_id
 FROM att""", "att")
cte("graded", "SELECT *, CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END::DOUBLE AS score FROM grades", "grades")
cte("reviews", """
 SELECT 'rev-' || attempt_id || '-' || rv AS review_id, attempt_id, eval_run_id, case_id, ck, model, 'rv-' || rv AS reviewer_pseudonym,
  CASE WHEN rv = 0 AND flavour = 'A' THEN 'accept' WHEN rv = 0 AND flavour = 'R' THEN 'reject' WHEN rv = 1 AND tax < 0.035 THEN 'accept'
   WHEN rv = 1 AND tax < 0.065 THEN 'reject' WHEN rv = 1 THEN 'tie' ELSE 'abstain' END AS decision,
  CASE WHEN rv = 0 THEN round(discount * 10, 2) WHEN tax > 0.055 THEN NULL ELSE round(tax * 12, 2) END AS score
 FROM (SELECT *, 0 AS rv FROM attempts WHERE line_no <= 2 UNION ALL SELECT *, 1 FROM attempts WHERE line_no = 1)""", "attempts")
cte("texts", """
 SELECT 'd-' || doc_id AS text_id, source, text FROM documents
 UNION ALL SELECT 'c-' || conv_id || '-' || turn, 'chat-' || role, text FROM conversations
 UNION ALL SELECT 'p-' || page_id, 'pages', html FROM pages""")
cte("registry", """
 SELECT 'lab/m' || m AS action, 'm' || m AS model, CASE m WHEN 0 THEN 32000 WHEN 1 THEN 128000 ELSE 200000 END::BIGINT AS max_context_tokens,
  m > 0 AS supports_tools, m <> 1 OR lo > 0 AS supports_structured_output,
  round(lo * (m + 1) * (m + 1) / 1e9, 9) AS input_price, round(hi * (m + 1) * (m + 1) / 1e9, 9) AS output_price
 FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), (SELECT unnest([0,1,2]) AS m)""")


def features_sql() -> str:
    """The same vector as SQL text for the side-by-side check."""
    def one(s, tr, a):
        if tr == "constant":
            return f"{a}::DOUBLE"
        if tr == "equals":
            return f"({s} = '{a}')::INT::DOUBLE"
        if tr == "not_in":
            return f"({s} NOT IN ({','.join(repr(x) for x in a)}))::INT::DOUBLE"
        if tr == "bool":
            return f"({s})::INT::DOUBLE"
        if tr == "present":
            return f"({s} IS NOT NULL)::INT::DOUBLE"
        if tr == "clip01":
            return f"least(1.0, greatest(0.0, {s}))::DOUBLE"
        if tr == "capped_ratio":
            return f"coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {s}::DOUBLE / {float(a)}::DOUBLE)), 0)::DOUBLE" if s not in OPTIONAL else f"CASE WHEN {s} IS NULL THEN 0::DOUBLE ELSE least(1.0::DOUBLE, {s}::DOUBLE / {float(a)}::DOUBLE) END"
        return f"least(1.0::DOUBLE, ln(1 + {s}::DOUBLE) / ln({float(a)}::DOUBLE + 1))"
    return "[" + ", ".join(one(s, tr, a) for _n, s, tr, a in V.FEATURES) + "]"
