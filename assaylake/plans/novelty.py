"""Queries: features, novelty, duplicates, candidates, lifecycle, preferences, flywheel metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import features as FT
from assaylake.functions.prefix import positions
from assaylake.functions.reasons import code_list
from assaylake.operators import lifecycle as L
from assaylake.operators import metrics as M
from assaylake.operators import novelty as N
from assaylake.operators import preferences as PR
from assaylake.operators import rewards as RW
from assaylake.operators import routing as RT
from assaylake.operators import unnest as U
from assaylake.operators.nearest import nearest_prior_vector
from assaylake.plans import rewards as _rewards  # noqa: F401  (its views are used below)
from assaylake.plans.catalog import query
from assaylake.plans.oracle import cte, features_sql, sql
from assaylake.session import cut_lineage
from assaylake.sources import views as V

OUTLIERS = {"unusual_cost": "final_cost", "unusual_latency": "final_latency_ms"}
WINDOWS = {"lab/m0": 32000, "lab/m1": 128000, "lab/m2": 200000}


def with_features(df):
    return df.withColumn("features", FT.routing_features(V.FEATURES))


cte("feat", f"SELECT *, {features_sql()} AS features FROM runs", "runs")


@query("routing_features", sql("SELECT k, i, round(features[i], 9) AS x FROM (SELECT k, features, unnest(range(1, 35)) AS i FROM feat) WHERE features[i] <> 0", "feat"))
def _(t):
    return with_features(V.runs(t)).select("k", F.posexplode("features").alias("p", "v")).filter("v <> 0").select("k", (F.col("p") + 1).alias("i"), F.round("v", 9).alias("x"))


@query("token_bucket", sql("SELECT CASE WHEN tokens < 1000 THEN '<1k' WHEN tokens < 4000 THEN '<4k' WHEN tokens < 16000 THEN '<16k' WHEN tokens < 64000 THEN '<64k' ELSE '>=64k' END AS bucket, count(*) AS n FROM runs0 GROUP BY 1", "runs0"))
def _(t):
    return V.runs(t).groupBy(N.token_bucket(F.col("tokens")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


cte("ctx", """
 SELECT ck, case_id, domain AS task_domain, greatest(1, length(prompt_text) // 4) AS tokens, round_even(least(1.0, greatest(1, length(prompt_text) // 4) / 128000.0), 6) AS ratio,
  contains(lower(prompt_text), 'json') AS structured, domain = 'conversation_memory' AS memory, tier, prompt_text FROM cases, (SELECT unnest(['t1','t2','t3','t4','tx']) AS tier)""", "cases")


def contexts(t):
    return RT.case_context(V.cases(t)).withColumn("tier", F.explode(F.array(*[F.lit(x) for x in ("t1", "t2", "t3", "t4", "tx")])))


@query("case_context", sql("SELECT DISTINCT ck, tokens, ratio, structured, memory, 0 AS depth FROM ctx", "ctx"))
def _(t):
    return RT.case_context(V.cases(t)).select("ck", "tokens", "ratio", "structured", "memory", F.col("depth").cast("int").alias("depth"))


cte("tier_actions", "SELECT DISTINCT tier, unnest(eligible) AS action FROM runs", "runs")
cte("elig", """
 SELECT ck, tier, string_agg(a.action, ',' ORDER BY a.action) AS eligible FROM ctx JOIN tier_actions a USING (tier) JOIN registry g ON g.action = a.action
 WHERE tokens <= max_context_tokens AND (NOT structured OR supports_structured_output) GROUP BY ALL""", "ctx", "tier_actions", "registry")


def tier_actions(t):
    return V.runs(t).select("tier", F.explode("eligible").alias("action")).distinct()


def eligible_contexts(t):
    return RT.eligible_actions(contexts(t), tier_actions(t), V.registry(t), ["ck", "tier"])


@query("eligible_actions", sql("SELECT ck, tier, eligible FROM elig", "elig"))
def _(t):
    return eligible_contexts(t).select("ck", "tier", code_list("eligible").alias("eligible"))


@query("estimated_cost", sql("SELECT k, round(tokens * input_price + 500 * output_price, 9) AS estimated_cost FROM runs r JOIN registry g ON r.action = g.action", "runs", "registry"))
def _(t):
    return RT.estimated_cost(V.runs(t), V.registry(t)).select("k", F.round("estimated_cost", 9).alias("estimated_cost"))


@query("epsilon_greedy_propensity", sql("SELECT k, round(propensity, 9) AS propensity FROM runs", "runs"))
def _(t):
    return V.runs(t).select("k", F.round(RT.epsilon_greedy_propensity(F.col("action"), F.lit("lab/m1"), F.size("eligible"), 0.3), 9).alias("propensity"))


@query("observed_tier_actions", sql("SELECT tier, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM tier_actions GROUP BY tier", "tier_actions"))
def _(t):
    return RT.observed_tier_actions(V.runs(t).withColumnRenamed("eligible", "eligible_actions")).select("tier", code_list("actions").alias("actions"))


@query("model_registry_rows", """
 SELECT 'lab/m' || (s_suppkey % 7) AS action, min(s_suppkey // 10) AS import_seq, min(s_suppkey) AS source, arg_min(s_acctbal, s_suppkey) AS price FROM supplier GROUP BY 1""")
def _(t):
    d = t.supplier.selectExpr("concat('lab/m', s_suppkey % 7) AS action", "s_suppkey div 10 AS import_seq", "s_suppkey % 10 AS pos", "s_suppkey AS source", "s_acctbal AS price")
    return U.model_registry_rows(d).select("action", "import_seq", "source", "price")


# ---- novelty ------------------------------------------------------------------------------
def _novelty_sql(p, facts, points, key):
    """Views of the novelty of each row of ``facts`` with its vector in ``points``; their names begin with ``p``."""
    cte(f"{p}sig2", f"SELECT *, error_key || '|' || coalesce(completed::VARCHAR, '~') AS fsig FROM {facts}", facts)
    cte(f"{p}nov1", f"""
 SELECT *, 5.0::DOUBLE / (count(*) OVER (PARTITION BY task_domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5) AS domain_rarity,
  CASE WHEN NOT (error_key = '' AND coalesce(completed, false)) AND row_number() OVER (PARTITION BY fsig ORDER BY seq) = 1 THEN 1 ELSE 0 END::DOUBLE AS new_failure_signature,
  CASE WHEN tool_key <> '' AND row_number() OVER (PARTITION BY tool_key ORDER BY seq) = 1 THEN 1 ELSE 0 END::DOUBLE AS new_tool_combination,
  count(final_cost) OVER wa AS nc, avg(final_cost) OVER wa AS mc, stddev_pop(final_cost) OVER wa AS sc, count(final_latency_ms) OVER wa AS nl, avg(final_latency_ms) OVER wa AS ml, stddev_pop(final_latency_ms) OVER wa AS sl
 FROM {p}sig2 WINDOW wa AS (PARTITION BY action ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", f"{p}sig2")
    cte(f"{p}near", f"""
 SELECT a.{key}, coalesce(least(1.0, min(list_distance(a.features, b.features)) / sqrt(34.0::DOUBLE)), 1.0) AS feature_distance FROM {points} a LEFT JOIN {points} b ON a.tier = b.tier AND a.task_domain = b.task_domain AND b.seq < a.seq GROUP BY a.{key}""", points)
    cte(f"{p}nov2", f"""
 SELECT n.*, feature_distance, CASE WHEN shadow_action <> action THEN 0.5 ELSE 0 END::DOUBLE AS shadow_disagreement, coalesce(correction_distance, 0) AS correction_magnitude,
  CASE WHEN nc >= 20 AND sc > 0 AND abs(final_cost - mc) / sc >= 3 THEN 1 ELSE 0 END::DOUBLE AS unusual_cost, CASE WHEN nl >= 20 AND sl > 0 AND abs(final_latency_ms - ml) / sl >= 3 THEN 1 ELSE 0 END::DOUBLE AS unusual_latency,
  CASE WHEN retry_count >= 2 THEN 1 ELSE 0 END::DOUBLE AS repeated_recovery, CASE WHEN ratio >= 0.9 THEN 1 ELSE 0 END::DOUBLE AS context_limit_edge,
  CASE WHEN tier IN ('t1','t2') AND tokens >= 0.8 * CASE WHEN list_contains(eligible, 'lab/m0') THEN 32000 ELSE 128000 END THEN 1 ELSE 0 END::DOUBLE AS tier_edge
 FROM {p}nov1 n JOIN {p}near USING ({key})""", f"{p}nov1", f"{p}near")
    cte(f"{p}nov", f"SELECT *, round(greatest({', '.join(_C)}) * 0.6 + ({' + '.join(_C)}) / 11 * 0.4, 6) AS novelty FROM {p}nov2", f"{p}nov2")


_C = ("domain_rarity", "feature_distance", "new_failure_signature", "new_tool_combination", "shadow_disagreement", "correction_magnitude", "unusual_cost", "unusual_latency", "repeated_recovery", "context_limit_edge", "tier_edge")
_novelty_sql("", "facts", "feat", "k")


def nearest(df):
    return nearest_prior_vector(with_features(df), ["tier", "task_domain"], "features", "seq")


def scored(t):
    return scored_rows(V.run_facts(t), V.runs(t), "k")


def scored_rows(facts, points, key):
    """Novelty of every row against the rows before it, one total order over all."""
    f = N.first_seen_tool_combo(N.first_seen_failure_signature(N.first_seen_domain_rarity(facts)))
    f = N.running_outliers(f, OUTLIERS)
    near = nearest(points).select(key, "feature_distance")
    return N.novelty_score(N.row_components(f.join(near, key), WINDOWS, V.LOW_TIERS))


@query("first_seen_domain_rarity", sql("SELECT k, round(domain_rarity, 9) AS domain_rarity FROM nov1", "nov1"))
def _(t):
    return N.first_seen_domain_rarity(V.runs(t)).select("k", F.round("domain_rarity", 9).alias("domain_rarity"))


@query("first_seen_failure_signature", sql("SELECT k, new_failure_signature FROM nov1", "nov1"))
def _(t):
    return N.first_seen_failure_signature(V.run_facts(t)).select("k", "new_failure_signature")


@query("first_seen_tool_combo", sql("SELECT k, new_tool_combination FROM nov1", "nov1"))
def _(t):
    return N.first_seen_tool_combo(V.run_facts(t)).select("k", "new_tool_combination")


@query("running_outlier", sql("SELECT k, CASE WHEN nc >= 20 AND sc > 0 AND abs(final_cost - mc) / sc >= 3 THEN 1 ELSE 0 END::DOUBLE AS unusual_cost FROM nov1", "nov1"))
def _(t):
    return N.running_outlier(V.run_facts(t), "final_cost", "unusual_cost").select("k", "unusual_cost")


@query("nearest_prior_vector", sql("SELECT k, round(feature_distance, 6) AS feature_distance FROM near", "near"))
def _(t):
    return nearest(V.runs(t)).select("k", F.round("feature_distance", 6).alias("feature_distance"))


@query("novelty_score", sql("SELECT k, novelty, (domain_rarity > 0)::INT + (feature_distance > 0)::INT + (new_failure_signature > 0)::INT + (new_tool_combination > 0)::INT + (shadow_disagreement > 0)::INT + (correction_magnitude > 0)::INT + (unusual_cost > 0)::INT + (unusual_latency > 0)::INT + (repeated_recovery > 0)::INT + (context_limit_edge > 0)::INT + (tier_edge > 0)::INT AS reasons FROM nov", "nov"))
def _(t):
    return scored(t).select("k", "novelty", F.size("novelty_reasons").alias("reasons"))


# runs before 1998 are stored evidence: their observations, outcomes and candidates; later runs are the batch
cte("hist_base", """
 SELECT (SELECT map_from_entries(list((d, n))) FROM (SELECT task_domain AS d, count(*) AS n FROM obs WHERE year(started_at) < 1998 GROUP BY 1)) AS domains,
  coalesce((SELECT list(DISTINCT fsig) FROM stored_cand), []) AS known_sigs, coalesce((SELECT list(DISTINCT tool_key) FROM stored_cand), []) AS known_tools""", "obs", "stored_cand")
cte("stored_cand", "SELECT * FROM nov WHERE year(started_at) < 1998 AND (novelty >= 0.35 OR critical_failure OR user_correction)", "nov")
cte("late", "SELECT * FROM sig2 WHERE year(started_at) >= 1998", "sig2")
cte("nov_late", """
 SELECT l.k, l.started_at, 5.0::DOUBLE / (count(*) OVER (PARTITION BY task_domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + coalesce(domains[task_domain], 0) + 5) AS domain_rarity,
  CASE WHEN NOT (error_key = '' AND coalesce(completed, false)) AND NOT list_contains(known_sigs, fsig) AND row_number() OVER (PARTITION BY fsig ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new_failure_signature,
  CASE WHEN tool_key <> '' AND NOT list_contains(known_tools, tool_key) AND row_number() OVER (PARTITION BY tool_key ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new_tool_combination
 FROM late l, hist_base""", "late", "hist_base")


@query("novelty_history", sql("""
 SELECT year(l.started_at) AS batch, count(*) AS runs, round(avg(l.domain_rarity), 6) AS mean_rarity, sum(l.new_failure_signature)::BIGINT AS new_signatures, sum(l.new_tool_combination)::BIGINT AS new_tools,
  sum(CASE WHEN nc >= 20 AND sc > 0 AND abs(final_cost - mc) / sc >= 3 THEN 1 ELSE 0 END)::BIGINT AS unusual_costs, sum(CASE WHEN nl >= 20 AND sl > 0 AND abs(final_latency_ms - ml) / sl >= 3 THEN 1 ELSE 0 END)::BIGINT AS unusual_latencies
 FROM nov_late l JOIN nov1 USING (k) GROUP BY 1""", "nov_late", "nov1"))
def _(t):
    facts = V.run_facts(t)
    stored = facts.filter(F.year("started_at") < 1998)
    candidates = cut_lineage(N.select_candidates(scored_rows(stored, V.runs(t).filter(F.year("started_at") < 1998), "k")).select("error_key", "completed", "tool_key"))
    start = cut_lineage(N.stored_context(V.observations(t).filter(F.year("started_at") < 1998), stored, candidates))
    f = facts.filter(F.year("started_at") >= 1998)
    f = N.first_seen_tool_combo(N.first_seen_failure_signature(N.first_seen_domain_rarity(f, start), start), start)
    f = N.running_outliers(f, OUTLIERS, start=start, kinds={"unusual_cost": "cost", "unusual_latency": "latency"})
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return f.groupBy(F.year("started_at").alias("batch")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("domain_rarity"), 6).alias("mean_rarity"), total("new_failure_signature", "new_signatures"),
                                                             total("new_tool_combination", "new_tools"), total("unusual_cost", "unusual_costs"), total("unusual_latency", "unusual_latencies"))


@query("select_candidates", sql("SELECT k FROM nov WHERE novelty >= 0.35 OR critical_failure OR user_correction", "nov"))
def _(t):
    return N.select_candidates(scored(t)).select("k")


# ---- duplicates and candidates: every 40th run was sent again under new ids ------------------
_KEY = ["task_domain", "tier", "tokens", "ratio", "tool_count", "structured", "tools", "memory", "external", "depth", "retry_number", "prev_tool_failure", "slo", "completed", "currency",
        "eligible", "action", "shadow_action", "final_latency_ms", "final_cost", "tool_key", "error_key", "retry_count", "structured_output_valid", "critical_failure"]
cte("sent", """
 SELECT *, 'cand-' || k || '-0' AS candidate_id FROM facts UNION ALL SELECT * REPLACE (seq + 549755813888 AS seq, 'run-re-' || k AS run_id), 'cand-' || k || '-1' FROM facts WHERE k % 40 = 0""", "facts")
_sigcols = "task_domain || '|' || tier || '|' || CASE WHEN tokens < 1000 THEN '<1k' WHEN tokens < 4000 THEN '<4k' WHEN tokens < 16000 THEN '<16k' WHEN tokens < 64000 THEN '<64k' ELSE '>=64k' END || '|' || structured || '|' || tools || '|' || memory || '|' || external || '|' || tool_key || '|' || action || '|' || error_key || '|' || coalesce(completed::VARCHAR, '~')"
cte("keyed", f"SELECT *, sha256({_sigcols}) AS ssig FROM sent", "sent")
_kp = ", ".join(_KEY)
cte("dup", f"""
 SELECT *, first_value(candidate_id) OVER (PARTITION BY {_kp} ORDER BY seq) AS fc, row_number() OVER (PARTITION BY {_kp} ORDER BY seq) AS fr FROM keyed""", "keyed")


def sent(t):
    """Every run, and every 40th one a second time under new ids and later in the order."""
    f = V.run_facts(t).withColumn("copy", F.explode(F.expr("CASE WHEN k % 40 = 0 THEN array(0, 1) ELSE array(0) END")))
    both = f.withColumns({"candidate_id": F.concat_ws("-", F.lit("cand"), "k", "copy"), "seq": F.expr("seq + copy * 549755813888L"),
                          "run_id": F.expr("CASE WHEN copy = 1 THEN concat('run-re-', k) ELSE run_id END")})
    key = F.sha2(N.canonical(*[F.col(c) if c != "eligible" else F.concat_ws(",", "eligible") for c in _KEY]), 256)
    return N.structural_signature(both).withColumn("exact_key", key)


@query("structural_signature", sql("SELECT candidate_id, ssig AS structural_signature FROM keyed", "keyed"))
def _(t):
    return sent(t).select("candidate_id", "structural_signature")


@query("dedup_exact", sql("SELECT candidate_id, CASE WHEN fr > 1 THEN fc END AS duplicate_of FROM dup", "dup"))
def _(t):
    s = sent(t).select("candidate_id", "exact_key", "seq")
    first = s.groupBy("exact_key").agg(F.min(F.struct("seq", "candidate_id")).alias("m"))
    return s.join(first, "exact_key").select("candidate_id", F.when(F.col("m.seq") < F.col("seq"), F.col("m.candidate_id")).alias("duplicate_of"))


cte("alike", """
 SELECT a.candidate_id, string_agg(b.candidate_id, ',' ORDER BY b.seq) AS similar_to FROM (SELECT * FROM dup) a
 JOIN LATERAL (SELECT candidate_id, seq FROM (SELECT d.candidate_id, d.seq, d.ssig, row_number() OVER (PARTITION BY ssig ORDER BY seq) AS r FROM dup d) z WHERE z.ssig = a.ssig AND z.r <= 6) b
  ON b.seq < a.seq AND (a.fr = 1 OR b.candidate_id <> a.fc) GROUP BY a.candidate_id""", "dup")
cte("links", """
 SELECT d.*, CASE WHEN fr > 1 THEN fc END AS duplicate_of, CASE WHEN a.similar_to IS NULL THEN '' ELSE array_to_string(string_split(a.similar_to, ',')[1:5], ',') END AS similar_to
 FROM dup d LEFT JOIN alike a USING (candidate_id)""", "dup", "alike")


@query("prior_duplicate_lookup", sql("SELECT candidate_id, duplicate_of, similar_to FROM links", "links"))
def _(t):
    return N.prior_duplicates(sent(t)).select("candidate_id", "duplicate_of", code_list("similar_to").alias("similar_to"))


cte("sfeat", f"SELECT *, {features_sql()} AS features FROM sent", "sent")
_novelty_sql("s", "sent", "sfeat", "candidate_id")
cte("chosen", f"""
 SELECT c.candidate_id, first_value(c.candidate_id) OVER w AS fc, row_number() OVER w AS fr FROM (SELECT * FROM snov WHERE novelty >= 0.35 OR critical_failure OR user_correction) c
 WINDOW w AS (PARTITION BY {_kp} ORDER BY seq)""", "snov")


@query("build_candidates", sql("""
 SELECT candidate_id, step, CASE step WHEN 0 THEN 'NEW' ELSE CASE WHEN fr = 1 THEN 'VALIDATED' ELSE 'REJECTED' END END AS to_state, CASE WHEN fr > 1 THEN fc END AS duplicate_of FROM chosen, (SELECT unnest([0, 1]) AS step)""", "chosen"))
def _(t):
    # runs become candidates by their novelty at arrival, a critical failure or a correction; links lead to earlier candidates
    s = sent(t)
    chosen = N.select_candidates(scored_rows(s, s, "candidate_id")).select("candidate_id", "seq", "exact_key", "structural_signature")
    # links read the candidates three times; without a copy of their keys all runs would be scored for each
    c = N.prior_duplicates(cut_lineage(chosen))
    return N.candidate_transitions(c).select("candidate_id", "step", "to_state", "duplicate_of")


@query("sanitize_case_sketch", sql("SELECT run_id, task_domain, tier, action AS live_action, len(eligible) AS eligible_count, tokens, retry_count, tool_key AS tool_names, error_key FROM facts", "facts"))
def _(t):
    return N.sanitize_case_sketch(V.run_facts(t)).select("run_id", "task_domain", "tier", "live_action", F.size("eligible_actions").alias("eligible_count"), "routing_context.tokens", "outcome.retry_count", "tool_names", "failure_signature.error_key")


@query("lineage_resolution", sql("""
 SELECT CASE WHEN o.o_orderkey IS NULL THEN 'orphan' WHEN o.o_orderstatus = 'P' THEN 'not_accepted' ELSE 'resolved' END AS finding, count(*) AS n FROM (SELECT event_id * 2 AS k FROM events) c LEFT JOIN orders o ON o.o_orderkey = c.k GROUP BY 1"""))
def _(t):
    cand = t.events.selectExpr("event_id * 2 AS k")
    raw = t.orders.selectExpr("o_orderkey AS k", "CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'accepted' END AS record_status")
    j = cand.join(raw, "k", "left")
    return j.groupBy(F.expr("CASE WHEN record_status IS NULL THEN 'orphan' WHEN record_status <> 'accepted' THEN 'not_accepted' ELSE 'resolved' END AS finding")).agg(F.count(F.lit(1)).alias("n"))


# ---- lifecycle ---------------------------------------------------------------------------------
cte("trans", """
 SELECT o_orderkey * 4 + i AS transition_id, 'cand-' || o_orderkey AS entity_id,
  CASE i WHEN 0 THEN 'NEW' WHEN 1 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'REJECTED' ELSE 'VALIDATED' END WHEN 2 THEN 'APPROVED' ELSE ['TRAIN_ONLY','REGRESSION','VALIDATION'][(o_orderkey % 3 + 1)::INT] END AS to_state,
  CASE i WHEN 0 THEN NULL WHEN 1 THEN 'NEW' WHEN 2 THEN 'VALIDATED' ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'NEW' ELSE 'APPROVED' END END AS from_state,
  CASE WHEN o_orderkey % 13 = 0 AND i = 1 THEN ' ' ELSE 'importer' END AS actor, CASE WHEN o_orderkey % 17 = 0 AND i = 2 THEN NULL ELSE 'r' END AS reason
 FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS i FROM orders)""")


def transitions(t):
    return (t.orders.select("o_orderkey", F.explode(F.expr("slice(array(0, 1, 2, 3), 1, cast(o_orderkey % 4 + 1 AS int))")).alias("i")).selectExpr(
        "o_orderkey", "o_orderkey * 4 + i AS transition_id", "concat('cand-', o_orderkey) AS entity_id",
        "CASE i WHEN 0 THEN 'NEW' WHEN 1 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'REJECTED' ELSE 'VALIDATED' END WHEN 2 THEN 'APPROVED' ELSE element_at(array('TRAIN_ONLY','REGRESSION','VALIDATION'), cast(o_orderkey % 3 + 1 AS int)) END AS to_state",
        "CASE i WHEN 0 THEN null WHEN 1 THEN 'NEW' WHEN 2 THEN 'VALIDATED' ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'NEW' ELSE 'APPROVED' END END AS from_state",
        "CASE WHEN o_orderkey % 13 = 0 AND i = 1 THEN ' ' ELSE 'importer' END AS actor", "CASE WHEN o_orderkey % 17 = 0 AND i = 2 THEN null ELSE 'r' END AS reason"))


cte("lstate", "SELECT entity_id, arg_max(to_state, transition_id) AS state FROM trans GROUP BY 1", "trans")


@query("latest_state", sql("SELECT entity_id, state FROM lstate", "lstate"))
def _(t):
    return L.latest_state(transitions(t))


@query("state_history", sql("SELECT entity_id, row_number() OVER w AS step, lag(to_state) OVER w AS previous_state, to_state FROM trans WINDOW w AS (PARTITION BY entity_id ORDER BY transition_id)", "trans"))
def _(t):
    return L.state_history(transitions(t)).select("entity_id", "step", "previous_state", "to_state")


@query("validate_transitions", sql("""
 SELECT transition_id, array_to_string(list_filter([CASE WHEN NOT edge THEN 'edge_not_allowed' END, CASE WHEN from_state IS DISTINCT FROM prev THEN 'from_is_not_previous' END, CASE WHEN trim(actor) = '' THEN 'missing_actor' END, CASE WHEN reason IS NULL THEN 'missing_reason' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT *, lag(to_state) OVER (PARTITION BY entity_id ORDER BY transition_id) AS prev,
  coalesce(from_state, '') || '>' || to_state IN ('>NEW','NEW>VALIDATED','NEW>REJECTED','VALIDATED>REJECTED','VALIDATED>APPROVED','APPROVED>REJECTED','APPROVED>TRAIN_ONLY','APPROVED>REGRESSION','APPROVED>VALIDATION','APPROVED>HOLDOUT','APPROVED>ADVERSARIAL') AS edge FROM trans)""", "trans"))
def _(t):
    return L.validate_transitions(transitions(t), "evaluation_candidate").select("transition_id", code_list("reasons").alias("reasons"))


@query("filter_by_state", sql("SELECT entity_id AS candidate_id, state FROM lstate WHERE state = 'VALIDATED'", "lstate"))
def _(t):
    e = t.orders.selectExpr("concat('cand-', o_orderkey) AS candidate_id")
    return L.filter_by_state(e, transitions(t), "candidate_id", "VALIDATED").select("candidate_id", "state")


@query("evidence_lookup", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND user_id < 20")
def _(t):
    return t.events.filter((F.col("event_type") == "error") & (F.col("user_id") < 20)).orderBy("event_id").select("event_id", "event_type", "user_id")


@query("review_queue_order", sql("SELECT candidate_id, state, row_number() OVER (ORDER BY (state <> 'VALIDATED')::INT, novelty DESC, candidate_id) AS position FROM (SELECT 'cand-' || k AS candidate_id, state, (k % 100) / 100.0 AS novelty FROM (SELECT o_orderkey AS k FROM orders) JOIN lstate ON entity_id = 'cand-' || k)", "lstate"))
def _(t):
    e = t.orders.selectExpr("concat('cand-', o_orderkey) AS candidate_id", "(o_orderkey % 100) / 100D AS novelty")
    q = L.filter_by_state(e, transitions(t), "candidate_id").withColumn("waiting", (F.col("state") != "VALIDATED").cast("int"))
    return positions(q, "position", "waiting", F.col("novelty").desc(), "candidate_id").select("candidate_id", "state", "position")


CURATION = [(f"approve:{r}", "VALIDATED", r) for r in ("REGRESSION", "HOLDOUT")] + [("reject", s, "REJECTED") for s in ("NEW", "VALIDATED", "APPROVED")]
_fold = """
 WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS r FROM ({dec})),
 f AS (SELECT d.entity_id, d.seq, d.decision, s.state AS met_state, coalesce({next0}, s.state) AS new_state, {next0} IS NOT NULL AS accepted, d.r FROM d LEFT JOIN ({states}) s USING (entity_id) WHERE d.r = 1
  UNION ALL SELECT d.entity_id, d.seq, d.decision, f.new_state, coalesce({next1}, f.new_state), {next1} IS NOT NULL, d.r FROM d JOIN f ON d.entity_id = f.entity_id AND d.r = f.r + 1)
 SELECT entity_id, seq, decision, met_state, new_state, accepted FROM f"""


def fold_sql(dec, states, rules, *deps):
    case = lambda s: "CASE " + " ".join(f"WHEN d.decision = '{n}' AND {s} = '{a}' THEN '{b}'" for n, a, b in rules) + " END"
    body = _fold.format(dec=dec, states=states, next0=case("s.state"), next1=case("f.new_state"))
    return sql(body.replace("WITH RECURSIVE", "WITH"), *deps).replace("WITH ", "WITH RECURSIVE ", 1)


@query("curate_candidates", fold_sql("SELECT 'cand-' || (event_id % 400) AS entity_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'approve:HOLDOUT' ELSE 'approve:REGRESSION' END AS decision FROM events", "SELECT * FROM lstate", CURATION, "lstate"))
def _(t):
    d = t.events.selectExpr("concat('cand-', event_id % 400) AS entity_id", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'approve:HOLDOUT' ELSE 'approve:REGRESSION' END AS decision")
    return L.apply_decisions(L.latest_state(transitions(t)), d, CURATION, depth=2)


# ---- preferences --------------------------------------------------------------------------------
cte("failed_runs", "SELECT DISTINCT k FROM lines WHERE (kind = 'tool' AND (NOT ok OR NOT executed)) OR (kind = 'validation' AND NOT ok)", "lines")
cte("cls0", """
 SELECT f.*, r.k IS NOT NULL AS failed, lower(trim(coalesce(hint, ''))) AS h FROM feedback f LEFT JOIN failed_runs r ON f.k = r.k""", "feedback", "failed_runs")
cte("cls1", """
 SELECT *, CASE WHEN same_request = false OR feedback_type = 'intent_change' THEN 'changed_intent' WHEN h = 'factual' THEN 'factual_correction' WHEN h = 'style' THEN 'style_preference' WHEN h = 'schedule' THEN 'schedule_detail_change'
   WHEN h = 'repair' THEN 'execution_repair' WHEN h = 'correction' THEN 'true_correction' WHEN h <> '' THEN 'ambiguous' WHEN failed AND feedback_type IN ('edit','correction') THEN 'execution_repair' ELSE 'ambiguous' END AS category,
  CASE WHEN same_request = false OR feedback_type = 'intent_change' THEN 0.9 WHEN h IN ('factual','style','schedule','repair','correction') THEN 0.75 WHEN h <> '' THEN 0.4 WHEN failed AND feedback_type IN ('edit','correction') THEN 0.75 ELSE 0.35 END::DOUBLE AS c0 FROM cls0""", "cls0")
cte("cls", """
 SELECT *, greatest(0, least(1, round(CASE WHEN category = 'ambiguous' THEN least(0.4, c1) ELSE c1 END, 4)))::DOUBLE AS confidence FROM (SELECT *, c0 + CASE WHEN category = 'execution_repair' AND failed THEN 0.1 ELSE 0 END
  - CASE WHEN minutes_after_output > 60 THEN 0.2 ELSE 0 END - CASE WHEN correction_distance >= 0.8 THEN 0.15 ELSE 0 END AS c1 FROM cls1)""", "cls1")


def classified(t):
    bad = V.lines(t).filter("(kind = 'tool' AND (NOT ok OR NOT executed)) OR (kind = 'validation' AND NOT ok)").select("k").distinct().withColumn("run_failed", F.lit(True))
    return PR.classify_feedback(V.feedback(t).join(bad, "k", "left"))


@query("classify_feedback", sql("SELECT feedback_id, category, confidence FROM cls", "cls"))
def _(t):
    return classified(t).select("feedback_id", "category", "confidence")


cte("prefs", """
 SELECT feedback_id, run_id, category, confidence, ch, re, CASE WHEN regexp_matches(ch || ' ' || re, 'sk-[A-Za-z0-9_-]{8,}|[Bb]earer\\s+[A-Za-z0-9_./+=-]{8,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'EXCLUDED:privacy' WHEN trim(ch) = '' THEN 'EXCLUDED:missing_chosen_text' WHEN trim(re) = '' THEN 'EXCLUDED:missing_rejected_text'
  WHEN category IN ('changed_intent','style_preference','schedule_detail_change') THEN 'EXCLUDED:excluded_category_' || category
  WHEN category = 'ambiguous' THEN 'NEEDS_REVIEW:ambiguous_category+low_confidence' WHEN confidence < 0.7 THEN 'NEEDS_REVIEW:low_confidence' ELSE 'PROPOSED:high_confidence_trainable' END AS s
 FROM (SELECT *, coalesce(sanitized_corrected_value, '') AS ch, coalesce(sanitized_original_value, '') AS re FROM cls)""", "cls")


def preference_pairs(t):
    return PR.extract_preference_pairs(classified(t), 0.7)


@query("extract_preference_pairs", sql("SELECT feedback_id, split_part(s, ':', 1) AS initial_state, split_part(s, ':', 2) AS gate, 'pair-' || substr(sha256(feedback_id || '|' || run_id), 1, 20) AS pair_id FROM prefs", "prefs"))
def _(t):
    return preference_pairs(t).select("feedback_id", "initial_state", "gate", "pair_id")


@query("preference_privacy_gate", sql("SELECT feedback_id FROM prefs WHERE s = 'EXCLUDED:privacy'", "prefs"))
def _(t):
    from assaylake.functions.privacy import preference_privacy_hit
    return V.feedback(t).filter(preference_privacy_hit(F.col("sanitized_corrected_value")) | preference_privacy_hit(F.col("sanitized_original_value"))).select("feedback_id")


@query("review_preferences", fold_sql("SELECT feedback_id AS entity_id, k * 3 + i AS seq, ['propose','approve','reject'][((k // 7 + i * (k % 3)) % 3 + 1)::INT] AS decision FROM (SELECT *, unnest(range(0, 3)) AS i FROM (SELECT feedback_id, substr(feedback_id, 4)::BIGINT AS k FROM prefs))",
                                      "SELECT feedback_id AS entity_id, split_part(s, ':', 1) AS state FROM prefs", PR.REVIEW_RULES, "prefs"))
def _(t):
    p = preference_pairs(t)
    d = p.select("k", F.col("feedback_id").alias("entity_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).selectExpr(
        "entity_id", "k * 3 + i AS seq", "element_at(array('propose','approve','reject'), cast((k div 7 + i * (k % 3)) % 3 + 1 AS int)) AS decision")
    return L.apply_decisions(p.select(F.col("feedback_id").alias("entity_id"), F.col("initial_state").alias("state")), d, PR.REVIEW_RULES, depth=3)


@query("preference_readiness", sql("""
 SELECT 'state' AS kind, split_part(s, ':', 1) AS key, count(*) AS n FROM prefs GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM prefs GROUP BY 2
 UNION ALL SELECT 'verdict', 'approved_below_minimum,missing_trainable_target', 0""", "prefs"))
def _(t):
    return PR.preference_readiness(preference_pairs(t).withColumnRenamed("initial_state", "state"))


# ---- flywheel metrics --------------------------------------------------------------------------
cte("fsr", """
 SELECT count(*) FILTER (first_shot_success) AS fs, count(first_shot_success) AS fsn, count(*) FILTER (retry_count > 0 AND completed AND NOT user_retry AND NOT user_abandon) AS rc, count(*) FILTER (retry_count > 0) AS rn,
  sum(retry_count) FILTER (retry_count > 0) AS rs, count(*) FILTER (NOT completed) AS un, count(completed) AS cn FROM facts""", "facts")
_FSR = """SELECT 'first_shot_success_rate' AS metric, round(fs::DOUBLE / fsn, 6) AS value, fs::DOUBLE AS numerator, fsn::DOUBLE AS denominator FROM fsr UNION ALL SELECT 'recovered_without_user_visible_failure', round(rc::DOUBLE / rn, 6), rc, rn FROM fsr
 UNION ALL SELECT 'average_recovery_attempts', round(rs::DOUBLE / rn, 6), rs, rn FROM fsr UNION ALL SELECT 'unrecovered_failure_rate', round(un::DOUBLE / cn, 6), un, cn FROM fsr"""


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("first_shot_recovery", sql(_FSR, "fsr"))
def _(t):
    return r6(M.first_shot_recovery(V.run_facts(t)), "value")


@query("live_shadow_pairs", sql("SELECT run_id, policy_version, shadow_action, action AS live_action FROM runs WHERE shadow_action IS NOT NULL", "runs"))
def _(t):
    return M.live_shadow_pairs(V.observations(t))


@query("shadow_disagreement_rate", sql("SELECT policy_version, round(avg((shadow_action <> action)::INT), 6) AS rate, count(*) AS n FROM runs WHERE shadow_action IS NOT NULL GROUP BY 1", "runs"))
def _(t):
    return r6(M.shadow_disagreement_rate(V.observations(t)), "rate")


_ue = """round(CASE WHEN bool_and(coalesce(currency = 'USD', false) AND final_cost IS NOT NULL AND completed IS NOT NULL) THEN sum(final_cost) / nullif(count(*) FILTER (completed), 0) END, 8) AS cost_per_successful_run,
  round(CASE WHEN bool_and(coalesce(currency = 'USD', false) AND final_cost IS NOT NULL) FILTER (scalar IS NOT NULL) THEN sum(scalar) / nullif(sum(final_cost) FILTER (scalar IS NOT NULL), 0) END, 8) AS reward_per_dollar,
  round(CASE WHEN bool_and(final_latency_ms IS NOT NULL) FILTER (scalar IS NOT NULL) THEN sum(scalar) / nullif(sum(final_latency_ms) FILTER (scalar IS NOT NULL) / 1000, 0) END, 8) AS reward_per_second, round(avg(scalar), 8) AS mean_reward, count(*) FILTER (completed) AS successes"""


@query("unit_economics", sql(f"SELECT session_id, tier, {_ue} FROM rewards GROUP BY ALL", "rewards"))
def _(t):
    r = RW.reward_run(V.run_facts(t), V.REWARDS)
    u = M.unit_economics(r, ["session_id", "tier"])
    return u.withColumns({c: F.round(c, 8) for c in ("cost_per_successful_run", "reward_per_dollar", "reward_per_second", "mean_reward")})


@query("tier_action_coverage", sql("SELECT tier, action AS chosen_action, count(*) AS n FROM runs GROUP BY ALL", "runs"))
def _(t):
    return M.tier_action_coverage(V.observations(t))


cte("psup", """
 SELECT count(l.action) AS supported_cells, count(*) AS eligible_cells FROM (SELECT DISTINCT tier, task_domain, unnest(eligible_actions) AS action FROM obs WHERE NOT shadow) e
 LEFT JOIN (SELECT DISTINCT tier, task_domain, chosen_action AS action FROM obs WHERE NOT shadow AND obs_propensity >= 0.01) l USING (tier, task_domain, action)""", "obs")


@query("propensity_support", sql("SELECT supported_cells, eligible_cells, round(supported_cells::DOUBLE / eligible_cells, 6) AS value FROM psup", "psup"))
def _(t):
    return r6(M.propensity_support(V.observations(t)), "value")


GATES = "array('oracle_isolation','ope_support','core_regression','tier_budget','holdout')"


def gate_log(t):
    """Stored gate rows: one verification report per supplier."""
    return t.supplier.select("s_suppkey", "s_nationkey", F.posexplode(F.expr(GATES)).alias("i", "gate")).selectExpr("concat('ver-', s_suppkey) AS report_id", "s_suppkey", "gate", "(s_suppkey * 7 + i * 3) % 11 > 1 AS passed")


cte("gate_log", "SELECT 'ver-' || s_suppkey AS report_id, s_suppkey, ['oracle_isolation','ope_support','core_regression','tier_budget','holdout'][i + 1] AS gate, (s_suppkey * 7 + i * 3) % 11 > 1 AS passed FROM supplier, (SELECT unnest(range(0, 5)) AS i)")
cte("crr", "SELECT count(*) FILTER (bad) AS critical_failed, count(*) AS reports FROM (SELECT report_id, bool_or(NOT passed AND gate IN ('oracle_isolation','core_regression','holdout')) AS bad FROM gate_log GROUP BY 1)", "gate_log")


@query("critical_regression_rate", sql("SELECT critical_failed, reports, round(critical_failed::DOUBLE / reports, 6) AS value FROM crr", "crr"))
def _(t):
    return r6(M.critical_regression_rate(gate_log(t)), "value")


cte("eff", "SELECT count(*) FILTER (state IN ('APPROVED','TRAIN_ONLY','REGRESSION','VALIDATION','HOLDOUT','ADVERSARIAL') AND k % 40 <> 1) AS approved, count(*) AS imported_candidates FROM (SELECT o_orderkey AS k FROM orders) JOIN lstate ON entity_id = 'cand-' || k", "lstate")


def stored_candidates(t):
    e = t.orders.selectExpr("concat('cand-', o_orderkey) AS candidate_id", "CASE WHEN o_orderkey % 40 = 1 THEN 'cand-0' END AS duplicate_of")
    return L.filter_by_state(e, transitions(t), "candidate_id")


@query("data_efficiency", sql("SELECT approved, imported_candidates, round(approved::DOUBLE / imported_candidates, 6) AS ratio FROM eff", "eff"))
def _(t):
    return r6(M.data_efficiency(stored_candidates(t)), "ratio")


@query("metrics_scorecard", sql(_FSR + f"""
 UNION ALL SELECT 'data_efficiency_ratio', round(approved::DOUBLE / imported_candidates, 6), approved, imported_candidates FROM eff UNION ALL SELECT 'propensity_support_coverage', round(supported_cells::DOUBLE / eligible_cells, 6), supported_cells, eligible_cells FROM psup
 UNION ALL SELECT 'critical_regression_rate', round(critical_failed::DOUBLE / reports, 6), critical_failed, reports FROM crr
 UNION ALL SELECT 'shadow_disagreement', round(avg((shadow_action <> action)::INT), 6), count(*) FILTER (shadow_action <> action), count(*) FROM runs WHERE shadow_action IS NOT NULL
 UNION ALL SELECT unnest(['cost_per_successful_run','reward_per_dollar','reward_per_second','mean_reward']), round(unnest([cost_per_successful_run, reward_per_dollar, reward_per_second, mean_reward]), 6), NULL, NULL FROM (SELECT {_ue} FROM rewards)""", "fsr", "eff", "psup", "crr", "runs", "rewards"))
def _(t):
    facts = V.run_facts(t)
    return r6(M.metrics_scorecard(facts, V.observations(t), RW.reward_run(facts, V.REWARDS), stored_candidates(t), gate_log(t)), "value")
