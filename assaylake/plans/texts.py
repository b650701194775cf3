"""Queries: text, privacy, graders and leakage over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import privacy as P
from assaylake.functions import text as X
from assaylake.functions.hashing import content_hash
from assaylake.functions.plan import computed_once
from assaylake.operators import grading as G
from assaylake.operators import lineage as LN
from assaylake.operators import similar as SM
from assaylake.plans.catalog import query
from assaylake.plans.oracle import cte, sql
from assaylake.sources import views as V

_tok = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"
_sq = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_norm = lambda c: f"regexp_replace(regexp_replace({_sq(c)}, ' *([,.;:!?]) *', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


@query("content_hash", "SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type || '|' || coalesce(props, '~')) AS content_hash FROM events")
def _(t):
    return t.events.select("event_id", content_hash("event_id", "user_id", "event_type", "props").alias("content_hash"))


@query("text_jaccard", f"""
 SELECT conv_id, turn, round(CASE WHEN u > 0 THEN i::DOUBLE / u WHEN ta = '' AND tb = '' THEN 1 ELSE 0 END, 6) AS similarity FROM (
 SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb, len(list_intersect({_tok('a.text')}, {_tok('b.text')})) AS i, len(list_distinct(list_concat({_tok('a.text')}, {_tok('b.text')}))) AS u
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""")
def _(t):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("text"), F.col("next_text")), 6).alias("similarity"))


@query("normalize_text", sql(f"SELECT text_id, sha256({_norm('text')}) AS normal_hash FROM texts", "texts"))
def _(t):
    return V.texts(t).select("text_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("normal_hash"))


@query("grade_exact_text", sql("SELECT attempt_id, trim(response_text) = trim(p_name) AS passed FROM att WHERE response_text IS NOT NULL", "att"))
def _(t):
    a = V.attempts_with_text(t).filter("response_text IS NOT NULL")
    return a.select("attempt_id", G.grade_exact_text(F.col("response_text"), F.col("p_name"))["passed"].alias("passed"))


@query("grade_normalized_text", sql(f"SELECT attempt_id, {_norm('response_text')} = {_norm('p_name')} AS passed FROM att WHERE response_text IS NOT NULL", "att"))
def _(t):
    a = V.attempts_with_text(t).filter("response_text IS NOT NULL")
    return a.select("attempt_id", G.grade_normalized_text(F.col("response_text"), F.col("p_name"))["passed"].alias("passed"))


@query("grade_exact_json", sql("""
 SELECT attempt_id, CASE WHEN NOT json_valid(response_text) THEN false ELSE coalesce(len(json_keys(response_text)) = 2 AND response_text->>'brand' = p_brand AND (response_text->'size')::VARCHAR = p_size::VARCHAR, false) END AS passed
 FROM att WHERE method = 'exact_json' AND response_text IS NOT NULL""", "att"))
def _(t):
    a = V.attempts_with_text(t).filter("method = 'exact_json' AND response_text IS NOT NULL")
    return a.select("attempt_id", G.grade_exact_json(F.col("response_text"), F.col("reference_answer"))["passed"].alias("passed"))


@query("grade_required_fields", sql("""
 SELECT attempt_id, CASE WHEN NOT json_valid(response_text) THEN NULL ELSE list_has_all(json_keys(response_text), ['brand','extra']) END AS passed FROM att WHERE method = 'exact_json' AND response_text IS NOT NULL""", "att"))
def _(t):
    a = V.attempts_with_text(t).filter("method = 'exact_json' AND response_text IS NOT NULL")
    return a.select("attempt_id", G.grade_required_fields(F.col("response_text"), ["brand", "extra"])["passed"].alias("passed"))


_SUM = "concat('Total = ', l_linenumber, ' + ', cast(l_quantity AS int), CASE WHEN l_returnflag = 'R' THEN ' which is unclear' ELSE concat(' = ', l_linenumber + cast(l_quantity AS int) + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) END, CASE WHEN l_discount > 0.05 THEN '.50' ELSE '' END)"


@query("grade_arithmetic", """
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 50 ELSE l_quantity END
   ELSE l_linenumber + l_quantity + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 0.5 ELSE 0 END END = l_linenumber + l_quantity AS passed FROM lineitem""")
def _(t):
    g = G.grade_arithmetic(F.expr(_SUM), F.expr("l_linenumber + l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g["passed"].alias("passed"))


@query("check_numeric_tail", """
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_returnflag <> 'R' AND l_linestatus = 'F') OR l_discount <= 0.05 AND false AS found FROM (SELECT * FROM lineitem)""")
def _(t):
    text = F.expr("concat('value ', l_orderkey + 1000000, repeat(' pad', 90), ' so x = ', CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_linestatus = 'F' THEN format_number(l_orderkey + 1000000, 0) ELSE cast(l_orderkey + 1000001 AS string) END)")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.has_number_near(text, F.expr("l_orderkey + 1000000")).alias("found"))


@query("check_keywords", sql("SELECT text_id, contains(lower(text), 'the') AND contains(lower(text), 'on') AS found FROM texts", "texts"))
def _(t):
    return V.texts(t).select("text_id", X.all_keywords(F.col("text"), F.array(F.lit("The"), F.lit("ON"))).alias("found"))


@query("check_script", """
 SELECT p_partkey, p_partkey % 3 <> 0 AND (CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'bolt') THEN 1 ELSE 0 END + 0) >= 1 AS found FROM part""")
def _(t):
    text = F.expr("concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' उत्तर' END)")
    return t.part.select("p_partkey", X.devanagari_with_keywords(text, F.array(F.lit("small"), F.lit("ring"), F.lit("bolt"))).alias("found"))


# ---- privacy -------------------------------------------------------------------------------
# RE2 has no lookaround: for numbers every other character gets a \\x02 behind it, so that of one separator between two
# matches the first takes the character and the second the \\x02
_BEFORE, _AFTER = "(^|\\x02)", "($|[^a-zA-Z0-9\\x02])"
_num = lambda m: f"regexp_replace({m}, '[^0-9]', '', 'g')"
_luhn = lambda d: f"list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN (length({d}) - j) % 2 = 1 THEN (substr({d}, j, 1)::INT * 2) // 10 + (substr({d}, j, 1)::INT * 2) % 10 ELSE substr({d}, j, 1)::INT END)) % 10 = 0"
_DETECTORS = {
    "private_key": ("()", "-----BEGIN (?:[A-Z0-9_-]+ )?PRIVATE KEY-----[\\s\\S]*?-----END (?:[A-Z0-9_-]+ )?PRIVATE KEY-----", "()", "true"),
    "authorization_header": ("()", "\\bBearer\\s+[a-zA-Z0-9_.~+/-]+=*", "()", "true"),
    "jwt": ("()", "\\beyJ[a-zA-Z0-9_-]{8,}\\.eyJ[a-zA-Z0-9_-]{8,}\\.[a-zA-Z0-9_-]*\\b", "()", "true"),
    "secret_token": ("()", "\\b(?:sk-(?:live-|proj-)?[a-zA-Z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[0-9a-zA-Z]{16,}|xox[baprs]-[0-9a-zA-Z-]{10,})\\b", "()", "true"),
    "pii_email": ("()", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "()", "true"),
    "pii_pan": (_BEFORE, "[A-Z]{5}[0-9]{4}[A-Z]", _AFTER, "true"),
    "pii_card": (_BEFORE, "(?:[0-9](?:[ -]\\x02)?){13,19}", _AFTER, _luhn(_num("p[i]"))),
    "pii_aadhaar": (_BEFORE, "(?:[0-9]{4}[ -]\\x02[0-9]{4}[ -]\\x02[0-9]{4}|[0-9]{12})", _AFTER, "true"),
    "pii_phone": (_BEFORE, "(?:\\+\\x02[0-9]{1,3}(?:[-.\\s]\\x02)?)?(?:(?:\\(\\x02)?[0-9]{2,5}(?:\\)\\x02)?(?:[-.\\s]\\x02)?)?[0-9]{2,5}(?:[-.\\s]\\x02)?[0-9]{3,5}", _AFTER, f"length({_num('p[i]')}) >= 10"),
}


def _spans_sql(reason: str) -> str:
    """Matches stand at even places between marks; places come from the lengths of what stands before."""
    before, core, after, holds = _DETECTORS[reason]
    source = "text" if before == "()" else "regexp_replace(text, '([^a-zA-Z0-9])', '\\1' || chr(2), 'g')"
    place = lambda to: f"length(replace(array_to_string(p[1:{to}], ''), chr(2), ''))"
    parts = f"string_split(regexp_replace({source}, '{before}({core}){after}', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1))"
    return f"""list_transform([{parts}], lambda p: list_transform(list_filter(range(2, len(p) + 1, 2), lambda i: {holds}),
      lambda i: {{'s': {place("i - 1")}, 'e': {place("i")}, 'r': '{reason}'}}))[1]"""


cte("pfind", f"""
 SELECT text_id, source, text, list_sort(list_reduce([{", ".join(_spans_sql(r) for r in _DETECTORS)}],
  lambda a, b: list_concat(a, list_filter(b, lambda x: len(list_filter(a, lambda y: y.s < x.e AND x.s < y.e)) = 0)))) AS spans FROM texts""", "texts")


def scanned(t):
    return computed_once(V.texts(t), "scanned", P.scan(F.col("text")))


@query("privacy_scan", sql("""
 SELECT text_id, CASE WHEN len(spans) > 0 THEN 'rejected' ELSE 'clean' END AS status, array_to_string(list_sort(list_distinct(list_transform(spans, lambda x: x.r))), ',') AS reasons FROM pfind""", "pfind"))
def _(t):
    r = scanned(t).withColumn("reasons", P.reasons_of(F.col("scanned")))
    return r.select("text_id", F.when(F.size("reasons") > 0, "rejected").otherwise("clean").alias("status"), F.array_join("reasons", ",").alias("reasons"))


@query("privacy_redact", sql("""
 SELECT text_id, array_to_string(list_transform(range(1, len(spans) + 2), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE spans[i - 1].e + 1 END,
  CASE WHEN i > len(spans) THEN length(text) ELSE spans[i].s END - CASE WHEN i = 1 THEN 0 ELSE spans[i - 1].e END) || CASE WHEN i > len(spans) THEN '' ELSE '[REDACTED:' || spans[i].r || ']' END), '') AS redacted FROM pfind""", "pfind"))
def _(t):
    return scanned(t).select("text_id", "scanned.redacted")


@query("privacy_findings", sql("""
 SELECT source, reason, sum(n)::BIGINT AS findings, count(*) AS texts FROM (SELECT text_id, source, reason, count(*) AS n FROM (SELECT text_id, source, unnest(spans).r AS reason FROM pfind) GROUP BY ALL) GROUP BY source, reason""", "pfind"))
def _(t):
    f = scanned(t).select("text_id", "source", F.explode("scanned.reasons").alias("reason"))
    return f.groupBy("source", "reason", "text_id").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "reason").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("texts"))


@query("redact_event_text", """
 SELECT event_id, CASE WHEN length(m) > 500 THEN substr(m, 1, 499) || '…' ELSE m END AS message FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'call failed, [REDACTED] for user ' || user_id WHEN 'click' THEN 'header [REDACTED]' WHEN 'view' THEN 'used [REDACTED]' WHEN 'signup' THEN repeat('word ', 80 + (event_id % 40)::INT) ELSE 'ok' END AS m FROM events)""")
def _(t):
    m = F.expr("CASE event_type WHEN 'error' THEN concat('call failed, password=hunter', event_id, ' for user ', user_id) WHEN 'click' THEN concat('header BEARER abcdefgh', event_id) WHEN 'view' THEN concat('used sk-abcd_', event_id + 10000) WHEN 'signup' THEN repeat('word ', cast(80 + event_id % 40 AS int)) ELSE 'ok' END")
    return t.events.select("event_id", P.redact_event_text(m).alias("message"))


@query("secret_signature_scan", """
 SELECT source_id, 'github-token' AS signature, sha256('ghp_' || sha256('g' || source_id)) AS fingerprint FROM (SELECT doc_id AS source_id FROM documents) WHERE source_id % 5 = 0 AND source_id % 10 <> 0
 UNION ALL SELECT doc_id, 'openai-token', sha256('sk-proj-' || substr(sha256('o' || doc_id), 1, 30)) FROM documents WHERE doc_id % 7 = 0""")
def _(t):
    d = t.documents.selectExpr("doc_id", "concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(' ghp_', sha2(concat('g', doc_id), 256), ' ') ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN concat(' sk-proj-', substr(sha2(concat('o', doc_id), 256), 1, 30), ' ') ELSE '' END) AS text")
    reviewed = t.documents.filter("doc_id % 10 = 0").selectExpr("doc_id AS source_id", "sha2(concat('ghp_', sha2(concat('g', doc_id), 256)), 256) AS fingerprint")
    hits = d.select(F.col("doc_id").alias("source_id"), F.explode(P.signature_hits(F.col("text"))).alias("h")).select("source_id", "h.signature", "h.fingerprint")
    return hits.join(reviewed, ["source_id", "fingerprint"], "left_anti").select("source_id", "signature", "fingerprint")


@query("benchmark_leakage_scan", sql(f"SELECT text_id, item_id::VARCHAR AS target_id FROM (SELECT text_id, {_sq('text')} AS n FROM texts), (SELECT item_id, {_sq('text')} AS g FROM benchmark) WHERE g <> '' AND contains(n, g)", "texts"))
def _(t):
    return LN.leakage_scan(V.texts(t).select("text_id", "text"), t.benchmark.selectExpr("cast(item_id AS string) AS target_id", "text AS target"))


@query("similar_texts", sql(f"""
 WITH t AS (SELECT text_id, list_sort(coalesce({_tok('text')}, [])) AS toks, coalesce(text, '') <> '' AND len(coalesce({_tok('text')}, [])) = 0 AS alone FROM texts),
 k AS (SELECT *, min(text_id) OVER (PARTITION BY toks, CASE WHEN alone THEN text_id END) AS class_id FROM t),
 w AS (SELECT class_id, len(toks) AS n, unnest(toks) AS tok FROM k WHERE text_id = class_id),
 p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM w a JOIN w b ON a.tok = b.tok AND a.class_id < b.class_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
 e AS (SELECT class_id, count(*) AS links, max(j) AS nearest FROM (SELECT a AS class_id, j FROM p UNION ALL SELECT b, j FROM p) GROUP BY 1)
 SELECT text_id, class_id, coalesce(links, 0) AS links, round(nearest, 6) AS nearest FROM k LEFT JOIN e USING (class_id)""", "texts"))
def _(t):
    return SM.near_text_counts(V.texts(t).select("text_id", "text")).withColumn("nearest", F.round("nearest", 6))


cte("leak_targets", """
 SELECT case_id, unnest(CASE WHEN method = 'exact_json' THEN list_concat(['{"brand": "' || p_brand || '", "size": ' || p_size || '}', '{"brand":"' || p_brand || '","size":' || p_size || '}'], CASE WHEN length(p_brand) >= 8 THEN [p_brand] ELSE [] END) ELSE [reference_answer] END) AS target FROM cases
 UNION SELECT case_id, 'rates ' || domain FROM cases
 UNION SELECT case_id, 'Valid JSON' FROM cases WHERE method = 'rubric'""", "cases")


def leak_targets(t):
    """Targets of every case; its criteria are a generic one and one on its domain."""
    return LN.leakage_targets(V.cases(t).withColumn("criteria", F.array(F.lit(" Valid JSON "), F.concat(F.lit("rates "), "domain"))))


@query("leakage_targets", sql("SELECT case_id, target FROM leak_targets", "leak_targets"))
def _(t):
    return leak_targets(t)


@query("case_leakage_scan", sql(f"""
 SELECT r.text_id, g.target FROM (SELECT DISTINCT sha256(n) AS text_id, n FROM (SELECT {_sq('response_text')} AS n FROM att WHERE response_text IS NOT NULL)) r,
 (SELECT DISTINCT target, {_sq('target')} AS g FROM leak_targets) g WHERE contains(r.n, g.g)""", "att", "leak_targets"))
def _(t):
    """Which distinct responses hold a target of any case."""
    said = V.attempts_with_text(t).filter("response_text IS NOT NULL").select(X.squeeze(F.col("response_text")).alias("text")).distinct().withColumn("text_id", F.sha2("text", 256))
    goals = leak_targets(t).select("target").distinct().withColumn("target_id", F.col("target"))
    return LN.leakage_scan(said, goals).select("text_id", F.col("target_id").alias("target"))
