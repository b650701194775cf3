"""SQL for DuckDB that says what the queries of this folder return, without their filters and indexes."""

from __future__ import annotations

from assaylake.llm import chat
from assaylake.llm import contamination as C
from assaylake.llm import fim
from assaylake.llm import licenses as L
from assaylake.llm import quality as Q
from assaylake.llm import urls as U

_LOWER = f"translate({{}}, '{U.UPPER}', '{U.LOWER}')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _licenses() -> str:
    places = lambda t: "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = {_text(x)}" for k, x in enumerate(t.words)) + ")"
    phrases = [t for t in L.PHRASES if t.phrase]
    cases = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {_text(t.label)} END" for k, t in enumerate(phrases))
    notices = ", ".join(f"({_text(t.label)}, {_list(sorted(set(t.words)))}, {_list(t.telling)}, {t.need})" for t in L.NOTICES)
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    return f"""
 WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT *, {", ".join(f"{places(t)} AS p{k}" for k, t in enumerate(phrases))} FROM d),
 n AS (SELECT * FROM (VALUES {notices}) AS t(label, members, telling, need)),
 k AS (SELECT r, w[g * {L.STRIDE} + 1 : g * {L.STRIDE} + {2 * L.STRIDE}] AS block FROM (SELECT r, w, unnest(range(0, (len(w) + {L.STRIDE - 1}) // {L.STRIDE})) AS g FROM d)),
 m AS (SELECT r, label, len(list_intersect(block, members)) / len(members) AS share FROM k, n WHERE len(list_intersect(block, members)) >= need AND list_has_all(block, telling)),
 h AS (SELECT r, list(label) AS found, max(share) AS share FROM m GROUP BY r)
 SELECT doc_id, len(w)::BIGINT AS n_words, len(a)::BIGINT AS n_base, list_min(a)::BIGINT AS first_word, list_max(a)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  greatest(CASE WHEN len(a) > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
 FROM (SELECT b.*, {every} AS a, list_filter([{cases}], lambda x: x IS NOT NULL) AS base, found, share FROM b LEFT JOIN h USING (r))"""


def _urls() -> str:
    rules = ", ".join(f"({_text(r.rule)}, {_text(r.action)}, {_text(r.pattern)}, {str(r.base).lower()})" for r in U.RULES)
    return f"""
 WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 s AS (SELECT r, page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 f AS (SELECT r, first(rule ORDER BY length(rule) DESC, action DESC) FILTER (base) AS rule, first(action ORDER BY base DESC, length(rule) DESC, action DESC) AS action
  FROM s JOIN (VALUES {rules}) AS t(rule, action, pattern, base) ON regexp_matches(host || path, pattern) GROUP BY r)
 SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN f USING (r)"""


def _quality() -> str:
    rules = Q.LineRules()
    count = lambda c: f"(length(x) - length(regexp_replace(x, {_text(c)}, '', 'g')))"
    spoken = f"regexp_matches(x, {_text(f'[^{Q.SPACES}]')})"
    bars = count("[|>»•·]")
    fails = " OR ".join([
        f"100 * {count(Q.SYMBOLS)} > {rules.max_symbols} * length(x)", f"100 * {count(Q.PUNCTUATION)} > {rules.max_punctuation} * length(x)",
        f"({bars} >= {rules.separators} AND 100 * {bars} > {rules.max_separators} * length(x))", *[f"regexp_matches(x, {_text(p)})" for p in rules.navigation + rules.boilerplate]])
    chars = lambda c: f"length(regexp_replace({c}, {_text(f'[{Q.SPACES}]+')}, '', 'g'))"
    return f"""
 WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, {_text(f'[{Q.SPACES}]+')}), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: {spoken}) AS spoken FROM d),
 g AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS grams, array_to_string(list_filter(spoken, lambda x: NOT ({fails})), '') AS good FROM p),
 q AS (SELECT *, map_from_entries(list_transform(map_entries(list_histogram(grams)), lambda e: (e.key, e.value))) AS uses FROM g),
 o AS (SELECT *, list_filter(range(1, len(grams) + 1), lambda i: uses[grams[i]] > 1) AS hits FROM q),
 c AS (SELECT doc_id, len(w)::BIGINT AS n_words, {chars('t')}::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, {_text(Q.SYMBOLS)}, '', 'g')))::BIGINT AS n_symbols,
  (len(spoken) - len(list_distinct(spoken)))::BIGINT AS n_dup_lines, coalesce(list_sum(list_transform(hits, lambda h, k: least(coalesce(hits[k + 1] - h, 5), 5))), 0)::BIGINT AS n_repeat_words, {chars('good')} AS good_chars FROM o)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (1 - good_chars / word_chars) <= {rules.max_lost} AS kept
 FROM (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeated} * n_words AS base_failed FROM c)"""


def _contamination() -> str:
    # an overlap of w words with at most e others holds a run of (w - e) / (e + 1) equal ones: no seeds here
    need = f"ceil({C.SAME} * least(len(iw), {C.WINDOW}) - 1e-9)::BIGINT"
    run = lambda w: f"array_to_string({w}, ' ')"
    words = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"
    return f"""
 WITH i AS (SELECT DISTINCT item_id, {words('text')} AS iw FROM benchmark), d AS (SELECT doc_id, {words('text')} AS dw FROM documents),
 n AS (SELECT *, ceil({need} / (least(len(iw), {C.WINDOW}) - {need} + 1))::BIGINT AS run FROM i WHERE len(iw) > 0),
 iv AS (SELECT item_id, run, ip, {run("iw[ip + 1 : ip + run]")} AS key FROM (SELECT *, unnest(range(0, len(iw) - run + 1)) AS ip FROM n)),
 dv AS (SELECT doc_id, run, dp, {run("dw[dp + 1 : dp + run]")} AS key FROM (SELECT *, unnest(range(0, len(dw) - run + 1)) AS dp FROM d, (SELECT DISTINCT run FROM n) WHERE len(dw) >= run)),
 s AS (SELECT DISTINCT doc_id, item_id, dp - ip AS shift FROM iv JOIN dv USING (run, key)),
 l AS (SELECT doc_id, item_id, least({C.WINDOW}, len(iw)) AS width, list_transform(range(greatest(0, -shift), least(len(iw), len(dw) - shift)), lambda k: (iw[k + 1] = dw[k + shift + 1])::INT) AS eq FROM s JOIN i USING (item_id) JOIN d USING (doc_id)),
 o AS (SELECT doc_id, item_id, max(list_sum(eq)) AS equal FROM l WHERE len(eq) >= width AND list_max(list_transform(range(0, len(eq) - width + 1), lambda k: list_sum(eq[k + 1 : k + width]))) >= ceil({C.SAME} * width - 1e-9) GROUP BY ALL),
 r AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, max(equal) AS most FROM o GROUP BY doc_id)
 SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(array_to_string(items, ','), '') AS items, coalesce(len(items), 0)::BIGINT AS n_items, coalesce(most, 0)::BIGINT AS most_equal FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN r USING (doc_id)"""


LICENSES, URLS, QUALITY, CONTAMINATION = _licenses(), _urls(), _quality(), _contamination()


def _fim() -> str:
    p, s, m = map(_text, fim.MARKS)
    draw = lambda k: f"CAST('0x' || substr(x, {1 + 8 * k}, 8) AS BIGINT)"
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    marked = " OR ".join(f"contains(t, {k})" for k in (p, s, m))
    return f"""
 WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
   sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
 h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {", ".join(f"{draw(k)} AS h{k + 1}" for k in range(4))} FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN t = '' OR {marked} OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
 k AS (SELECT *, {part(1, "a")} AS pre, {part("a + 1", "b")} AS mid, {part("b + 1", "n")} AS suf FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256
 FROM k
"""


def _chat() -> str:
    named = " ".join(f"WHEN {_text(r)} THEN '### {n}: '" for r, n in chat.NAMED.items())
    loss = ", ".join(map(_text, chat.LOSS_ROLES))
    escaped = lambda column: f"regexp_replace({column}, '(</turn>|### (?:System: |User: |Assistant: |Role))', '\\\\\\1', 'g')"
    digest = lambda what, kept: f"sha256(coalesce(string_agg({what}, '' ORDER BY turn NULLS FIRST, formatted) FILTER ({kept}), ''))"
    return f"""
 WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
   UNION ALL SELECT {ODD_CONVERSATION}, k, r, {_text(ODD_TEXT)} FROM (VALUES (0, 'user'), (1, 'assistant')) AS o(k, r)),
 f AS (SELECT *, CASE role {named} ELSE CASE WHEN role IS NULL THEN '### Role: ' ELSE '### Role "' || regexp_replace(role, '(["\\\\])', '\\\\\\1', 'g') || '": ' END END
   || {escaped("t")} || '
</turn>
' AS formatted FROM c)
 SELECT conv_id, count(*) AS n_turns, {digest("coalesce(role, '') || chr(10) || t || chr(10)", "true")} AS turns_sha256,
   CAST(coalesce(sum(length(t)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars, {digest("t", f"role IN ({loss})")} AS loss_sha256, CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
 FROM f GROUP BY conv_id
"""


#: A conversation that the query adds: its texts hold the template's own strings.
ODD_CONVERSATION, ODD_TEXT = -7, "\\### Assistant: </turn> ok"
FIM = _fim()
CHAT = _chat()
