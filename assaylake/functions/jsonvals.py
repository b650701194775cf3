"""JSON values: strict parsing, type-strict canonical text, and schema conformance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions.reasons import let

# JSON tokens: strings, numbers, literals, punctuation (fixed pattern)
TOKEN = r'"(?:[^"\\]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|[{}\[\],:]'


def parse_strict(text: Column) -> Column:
    """Variant of a JSON document; null when the text is not exactly one JSON value.

    The variant parser ignores text after the first value, so the document must also
    parse inside an array and inside an object. What cannot begin a value is not parsed: a failed parse is dear.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    begins = text.rlike(r'^\s*(?:[\[{"0-9-]|true|false|null)')
    return F.when(begins, F.when(F.coalesce(one, F.lit(False)) & in_object.isNotNull(), F.try_parse_json(text)))


def _tag(tok: Column) -> Column:
    """A token's tagged form, told by its first character: white space and commas come before ``-``, digits before ``:``, all else after."""
    is_int = ~(tok.contains(".") | tok.contains("e") | tok.contains("E"))
    as_int = F.coalesce(tok.try_cast("decimal(38,0)").cast("string"), tok)
    return (F.when(tok.startswith('"'), F.concat(F.lit('"s'), F.substring(tok, 2, 2147483647)))
            .when(tok >= ":", tok).when(tok == ",", tok).when(tok < "-", F.lit(""))
            .when(is_int, F.concat(F.lit('"i'), as_int, F.lit('"')))
            .otherwise(F.concat(F.lit('"f'), tok.cast("double").cast("string"), F.lit('"'))))


def _one_value(tg: Column) -> Column:
    """JSON text of tagged text, or null if that is not one value: it is parsed in an array and in an object."""
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), tg, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), tg, F.lit("}")))
    return let(in_array, lambda a: F.when((F.size(a) == 1) & in_object.isNotNull(), F.to_json(F.get(a, F.lit(0)))))


def canonical_json(text: Column) -> Column:
    """Canonical text in which equal means equal in value and in type; null when not one JSON value.

    Numbers become tagged strings (``i`` integer, ``f`` float), string values get the
    tag ``s``; object keys come out sorted and arrays keep their order.
    """
    tokens = F.regexp_extract_all(text, F.lit("(" + TOKEN + r"|\s+)"), F.lit(1))
    tagged = lambda ts: F.when(F.array_join(ts, "") == text, F.array_join(F.transform(ts, _tag), ""))  # nothing between the tokens

    def finish(tg: Column) -> Column:
        # without escapes a value is written as long as it was read, so an equal length says that nothing follows it
        whole = lambda j: (F.length(j) == F.length(tg)) & ~tg.rlike(r"[\\\x00-\x1f]")
        return let(F.to_json(F.try_parse_json(tg)), lambda j: F.when(whole(j), j).otherwise(_one_value(tg)))

    return let(let(tokens, tagged), finish)


def json_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Type-strict equality of two JSON texts; a tolerance applies to numbers of one type."""
    return canonical_equal(canonical_json(a), canonical_json(b), tolerance)


def canonical_equal(ca: Column, cb: Column, tolerance: float = 0.0) -> Column:
    """Equality of two canonical texts."""
    if not tolerance:
        return ca == cb
    ta, tb = (F.regexp_extract_all(c, F.lit("(" + TOKEN + ")"), F.lit(1)) for c in (ca, cb))

    def close(x: Column, y: Column) -> Column:
        same_kind = F.substring(x, 1, 2) == F.substring(y, 1, 2)
        number = x.rlike('^"[if]')
        value = lambda t: F.substring(t, 3, 2147483647).substr(F.lit(1), F.length(t) - 3).try_cast("double")
        return (x == y) | (same_kind & number & F.coalesce(F.abs(value(x) - value(y)) <= tolerance, F.lit(False)))

    return (F.size(ta) == F.size(tb)) & F.forall(F.zip_with(ta, tb, close), lambda v: v)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant has a JSON type; a boolean is never a number."""
    s = _kind(v)
    if kind == "object":
        return s.startswith("OBJECT")
    if kind == "array":
        return s.startswith("ARRAY")
    if kind == "integer":
        return s.rlike(r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$")
    if kind == "number":  # one pattern: a kind that is named twice is worked out twice
        return s.rlike(r"^(BIGINT$|DECIMAL|DOUBLE$|FLOAT$)")
    return s == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[kind]


def schema_violations(v: Column, schema: dict, path: Column | str = "$", extra_keys: bool = False) -> Column:
    """Array of violations of a variant against a small JSON schema.

    The schema is walked once on the driver; the result is one Catalyst expression.
    Supported: type, const, enum, required, properties, additionalProperties=false,
    items, minItems, minimum, maximum, exclusiveMinimum, pattern.
    """
    p = F.lit(path) if isinstance(path, str) else path
    checks: list[Column] = []

    def say(cond: Column, text: str) -> None:
        checks.append(F.when(F.coalesce(cond, F.lit(False)), F.array(F.concat(p, F.lit(text)))).otherwise(F.array().cast("array<string>")))

    if "const" in schema:
        import json
        say(F.to_json(v) != F.lit(json.dumps(schema["const"])), " differs from the constant")
    if "enum" in schema:
        import json
        allowed = [json.dumps(e, separators=(",", ":")) for e in schema["enum"]]
        say(~F.coalesce(F.to_json(v).isin(*allowed), F.lit(False)), " is not an allowed value")
    num = F.try_variant_get(v, "$", "double")
    if "minimum" in schema:
        say(is_kind(v, "number") & (num < schema["minimum"]), " is below the minimum")
    if "maximum" in schema:
        say(is_kind(v, "number") & (num > schema["maximum"]), " is above the maximum")
    if "exclusiveMinimum" in schema:
        say(is_kind(v, "number") & (num <= schema["exclusiveMinimum"]), " is not above the minimum")
    if "pattern" in schema:
        say(is_kind(v, "string") & ~F.try_variant_get(v, "$", "string").rlike(schema["pattern"]), " does not match the pattern")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    obj = is_kind(v, "object")
    for key in schema.get("required", []):
        say(obj & ~F.array_contains(keys, key), f".{key} is required")
    props = schema.get("properties", {})
    if schema.get("additionalProperties") is False and not extra_keys:
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in props])))
        checks.append(F.when(obj, F.transform(extra, lambda k: F.concat(p, F.lit("."), k, F.lit(" is not permitted")))).otherwise(F.array().cast("array<string>")))
    for key, sub in props.items():
        child = F.try_variant_get(v, f"$.{key}", "variant")
        inner = schema_violations(child, sub, F.concat(p, F.lit(f".{key}")), extra_keys)
        checks.append(F.when(obj & F.array_contains(keys, key), inner).otherwise(F.array().cast("array<string>")))
    if "minItems" in schema:
        say(is_kind(v, "array") & (F.size(F.try_variant_get(v, "$", "array<variant>")) < schema["minItems"]), " has too few items")
    if isinstance(schema.get("items"), dict):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(items, lambda x, i: schema_violations(x, schema["items"], F.concat(p, F.lit("["), i.cast("string"), F.lit("]")), extra_keys))
        checks.append(F.when(is_kind(v, "array"), F.flatten(each)).otherwise(F.array().cast("array<string>")))
    found = F.concat(*checks) if checks else F.array().cast("array<string>")
    kinds = schema.get("type")
    if kinds is None:
        return found
    kinds = kinds if isinstance(kinds, list) else [kinds]
    ok = F.lit(False)
    for k in kinds:
        ok = ok | is_kind(v, k)
    return F.when(~ok, F.array(F.concat(p, F.lit(" must be " + " or ".join(kinds))))).otherwise(found)
