"""Secrets and personal data in text: detection with positions, redaction, findings.

Detectors look at the original text. Their matches are taken in priority order; a match that overlaps one taken
before is dropped whole, whatever its length. The text is then cut once. Built-in expressions know no positions of
matches, so this runs on Arrow batches; texts that cannot hold a finding are told apart in the JVM and stay there.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.functions.jsonvals import TOKEN, parse_strict
from assaylake.functions.reasons import let

# ---- fixed patterns ---------------------------------------------------------------
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9_-]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9_-]+ )?PRIVATE KEY-----",
    "authorization_header": r"\bBearer\s+[a-zA-Z0-9_\-.~+/]+=*",
    "jwt": r"\beyJ[a-zA-Z0-9_\-]{8,}\.eyJ[a-zA-Z0-9_\-]{8,}\.[a-zA-Z0-9_\-]*\b",
    "secret_token": r"\b(?:sk-(?:live-|proj-)?[a-zA-Z0-9_\-]{16,}|AKIA[0-9A-Z]{16}|ghp_[0-9a-zA-Z]{16,}|xox[baprs]-[0-9a-zA-Z-]{10,})\b",
    "pii_email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "pii_pan": r"(?<![a-zA-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![a-zA-Z0-9])",
    "pii_card": r"(?<![a-zA-Z0-9])(?:\d[ -]?){13,19}(?![a-zA-Z0-9])",
    "pii_aadhaar": r"(?<![a-zA-Z0-9])(?:\d{4}[ -]\d{4}[ -]\d{4}|\d{12})(?![a-zA-Z0-9])",
    "pii_phone": r"(?<![a-zA-Z0-9])(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{2,5}\)?[-.\s]?)?\d{2,5}[-.\s]?\d{3,5}(?![a-zA-Z0-9])",
}
#: A text without any of these has no match of the detector; digits are told by a pattern.
HINTS = {"private_key": ("PRIVATE KEY-----",), "authorization_header": ("Bearer",), "jwt": ("eyJ",), "secret_token": ("sk-", "AKIA", "ghp_", "xox"), "pii_email": ("@",)}
CREDENTIAL_KEYS = ("authorization", "api_key", "apikey", "password", "secret", "access_token", "refresh_token", "cookie", "set-cookie")
EVENT_PATTERNS = (
    r"\bsk-[A-Za-z0-9_\-]{8,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._\-~+/=]{8,}",
    r"(?i)\b(api[_-]?key|access[_-]?token|token|secret|password)\s*[=:]\s*[^\s&,;]+",
)
PREFERENCE_PATTERNS = (
    r"sk-[A-Za-z0-9_\-]{8,}",
    r"(?i)Bearer\s+[A-Za-z0-9_\-./+=]{8,}",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
)
SIGNATURES = {
    "private-key-block": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-token": r"\b(?:ghp_|gho_|ghs_)[A-Za-z0-9]{36,}\b",
    "openai-token": r"\bsk-(?:proj-|or-v1-)[A-Za-z0-9_-]{24,}\b",
}
#: A text with a finding holds one of these marks or a number: a cheap test before anything leaves the JVM. Cards, phones and the like
#: have ten digits or more, at most two separators between them; the other number is five capitals, four digits and a capital.
MARKS = ("@", "Bearer", "PRIVATE KEY", "eyJ", "sk-", "AKIA", "ghp_", "xox")
NUMBER = r"\p{Nd}(?:[^\p{L}\p{Nd}]{0,2}\p{Nd}){9}|[A-Z]{5}\p{Nd}{4}[A-Z]"
#: Both tests in one pattern, to state what they tell apart.
SUSPECT = "|".join(MARKS) + "|" + NUMBER
SUSPECT_DOCUMENT = SUSPECT + r"|\\|(?i:" + "|".join(CREDENTIAL_KEYS) + ")"
#: In a JSON document without a backslash: a credential field, and a number that does not begin in the value of a field.
NAMED_FIELD = '"(?iu:' + "|".join(CREDENTIAL_KEYS) + ')"'
FREE_NUMBER = r'\p{Nd}(?=(?:[^\p{L}\p{Nd}]{0,2}\p{Nd}){9})(?<!\w":\s{0,8}-?[0-9.eE+-]{1,40})|[A-Z]{5}\p{Nd}{4}[A-Z]'

#: So many texts of a batch are held as Python strings at a time.
SLICE = 256

_COMPILED = {name: re.compile(p) for name, p in PATTERNS.items()}
_DIGITS = re.compile(r"\d")
_NUMBERS = re.compile(r"\d(?:[-.\s()]{0,2}\d){9}|[A-Z]{5}[0-9]{4}[A-Z]")
_SUSPECT_VALUE = re.compile("|".join(h for hints in HINTS.values() for h in hints) + r"|\\|" + _NUMBERS.pattern)
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+(@)?")
_BORDER = re.compile(r"\b")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9_-]+ )?PRIVATE KEY-----")
#: What makes a JSON document suspect besides its numbers, and a number that is the value of a field: where no backslash is about, a quote
#: behind a word character ends a string.
_SUSPECT_DOCUMENT = re.compile("|".join(h for hints in HINTS.values() for h in hints) + r"|\\|" + "|".join(CREDENTIAL_KEYS))
_FIELD_NUMBER = re.compile(r'(?<=\w":)\s*-?[0-9.eE+-]+')
_TOKENS = re.compile(rf"(\s+)|({TOKEN})")


def luhn(digits: str) -> bool:
    """Luhn check of a digit string."""
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One attempt for each run of address characters that ends in ``@``: every later start in it fails alike."""
    done = 0
    for run in _LOCAL_PART.finditer(text):
        if run[1] and (border := _BORDER.search(text, max(run.start(), done), run.end() - 1)) and border.start() < run.end() - 1:
            found = _COMPILED["pii_email"].match(text, border.start())
            if found:
                done = found.end()
                yield found.span()


def _matches(reason: str, text: str) -> Iterator[tuple[int, int]]:
    pattern = _COMPILED[reason]
    if reason == "pii_email":
        yield from _emails(text)
    elif reason == "private_key":
        last = max((m.end() for m in _KEY_END.finditer(text)), default=0)  # beyond it no block ends
        yield from (m.span() for m in pattern.finditer(text, 0, last))
    elif reason in ("pii_card", "pii_phone"):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if luhn(digits) if reason == "pii_card" else len(digits) >= 10:
                yield m.span()
    else:
        yield from (m.span() for m in pattern.finditer(text))


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, reason)`` of all findings, in order of the text; they never overlap."""
    taken: list[tuple[int, int, str]] = []
    numbers = bool(_NUMBERS.search(text))
    for reason in PATTERNS:
        if not (any(h in text for h in HINTS[reason]) if reason in HINTS else numbers):
            continue
        new = []
        for start, end in _matches(reason, text):
            k = bisect_left(taken, (end,))  # the spans before k begin before this one ends
            if not k or taken[k - 1][1] <= start:
                new.append((start, end, reason))
        taken = sorted(taken + new)
    return taken


def _marker(reason: str) -> str:
    return f"[REDACTED:{reason}]"


def redacted_text(text: str) -> tuple[str, list[str]]:
    """The text with each finding replaced by its marker, and the reasons of the findings."""
    found = spans_of(text)
    parts, at = [], 0
    for start, end, reason in found:
        parts += [text[at:start], _marker(reason)]
        at = end
    return "".join([*parts, text[at:]]), [r for _, _, r in found]


def redacted_document(raw: str) -> tuple[str, list[str]]:
    """A JSON document with its string values redacted and credential fields replaced; keys and numbers stay as written.

    A field counts by its name in any case, and is left alone if its value is null or empty. Text that is no JSON is
    redacted as text.
    """
    try:
        json.loads(raw)
    except ValueError:
        return redacted_text(raw)
    if not _SUSPECT_DOCUMENT.search(raw) and not _SUSPECT_DOCUMENT.search(raw.lower()) and not _NUMBERS.search(_FIELD_NUMBER.sub("", raw)):
        return raw, []
    tokens = [m[0] for m in _TOKENS.finditer(raw)]
    solid = [i for i, t in enumerate(tokens) if not t.isspace()]
    reasons: list[str] = []
    k = 0
    while k < len(solid):
        token = tokens[solid[k]]
        if token[0] != '"':
            k += 1
            continue
        if k + 1 < len(solid) and tokens[solid[k + 1]] == ":":
            end, k = _value_end(tokens, solid, k + 2), k + 2
            value = [tokens[i] for i in solid[k:end]]
            if json.loads(token).lower() in CREDENTIAL_KEYS and value not in (["null"], ['""'], ["{", "}"], ["[", "]"]):
                reasons.append("credential_field")
                tokens[solid[k]] = json.dumps(_marker("credential_field"))
                for i in range(solid[k] + 1, solid[end - 1] + 1):
                    tokens[i] = ""
                k = end
            continue
        text, found = redacted_text(json.loads(token)) if _SUSPECT_VALUE.search(token) else ("", [])
        if found:
            tokens[solid[k]] = json.dumps(text, ensure_ascii=False)
            reasons += found
        k += 1
    return "".join(tokens), reasons


def _value_end(tokens: list[str], solid: list[int], k: int) -> int:
    """The place behind the JSON value that begins at ``k``."""
    depth = 0
    while True:
        token = tokens[solid[k]]
        depth += (token in "{[") - (token in "}]")
        k += 1
        if not depth:
            return k


def _suspect(text: Column) -> Column:
    """Fixed strings are looked for as such; one pattern of all would try each of them at each character."""
    return reduce(or_, [text.contains(m) for m in MARKS]) | text.rlike(NUMBER)


def _suspect_document(raw: Column) -> Column:
    """The same for a JSON document, where escapes may hide a finding and fields count by their name."""
    named = let(F.lower(raw), lambda low: reduce(or_, [low.contains(k) for k in CREDENTIAL_KEYS]))
    return raw.contains("\\") | _suspect(raw) | named


def _searched_document(raw: Column) -> Column:
    """Documents that Python has to search: a long number that is the value of a field is a finding only in text that is no JSON."""
    number = raw.rlike(NUMBER) & (raw.rlike(FREE_NUMBER) | parse_strict(raw).isNull())
    return raw.contains("\\") | reduce(or_, [raw.contains(m) for m in MARKS]) | raw.rlike(NAMED_FIELD) | number


def _scanned_slice(texts: pa.Array, how) -> pa.Array:
    # one text at a time; a text without a finding stays in the JVM's copy
    made = (how(t.as_py()) if t.is_valid else (None, []) for t in texts)
    return pa.array(({"redacted": r if f else None, "reasons": f} for r, f in made), pa.struct([("redacted", pa.string()), ("reasons", pa.list_(pa.string()))]))


def _scanned(text: Column, suspect: Column, how) -> Column:
    @arrow_udf("struct<redacted: string, reasons: array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_scanned_slice(texts.slice(at, SLICE), how) for at in range(0, max(len(texts), 1), SLICE)])

    found = scan(F.when(suspect, text))
    return F.struct(F.coalesce(found["redacted"], text).alias("redacted"), found["reasons"].alias("reasons"))


def scan(text: Column) -> Column:
    """struct<redacted, reasons>: the redacted text and the reason of each finding, with repeats. Null stays null, without reasons."""
    return _scanned(text, _suspect(text), redacted_text)


def scan_document(raw_json: Column) -> Column:
    """``scan`` for a JSON document text."""
    return _scanned(raw_json, _searched_document(raw_json), redacted_document)


def reasons_of(scanned: Column) -> Column:
    return F.array_sort(F.array_distinct(scanned["reasons"]))


def redact_event_text(text: Column, limit: int = 500) -> Column:
    """Operational text: three credential patterns, bounded length."""
    out = text
    for p in EVENT_PATTERNS:
        out = F.regexp_replace(out, p, "[REDACTED]")
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def preference_privacy_hit(text: Column) -> Column:
    hit = F.lit(False)
    for p in PREFERENCE_PATTERNS:
        hit = hit | F.coalesce(text.rlike(p), F.lit(False))
    return hit


def signature_hits(text: Column) -> Column:
    """array<struct(signature, fingerprint)> of high-specificity secrets; the match itself is never kept."""
    return F.concat(*[_hits(text, name, p) for name, p in SIGNATURES.items()])


def _hits(text: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("signature"), F.sha2(m, 256).alias("fingerprint")))
