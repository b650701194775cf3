"""Text functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard; two empty texts are equal, two texts without tokens are not."""
    ta, tb = tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit("")))
    inter, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    both_empty = (F.coalesce(a, F.lit("")) == "") & (F.coalesce(b, F.lit("")) == "")
    return F.when(union > 0, inter / union).when(both_empty, 1.0).otherwise(0.0)


def strip(text: Column) -> Column:
    """Trim all white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Lower case, one space for each run of white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Conservative normal form: case, white space and punctuation only."""
    t = F.regexp_replace(squeeze(text), r" *([,.;:!?]) *", "$1")
    return F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", "")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([-+]?\d+(?:\.\d+)?)"), F.lit(1))


def has_number_near(text: Column, expected: Column, tail: int = 300, tolerance: float = 1e-5) -> Column:
    """Any number in the last characters, thousands separators removed, close to the expected one."""
    end = F.regexp_replace(F.right(text, F.lit(tail)), ",", "")
    found = F.regexp_extract_all(end, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.exists(found, lambda x: F.abs(x.cast("double") - expected) < tolerance)


def all_keywords(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.forall(keywords, lambda w: F.contains(low, F.lower(w)))


def devanagari_with_keywords(text: Column, keywords: Column) -> Column:
    """Devanagari letters present and at least half of the keywords (one at least)."""
    hits = F.size(F.filter(keywords, lambda w: F.contains(text, w)))
    need = F.greatest(F.lit(1), F.floor(F.size(keywords) / 2).cast("int"))
    return text.rlike("[ऀ-ॿ]") & (hits >= need)
