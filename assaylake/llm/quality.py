"""Quality rules, line first: judge lines, drop the failing ones, then reject texts that lose too much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.plan import computed_once
from assaylake.llm.common import whole_text, words_of

SPACES = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


@dataclass(frozen=True)
class LineRules:
    """A line with a word fails if any rule says so; percentages are of its code points.

    Punctuation: more than ``max_symbols`` % symbols or ``max_punctuation`` % punctuation in all. Navigation: at least
    ``separators`` bars, arrows or bullets that make up more than ``max_separators`` %, or a whole line that is a
    menu word. Boilerplate: a whole line around a stock notice. A text fails if its failing lines held more than
    ``max_lost`` % of its word characters.
    """

    max_symbols: int = 10
    max_punctuation: int = 25
    separators: int = 3
    max_separators: int = 4
    navigation: tuple[str, ...] = (
        r"(?i)^\s*(?:home|menu|search|login|log in|sign in|sign up|register|next|previous|back to top|skip to (?:main )?content|read more|load more|share this|view all)[\s>»:.]*$",)
    boilerplate: tuple[str, ...] = (
        r"(?i)^.{0,40}(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|subscribe to our newsletter|enable javascript|javascript is disabled).{0,60}$",
        r"(?i)^.{0,20}lorem ipsum")
    max_lost: int = 50
    min_words: int = 10
    max_repeated: int = 20


def _count(line: Column, characters: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, characters, ""))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    n, bars = F.length(line), _count(line, "[|>»•·]")
    bad = (100 * _count(line, SYMBOLS) > rules.max_symbols * n) | (100 * _count(line, PUNCTUATION) > rules.max_punctuation * n)
    bad = bad | ((bars >= rules.separators) & (100 * bars > rules.max_separators * n))
    for p in rules.navigation + rules.boilerplate:
        bad = bad | line.rlike(p)
    return bad & line.rlike(f"[^{SPACES}]")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that lie in a window of ``window`` words that is found twice or more, the first included.

    Windows are told apart by XXH64. Sorting (hash, place) brings equal windows together; the places that have
    an equal neighbour are sorted again, and each adds the words up to the next one, the window's length at most.
    """
    n = F.size(words)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[at(i, k) for k in range(window)]))
    return F.when(n > window, hashes)


def _covered(hashes: Column, window: int) -> Column:
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, k: F.get(p, k)["h"]
    marked = lambda p: F.array_sort(F.transform(F.filter(F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), ((x["h"] == same(p, k + 1)) | ((k > 0) & (x["h"] == same(p, F.greatest(k - 1, F.lit(0)))))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
    places = F.transform(F.array(pairs), marked)[0]
    added = lambda q: F.aggregate(F.transform(q, lambda i, k: F.least(F.coalesce(F.get(q, k + 1) - i, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x)
    return F.transform(F.array(places), added)[0]


def measure(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), name: str = "quality", window: int = 5) -> DataFrame:
    """All columns and a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost, kept.

    ``clean_text`` holds the lines that pass, in order; ``lost`` is the share of word characters that went with the others.
    Null and empty texts have no words and fail. Repeated rows are judged each. No shuffle: each text is judged by itself.
    """
    text = whole_text(text_col)
    words = words_of(text, SPACES)
    lines = F.split(text, "\n", -1)
    step = "quality_parts" if "quality_parts" not in docs.columns else "quality_parts_"
    parts = computed_once(docs, step, F.struct(words.alias("words"), F.filter(lines, lambda x: x.rlike(f"[^{SPACES}]")).alias("spoken"), F.filter(lines, lambda x: ~line_fails(x, rules)).alias("good")))
    w, spoken, good = (F.col(f"{step}.{c}") for c in ("words", "spoken", "good"))
    hashed = f"{step}_h"
    parts = computed_once(parts, hashed, repeated_words(w, window))
    h = F.col(hashed)
    repeat = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, window)).otherwise(0)
    counted = f"{step}_n"
    chars = F.length(F.array_join(w, ""))
    good_chars = F.length(F.regexp_replace(F.array_join(good, ""), f"[{SPACES}]+", ""))
    parts = computed_once(parts, counted, F.struct(
        F.size(w).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"), F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(good, "\n").alias("clean_text"), good_chars.cast("long").alias("good_chars")))
    c = lambda x: F.col(f"{counted}.{x}")
    failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeated * c("n_words"))
    lost = F.when(c("word_chars") > 0, 1 - c("good_chars") / c("word_chars")).otherwise(0.0)
    return parts.select(*docs.columns, F.struct(*[c(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"),
        c("clean_text").alias("clean_text"), lost.alias("lost"), (~failed & (100 * lost <= rules.max_lost)).alias("kept")).alias(name))
