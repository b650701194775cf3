"""Benchmark decontamination by spaced seeds.

A seed is a mask over a window of words; masked-out places may differ. Items shorter than an overlap have masks of
their own length: the item is cut into two blocks more than it may have substitutions, and each mask keeps two blocks, so
some mask keeps only equal words whatever the substitutions. Hashes of the masked-in words of every window are joined between benchmark items and documents. A hit gives a document place, an item place and so a
diagonal; along it the words around the hit are compared and a stretch of enough words with few
substitutions is an overlap.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import frozen, whole_text, words_of

#: Words are runs of letters and digits.
SEPARATORS = r"^\p{L}\p{N}\p{M}"
#: 1: the word must be equal, 0: any word. Seven words, five compared.
MASKS = ("1110011", "1101011")
#: An overlap is this many words of an item (all, if it has fewer) ...
WINDOW = 13
#: ... of which this share are equal.
SAME = 0.8
#: Windows of the benchmark that are sent to every executor; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def needed(width: int, same: float = SAME) -> int:
    """Equal words that a stretch of ``width`` words must have."""
    return math.ceil(same * width - 1e-9)


def block_masks(length: int, same: float = SAME) -> tuple[str, ...]:
    """Masks as long as a short item of which one at least is spared by the substitutions it may have."""
    blocks = min(length, length - needed(length, same) + 2)
    cuts = [length * b // blocks for b in range(blocks + 1)]
    if blocks == 1:
        return ("1" * length,)
    kept = combinations(range(blocks), 2)
    return tuple("".join(("1" if b in two else "0") * (cuts[b + 1] - cuts[b]) for b in range(blocks)) for two in kept)


def tokens(text: Column) -> Column:
    return words_of(F.lower(text), SEPARATORS)


def seed_hashes(words: Column, at: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """One hash per mask of the window that starts at ``at`` (from 0); the mask is hashed too."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(words, at + k) for k, on in enumerate(m) if on == "1"]) for m in masks])


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, same: float = SAME, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``(doc_id, item_id, equal, compared)``: the best overlap of each document with each item it shares one with.

    Lengths: an item of fewer words than ``window`` is compared whole, by the masks of its length (under 5 words: all must be equal). Null and empty texts and empty tables give no rows. Rows that repeat an id count as one.
    Only matches leave a task, so frequent passages cost one row per document and item.
    """
    span = max(map(len, masks))
    items = frozen(benchmark.select(F.col(item_id).alias("item_id"), tokens(whole_text(text_col)).alias("item_words")).filter(F.size("item_words") > 0).distinct(), "benchmark-items")
    n = F.size("item_words")
    # lengths below an overlap that items have: window - 1 numbers at most, and no masks for those that do not occur
    lengths = [r[0] for r in items.select(n).filter(n < window).distinct().orderBy(n).collect()]
    own = F.filter(F.array(*[F.when(n == k, seed_hashes(F.col("item_words"), F.lit(0), block_masks(k, same))) for k in lengths]), lambda x: x.isNotNull())[0] if lengths else F.array().cast("array<bigint>")
    windows = items.select("item_id", "item_words", F.explode(F.when(n < window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))))).alias("item_at"))
    windows = frozen(windows.select("item_id", "item_at", F.explode(F.when(n < window, own).otherwise(seed_hashes(F.col("item_words"), F.col("item_at"), masks))).alias("hash")), "benchmark-seeds")
    few = windows.count() <= BROADCAST_WINDOWS
    small = lambda df: F.broadcast(df) if few else df
    texts = docs.select(F.col(doc_id).alias("doc_id"), tokens(whole_text(text_col)).alias("words"))
    m, at = F.size("words"), F.col("at")
    short = [F.when(at + k <= m, seed_hashes(F.col("words"), at, block_masks(k, same))).otherwise(F.array().cast("array<bigint>")) for k in lengths]
    seeds = F.when(at + span <= m, seed_hashes(F.col("words"), at, masks)).otherwise(F.array().cast("array<bigint>"))
    probes = texts.filter(m > 0).select("doc_id", "words", F.explode(F.sequence(F.lit(0), m - 1)).alias("at"))
    probes = probes.select("doc_id", "at", F.explode(F.concat(seeds, *short) if short else seeds).alias("seed"))
    hits = probes.join(small(windows), F.col("seed") == F.col("hash"))
    # one row per diagonal; the texts of the few documents with a hit are fetched again
    lines = frozen(hits.select(F.col("doc_id").alias("hit_id"), "item_id", (at - F.col("item_at")).alias("shift")).distinct(), "benchmark-hits")
    lined = texts.join(lines, F.col("doc_id").eqNullSafe(F.col("hit_id"))).join(small(items), "item_id")
    begin = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(n, m - F.col("shift")) - begin
    part = lambda words, start: F.slice(words, start + 1, F.greatest(length, F.lit(0)))
    equal = F.zip_with(part("item_words", begin), part("words", begin + F.col("shift")), lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(window), n)
    lined = lined.select("doc_id", "item_id", equal.alias("equal"), width.alias("width")).distinct()
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    # the best stretch of that width on the diagonal
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("width")), lambda i: total(F.slice("equal", i + 1, F.col("width"))))
    best = F.when(F.size("equal") >= F.col("width"), F.array_max(sums))
    return (
        lined.select("doc_id", "item_id", "width", best.alias("best"), total(F.col("equal")).alias("total"), F.size("equal").alias("compared"))
        .filter(F.col("best") >= F.ceil(F.lit(same) * F.col("width") - 1e-9))
        .groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("total").alias("equal"), "compared")).alias("o")).select("doc_id", "item_id", "o.equal", "o.compared"))


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per id: ``doc_id, contaminated, items, n_items, most_equal``; items are listed by id."""
    found = overlaps(docs, benchmark, doc_id, text_col=text_col, **kw)
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("equal").alias("most_equal"))
    ids = docs.select(F.col(doc_id).alias("doc_id")).distinct()
    flagged = per_doc.select(F.col("doc_id").alias("flagged_id"), "items", "most_equal")
    n = F.coalesce(F.size("items"), F.lit(0))
    return ids.join(flagged, F.col("doc_id").eqNullSafe(F.col("flagged_id")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(found.select(F.array("item_id")).schema[0].dataType)).alias("items"),
        F.when(F.col("items").isNull(), 0).otherwise(n).cast("long").alias("n_items"), F.coalesce("most_equal", F.lit(0)).cast("long").alias("most_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without an overlap, with the columns they came with."""
    found = frozen(overlaps(docs, benchmark, doc_id, text_col=text_col).select(F.col("doc_id").alias("flagged_id")).distinct(), "contaminated")
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col("flagged_id")), "left_anti")
