"""Licence scan: exact set-similarity join of text blocks with licence templates.

A text is cut into blocks of words that overlap, so that each template-long run of words lies inside one block.
The tokens of a template are ordered by their frequency in the corpus, rarest first. A block that holds at least
``need = ceil(threshold * size)`` of a template's tokens must hold one of its first ``size - need + 1``; only these
prefix tokens are looked up. Length filter: a block of fewer than ``need`` distinct words cannot match. Positional
filter: beyond the first shared token in the order, the block must have template words enough to reach ``need``. What is
left is compared as whole sets, and the words that tell a licence from its relatives must all be there; for short phrases
the words must also stand one after another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import boxed, unboxed, whole_text, words_of

#: Everything in ASCII but digits and letters separates words.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: A new block starts every so many words and is twice as long.
STRIDE = 32
THRESHOLD = 0.8
KELVIN = "K"


@dataclass(frozen=True)
class Template:
    """``phrase``: all words, one after another, wherever they stand; else a set of words to be contained, the ``telling`` ones without exception."""

    label: str
    words: tuple[str, ...]
    phrase: bool = False
    telling: tuple[str, ...] = ()

    @property
    def need(self) -> int:
        size = len(set(self.words))
        return size if self.phrase else math.ceil(THRESHOLD * size - 1e-9)


def template(label: str, text: str, phrase: bool = False, telling: str = "") -> Template:
    return Template(label, tuple(text.split()), phrase, tuple(telling.split()))


# fixed values: the phrases and labels of the contract
PHRASES = (
    template("gpl", "gnu general public license", True),
    template("apache", "apache license", True),
    template("cc-by", "cc by", True),
    template("mit", "mit license", True),
)
#: Sentences of usual licence notices, as word sets; short identifiers would match by chance.
NOTICES = (
    template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", telling="gnu general"),
    template("gpl", "this work is licensed under the gnu general public license version 3", telling="gnu general"),
    template("lgpl", "licensed under the terms of the gnu lesser general public license", telling="lesser"),
    template("agpl", "licensed under the terms of the gnu affero general public license", telling="affero"),
    template("apache", "licensed under the apache license version 2 0", telling="apache"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", telling="permission hereby granted"),
    template("mit", "released under the terms of the mit license", telling="mit"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", telling="redistribution source binary"),
    template("cc-by", "licensed under a creative commons attribution 4 0 international license", telling="creative commons attribution"),
    template("cc-by", "licensed under cc by 4 0", telling="cc by"),
    template("cc-by-nc", "licensed under cc by nc 4 0", telling="cc nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", telling="cc sa"),
    template("cc0", "dedicated to the public domain under creative commons zero", telling="creative commons zero"),
    template("mpl", "subject to the terms of the mozilla public license", telling="mozilla"),
)


def tokens(text: Column) -> Column:
    """Lower-case words of a text.

    ``lower`` also lowers beyond A-Z; only the Kelvin sign would turn into an ASCII letter, so it is replaced before.
    """
    return words_of(F.lower(F.replace(text, F.lit(KELVIN), F.lit("ĸ"))), SEPARATORS)


def token_order(words: DataFrame, templates: tuple[Template, ...], column: str = "words") -> dict[str, int]:
    """Place of each template token in the global order: by number of texts that hold it, then by itself.

    The driver gets one row per template token.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    held = words.select(F.explode(F.array_intersect(F.col(column), F.array(*map(F.lit, vocabulary)))).alias("token"))
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def prefix_of(t: Template, order: dict[str, int]) -> list[str]:
    members = sorted(set(t.words), key=order.__getitem__)
    return members[: len(members) - t.need + 1]


def prefix_index(spark, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """``token, at, label, members, telling, sequence, size, need, phrase`` for each prefix token (place ``at`` from 0); words of sets as places in the order."""
    rows = []
    for t in templates:
        members = sorted(set(t.words), key=order.__getitem__)
        for at, w in enumerate(prefix_of(t, order)):
            rows.append((order[w], at, t.label, [order[m] for m in members], [order[x] for x in t.telling], list(t.words), len(members), t.need, t.phrase))
    return spark.createDataFrame(rows, "token int, at int, label string, members array<int>, telling array<int>, sequence array<string>, size int, need int, phrase boolean")


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text", templates: tuple[Template, ...] = PHRASES + NOTICES, stride: int = STRIDE) -> DataFrame:
    """The carried columns and ``license_scan``: struct of n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places of phrases are counted over the whole text; ``score`` is the largest share of a template's tokens that a
    block holds, among the templates at their threshold. Null and empty texts have no words, places or labels.
    Repeated rows are scanned each; of equal shares the score is the same; an empty table gives no rows. The template list is a parameter of bounded size, so its index is broadcast.
    """
    if max(len(t.words) for t in templates) > stride + 1:
        raise ValueError("a template is longer than a block's overlap")
    texts = boxed(docs, carry, words=tokens(whole_text(text_col)))
    order = token_order(texts, templates)
    index = prefix_index(docs.sparkSession, templates, order)
    prefix = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in prefix_of(t, order)})])
    n, words = F.size("words"), F.col("words")
    # one row per block that holds a prefix token; a text without any stays one row without a block
    every = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / stride).cast("int"))
    candidates = F.when(F.arrays_overlap(words, prefix), F.filter(every, lambda b: F.arrays_overlap(F.slice(words, b * stride + 1, F.lit(2 * stride)), prefix)))
    blocks = texts.withColumn("row_no", F.monotonically_increasing_id()).select("box", "row_no", n.cast("long").alias("n_words"), "words", F.explode_outer(candidates).alias("no"))
    blocks = blocks.select("box", "row_no", "n_words", "no", F.slice("words", F.col("no") * stride + 1, F.lit(2 * stride)).alias("block"))
    # the block's template words as places in the order
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    known = F.array_sort(F.transform(F.array_intersect("block", F.array(*map(F.lit, order))), lambda w: place[w]))
    first_places = F.array(*[F.lit(i) for i in sorted({order[w] for t in templates for w in prefix_of(t, order)})])
    blocks = blocks.withColumn("known", known)
    hits = blocks.select("*", F.explode_outer(F.array_intersect("known", first_places)).alias("hit"))
    pairs = hits.join(F.broadcast(index), F.col("hit") == F.col("token"), "left")
    # a pair is judged at its first shared prefix token only
    first = (F.col("at") == 0) | ~F.arrays_overlap("known", F.slice("members", 1, F.greatest(F.col("at"), F.lit(1))))
    length_ok = F.size(F.array_distinct("block")) >= F.col("need")
    position_ok = F.size("known") - F.array_position("known", F.col("hit")) + 1 >= F.col("need")
    shared = F.size(F.array_intersect("known", "members"))
    told = F.size(F.array_intersect("known", "telling")) == F.size("telling")
    share = F.when(first & length_ok & position_ok, F.when((shared >= F.col("need")) & told, shared / F.col("size")))
    run = F.size("sequence")
    starts = F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda p: F.slice(F.col("block"), p + 1, run) == F.col("sequence"))
    judged = pairs.select("box", "row_no", "n_words", "label", "phrase", "no", "block", "sequence", share.alias("share")).select(
        "box", "row_no", "n_words", "label", "phrase", "share",
        F.when(F.col("share").isNotNull() & F.col("phrase"), F.transform(starts, lambda p: F.col("no") * stride + p)).alias("places"))
    found = F.col("share").isNotNull() & (~F.col("phrase") | (F.size("places") > 0))
    listed = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    per_text = judged.groupBy("row_no").agg(
        F.first("box").alias("box"), F.first("n_words").alias("n_words"), F.coalesce(F.sum(F.size("places")), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"), F.max(F.array_max("places")).cast("long").alias("last_word"),
        listed(found & F.col("phrase")).alias("base_labels"), listed(found).alias("labels"), F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"))
    return per_text.select(*unboxed(carry), F.struct("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").alias("license_scan"))
