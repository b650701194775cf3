"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import cut_lineage, frozen  # noqa: F401  (others take frozen from here)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not use yet (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in used:
        name += "_"
    return name


def boxed(df: DataFrame, carry: Sequence[str], **columns: Column) -> DataFrame:
    """The carried columns in one struct ``box`` beside new columns, so that no name of the table meets a name of the operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("box"), *[c.alias(n) for n, c in columns.items()])


def unboxed(carry: Sequence[str]) -> list[Column]:
    return [F.col("box").getField(c).alias(c) for c in carry]


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo a divisor; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def words_of(text: Column, separators: str) -> Column:
    """Split on runs of separator characters, without the empty strings at the ends."""
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of the edges ``(a, b)`` reaches.

    Alternates large-star and small-star steps until the edges stay the same. Each round is a few
    shuffles of edges and a reliable checkpoint; neither edges nor components reach the driver.
    Self-links and repeated edges are fine; no edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # every edge points from its larger to its smaller node
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = mark(e)
    while last[0]:
        e = cut_lineage(star(star(e, large=True), large=False))
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
