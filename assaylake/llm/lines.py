"""Line dedup by a segment-partition edit join.

Two lines are near within as many edits as the length of the shorter one allows. A line within ``edits`` edits of a
shorter or equally long one holds one of that line's ``edits + 1`` segments unchanged, near its place.
Lines are filed under (length, segment number, segment) and ask for the substrings that a segment of a shorter
or equally long line can have moved to. Lines that meet are verified by a banded bit-parallel edit distance.

Of equal lines the first (by document id, then place) stays. A line near one that comes first is dropped
wherever it stands, whether or not that one is dropped itself, so no chains need to be followed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import frozen, whole_text

#: ``(code points, edits)``: lines from that length on may differ by so many edits; shorter ones only repeat exactly.
LIMITS = ((20, 1), (40, 2), (400, 3))
#: Bits of a key that hold the edits of its filed lines.
EDIT_BITS = 4
#: Rows under one key that are paired at once; fuller keys are split by letter parities.
BUCKET = 64
#: Lines of a split full key that a task compares with as many others; larger groups are compared block by block, each two blocks in a group of their own.
BLOCK = 4096
#: Lines with a candidate that are looked up by broadcast; more are joined by a shuffle.
BROADCAST_LINES = 2_000_000
#: Different lines that a task remembers to have filed.
REMEMBERED = 1_000_000
#: Characters stripped from the ends of a line.
MARGIN = " \t\r\x0b\x0c"


def allowed(length: int, limits: tuple[tuple[int, int], ...] = LIMITS) -> int:
    """Edits within which a line of this length is near a line that is as long or longer."""
    return max((e for n, e in limits if length >= n), default=0)


# ---- segments --------------------------------------------------------------------------------
def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the even segments of a line; longer ones come last."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def moved_places(other: int, length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """``(other, segment, start, size)`` of the substrings by which a line of ``length`` asks for lines of length ``other``.

    If segment ``i`` (from 0) is the first unchanged one, at most ``i`` edits lie before it and the others after
    it, which bounds how far it can have moved from either end.
    """
    out, extra = [], length - other
    for i, (p, n) in enumerate(segments(other, edits)):
        low = max(0, p - i, p + extra - (edits - i))
        high = min(length - n, p + i, p + extra + (edits - i))
        out += [(other, i, s, n) for s in range(low, high + 1)]
    return out


def probe_places(length: int, edits: int, minimum: int) -> list[tuple[int, int, int, int]]:
    """The substrings a line of ``length`` probes with where all lines may differ by ``edits``."""
    return [x for other in range(max(minimum, length - edits), length + 1) for x in moved_places(other, length, edits)]


def key_plan(length: int, limits: tuple[tuple[int, int], ...] = LIMITS) -> list[tuple[int, int, int, int, int, bool]]:
    """``(length of the filed line, segment, start, size, edits, probe)`` of all keys of a line."""
    most, own = max(e for _, e in limits), allowed(length, limits)
    filed = [(length, i, p, n) for i, (p, n) in enumerate(segments(length, own))]
    # filed rows meet each other, so a line need not ask for its own segments
    reach = [(other, allowed(other, limits)) for other in range(max(0, length - most), length + 1)]
    probes = [(*x, e) for other, e in reach if e and length - other <= e for x in moved_places(other, length, e) if x not in filed]
    return [(*x, own, False) for x in filed] + [(*x, True) for x in probes]


def _file_lines(batches: Iterator[pa.RecordBatch], limits: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    """``(key, line, probe)`` rows of each line, once per task as far as remembered."""
    from xxhash import xxh64_intdigest

    seen: set[int] = set()
    plans: dict[int, tuple[list[tuple[int, int, int]], bytes, bytes]] = {}
    margin, min_chars = MARGIN.encode(), min(n for n, _ in limits)

    def plan(n: int):
        keys = key_plan(n, limits)
        return [(4 * p, 4 * (p + s), (length << 8) | i) for length, i, p, s, _, _ in keys], bytes(x[4] for x in keys), bytes(x[5] for x in keys)

    for batch in batches:
        keys, lines, sizes, edits, probes = [], [], [], bytearray(), bytearray()
        for t in batch.column(0).cast(pa.binary()):
            for raw in t.as_py().split(b"\n"):
                b = raw.strip(margin)
                if len(b) < min_chars:
                    continue
                line = xxh64_intdigest(b, 42)
                if line in seen:
                    continue
                wide = b.decode().encode("utf-32-le")
                n = len(wide) // 4
                if n < min_chars:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(line)
                places = plans.get(n)
                if places is None:
                    places = plan(n)
                    if len(plans) < 4096:
                        plans[n] = places
                keys += [xxh64_intdigest(wide[p:q], seed) for p, q, seed in places[0]]
                lines.append(line)
                sizes.append(len(places[0]))
                edits += places[1]
                probes += places[2]
            if len(keys) > 200_000:
                yield _rows(keys, lines, sizes, edits, probes)
                keys, lines, sizes, edits, probes = [], [], [], bytearray(), bytearray()
        if keys:
            yield _rows(keys, lines, sizes, edits, probes)


def _rows(keys: list[int], lines: list[int], sizes: list[int], edits: bytearray, probes: bytearray) -> pa.RecordBatch:
    key = np.array(keys, np.uint64) >> np.uint64(EDIT_BITS) << np.uint64(EDIT_BITS) | np.frombuffer(edits, np.uint8)
    line = np.repeat(np.array(lines, np.uint64), sizes)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line.view(np.int64)), pa.array(np.frombuffer(probes, np.bool_))], ["key", "line", "probe"])


def _pair_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Emits pairs of a filed and another line, and the lines of full keys (``b`` null)."""
    held_key, held, spilling = None, [], False

    def fold(rows):
        """Each line once as filed and once as probing."""
        lines, probe = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        parts = [(np.unique(lines[probe == p]), p) for p in (False, True)]
        return [(x, np.full(len(x), p)) for x, p in parts]

    def pairs(rows: list[tuple[np.ndarray, np.ndarray]], out: list):
        filed, asking = (x for x, _ in fold(rows))
        if len(filed):
            asking = np.union1d(filed, asking)
            a, b = np.repeat(filed, len(asking)), np.tile(asking, len(filed))
            keep = a != b
            out.append((np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])))

    def batch_of(keys, a, b):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        line = batch.column(1).to_numpy(zero_copy_only=False)
        probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(key)]))
        edge = (starts == 0) | (ends == len(key))
        found: list = []
        two = starts[(ends - starts == 2) & ~edge]  # most runs with company
        two = two[(line[two] != line[two + 1]) & ~(probe[two] & probe[two + 1])]
        if len(two):
            found.append((np.minimum(line[two], line[two + 1]), np.maximum(line[two], line[two + 1])))
        keep = (ends - starts > 2) | edge
        for s, e in zip(starts[keep], ends[keep], strict=True):
            if key[s] != held_key:
                if held and not spilling:
                    pairs(held, found)
                held_key, held, spilling = key[s], [], False
            held.append((line[s:e], probe[s:e]))
            if spilling or sum(len(x[0]) for x in held) > limit:
                held = fold(held)
                if spilling or sum(len(x[0]) for x in held) > limit:
                    spilling = True
                    full = np.unique(np.concatenate([x[0] for x in held]))
                    yield batch_of(np.full(len(full), held_key), full, pa.nulls(len(full), pa.int64()))
                    held = []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield batch_of(np.zeros(len(a), np.int64), a, b)
    if held and not spilling:
        found = []
        pairs(held, found)
        for a, b in found:
            yield batch_of(np.zeros(len(a), np.int64), a, b)


# ---- verification ----------------------------------------------------------------------------
def within(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` insertions, deletions and substitutions turn one into the other.

    Bit-parallel over a band of ``2 * edits + 1`` rows that moves down with each character: bit ``k`` is row
    ``j - edits + k`` in column ``j``. The distance is followed along the band's lowest row, then along the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if not n:
        return m <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + edits)
    up, down = full & ~((1 << edits) - 1), 0  # below row 0 each row of the first column is one more
    row = distance = min(edits, m)  # the lowest row of the band in column 0 and its value
    for j, c in enumerate(b):
        match = (places.get(c, 0) >> j) & full
        same = ((((match & up) + up) ^ up) | match | down) & full  # no step on the diagonal
        right_up = down | (full & ~(same | up))
        right_down = same & up
        if row < m:
            row += 1
            distance += not same >> (width - 1) & 1
        else:  # the last row leaves the band upwards, a bit a column
            bit = m - (j + 1) + edits
            distance += (right_up >> bit & 1) - (right_down >> bit & 1)
        if distance > 2 * edits:  # the last row has at most ``edits`` steps that could lower it
            return False
        up = right_down | (full & ~((same >> 1) | right_up))
        down = (same >> 1) & right_up
    return distance <= edits


def parity(line: str) -> int:
    """Which of 64 letter classes occur an odd number of times; an edit changes two bits at most.

    A multiplicative hash spreads neighbouring code points evenly over the bits, so letters and digits fall in every piece.
    """
    bits = 0
    for c in set(line):
        if line.count(c) & 1:
            bits ^= 1 << ((ord(c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 58)
    return bits


def _near(limits: tuple[tuple[int, int], ...]):
    @arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([within(x, y, allowed(min(len(x), len(y)), limits)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return near


def _by_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a full key under ``2 * edits + 1`` pieces of its parities, one of which near lines share."""
    for whole in batches:
        every = whole.column("key").to_numpy(zero_copy_only=False) & ((1 << EDIT_BITS) - 1)
        for edits in np.unique(every).tolist():
            yield from _pieces(whole.filter(pa.array(every == edits)), 2 * edits + 1)


def _pieces(batch: pa.RecordBatch, pieces: int) -> Iterator[pa.RecordBatch]:
    marks = np.array([parity(t) for t in batch.column("text").to_pylist()], np.uint64)
    for k in range(pieces):
        low, high = 64 * k // pieces, 64 * (k + 1) // pieces
        value = (marks >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array((value | np.uint64(k << 48)).astype(np.int64)), batch.column("h1"), batch.column("h2"), batch.column("text"), pa.array(marks.view(np.int64)), batch.column("place")],
            ["key", "piece", "h1", "h2", "text", "mark", "place"])


def _first_near(batches: Iterator[pa.RecordBatch], limits: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, piece, low, high, place). Emits each line that has an earlier near one in the same two blocks of the key."""
    held, texts, marks, blocks, used = None, [], np.zeros(64, np.uint64), np.zeros(64, np.int64), 0
    for batch in batches:
        h1, h2 = [], []
        mark = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
        cols = [batch.column(c).to_pylist() for c in ("key", "piece", "low", "high", "block", "h1", "h2", "text")]
        for i, (key, piece, low, high, block, x, y, text) in enumerate(zip(*cols, strict=True)):
            if (key, piece, low, high) != held:
                held, texts, marks, blocks, used = (key, piece, low, high), [], np.zeros(64, np.uint64), np.zeros(64, np.int64), 0
            close = np.bitwise_count(marks[:used] ^ mark[i]) <= 2 * (key & ((1 << EDIT_BITS) - 1))  # nearer lines that both only ask meet under a key of their own
            if low != high:  # the lines of one block meet where it is paired with itself
                close &= blocks[:used] != block
            if any(texts[j] != text and within(texts[j], text, allowed(min(len(texts[j]), len(text)), limits)) for j in np.flatnonzero(close)):
                h1.append(x), h2.append(y)
            if used == len(marks):
                marks, blocks = np.concatenate((marks, np.zeros(used, np.uint64))), np.concatenate((blocks, np.zeros(used, np.int64)))
            marks[used], blocks[used] = mark[i], block
            used += 1
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["h1", "h2"])


def _in_blocks(split: DataFrame, limit: int) -> DataFrame:
    """Adds ``block, low, high``: groups of over ``limit`` lines are cut into blocks, and each line goes to its block's pair with every block."""
    large = frozen(split.groupBy("key", "piece").count().filter(F.col("count") > limit).select("key", "piece", F.ceil(F.col("count") / limit).alias("blocks")), "line-groups")
    if large.isEmpty():
        return split.select("*", *[F.lit(0).cast("long").alias(c) for c in ("block", "low", "high")])
    n = F.coalesce("blocks", F.lit(1).cast("long"))
    rows = split.join(large, ["key", "piece"], "left").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), n))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select(*split.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


# ---- the operator ----------------------------------------------------------------------------
def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, line_no, line, h1, h2)`` of every line with a character that is not stripped; two hashes name a line."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(whole_text(text_col), "\n", -1)).alias("line_no", "raw"))
    lines = split.select("doc_id", "line_no", F.btrim("raw", F.lit(MARGIN)).alias("line")).filter("line <> ''")
    return lines.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def near_later(docs: DataFrame, first: DataFrame, id_col: str, text_col: str, limits: tuple[tuple[int, int], ...] = LIMITS) -> DataFrame:
    """``(h1, h2)`` of the lines that are near a line with an earlier first place. ``first``: h1, h2, place."""
    filed = docs.select(whole_text(text_col).alias("text")).mapInArrow(lambda it: _file_lines(it, limits), "key long, line long, probe boolean")
    met = frozen(filed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _pair_runs(it, BUCKET), "key long, a long, b long"), "line-pairs")
    pairs = met.filter("b IS NOT NULL").select("a", "b").distinct()
    full = met.filter("b IS NULL").select("key", "a").distinct()
    wanted = frozen(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(full.select("a")).distinct().withColumnRenamed("a", "wanted"), "line-wanted")
    few = wanted.count() <= BROADCAST_LINES
    lines = line_rows(docs, id_col, text_col).filter(F.length("line") >= min(n for n, _ in limits))
    texts = lines.join(F.broadcast(wanted) if few else wanted, F.col("h1") == F.col("wanted"), "left_semi").select("h1", "h2", F.col("line").alias("text")).dropDuplicates(["h1", "h2"])
    texts = frozen(texts.join(first.select("h1", "h2", "place"), ["h1", "h2"]), "line-texts")
    side = lambda c: texts.select(*[F.col(x).alias(f"{c}_{x}") for x in texts.columns])
    both = pairs.join(side("a"), F.col("a") == F.col("a_h1")).join(side("b"), F.col("b") == F.col("b_h1"))
    near = both.filter(_near(limits)("a_text", "b_text")).select(F.explode(F.array(
        *[F.when(F.col(f"{y}_place") < F.col(f"{x}_place"), F.struct(F.col(f"{x}_h1").alias("h1"), F.col(f"{x}_h2").alias("h2"))) for x, y in (("a", "b"), ("b", "a"))])).alias("l")).filter("l IS NOT NULL").select("l.h1", "l.h2")
    crowd = full.join(texts, F.col("a") == F.col("h1")).select("key", "h1", "h2", "text", "place")
    crowd = frozen(crowd, "line-crowd")
    split = crowd.mapInArrow(_by_parity, f"key long, piece long, h1 long, h2 long, text string, mark long, place {crowd.schema['place'].dataType.simpleString()}")
    group = ["key", "piece", "low", "high"]
    more = _in_blocks(split, BLOCK).repartition(*group).sortWithinPartitions(*group, "place").drop("place").mapInArrow(lambda it: _first_near(it, limits), "h1 long, h2 long")
    return near.unionByName(more).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[tuple[int, int], ...] = LIMITS) -> DataFrame:
    """``(doc_id, lines, near)``: numbers (from 0) of the lines to drop, and how many of them only because they are near an earlier line.

    Documents without such lines have no row. Rows that repeat an id count as one document with equal places.
    A null id comes first. Lines without a character stay.
    """
    lines = line_rows(docs, id_col, text_col)
    classes = frozen(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("place"), F.count(F.lit(1)).alias("n")), "line-classes")
    later = near_later(docs, classes, id_col, text_col, limits).withColumn("later", F.lit(True))
    # lines that stand once and are near no earlier one need no look-up
    dropped = classes.join(later, ["h1", "h2"], "left").filter("n > 1 OR later").select("h1", "h2", "place", F.coalesce("later", F.lit(False)).alias("later"))
    hit = lines.select("doc_id", "line_no", "h1", "h2").join(dropped, ["h1", "h2"])
    here = F.struct("doc_id", "line_no").eqNullSafe(F.col("place"))
    hit = hit.filter(F.col("later") | ~here)
    return hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines"), F.count_distinct(F.when(here, F.col("line_no"))).alias("near"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """All documents and columns, texts without the repeated lines; a text that loses none stays as it is."""
    gone = frozen(repeated_lines(docs, id_col, text_col, **kw), "line-decisions").select(F.col("doc_id").alias("decided_id"), F.col("lines").alias("decided_lines"))
    parts = F.split(F.col(f"`{text_col}`"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("decided_lines"))
    text = F.when(F.col("decided_lines").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    joined = docs.join(gone.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("decided_id")), "left")
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
