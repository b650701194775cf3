"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A pair within three differing bits has a half (32 bits) that differs in at most one bit. Each fingerprint is
filed under both halves and asks for both halves and for each half with one more bit set (of two halves
that differ in one bit, one gets the other by setting it). Rows that meet under one key are compared in full.
Only distinct fingerprints take part, so copies cost nothing beyond their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import connected, frozen, whole_text

#: Rows under one key that are compared at once; fuller keys are split by the other half's quarters.
BUCKET = 4096
LANES = np.uint64(0x0001000100010001)
#: Shingles added up before a 16-bit lane could overflow.
LANE_ROWS = 65535


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words; a shorter text is one run."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only, splits at 20 and 09-0D only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return [xxhash.xxh64_intdigest(r, 42) for r in runs]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One fingerprint per text from the hashes of all texts, laid end to end."""
    out = np.zeros(len(lengths), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(lengths)
    starts = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    # cut long texts into runs that a lane can count, then add the runs of a text
    runs = [np.arange(s, s + n, LANE_ROWS) for s, n in zip(starts, lengths[full], strict=True)]
    owner = np.repeat(np.arange(len(full)), [len(r) for r in runs])
    cuts = np.concatenate(runs)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    twice = lengths[full].astype(np.int64)
    bits = np.zeros(len(full), np.uint64)
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts)
        for lane in range(4):
            count = ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            count = np.add.reduceat(count, first)
            bits |= (2 * count > twice).astype(np.uint64) << np.uint64(shift + 16 * lane)
    out[full] = bits
    return out


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash over word runs as a 64-bit integer; empty and null texts give zero."""

    @arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        parts, lengths = [], []
        for t in texts.cast(pa.binary()):
            h = shingle_hashes(t.as_py(), width)
            parts.append(np.array(h, np.uint64))
            lengths.append(len(h))
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return pa.array(majority_bits(hashes, np.array(lengths, np.int64)).view(np.int64))

    return simhash(F.coalesce(text, F.lit("")))


# ---- links between distinct fingerprints -----------------------------------------------------
def _half(fp: np.ndarray, no: int) -> np.ndarray:
    return (fp >> np.uint64(32 * no)) & np.uint64(0xFFFFFFFF)


def _ball(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of each value itself and of each with one more bit set."""
    rows, found = [np.arange(len(values))], [values]
    for b in range(bits):
        unset = np.flatnonzero((values >> np.uint64(b)) & np.uint64(1) == 0)
        rows.append(unset)
        found.append(values[unset] | np.uint64(1 << b))
    return np.concatenate(rows), np.concatenate(found)


def _file_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for no in (0, 1):
            rows, values = _ball(_half(fp, no), 32)
            yield pa.RecordBatch.from_arrays([pa.array((values | np.uint64(no << 32)).view(np.int64)), pa.array(fp[rows].view(np.int64))], ["key", "fp"])


def _file_quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a full key, filed again under the other half's quarters: within three bits, one quarter differs in one at most."""
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        no = (key >> 32).astype(np.uint64)
        other = np.where(no == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
        for quarter in (0, 1):
            rows, values = _ball((other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF), 16)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array((values | np.uint64(quarter << 16)).astype(np.int64)), pa.array(fp[rows].view(np.int64))], ["key", "sub", "fp"])


def spanning_links(fp: np.ndarray, filed: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what the links between filed rows and all rows join; each new row costs one pass over the rest."""
    links, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            u = todo.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= distance
            if not filed[u]:
                near &= filed[rest]
            new, rest = rest[near], rest[~near]
            links += [(u, v) for v in new]
            todo += list(new)
    return links


def _link_runs(batches: Iterator[pa.RecordBatch], distance: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Emits links, and the rows of keys with more than ``limit`` rows."""
    held: list[np.ndarray] = []
    held_key, spilling = None, False

    def emit(keys, a, b=None):
        full = b is None
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(a.view(np.int64)), pa.array(a.view(np.int64) if full else b.view(np.int64)), pa.array(np.full(len(a), full))], ["key", "a", "b", "full"])

    def solve(key: tuple, rows: np.ndarray):
        fp = np.unique(rows)
        filed = _half(fp, key[0] >> 32) == np.uint64(key[0] & 0xFFFFFFFF)
        if len(fp) < 2 or not filed.any():
            return None
        if len(fp) == 2 and np.bitwise_count(fp[0] ^ fp[1]) > distance:
            return None
        links = spanning_links(fp, filed, distance)
        if not links:
            return None
        i = np.array(links)
        return emit(np.full(len(i), key[0]), fp[i[:, 0]], fp[i[:, 1]])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        keys, fp = columns[:-1], columns[-1].view(np.uint64)
        change = np.zeros(len(fp), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        ends = np.concatenate((starts[1:], [len(fp)]))
        # single rows within the batch link to nothing
        keep = (ends - starts > 1) | (starts == 0) | (ends == len(fp))
        for s, e in zip(starts[keep], ends[keep], strict=True):
            key = tuple(int(k[s]) for k in keys)
            if key != held_key:
                if held and not spilling and (out := solve(held_key, np.concatenate(held))):
                    yield out
                held, held_key, spilling = [], key, False
            held.append(fp[s:e])
            if spilling or limit and sum(map(len, held)) > limit:
                spilling = True
                rows = np.concatenate(held)
                yield emit(np.full(len(rows), key[0]), rows)
                held = [rows[:0]]
    if held and not spilling and (out := solve(held_key, np.concatenate(held))):
        yield out


def near_links(fingerprints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints (column ``fp``) within ``distance`` (3 at most) bits.

    Not every pair is listed: a group of n gets n - 1 links under a key, enough for the same components.
    A key with more than ``bucket`` rows is filed again by a quarter of its other half; what then meets
    shares 48 of 64 bits up to the ball, so its size has a bound.
    """
    if distance > 3:
        raise ValueError("two halves with balls of one bit find at most three differing bits")
    out = "key long, a long, b long, full boolean"
    filed = fingerprints.select("fp").distinct().mapInArrow(_file_halves, "key long, fp long")
    found = frozen(filed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _link_runs(it, distance, bucket), out), "simhash-links")
    again = found.filter("full").select("key", F.col("a").alias("fp")).mapInArrow(_file_quarters, "key long, sub long, fp long")
    more = again.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(lambda it: _link_runs(it, distance, None), out)
    return found.filter("NOT full").select("a", "b").unionByName(more.select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` and ``component_id``, the smallest id its fingerprint reaches by links.

    Null and empty texts have fingerprint zero and link like others. Rows with equal texts are in one
    component. Repeated ids keep their rows; a null id never names a component unless all ids in it are null.
    An empty table gives no rows.
    """
    marks = frozen(docs.select(F.col(id_col).alias("doc_id"), fingerprint(whole_text(text_col), width).alias("fp")), "simhash-marks")
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(near_links(first, distance))
    rooted = first.join(roots, first["fp"] == roots["node"]).select("fp", "root", "first")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("low"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("linked_fp"), "low")
    classes = first.join(named, first["fp"] == named["linked_fp"], "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with the columns it came with.

    Rows that repeat an id are one document: one of them stays if any of them is first in its component.
    Rows with a null id are compared but never dropped.
    """
    groups = near_groups(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    per_id = frozen(groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")), "simhash-decisions")
    gone = per_id.filter("NOT stays").select(F.col("doc_id").alias("decided_id"))
    repeated = per_id.filter("stays AND n > 1").select(F.col("doc_id").alias("decided_id"))
    same = F.col(id_col) == F.col("decided_id")
    once = docs.join(gone.unionByName(repeated).hint("merge"), same, "left_anti")
    if repeated.isEmpty():  # texts are dealt out once
        return once
    return once.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col]))
