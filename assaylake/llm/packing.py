"""Packing documents into sequences of a fixed token budget: best-two-fit over a length histogram.

Documents of one length are alike, so the plan needs only how many there are of each length, a table with at
most ``capacity`` rows whatever the corpus. A planned bin is repeated as often as the counts allow, which
keeps the number of different bins bounded as well. Documents then look up their place by length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import frozen, whole_text

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks; lengths with more are split by a hash.
RANKED = 50_000
#: Distinct words a worker remembers the ids of.
REMEMBERED = 200_000
MARKS = frozenset(".,;:!?")
#: Bytes of text encoded at a time.
STEP = 4 << 20


# ---- tokens ----------------------------------------------------------------------------------
class Places(dict):
    """Numbers words in the order they come up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts for tokenizers that lower-case, drop white space and never join across it.

    Texts are put together from the runs between white space, each encoded once. Up to ``REMEMBERED`` runs stay for
    later texts. A run that ends in one mark after a letter a-z is the run without it and the mark.
    """

    def __init__(self, tokenizer_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.places = Places()
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Words of lower-case letters alone are one unit to the tokenizer: they go in one text and are told apart by their ends."""
        plain = [i for i, w in enumerate(words) if w.isalpha() and w == w.lower()]
        ids = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in plain])], add_special_tokens=False)[0].ids
        cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(cuts) != len(plain):
            plain, cuts = [], []
        out: list = [None] * len(words)
        for i, a, b in zip(plain, [0, *cuts[:-1]], cuts, strict=False):
            out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self, words: list[str]) -> None:
        stem_of = {w: w[:-1] for w in words if w[-1:] in MARKS and "a" <= w[-2:-1] <= "z"}
        units = list({*(stem_of.get(w, w) for w in words), *(w[-1:] for w in stem_of)})
        ids = {}
        for at in range(0, len(units), 1000):
            part = units[at : at + 1000]
            ids.update(zip(part, self.ids_of(part), strict=True))
        found = [ids[stem_of[w]] + ids[w[-1:]] if w in stem_of else ids[w] for w in words]
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, found), np.int64, len(found))))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.int32)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has."""
        # a special token is not to arise from lower-casing
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        runs = pc.ascii_split_whitespace(lowered)
        words = runs.flatten().dictionary_encode()
        known = len(self.places)
        of_word = np.fromiter(map(self.places.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        self.learn(list(islice(reversed(self.places), len(self.places) - known))[::-1])
        at = of_word[words.indices.to_numpy()]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.sizes))), pa.int32()), pa.array(self.flat))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(self.sizes[at])))
        sizes = np.diff(ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()])
        if len(self.places) > REMEMBERED:
            while len(self.places) > max(known, REMEMBERED):
                self.places.popitem()
            kept = len(self.places)
            self.flat, self.sizes = self.flat[: int(self.sizes[:kept].sum())], self.sizes[:kept]
        return ids, sizes


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> Encoder:
    """A worker process keeps its encoder from task to task."""
    return Encoder(tokenizer_path)


def _pieces(tokenizer_path: str, end_id: int | None, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            until = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(until // STEP, prepend=-1))  # about STEP bytes of text at a time
            for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                if end_id is not None:
                    sizes = sizes + 1
                    own = np.ones(len(ids) + len(sizes), bool)
                    own[np.cumsum(sizes) - 1] = False
                    whole = np.full(len(own), end_id, np.int32)
                    whole[own] = ids
                    ids = whole
                pieces = -(-sizes // capacity)
                rows = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[rows] - start)
                ends = np.concatenate(([0], np.cumsum(length)))
                unsigned = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(unsigned[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = {"doc_id": batch.column(0).take(pa.array(rows + a)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


# ---- plan ------------------------------------------------------------------------------------
@dataclass
class Plan:
    """Runs of equal bins as segments: ranks from ``first`` of ``length`` go to bins from ``base``, ``times`` to a bin, from ``offset``."""

    keys: np.ndarray
    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    bins: int


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(repeats, lengths)`` of bins that hold each counted length once.

    A bin is filled greedily with the largest lengths that fit. Then its smallest member gives way to two
    unpacked ones whose sum leaves a smaller gap, as long as there are such.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"length {n} does not fit a sequence of {capacity}")
        left[n] += c
    index = np.arange(capacity + 1)

    def below() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, index, 0))  # the largest unpacked length up to each length

    plan, low = [], below()
    while low[capacity]:
        members, gap = [], capacity

        def take(n: int) -> None:
            nonlocal low, gap
            members.append(n)
            left[n] -= 1
            gap -= n
            if not left[n]:
                low = below()

        while gap and low[gap]:
            take(int(low[gap]))
        while gap:
            smallest = min(members)
            room = gap + smallest
            a = np.flatnonzero(left[: room // 2 + 1])
            if not len(a):
                break
            b = low[room - a]
            # a length meets itself only if two are left
            alone = (b == a) & (left[a] < 2)
            b = np.where(alone, low[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            best = int(np.argmax(both))
            if both[best] <= smallest:
                break
            members.remove(smallest)
            left[smallest] += 1
            gap = room
            low = below()
            take(int(a[best]))
            take(int(b[best]))
        uses = Counter(members)
        more = int(min(left[n] // k for n, k in uses.items()))
        if more:
            for n, k in uses.items():
                left[n] -= more * k
            low = below()
        plan.append((1 + more, sorted(members, reverse=True)))
    return plan


def lay_out(plan: list[tuple[int, list[int]]]) -> Plan:
    used: Counter = Counter()
    rows, base = [], 0
    for repeats, members in plan:
        offset = 0
        for n, k in sorted(Counter(members).items(), reverse=True):
            rows.append((n, used[n], base, k, offset))
            used[n] += repeats * k
            offset += n * k
        base += repeats
    rows.sort()
    length, first, start, times, offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([],) * 5))
    return Plan((length << 48) + first, length, first, start, times, offset, base)


# ---- places ----------------------------------------------------------------------------------
def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of length 1 to ``capacity``; sequences have no gaps from offset 0.

    Ranks within a length follow ``order`` inside hash groups of about ``RANKED`` rows, so a length that
    holds a third of all pieces is many groups. Rows alike in all of ``order`` may change places with each other.
    ``pieces`` is read three times: pass a written table.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}  # capacity rows at most
    plan = lay_out(best_two_fit(counts, capacity))
    shares = pieces.sparkSession.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "of_length long, shares long")
    grouped = pieces.join(F.broadcast(shares), F.col(length_col) == F.col("of_length")).withColumn("share", F.pmod(F.xxhash64(*order), "shares")).drop("of_length")
    sizes = grouped.groupBy(length_col, "share").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(length_col).orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(length_col).alias("of_length"), F.col("share").alias("of_share"), before.alias("before"))
    ranked = grouped.withColumn("rank", F.row_number().over(W.partitionBy(length_col, "share").orderBy(*order)) - 1)
    ranked = ranked.join(starts, (F.col(length_col) == F.col("of_length")) & (F.col("share") == F.col("of_share"))).withColumn("rank", F.col("rank") + F.col("before"))

    @arrow_udf("struct<sequence_id bigint, offset bigint>")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(plan.keys, (n << 48) + r, side="right") - 1
        turn = r - plan.first[at]
        k = plan.times[at]
        return pa.StructArray.from_arrays([pa.array(plan.base[at] + turn // k), pa.array(plan.offset[at] + (turn % k) * n)], ["sequence_id", "offset"])

    seated = ranked.withColumn("seat", seat(F.col(length_col).cast("long"), F.col("rank").cast("long")))
    return seated.select(*pieces.columns, "seat.sequence_id", "seat.offset")


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)`` of all documents, written to the shared folder.

    ``ids_crc32`` is the unsigned checksum of a piece's ids as little-endian unsigned 32-bit integers; ``ids`` can be left out.
    Null and empty texts are one piece with the end id. Only texts longer than the capacity are cut; the
    last piece holds the rest. Repeated rows are packed again; an empty table gives no pieces.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return frozen(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity, keep_ids), schema), "pieces")


def pack(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """All pieces with their ids and their place: the columns of ``tokenized_pieces``, ``sequence_id`` and ``offset``."""
    return place(tokenized_pieces(docs, tokenizer_path, **kw), ["doc_id", "piece"])
