"""Spelling variants: words within one inserted, deleted or replaced code point, and the frequent form each belongs to.

Words are searched in a bidirectional FM-index over the delimited vocabulary ``$word$word$...``. A word with one error has
its first or its second half unchanged, so two searches find all: one reads ``$`` and the first half exactly and goes on to
the right with one error allowed, the other reads ``$`` and the second half backwards and goes on to the left. A match is an
interval of suffix ranks that both directions keep in step; a whole ``$word$`` is one rank, and the rank is the word's number.

The vocabulary is dealt out by what a search reads exactly: words with equal beginnings, or equal endings, meet in one block.
Crowded beginnings are dealt out again by whole halves, and halves that still fill a block are cut into several indexes, each
of which all words of that half ask. A task holds one block's index whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import frozen, whole_text

MIN_CHARS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent.
RATIO = 10
#: One run in so many loses a code point before it counts.
SPOIL = 31
RUN = "A-Za-z\u00c0-\u00ff"
#: Words of an index, and words of a task on average.
BLOCK, SHARE = 50_000, 20_000
#: Distinct words a task counts before it passes them on, and words that search at the same time.
COUNTED, ASKED = 500_000, 20_000


# ---- words -----------------------------------------------------------------------------------
def _count(min_chars: int, spoil: int):
    runs = re.compile(f"[{RUN.replace('A-Z', '')}]{{{min_chars},}}")  # after lower-casing

    def emit(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(runs.findall(text.as_py().lower().decode())).items():  # bytes: lowers A-Z only
                    if spoil and not (h := zlib.crc32(word.encode(), start)) % spoil:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < min_chars:
                            continue
                    total[word] += n
            if len(total) >= COUNTED:
                yield from emit(total)
                total.clear()
        yield from emit(total)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, spoil: int = SPOIL) -> DataFrame:
    """``(word, n)`` of all texts: maximal letter runs, A-Z lowered, at least ``min_chars`` long and ``min_count`` frequent.

    ``spoil`` deletes a code point of one (document, run) in so many, drawn from a hash; 0 leaves words as they are.
    Null texts have no words, a null id is an empty one in the hash, repeated rows count again. Tasks count before words are exchanged.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), whole_text(text_col).alias("text"))
    counts = rows.mapInArrow(_count(min_chars, spoil), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- index -----------------------------------------------------------------------------------
def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order. The first key takes as many symbols as fit 62 bits; open groups are doubled."""
    n, bits = len(text), max(int(symbols).bit_length(), 1)
    width = max(62 // bits, 1)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    while True:
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        at = order[places]
        first, second = rank[at], rank[np.minimum(at + width, n)]
        by = np.lexsort((second, first))
        order[places] = at[by]
        first, second = first[by], second[by]
        new[places[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        width *= 2


class Ranks:
    """Counts of symbols before a place of a Burrows-Wheeler transform: sums every ``stride`` places, the rest by comparison."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_array(text, symbols)
        self.bwt = text[order - 1]
        self.stride = stride = max(8, 1 << (symbols // 8).bit_length())
        n_blocks = len(text) // stride + 1
        padded = np.zeros(n_blocks * stride, text.dtype)
        padded[: len(text)] = self.bwt
        self.blocks = padded.reshape(n_blocks, stride)
        counts = np.bincount((np.arange(len(text)) // stride) * symbols + self.bwt, minlength=n_blocks * symbols).reshape(n_blocks, symbols)
        #: below[b, c]: symbols less than c in the first b blocks
        self.below = np.zeros((n_blocks + 1, symbols + 1), np.int32)
        self.below[1:, 1:] = np.cumsum(np.cumsum(counts, axis=0), axis=1)
        self.places = np.arange(stride)

    def before(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before each place are less than, and equal to, the asked one."""
        block, rest = np.divmod(place, self.stride)
        low = self.below[block, symbol]
        same = self.below[block, symbol + 1] - low
        near = self.blocks[block]
        inside = self.places < rest[:, None]
        asked = symbol.astype(near.dtype)[:, None]
        return low + ((near < asked) & inside).sum(1), same + ((near == asked) & inside).sum(1)


class WordIndex:
    """Bidirectional FM-index of different words in code-point order; symbol 0 is the delimiter.

    ``flat`` holds the words' symbols end to end, ``ends`` where each stops.
    """

    def __init__(self, flat: np.ndarray, ends: np.ndarray, symbols: int) -> None:
        self.words = len(ends)
        text = np.zeros(len(flat) + self.words + 1, np.uint8 if symbols < 256 else np.uint16 if symbols < 65536 else np.int32)
        text[np.arange(len(flat)) + 1 + np.repeat(np.arange(self.words), np.diff(ends, prepend=0))] = flat
        self.firsts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.symbols = symbols
        self.ranks = {-1: Ranks(text, symbols), 1: Ranks(text[::-1].copy(), symbols)}

    def extend(self, way: int, symbol: np.ndarray, here: np.ndarray, there: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left (-1) or right (1): first ranks in the index of that way and in the other, and size."""
        ranks = self.ranks[way]
        less, same = ranks.before(symbol, here)
        less_to, same_to = ranks.before(symbol, here + size)
        return self.firsts[symbol] + same, there + less_to - less, same_to - same

    def followers(self, way: int, here: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an interval's number and a symbol that may extend it; small intervals name only those that do."""
        small = size <= 2 * self.symbols
        rows = np.flatnonzero(small)
        of = np.repeat(rows, size[rows])
        at = np.arange(len(of)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + here[of]
        pairs = np.unique(of * self.symbols + self.ranks[way].bwt[at])
        wide = np.flatnonzero(~small)
        return (np.concatenate((pairs // self.symbols, np.repeat(wide, self.symbols))),
                np.concatenate((pairs % self.symbols, np.tile(np.arange(self.symbols), len(wide)))))


class Patterns:
    """Words as symbols in one direction; ``exact`` symbols of each are read without error. Unknown symbols are -1, the end is 0."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, exact: np.ndarray) -> None:
        self.flat, self.exact = np.append(flat, 0), exact
        self.size = np.diff(ends, prepend=0)
        self.start = ends - self.size

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.size[word], self.flat[np.minimum(self.start[word] + place, len(self.flat) - 1)], 0)


def exact_parts(index: WordIndex, way: int, asked: Patterns) -> list[np.ndarray]:
    """Word, first rank this way and the other way, and size for ``$`` and the exact part; empty ones are left out."""
    n = len(asked.size)
    word, here, there, size = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.words + 1)
    state, done, place = [word, here, there, size], [], 0
    while len(state[0]):
        ready = asked.exact[state[0]] == place
        done.append([x[ready] for x in state])
        state = [x[~ready] for x in state]
        symbol = asked.at(state[0], np.full(len(state[0]), place))
        known = symbol > 0
        state, symbol = [x[known] for x in state], symbol[known]
        state[1:] = index.extend(way, symbol, *state[1:])
        state = [x[state[3] > 0] for x in state]
        place += 1
    return [np.concatenate(x) for x in zip(*done, strict=True)] if done else state


def one_error(index: WordIndex, way: int, asked: Patterns, states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, number of an index word) where the exact part holds and the rest has exactly one error.

    Of several places where one error means the same (a run of equal symbols), the last one counts.
    """
    open_, wrong = [*states, asked.exact[states[0]]], [np.zeros(0, np.int64)] * 5
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_[0]) or len(wrong[0]):
        word, here, there, size, place = open_
        here_now, end = asked.at(word, place), place == asked.size[word]
        branches = [wrong_next] if (wrong_next := _step(index, way, asked, wrong, found)) else []
        # one symbol of the word is missing
        gone = ~end & (asked.at(word, place + 1) != here_now)
        branches.append([word[gone], here[gone], there[gone], size[gone], place[gone] + 1])
        # another symbol stands before the next one, or in its place
        of, symbol = index.followers(way, here, size)
        other = (symbol != 0) & (symbol != here_now[of])
        of, symbol = of[other], symbol[other]
        h, t, s = index.extend(way, symbol, here[of], there[of], size[of])
        real = s > 0
        of, h, t, s = of[real], h[real], t[real], s[real]
        branches.append([word[of], h, t, s, place[of]])
        inner = ~end[of]
        branches.append([word[of][inner], h[inner], t[inner], s[inner], place[of][inner] + 1])
        wrong = [np.concatenate(x) for x in zip(*branches, strict=True)]
        # the word itself goes on without error
        on = here_now > 0
        h, t, s = index.extend(way, here_now[on], here[on], there[on], size[on])
        real = s > 0
        open_ = [word[on][real], h[real], t[real], s[real], place[on][real] + 1]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _step(index: WordIndex, way: int, asked: Patterns, wrong: list[np.ndarray], found: list) -> list[np.ndarray] | None:
    """States that have had their error read their next symbol; whole words are found."""
    if not len(wrong[0]):
        return None
    symbol = asked.at(wrong[0], wrong[4])
    known = symbol >= 0
    word, here, there, size, place = (x[known] for x in wrong)
    symbol = symbol[known]
    here, there, size = index.extend(way, symbol, here, there, size)
    whole = (size > 0) & (symbol == 0)
    found.append((word[whole], (here if way < 0 else there)[whole] - 1))
    on = (size > 0) & (symbol > 0)
    return [word[on], here[on], there[on], size[on], place[on] + 1]


# ---- blocks ----------------------------------------------------------------------------------
class Block:
    """Words ``filed`` in an index, and the search of words that share its beginnings (side 0) or endings (side 1)."""

    def __init__(self, filed: dict[str, int], side: int) -> None:
        self.words = sorted(filed)
        self.n = np.array([filed[w] for w in self.words], np.int64)
        self.side = side
        self.alphabet = {c: i for i, c in enumerate(sorted(set().union(*self.words)), 1)}
        flat, ends = self._symbols(self.words)
        self.index = WordIndex(flat, ends, len(self.alphabet) + 1)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = self.alphabet.get
        return np.array([code(c, -1) for w in words for c in w], np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))

    def ask(self, words: list[str]) -> pa.RecordBatch:
        """``word, n_near, form_n, form``: near words on this side, and the most frequent one (ties: the smallest)."""
        flat, ends = self._symbols(words)
        size = np.diff(ends, prepend=0)
        half = size // 2
        first = Patterns(flat, ends, half)
        begun = exact_parts(self.index, 1, first)
        if self.side == 0:
            asked, near = one_error(self.index, 1, first, begun)
        else:
            back = np.repeat(ends - size + ends, size) - 1 - np.arange(len(flat))
            second = Patterns(flat[back], ends, size - half)
            asked, near = one_error(self.index, -1, second, exact_parts(self.index, -1, second))
            # words with the whole first half are the other side's
            low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            low[begun[0]], high[begun[0]] = begun[2] - 1, begun[2] - 1 + begun[3]
            new = (near < low[asked]) | (near >= high[asked])
            asked, near = asked[new], near[new]
        by = np.lexsort((near, -self.n[near], asked))
        asked, near = asked[by], near[by]
        best = np.flatnonzero(np.diff(asked, prepend=-1))
        counts = np.diff(best, append=len(asked))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in asked[best]], pa.string()), pa.array(counts, pa.int64()), pa.array(self.n[near[best]], pa.int64()), pa.array([self.words[i] for i in near[best]], pa.string())],
            ["word", "n_near", "form_n", "form"])


def _search(block: int, asked: int):
    """Rows come sorted by side, key and cut, those to be filed first. Keys share an index up to ``block`` words; a cut key has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed: dict[str, int] = {}
        asks: list[str] = []
        held = solver = None

        def solve() -> Iterator[pa.RecordBatch]:
            nonlocal solver
            if filed:
                solver = solver or Block(filed, held[0])
                for at in range(0, len(asks), asked):
                    yield solver.ask(asks[at : at + asked])
            asks.clear()

        for batch in batches:
            for side, key, cut, files, queries, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (side, key, cut)
                if group != held:
                    if held and (side != held[0] or cut >= 0 or held[2] >= 0 or len(filed) >= block):
                        yield from solve()
                        filed, solver = {}, None
                    held = group
                if files:
                    filed[word] = n
                if queries:
                    asks.append(word)
                    if not files and cut >= 0 and len(asks) >= asked:  # a cut key's words to file have all been seen
                        yield from solve()
        if held:
            yield from solve()

    return run


def _filed(words: DataFrame, min_chars: int, block: int) -> DataFrame:
    """``side, key, cut, files, queries, word, n``: where each word is filed and where it asks.

    A near word shares the first ``min_chars // 2`` code points or the rest of ``min_chars`` at the end. Words of a crowded key
    ask under their length and exact half and are filed under the halves that words up to one longer or shorter ask for.
    """
    head, tail = min_chars // 2, min_chars - min_chars // 2
    word, size = F.col("word"), F.length("word")
    part = lambda side, k: F.when(F.col("side") == side, F.substring(word, 1, k) if isinstance(k, int) else F.substr(word, F.lit(1), k))
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    rows = sides.withColumn("key", F.coalesce(part(0, head), F.substring(word, -tail, tail)))

    def crowded(keyed: DataFrame) -> DataFrame:
        full = keyed.filter("files").groupBy("side", "key").count().filter(F.col("count") > block)
        return keyed.join(full.withColumn("cuts", F.ceil(F.col("count") / block).cast("int")).drop("count"), ["side", "key"], "left")

    out = ("side", "key", "cut", "files", "queries", "word", "n")
    whole = F.lit(-1).alias("cut")
    yes = F.lit(True)
    level = crowded(rows.withColumn("files", yes).withColumn("queries", yes))
    plain = level.filter("cuts IS NULL").select("side", "key", whole, "files", "queries", "word", "n")
    lengths = level.filter("cuts IS NOT NULL").select("side", "word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("length")).filter(F.col("length") >= min_chars)
    half = F.floor(F.col("length") / 2).cast("int")
    rest = F.col("length") - half
    by_half = lengths.withColumn("key", F.concat_ws(":", "length", F.coalesce(part(0, half), F.substr(word, size - rest + 1, rest))))
    fine = crowded(by_half.withColumn("files", yes).withColumn("queries", F.col("length") == size))
    uncut = fine.filter("cuts IS NULL").select("side", "key", whole, "files", "queries", "word", "n")
    own = F.pmod(F.xxhash64("word"), "cuts").cast("int")
    cut = fine.filter("cuts IS NOT NULL").withColumn("own", own).withColumn("cut", F.explode(F.when(F.col("queries"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("own"))))
    cut = cut.withColumn("files", F.col("cut") == F.col("own"))
    return plain.unionByName(uncut).unionByName(cut.select(*out)).select(*out)


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK, share: int = SHARE, asked: int = ASKED) -> DataFrame:
    """Per word of ``(word, n)`` with near words: ``n_near`` and the most frequent of them as ``form`` with ``form_n`` (ties: smallest).

    Words must be different and at least ``min_chars`` (two or more) long. ``words`` is read several times: pass a written table.
    """
    if min_chars < 2:
        raise ValueError("words of one code point have no half to read exactly")
    filed = _filed(words, min_chars, block)
    tasks = max(1, -(-2 * words.count() // share))
    keys = ["side", "key", "cut"]
    dealt = filed.repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("files"))
    found = dealt.mapInArrow(_search(block, asked), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots_of(links: DataFrame) -> DataFrame:
    """``(word, root)`` for links ``(word, form)`` without cycles, by pointer jumping: each round doubles the steps taken."""
    jumps = frozen(links.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jumps.join(onward, "root", "left_semi").isEmpty():
            return jumps
        jumps = frozen(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-links")


def variant_groups(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """Per word of ``(word, n)``: ``form`` and ``root``, ``n``, ``n_near``, ``form_n``.

    The form is the most frequent near word (ties: smallest in code-point order) if it is at least ``ratio`` times as frequent,
    else null; the root follows forms to the last, and is the word itself where there is none. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    near = near_words(words, min_chars, **sizes)
    holds = F.col("form_n") >= ratio * F.col("n")
    judged = frozen(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = roots_of(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, spoil: int = SPOIL) -> DataFrame:
    """``variant_groups`` of the words of all texts."""
    return variant_groups(frozen(vocabulary(docs, id_col, text_col, min_chars, min_count, spoil), "spelling-words"), min_chars, ratio)
