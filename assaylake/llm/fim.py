"""Fill-in-the-middle: texts are cut at unit borders into prefix, middle and suffix and written in another order.

A unit is a word with the white space before it; white space at the end of a text is one more unit. A text's bytes are cut
into fixed blocks, and a Fenwick tree holds the units and code points of the blocks: a binary-lifting descent finds the
block of a cut in O(log blocks), and only that block is searched for the place itself.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import free_name, whole_text

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are reordered, and percent of those that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Bytes of a block.
BLOCK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class UnitTree:
    """Fenwick tree over the blocks of one UTF-8 text: units that end in a block and code points that begin in it."""

    def __init__(self, text: bytes, block: int = BLOCK) -> None:
        raw = np.frombuffer(text, np.uint8)
        space = _SPACE[raw]
        self.block = block
        self.ends = np.ones(len(raw), bool)
        np.greater(space[1:], space[:-1], out=self.ends[:-1])
        self.begins = (raw & 0xC0) != 0x80
        starts = np.arange(0, len(raw), block)
        self.blocks = len(starts)
        self.units, self.points = (self._tree(np.add.reduceat(x, starts, dtype=np.int64) if len(raw) else starts) for x in (self.ends, self.begins))
        self.n = int(np.count_nonzero(self.ends))

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        sums = np.concatenate(([0], np.cumsum(counts)))
        i = np.arange(len(sums))
        return (sums - sums[i - (i & -i)]).tolist()

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if not units:
            return 0, 0
        at, points = 0, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.blocks and self.units[to] < units:
                at, units, points = to, units - self.units[to], points + self.points[to]
            step >>= 1
        low = at * self.block
        place = int(np.flatnonzero(self.ends[low : low + self.block])[units - 1]) + 1
        return low + place, points + int(np.count_nonzero(self.begins[low : low + place]))


def draws(id_col: str, seed: int = SEED) -> Column:
    """Four unsigned 32-bit draws from the sha256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.substring(digest, 1 + 8 * k, 8) for k in range(4)]), lambda x: F.conv(x, 16, 10).cast("long"))


def _checked(marks: tuple[str, str, str]) -> None:
    overlap = [any(a.endswith(b[:k]) for k in range(1, len(b))) for a in marks for b in marks]
    if not all(marks) or any(a in b for a, b in permutations(marks, 2)) or any(overlap):
        raise ValueError(f"marks must not be empty, contain each other or overlap: {marks}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, marks: tuple[str, str, str] = MARKS, into: str = "fim") -> DataFrame:
    """Add a struct: ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and the ``output``.

    The two cuts are drawn among all n + 1 unit borders. A text that is null, empty or holds a mark stays plain, so that
    ``restore`` is exact. Equal ids draw equally, so repeated rows give repeated results; a null id draws as an empty
    one. An empty table gives no rows. Columns of the table stay; if it has one named as ``into``, an underscore is added.
    """
    _checked(marks)
    before = [m.encode() for m in marks]

    @arrow_udf("struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def reorder(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        four = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        rows = []
        for text, (h1, h2, h3, h4) in zip(texts.cast(pa.binary()).to_pylist(), four.tolist(), strict=True):
            tree = UnitTree(text)
            if not text or h3 % 100 >= rate or any(m in text for m in before):
                rows.append((tree.n, "plain", None, None, text))
                continue
            a, b = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
            (x, x_points), (y, y_points) = tree.cut(a), tree.cut(b)
            prefix, middle, suffix = before[0] + text[:x], before[2] + text[x:y], before[1] + text[y:]
            spm = h4 % 100 < suffix_first
            rows.append((tree.n, "spm" if spm else "psm", x_points, y_points - x_points, (suffix + prefix if spm else prefix + suffix) + middle))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("*", reorder(whole_text(text_col), draws(id_col, seed)).alias(free_name(docs, into)))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Each mark is in it once, because texts with marks stay plain."""
    p, s, m = marks
    outer = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    tail = lambda mark: F.substring_index(outer, mark, -1)
    head = lambda mark, until: F.substr(F.substring_index(outer, until, 1), F.lit(len(mark) + 1))
    return (F.when(form == "psm", F.concat(head(p, s), middle, tail(s)))
            .when(form == "spm", F.concat(tail(p), middle, head(s, p)))
            .otherwise(output))
