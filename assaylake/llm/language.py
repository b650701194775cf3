"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to three bytes predicts the next byte. A byte that a context has
not seen costs an escape, then the shorter context predicts it among the bytes not excluded. The statistics
are frozen after training, so the code length of every (context, byte) pair is a table and a text is scored
by two lookups a byte; the language with the shortest code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import crc_remainder, whole_text

#: Bytes of text per language from which on no more documents are drawn to learn from.
TRAIN_BYTES = 2_000_000
#: Contexts of three bytes that keep a row of their own: an equal share for each language, its most frequent ones.
CONTEXTS = 20_000
#: Steps of the hash order for each power of two; a language's draw ends with a whole step.
DRAW_STEPS = 64
UNKNOWN = "und"
PAD = b"   "
#: Bytes of a text scored at a time.
STEP = 1 << 20


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte -> column
    node: np.ndarray  # three columns, one after another -> row
    bits: np.ndarray  # row * columns + column -> code length per language
    prior: np.ndarray  # bits per language


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).cast(pa.binary())
        for lang in sorted(set(langs)):
            grams, size = [], 0

            def counted():
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

            for i in np.flatnonzero(langs == lang):
                padded = PAD + texts[int(i)].as_py()
                for at in range(0, len(padded) - len(PAD), STEP):
                    b = np.frombuffer(padded[at : at + STEP + len(PAD)], np.uint8).astype(np.int64)
                    grams.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
                    size += len(b)
                    if size > 4 * STEP:
                        yield counted()
                        grams, size = [], 0
            if grams:
                yield counted()


def _predict(counts: np.ndarray, lower: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Probabilities per byte of each column; ``width``: how many byte values a column stands for."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    seen = counts > 0
    open_mass = np.where(seen, 0, lower * width).sum(1, keepdims=True)
    escape = np.where(open_mass > 0, distinct / np.maximum(total + distinct, 1), 0)
    spread = np.maximum(np.where(open_mass > 0, total + distinct, total), 1)
    out = np.where(seen, counts / spread, lower * escape / np.maximum(open_mass, 1e-300))
    return np.where(total > 0, out, lower)


def build_trees(grams: dict[str, tuple[np.ndarray, np.ndarray]], documents: dict[str, int], contexts: int = CONTEXTS) -> ContextTrees:
    """From counts of four-byte runs per language."""
    languages = sorted(grams)
    every = np.concatenate([g for g, _ in grams.values()])
    used = np.unique(every & 255)
    symbol = np.full(256, len(used), np.int64)
    symbol[used] = np.arange(len(used))
    columns = len(used) + 1
    width = np.ones(columns)
    width[-1] = max(256 - len(used), 0)

    def context(g: np.ndarray, order: int) -> np.ndarray:
        code = np.zeros(len(g), np.int64)
        for k in range(order, 0, -1):
            code = code * columns + symbol[(g >> (8 * k)) & 255]
        return code

    # rows: the empty context, then the seen contexts of one, two and three bytes
    kept = [np.zeros(1, np.int64), *(np.unique(context(every, k)) for k in (1, 2))]
    frequent = []
    for g, n in grams.values():
        triple, where = np.unique(context(g, 3), return_inverse=True)
        frequent.append(triple[np.lexsort((triple, -np.bincount(where, n)))[:max(1, contexts // len(languages))]])
    kept.append(np.unique(np.concatenate(frequent)))
    starts = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
    table = np.empty((starts[-1], columns, len(languages)), np.float32)
    for at, lang in enumerate(languages):
        g, n = grams[lang]
        below = np.full((1, columns), 1 / 256)
        for order, codes in enumerate(kept):
            c = context(g, order)
            row = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            hit = codes[row] == c
            counts = np.zeros((len(codes), columns))
            np.add.at(counts, (row[hit], symbol[g[hit] & 255]), n[hit])
            parent = np.searchsorted(kept[order - 1], codes % columns ** (order - 1)) if order else np.zeros(1, np.int64)
            below = _predict(counts, below[parent], width)
            table[starts[order] : starts[order + 1], :, at] = -np.log2(np.maximum(below, 2.0**-60))
    node = np.zeros(columns**3, np.int32)
    codes = np.arange(columns**3)
    for order in (1, 2, 3):
        part = codes % columns**order
        row = np.minimum(np.searchsorted(kept[order], part), len(kept[order]) - 1)
        node = np.where(kept[order][row] == part, starts[order] + row, node).astype(np.int32)
    share = np.array([documents[x] for x in languages], float)
    return ContextTrees(languages, symbol, node, table.reshape(-1, len(languages)), -np.log2(share / share.sum()))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Frozen trees from labelled rows; rows with null text or label teach nothing. None without any labelled text.

    Documents of a language are drawn in the order of a hash of id and text until ``train_bytes`` are reached, one at
    least; drawn texts are read whole. The order is followed in steps, ``DRAW_STEPS`` for each power of two, and the step that
    reaches the bound is drawn whole. Equal rows have equal hashes, so they are drawn together or not at all. The driver gets
    one row per language and step that occurs (4096 steps at most) and the counts of distinct four-byte runs of that sample.
    """
    known = docs.select(F.lower(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h")).filter("text IS NOT NULL AND lang IS NOT NULL")
    known = known.withColumn("step", F.floor(F.log2((F.shiftrightunsigned("h", 1) + 1).cast("double")) * DRAW_STEPS))
    steps = known.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    documents: dict[str, int] = {}
    drawn_bytes: dict[str, int] = {}
    last: dict[str, int] = {}
    for r in sorted(steps, key=lambda r: (r["lang"], r["step"])):
        documents[r["lang"]] = documents.get(r["lang"], 0) + r["n"]
        if drawn_bytes.get(r["lang"], 0) < max(train_bytes, 1):
            drawn_bytes[r["lang"]] = drawn_bytes.get(r["lang"], 0) + r["size"]
            last[r["lang"]] = r["step"]
    if not any(drawn_bytes.values()):
        return None
    ends = docs.sparkSession.createDataFrame(sorted(last.items()), "known_lang string, last long")
    drawn = known.join(F.broadcast(ends), F.col("lang") == F.col("known_lang")).filter(F.col("step") <= F.col("last")).select("lang", "text")
    counted = drawn.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = {k: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.float64)) for k, part in counted.groupby("lang")}
    return build_trees(grams, documents)


def code_lengths(trees: ContextTrees, text: bytes) -> np.ndarray:
    """Bits of the text under each language."""
    columns = round(len(trees.node) ** (1 / 3))
    out = np.zeros(len(trees.languages))
    padded = PAD + text
    for at in range(0, len(text), STEP):
        part = padded[at : at + STEP + 3]
        s = trees.symbol[np.frombuffer(part, np.uint8)]
        rows = trees.node[(s[:-3] * columns + s[1:-2]) * columns + s[2:-1]].astype(np.int64)
        out += trees.bits[rows * columns + s[3:]].sum(0, dtype=np.float64)
    return out


def predict(text: Column, trees: ContextTrees | None, spark) -> Column:
    """``struct<lang, score, known>``. ``und`` and 0 where the text is null or has no letter.

    ``score`` is the posterior probability of the language, ``known`` whether the text codes shorter than its plain bytes. Ties go to the first language by name.
    """
    if trees is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("known"))
    shared = spark.sparkContext.broadcast(trees)

    @arrow_udf("struct<lang string, score double, known boolean>")
    def ppm(texts: pa.Array) -> pa.Array:
        t = shared.value
        lang, score, known = [], [], []
        for x in texts.cast(pa.binary()):
            if not x.is_valid:
                lang.append(UNKNOWN), score.append(0.0), known.append(False)
                continue
            b = x.as_py()
            bits = code_lengths(t, b)
            total = bits + t.prior
            best = int(np.argmin(total))
            lang.append(t.languages[best])
            score.append(float(1 / np.exp2(np.maximum(total[best] - total, -1000)).sum()))
            known.append(bool(bits[best] < 8 * len(b)))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], ["lang", "score", "known"])

    return ppm(F.when(text.rlike(r"\p{L}"), F.lower(text)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 5) -> DataFrame:
    """All columns, ``held_out`` (their label taught nothing), and ``prediction``.

    An empty table gives an empty one. Rows that repeat are predicted each, and all alike.
    """
    held = crc_remainder(id_col, held_out_of) == 0
    trees = train(docs.filter(~held), text_col, lang_col, id_col)
    return docs.withColumns({"held_out": held, "prediction": predict(F.col(text_col), trees, docs.sparkSession)})


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents with a language: some letter, and a code shorter than the plain bytes. Columns stay as they are."""
    trees = train(docs.filter(crc_remainder("doc_id", 5) != 0))
    p = predict(whole_text(), trees, docs.sparkSession)
    return docs.filter((p["lang"] != UNKNOWN) & p["known"])
