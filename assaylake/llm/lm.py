"""Language-model scores: word counts over the whole corpus and a log-bilinear neural model.

The neural model predicts the next word class (the most frequent words, the end of a text, or "another word")
from the two words before it: the context vectors, each through the matrix of its position, are summed and
compared with the target vectors. It is trained in numpy with noise-contrastive estimation on all training
texts: tasks train on shards of them, and after each round their parameters are averaged. The number of
classes grows with the vocabulary. Because the context is a sum, the normaliser of every pair of context words
is one matrix product of exponentials, so all token probabilities are exactly normalised. Words outside the
classes are spelt out by their counts over all training documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import crc_remainder, free_name, frozen, whole_text

#: Words with a class of their own at least, and classes for each square root of the number of different words
#: (the normaliser of all pairs of classes so grows as the vocabulary).
CLASSES, CLASSES_PER_ROOT = 1500, 1.5
#: Words, the most frequent ones, whose counts every worker holds; the counts of all others are joined.
COMMON = 200_000
#: Training tokens, in expectation, between two averages of one shard's parameters, and those a task holds at once.
SHARD_TOKENS, CHUNK_TOKENS = 500_000, 1 << 18
#: Times every training text is learnt from, and averages of the parameters within a pass; the same at every size.
PASSES, PARTS = 1, 4
#: Parameters that a task adds up, and at most that many sums reach the driver in a round.
FAN = 16
#: Distinct words a counting task holds before it hands its counts on.
HELD_WORDS = 1_000_000
OTHER, END, START = 0, 1, 2
FIRST_WORD = 3


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()):
            held.update(t.as_py().lower().split())
            if len(held) > HELD_WORDS:
                yield emit()
                held.clear()
    if held:
        yield emit()


@dataclass
class Totals:
    """``known``: words and counts of the common words; ``cut``: words counted less often are looked up by a join."""

    tokens: int
    types: int
    ends: int
    cut: int
    known: dict[bytes, int]


def count_corpus(train: DataFrame, text_col: str = "text", common: int = COMMON) -> tuple[DataFrame, Totals]:
    """``(word, n)`` over all training texts, and what fits every worker.

    The cut is the lowest power of the eighth root of two that at most ``common`` words reach.
    """
    counts = frozen(train.select(whole_text(text_col).alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = train.count()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    held, step = 0, None
    for r in steps:  # one row for each eighth of a power of two
        held += r["words"]
        if held > common:
            break
        step = r["step"]
    cut = math.ceil(2 ** (step / 8) - 1e-9) if step is not None else 1 << 62
    known = {r["word"].encode(): r["n"] for r in counts.filter(F.col("n") >= cut).toLocalIterator()}
    words = sum(r["n"] for r in steps)
    types = sum(r["words"] for r in steps)
    return counts, Totals(words + ends, types + (ends > 0), ends, cut, known)


# ---- the neural model ------------------------------------------------------------------------
@dataclass
class LogBilinear:
    """``near[c, w] + far[c, w]`` are the unnormalised log scores after the last and the last but one word; ``norm`` their normaliser.

    ``trained``: tokens read in all rounds.
    """

    classes: dict[bytes, int]
    last: np.ndarray
    before: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    trained: int = 0

    @property
    def near(self) -> np.ndarray:
        return self.last @ self.target.T

    @property
    def far(self) -> np.ndarray:
        return self.before @ self.target.T + self.bias

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """Natural log probabilities of class ids in a text that ends with END."""
        c = np.concatenate(([START, START], ids))
        c1, c2 = c[1:-1], c[:-2]
        return np.einsum("ij,ij->i", self.last[c1] + self.before[c2], self.target[ids]) + self.bias[ids] - self.norm[c1, c2]


def unigram_of(counts: np.ndarray) -> np.ndarray:
    """The noise: class counts and one more, a start hardly ever."""
    unigram = counts + 1.0
    unigram[START] = 1e-3
    return unigram / unigram.sum()


def untrained(unigram: np.ndarray, dim: int = 32, seed: int = 11) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Parameters, and their sums of squared gradients."""
    rng, size = np.random.default_rng(seed), len(unigram)
    p = {
        "context": rng.normal(0, 0.1, (size, dim)), "target": rng.normal(0, 0.1, (size, dim)), "bias": np.log(unigram),
        "m1": np.eye(dim) * 0.5, "m2": np.eye(dim) * 0.5,
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return p, {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}


def nce_pass(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], texts: list[np.ndarray], unigram: np.ndarray, rng: np.random.Generator, noise: int = 200, batch: int = 2048, rate: float = 0.1) -> None:
    """One pass of Adagrad over all tokens of the texts, in place; the noise is shared in a batch."""
    ids = np.concatenate([np.concatenate(([START, START], t)) for t in texts])
    log_noise = np.log(unigram * noise).astype(np.float32)
    rate = np.float32(rate)

    def by_class(rows):
        order = np.argsort(rows.astype(np.uint16) if len(unigram) < 1 << 16 else rows, kind="stable")  # 16 bits sort by radix
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        return order, starts, rows[starts]

    def step(name, grad, rows=None):
        if rows is None:
            seen[name] += grad * grad
            p[name] -= rate * grad / np.sqrt(seen[name])
            return
        order, starts, uniq = rows
        total = np.add.reduceat(grad[order], starts, axis=0)
        now = seen[name][uniq] + total * total
        seen[name][uniq] = now
        p[name][uniq] -= rate * total / np.sqrt(now)

    order = rng.permutation(np.flatnonzero(ids != START))
    ladder = np.cumsum(unigram)
    draws = np.minimum(np.searchsorted(ladder, rng.random((-(-len(order) // batch), noise)) * ladder[-1], side="right"), len(unigram) - 1)
    for k in range(0, len(order), batch):
        i = order[k : k + batch]
        w, c1, c2, z = ids[i], ids[i - 1], ids[i - 2], draws[k // batch]
        r1, r2 = p["context"][c1], p["context"][c2]
        r = r1 @ p["m1"] + r2 @ p["m2"]
        t, n = p["target"][w], p["target"][z]
        # d loss / d score: P(noise | data word) with a minus sign, P(data | noise word)
        m = np.float32(len(i))
        gt = -1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", r, t) + p["bias"][w] - log_noise[w], 80))) / m
        gn = r @ n.T
        gn += p["bias"][z] - log_noise[z]
        np.negative(gn, gn)
        np.minimum(gn, 80, gn)
        np.exp(gn, gn)
        gn += 1
        np.divide(1 / m, gn, gn)
        gr = gt[:, None] * t + gn @ n
        words = by_class(np.concatenate((w, z)))
        step("target", np.concatenate((gt[:, None] * r, gn.T @ r)), words)
        step("bias", np.concatenate((gt, gn.sum(0))), words)
        step("context", np.concatenate((gr @ p["m1"].T, gr @ p["m2"].T)), by_class(np.concatenate((c1, c2))))
        step("m1", r1.T @ gr)
        step("m2", r2.T @ gr)


def train_nce(texts: list[np.ndarray], size: int, dim: int = 32, epochs: int = 4, noise: int = 200, batch: int = 2048, rate: float = 0.1, seed: int = 11):
    """Embeddings and biases by noise-contrastive estimation with Adagrad, of texts in memory; the noise is the unigram distribution."""
    unigram = unigram_of(np.bincount(np.concatenate(texts), minlength=size))
    p, seen = untrained(unigram, dim, seed)
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        nce_pass(p, seen, texts, unigram, rng, noise, batch, rate)
    return p


def normalised(p: dict[str, np.ndarray], classes: dict[bytes, int], block: int = 512) -> LogBilinear:
    """The log normaliser of every pair of context words from matrix products, a block of last words at a time."""
    bias = p["bias"].copy()
    bias[START] = -1e4  # a start is never predicted
    last, before, target = p["context"] @ p["m1"], p["context"] @ p["m2"], p["target"]
    far = before @ target.T + bias
    b = far.max(1, keepdims=True)
    far -= b
    np.exp(far, far)
    norm = np.empty((len(bias), len(bias)), np.float32)
    for k in range(0, len(bias), block):
        near = last[k : k + block] @ target.T
        a = near.max(1, keepdims=True)
        total = np.exp(near - a) @ far.T
        for i, j in zip(*np.nonzero(total < 1e-25), strict=True):  # their largest terms lie far apart
            x = (last[k + i] + before[j]).astype(np.float64) @ target.T + bias
            norm[k + i, j] = x.max() + math.log(np.exp(x - x.max()).sum())
        usual = total >= 1e-25
        norm[k : k + block][usual] = (np.log(np.maximum(total, 1e-25)) + a + b.T)[usual]
    return LogBilinear(classes, last, before, target, bias, norm)


def _class_ids(index: dict[bytes, int], kind: type):
    def run(batches):
        for batch in batches:
            rows = [np.array([*(index.get(w, OTHER) for w in t.as_py().lower().split()), END], kind).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["mark", "ids"])

    return run


def _flat(p: dict[str, np.ndarray], seen: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x[k].ravel() for x in (p, seen) for k in sorted(x)])


def _shaped(flat: np.ndarray, like: tuple[dict, dict]) -> tuple[dict, dict]:
    out, at = ({}, {}), 0
    for x, y in zip(like, out, strict=True):
        for k in sorted(x):
            y[k] = flat[at : at + x[k].size].reshape(x[k].shape).astype(np.float32)
            at += x[k].size
    return out


def _train_shards(shared, unigram: np.ndarray, kind: type, turn: int, chunk: int):
    """Rows come sorted by shard. A shard starts from the shared parameters and gives its own, times its tokens."""

    def run(batches):
        now, held, size, tokens, state, rng = None, [], 0, 0, None, None

        def learn():
            nonlocal held, size, tokens
            if held:
                nce_pass(*state, held, unigram, rng)
                tokens += size
                held, size = [], 0

        def emit():
            learn()
            blob = (_flat(*state).astype(np.float64) * tokens).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([tokens], pa.int64()), pa.array([blob], pa.binary())], ["shard", "n", "blob"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        yield emit()
                    now, tokens = shard, 0
                    state, rng = tuple({k: v.copy() for k, v in x.items()} for x in shared.value), np.random.default_rng((turn, shard))
                text = np.frombuffer(ids.as_buffer(), kind).astype(np.int64)
                held.append(text)
                size += len(text)
                if size >= chunk:
                    learn()
        if now is not None:
            yield emit()

    return run


def _sum_shards(batches):
    """One row a group from rows sorted by group and shard."""
    now, n, total = None, 0, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "blob"])
    for batch in batches:
        for part, tokens, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if part != now:
                if now is not None:
                    yield row()
                now, n, total = part, 0, 0.0
            n, total = n + tokens, total + np.frombuffer(blob.as_buffer())
    if now is not None:
        yield row()


def _added(learnt: DataFrame, shards: int) -> DataFrame:
    """``(part, n, blob)``, at most ``FAN`` rows: sums of ``(shard, n, blob)`` in a fixed order, ``FAN`` by ``FAN``."""
    sums, groups = learnt.withColumnRenamed("shard", "part"), shards
    while True:
        groups = -(-groups // FAN)
        rows = sums.select((F.col("part") % groups).alias("part"), F.col("part").alias("from_part"), "n", "blob").repartition(groups, "part").sortWithinPartitions("part", "from_part")
        sums = rows.select("part", "n", "blob").mapInArrow(_sum_shards, "part long, n long, blob binary")
        if groups <= FAN:
            return sums


def fit(train: DataFrame, totals: Totals, text_col: str = "text", id_col: str = "doc_id", classes: int | None = None, shard_tokens: int | None = None, passes: int | None = None) -> LogBilinear | None:
    """The neural model from all training texts; None without training texts.

    A hash of id and text deals the texts to shards and to the parts of a pass. In a round each shard's texts of one part
    are learnt from the same parameters, and the mean by tokens of what the shards learnt starts the next round. The means are
    added up as a tree of ``FAN`` branches, so no task reads more than that many sets of parameters.
    """
    if not totals.ends:
        return None
    if classes is None:
        classes = max(CLASSES, math.ceil(CLASSES_PER_ROOT * math.sqrt(totals.types)))
    top = sorted(totals.known.items(), key=lambda x: (-x[1], x[0]))[:classes]
    index = {w: FIRST_WORD + i for i, (w, _) in enumerate(top)}
    size = FIRST_WORD + len(index)
    kind = np.int16 if size < 1 << 15 else np.int32
    counts = np.array([0, totals.ends, 0, *(n for _, n in top)], np.float64)
    counts[OTHER] = totals.tokens - counts.sum()
    unigram = unigram_of(counts)
    shards = max(1, round(totals.tokens / (PARTS * (shard_tokens or SHARD_TOKENS))))
    marked = train.select(F.xxhash64(id_col, text_col).alias("mark"), whole_text(text_col).alias("text")).mapInArrow(_class_ids(index, kind), "mark long, ids binary")
    dealt = marked.select(F.pmod("mark", F.lit(shards)).alias("shard"), F.pmod(F.shiftright("mark", 40), F.lit(PARTS)).alias("slice"), "mark", "ids")
    dealt = frozen(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "mark", "ids"), "lm-ids")
    state, trained, context = untrained(unigram), 0, train.sparkSession.sparkContext
    for turn in range((passes or PASSES) * PARTS):
        shared = context.broadcast(state)
        learnt = dealt.filter(F.col("slice") == turn % PARTS).select("shard", "ids").mapInArrow(_train_shards(shared, unigram, kind, turn, CHUNK_TOKENS), "shard long, n long, blob binary")
        rows = sorted(_added(learnt, shards).collect(), key=lambda r: r["part"])
        if rows:
            tokens = sum(r["n"] for r in rows)
            state, trained = _shaped(sum(np.frombuffer(bytes(r["blob"])) for r in rows) / tokens, state), trained + tokens
        shared.unpersist()
    return replace(normalised(state[0], index), trained=trained)


# ---- scores ----------------------------------------------------------------------------------
_SCORED = "n_tokens long, n_known long, base_sum double, class_sum double, other_sum double, others long, rare array<struct<word:string,n:long>>"


def _scorer(shared):
    def run(batches):
        totals, model = shared.value
        known = totals.known
        logs = {w: math.log10(c + 1) for w, c in known.items()}
        classes = model.classes if model else {}
        class_logs = [0.0] * (FIRST_WORD + len(classes))
        for w, i in classes.items():
            class_logs[i] = logs[w]
        end_log = math.log10(totals.ends + 1)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_known", "base_sum", "class_sum", "other_sum", "others", "rare")}
            for t in batch.column(batch.num_columns - 1).cast(pa.binary()):
                words = t.as_py().lower().split()
                ids = np.fromiter((classes.get(w, OTHER) for w in words), np.int64, len(words))
                spelt = [words[i] for i in np.flatnonzero(ids == OTHER)]
                rare = Counter(w for w in spelt if w not in logs)
                other_sum = math.fsum(logs[w] for w in spelt if w in logs)
                uses = np.bincount(ids, minlength=len(class_logs))
                uses[OTHER] = 0
                n_rare = sum(rare.values())
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(words) - n_rare + (totals.ends > 0))
                out["base_sum"].append(float(uses @ np.array(class_logs)) + other_sum + end_log)
                out["class_sum"].append(float(model.log_probs(np.append(ids, END)).sum(dtype=np.float64)) / math.log(10) if model else 0.0)
                out["other_sum"].append(other_sum)
                out["others"].append(len(spelt))
                out["rare"].append([{"word": w.decode(), "n": n} for w, n in rare.items()])
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "others": pa.int64(), "rare": pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(v, types.get(k, pa.float64())) for k, v in out.items())], [*batch.schema.names[:-1], *out])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` adds the neural model's log probabilities of the word classes; a word outside the classes adds to that of
    "another word" its share of all counts outside them, whatever stands before it.

    Null and empty texts are one end token. Repeated rows are scored each. Without training rows every token
    is unknown and the model is the counts alone. Words outside the common ones meet the full count table by
    a join on (word, text) counts, so no word is left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_remainder(id_col, held_out_of) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.filter("NOT held_out")
    counts, totals = count_corpus(train)
    model = fit(train, totals)
    shared = docs.sparkSession.sparkContext.broadcast((totals, model))
    key, id_type = free_name(rows, "row_no"), rows.schema["doc_id"].dataType.simpleString()
    scored = frozen(
        rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias(key), whole_text().alias("text"))
        .mapInArrow(_scorer(shared), f"doc_id {id_type}, held_out boolean, {key} long, {_SCORED}"), "lm-rows")
    rare = scored.select(key, F.explode("rare").alias("r")).select(key, "r.word", F.col("r.n").alias("uses"))
    found = rare.join(counts.filter(F.col("n") < totals.cut), "word")
    added = found.groupBy(key).agg(F.sum("uses").alias("rare_known"), F.sum(F.col("uses") * F.log10(F.col("n") + 1)).alias("rare_sum"))
    in_classes = sum(totals.known[w] for w in model.classes) if model else 0
    log_base = math.log10(totals.tokens + totals.types + 1)
    spelt_tokens, spelt_types = totals.tokens - totals.ends - in_classes, totals.types - (totals.ends > 0) - (len(model.classes) if model else 0)
    log_spelt = math.log10(spelt_tokens + spelt_types + 1)
    more = F.coalesce("rare_sum", F.lit(0.0))
    base = F.col("base_sum") + more - F.col("n_tokens") * F.lit(log_base)
    neural = F.col("class_sum") + F.col("other_sum") + more - F.col("others") * F.lit(log_spelt)
    return scored.drop("rare").join(added, key, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (neural if model else base).alias("score"))
