"""Small tests of what was mended in the third pass over the third review's findings."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from assaylake.functions import privacy as P
from assaylake.operators import similar as SM
from assaylake.plans import validation
from assaylake.sources.tables import Tables


def test_unlike_texts_do_not_meet_on_a_rare_token(spark, monkeypatch):
    """long sets that share a few rare tokens are no pair to verify; alike ones of any size ratio are all found."""
    rng, seen = random.Random(3), []
    real = SM.met_classes
    monkeypatch.setattr(SM, "met_classes", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    often = [f"w{i}" for i in range(3000)]
    sets = [set(rng.sample(often, rng.randrange(60, 140))) | {"rare1", "rare2"} for _ in range(40)]
    for s in sets[:20]:  # near copies: tokens lost, added and replaced, up to the border and beyond it
        gone = rng.randrange(0, len(s) // 4)
        sets.append(set(sorted(s)[gone:]))
        sets.append(s | {f"x{rng.random()}" for _ in range(rng.randrange(1, len(s) // 3))})
        sets.append(set(sorted(s)[gone // 2:]) | {f"y{rng.random()}" for _ in range(gone // 2)})
    sets += [{"rare1"}, {"rare1", "rare2"}, {"rare1", "rare2", "a", "b", "c"}, {"rare1", "rare2", "a", "b"}]
    rows = [(i, " ".join(sorted(s)).replace(".", "_")) for i, s in enumerate(sets)]
    toks = {i: frozenset(t.split()) for i, t in rows}
    cls = {i: min(j for j in toks if toks[j] == toks[i]) for i in toks}
    reps = sorted(set(cls.values()))
    want = {(a, b): len(toks[a] & toks[b]) / len(toks[a] | toks[b]) for a in reps for b in reps if a < b and 5 * len(toks[a] & toks[b]) >= 4 * len(toks[a] | toks[b])}
    members, links = SM.similar_texts(spark.createDataFrame(rows, "text_id bigint, text string"))
    assert {r.text_id: r.class_id for r in members.collect()} == cls
    assert {(r.a, r.b): r.similarity for r in links.collect()} == want and len(want) > 40
    rare = sum(5 * min(len(toks[a]), len(toks[b])) >= 4 * max(len(toks[a]), len(toks[b])) for a in reps for b in reps if a < b)
    assert seen[0].count() - len(want) < rare / 20  # all of these met before, on one of the two rare tokens


def test_documents_are_not_moved_for_their_batch(spark):
    """Runs are dealt out by batch before documents are made; finding duplicates in a batch deals out nothing more."""
    plan = validation.records(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Window") < plan.index("Exchange hashpartitioning")


def test_scan_holds_few_texts_of_a_batch(spark, monkeypatch):
    """a batch is scanned in slices, so few redacted texts stand in Python at once; the result is the same."""
    monkeypatch.setattr(P, "SLICE", 3)
    rows = [(i, [None, "", "plain", "mail a@b.example now", "sk-" + "a" * 20][i % 5]) for i in range(11)]
    df = spark.createDataFrame(rows, "i int, text string").coalesce(1).select("i", P.scan(F.col("text")).alias("s"))
    got = {r.i: (r.s.redacted, r.s.reasons) for r in df.collect()}
    assert got == {i: P.redacted_text(x) if x is not None else (None, []) for i, x in rows}
    texts = pa.array(["mail a@b.example now"] * 5)
    assert P._scanned_slice(texts.slice(3, 3), P.redacted_text).to_pylist() == [{"redacted": "mail [REDACTED:pii_email] now", "reasons": ["pii_email"]}] * 2
