"""SimHash, line dedup, packing and the pipeline: brute force on small tables, odd rows, hot groups."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from odd_rows import ODD, prose, result
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaylake.llm import common, lines, packing, simhash
from assaylake.llm.queries import pack_documents

SF = "/root/testdata/sf0.001"


# ---- SimHash ---------------------------------------------------------------------------------
def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components(make):
    base = prose(1, 400)
    near = [base.replace(base.split()[k], "changed", 1) for k in range(0, 60, 3)]
    docs = make([*ODD, base, base.upper(), *near, *[prose(i, 30) for i in range(2, 40)], "one two", "k " * 70_000, (3, "again"), (3, "again")])
    got = result(simhash.near_groups(docs))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = sorted({r["fp"] & (2**64 - 1) for r in got})
    for r in got:
        if r["doc_id"] != 3:
            assert r["fp"] & (2**64 - 1) == fingerprint(text[r["doc_id"]])
    root = components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    low = defaultdict(lambda: 10**9)
    for r in got:
        k = root[r["fp"] & (2**64 - 1)]
        low[k] = min(low[k], r["doc_id"])
    assert all(r["component_id"] == low[root[r["fp"] & (2**64 - 1)]] for r in got)
    assert {r["fp"] for r in got if text[r["doc_id"]] is None} == {0}
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({r["component_id"] for r in got})
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [3, 4096])
def test_links_of_crowded_fingerprints(spark, bucket):
    """Small buckets send nearly all rows through the second split; the components stay those of all pairs."""
    r = random.Random(bucket)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:6]:
        for _ in range(25):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps |= {(7 << 32) | i for i in range(60)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    links = simhash.near_links(df, bucket=bucket)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in links.collect())
    got = {row["node"]: row["root"] for row in common.connected(links).collect()}
    want = components(sorted(signed), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.connected(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert common.connected(edges.limit(0)).count() == 0


# ---- lines -----------------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, s, edits):
    s = list(s)
    for _ in range(edits):
        k = r.randrange(len(s) or 1)
        if not s:
            break
        kind = r.randrange(3)
        s[k : k + 1] = [] if kind == 0 else [r.choice("abé ")] if kind == 1 else [s[k], r.choice("abé ")]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_banded_distance(edits):
    r = random.Random(edits)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        b = changed(r, a, r.randint(0, edits + 2)) if a and r.random() < 0.8 else "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        assert lines.within(a, b, edits) == (distance(a, b) <= edits), (a, b)


def test_probes_reach_every_near_line():
    r = random.Random(5)
    for edits in (1, 2, 3):
        for _ in range(1500):
            a = "".join(r.choice("abc") for _ in range(r.randint(6, 20)))
            b = changed(r, a, r.randint(0, edits))
            short, long = sorted((a, b), key=len)
            if distance(a, b) > edits or len(short) <= edits:
                continue
            filed = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(lines.segments(len(short), edits))}
            assert filed & {(length, i, long[p : p + n]) for length, i, p, n in lines.probe_places(len(long), edits, 1)}


def plain_line_dedup(rows, limits=lines.LIMITS):
    places = [(i, k, t.strip(lines.MARGIN)) for i, text in rows for k, t in enumerate((text or "").split("\n"))]
    places = [p for p in places if p[2]]
    first = {}
    for i, k, t in places:
        first[t] = min(first.get(t, (i, k)), (i, k))
    edits = lambda u, t: max([e for n, e in limits if min(len(u), len(t)) >= n], default=0)
    near = {t for t in first if any(u != t and first[u] < first[t] and abs(len(u) - len(t)) <= edits(u, t) and distance(u, t) <= edits(u, t) for u in first)}
    gone = defaultdict(set)
    for i, k, t in places:
        if t in near or (i, k) != first[t]:
            gone[i].add(k)
    return {i: sorted(x) for i, x in gone.items()}


@pytest.mark.parametrize("bucket", [2, 64])
def test_line_dedup(make, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    r = random.Random(3)
    stock = [prose(i, 12) for i in range(12)] + ["A page of many pages that all look very much alike, number %d" % i for i in range(15)]
    texts = [*ODD]
    for _ in range(40):
        texts.append("\n".join([r.choice(stock) if r.random() < 0.5 else changed(r, r.choice(stock), r.randint(0, 4)) for _ in range(r.randint(1, 5))] + [prose(r.randrange(10**6), 9), "short"]))
    docs = make(texts)
    got = {row["doc_id"]: row["lines"] for row in lines.repeated_lines(docs).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)))
    left = {row["doc_id"]: row["text"] for row in lines.drop_lines(docs).collect()}
    for i, t in enumerate(texts):
        assert left[i] == (t if i not in got else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i]))
    assert lines.drop_lines(docs).columns == docs.columns and lines.drop_lines(docs.limit(0)).count() == 0


def test_keys_reach_across_the_limits():
    r = random.Random(9)
    limits = ((4, 1), (8, 2), (14, 3))
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randint(3, 18)))
        b = changed(r, a, r.randint(0, 3))
        short, long = sorted((a, b), key=len)
        edits = lines.allowed(len(short), limits)
        if not edits or distance(a, b) > edits:
            continue
        keys = [{(n, i, t[p : p + size], e) for n, i, p, size, e, probe in lines.key_plan(len(t), limits) if not (filed and probe)} for t, filed in ((short, True), (long, False))]
        assert keys[0] & keys[1], (a, b)


@pytest.mark.parametrize("bucket", [2, 64])
def test_edits_follow_the_length(make, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    monkeypatch.setattr(lines, "BLOCK", 5)
    r = random.Random(4)
    stock = [prose(i, n)[:length] for i, (n, length) in enumerate([(9, 19), (9, 20), (9, 21), (9, 39), (9, 40), (9, 41), (90, 399), (90, 400), (90, 401)])]
    texts = ["\n".join(changed(r, t, r.randint(0, 4)) for t in stock) for _ in range(9)]
    got = {row["doc_id"]: row["lines"] for row in lines.repeated_lines(make(texts)).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)))
    notice = "Read our terms of use."
    kept = {row["doc_id"]: row["text"] for row in lines.drop_lines(make([notice, notice.replace("R", "B"), "Page 1", "Page 2"])).collect()}
    assert kept == {0: notice, 1: "", 2: "Page 1", 3: "Page 2"}


def test_full_keys_split(spark, make, monkeypatch):
    orders = [f"the order with number {i * 7919 % 100_000} was shipped to the customer on day {i % 97}" for i in range(400)]
    kind = "key long, h1 long, h2 long, text string, place long"
    full = spark.createDataFrame([(2, i, i, t, i) for i, t in enumerate(orders)], kind)
    split = full.mapInArrow(lines._by_parity, "key long, piece long, h1 long, h2 long, text string, mark long, place long")
    sizes = split.groupBy("piece").count().collect()
    assert all(sum(r["piece"] >> 48 == k for r in sizes) > 1 for k in range(5))
    # no group of two blocks holds much more than two limits, and every two lines of a group meet
    groups = defaultdict(set)
    for r in lines._in_blocks(split, 20).collect():
        groups[r["piece"], r["low"], r["high"]].add(r["h1"])
    assert max(map(len, groups.values())) < 80
    meet = {(piece, *pair) for (piece, _, _), g in groups.items() for pair in combinations(sorted(g), 2)}
    whole = defaultdict(set)
    for r in split.collect():
        whole[r["piece"]].add(r["h1"])
    assert meet == {(piece, *pair) for piece, g in whole.items() for pair in combinations(sorted(g), 2)}
    monkeypatch.setattr(lines, "BUCKET", 2)
    monkeypatch.setattr(lines, "BLOCK", 6)
    docs = make(orders[:120])
    got = {row["doc_id"]: row["lines"] for row in lines.repeated_lines(docs).collect()}
    assert got == plain_line_dedup(list(enumerate(orders[:120]))) and got


def test_line_dedup_of_repeated_rows(make):
    long = prose(8, 20)
    docs = make([(1, f"{long}\nx"), (1, f"{long}\nx"), (None, long + "!"), (2, long)])
    got = {row["doc_id"]: (row["lines"], row["near"]) for row in lines.repeated_lines(docs).collect()}
    assert got == {1: ([0], 1), 2: ([0], 0)}


# ---- packing ---------------------------------------------------------------------------------
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, texts):
    tok = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want.append((i, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 4096
    return len(bins), sum(x[3] for x in want)


def test_packing_round_trip(make, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = [*ODD, *[prose(i, 5 + 37 * i % 900) for i in range(60)], prose(1, 9000), "Ünï ﬁ ½ x y  z 漢字かな 👍🏽 <|endoftext|> don't I'LL Á e\x85f\x1cg"] + ["same"] * 30
    docs = make([*texts, (4, "twice"), (4, "twice")])
    bins, tokens = check_packing(pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= -(-tokens // 4096) + 1
    assert pack_documents(docs.limit(0)).count() == 0


def test_packing_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bins, tokens = check_packing(pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins == -(-tokens // 4096)


def test_plan_packs_every_count_once():
    r = random.Random(2)
    counts = {r.randint(1, 4096): r.randint(1, 1000) for _ in range(300)}
    plan = packing.best_two_fit(counts)
    packed = defaultdict(int)
    for times, members in plan:
        assert sum(members) <= 4096
        for m in members:
            packed[m] += times
    assert dict(packed) == counts
    # the greedy fill leaves 6 + 3; two of two and of three fit the gap of the three better
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


# ---- pipeline --------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}, name
        docs = common.frozen(out, "test")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[0] and sizes[-1] < sizes[0]
    by_stages = P.STAGES[-1][1](spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(by_stages.select(*key).collect()) == sorted(P.run(spark, SF).select(*key).collect())
    check_packing(by_stages.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_row_ids_need_not_be_unique_or_present(make):
    docs = make([(None, prose(1, 50)), (None, prose(1, 50)), (2, prose(1, 50)), (2, prose(2, 50))])
    left = simhash.drop_near_copies(docs)
    assert left.filter(F.col("doc_id").isNull()).count() == 2 and left.filter("doc_id = 2").count() == 1
