"""Language ID, language-model scores, extraction: brute force, held-out accuracy, odd rows."""

import math
import zlib
import time
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD, prose, result
from pyspark.sql import functions as F

from assaylake.llm import extraction, language, lm
from assaylake.llm.labelled_pages import PAGES

SF = "/root/testdata/sf0.01"


def held(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


# ---- language --------------------------------------------------------------------------------
def ppm_bits(samples: list[bytes], text: bytes) -> float:
    """Code length by the textbook recursion over dictionaries; bytes never seen share what is left of 256."""
    counts = [Counter(), {}, {}, {}]
    for s in samples:
        s = b"   " + s
        for i in range(3, len(s)):
            counts[0][s[i]] += 1
            for k in (1, 2, 3):
                counts[k].setdefault(s[i - k : i], Counter())[s[i]] += 1

    def spread(order, context):
        lower = [1 / 256] * 256 if order == 0 else spread(order - 1, context)
        c = counts[0] if order == 0 else counts[order].get(context[3 - order :], {})
        if not c:
            return lower
        total, rest = sum(c.values()), sum(lower[b] for b in range(256) if b not in c)
        escape = len(c) / (total + len(c)) / rest if rest > 0 else 0
        return [c[b] / (total + len(c) if rest > 0 else total) if b in c else lower[b] * escape for b in range(256)]

    t = b"   " + text
    return -sum(math.log2(spread(3, t[i - 3 : i])[t[i]]) for i in range(3, len(t)))


def test_code_lengths_follow_the_recursion():
    samples = {"x": [b"abab abc", b"bca"], "y": [b"xyz xyz"]}
    grams = {}
    for k, texts in samples.items():
        all_of = Counter()
        for s in texts:
            b = b"   " + s
            all_of.update(int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3))
        g = np.array(sorted(all_of), np.int64)
        grams[k] = (g, np.array([all_of[x] for x in g], float))
    trees = language.build_trees(grams, {"x": 2, "y": 1})
    for text in (b"abc", b"ab xyz", b"q", "é".encode()):
        bits = language.code_lengths(trees, text)
        for i, k in enumerate(trees.languages):
            assert bits[i] == pytest.approx(ppm_bits(samples[k], text), rel=1e-5)
    long = b"abc xyz " * 200_000
    half = language.code_lengths(trees, long[: len(long) // 2])
    assert language.code_lengths(trees, long) == pytest.approx(2 * half, rel=1e-3)


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = result(language.identify(docs))
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) for r in rows)
    assert np.mean([r["prediction"]["lang"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["prediction"]["score"] <= 1 for r in rows)
    moved = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert [r["prediction"] for r in result(language.identify(moved))] == [r["prediction"] for r in rows]


def test_language_of_odd_rows(make):
    docs = make([*ODD, *[prose(i, 40) for i in range(30)]], langs=[None if i % 7 == 0 else "en" for i in range(len(ODD) + 30)])
    rows = {r["doc_id"]: r["prediction"] for r in result(language.identify(docs))}
    for i, t in enumerate(ODD):
        assert (rows[i]["lang"] == "und") == (t is None or not any(c.isalpha() for c in t)), t
    assert language.identify(docs.limit(0)).count() == 0
    nothing = result(language.identify(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["prediction"]["lang"] for r in nothing} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(len(ODD), len(ODD) + 30))


def test_a_language_of_few_long_documents_is_learnt(make):
    long = [(k, prose(70 + k, 4000)) for k in range(3)]
    other = [(10 + k, "".join(chr(0x430 + (7 * k + j * j) % 32) if j % 6 else " " for j in range(400))) for k in range(60)]
    docs = make([*long, *other], langs=["xx"] * 3 + ["yy"] * 60)
    for bound in (0, 1, 50, 5000):
        trees = language.train(docs, train_bytes=bound)
        assert trees.languages == ["xx", "yy"]
        assert np.argmin(language.code_lengths(trees, prose(70, 300).encode())) == 0 and np.argmin(language.code_lengths(trees, other[0][1].encode())) == 1
    # contexts are ranked within a language, so a large one cannot push out those of a small one
    grams = {"big": (np.arange(0x61616161, 0x61616161 + 20), np.full(20, 1e6)), "small": (np.array([0x62626263]), np.array([1.0]))}
    trees = language.build_trees(grams, {"big": 1, "small": 1}, contexts=2)
    columns, (b, c) = round(len(trees.node) ** (1 / 3)), trees.symbol[[0x62, 0x63]]
    row = lambda *context: trees.node[(context[0] * columns + context[1]) * columns + context[2]]
    assert row(b, b, b) != row(columns - 1, b, b) and trees.bits[row(b, b, b) * columns + c, 1] <= 1


# ---- language model --------------------------------------------------------------------------
def test_scores_match_a_plain_count(make, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 40)
    texts = [*ODD, *[prose(i % 9, 60 + i) for i in range(40)], "Unseen-word here", "x " * 2000]
    docs = make([*texts, (5, "twice"), (5, "twice"), (None, "no id")])
    counts, totals = lm.count_corpus(docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2), common=60)
    assert 0 < len(totals.known) <= 60
    monkeypatch.setattr(lm, "count_corpus", lambda train, common=60: (counts, totals))
    got = result(lm.score(docs))
    lower = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = Counter()
    for i, t in rows:
        if held(i, 7) != 2:
            train.update([*lower(t), None])
    n, v = sum(train.values()), len(train)
    want = sorted(((i is None, i or 0), held(i, 7) == 2, len(lower(t)) + 1, sum(train[w] > 0 for w in [*lower(t), None]), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*lower(t), None]), 6)) for i, t in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert lm.score(docs.limit(0)).count() == 0


def test_probabilities_are_normalised_and_better_than_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = result(lm.score(docs))
    out = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    texts = [np.array([3, 4, 5] * 30 + [lm.END]), np.array([6, 3, 4] * 20 + [lm.END])]
    p = lm.train_nce(texts, 7, dim=8, epochs=30, noise=20, batch=32)
    model = lm.normalised(p, {})
    prob = np.exp(model.near[:, None, :] + model.far[None, :, :] - model.norm[:, :, None])
    assert prob.sum(2) == pytest.approx(np.ones((7, 7)), rel=1e-4)
    assert prob[3, 5, 4] > 0.6 > prob[3, 5, 6]


def test_model_learns_from_all_texts(make, monkeypatch):
    docs = make([prose(i, 80) for i in range(60)])
    _, totals = lm.count_corpus(docs)
    models = [lm.fit(docs, totals, shard_tokens=40) for _ in range(2)]  # 30 shards: two levels of sums
    assert {m.trained for m in models} == {lm.PASSES * totals.tokens} and lm.fit(docs, totals, passes=3).trained == 3 * totals.tokens
    assert np.array_equal(models[0].norm, models[1].norm)  # means in a fixed order
    # every text is learnt from as often at any size of the corpus
    huge = lm.Totals(1 << 40, totals.types, totals.ends, totals.cut, totals.known)
    assert lm.fit(docs, huge, shard_tokens=1 << 36).trained == lm.PASSES * totals.tokens
    # classes follow the vocabulary
    monkeypatch.setattr(lm, "CLASSES", 5)
    assert [len(lm.fit(docs, lm.Totals(totals.tokens, v, totals.ends, totals.cut, totals.known)).classes) for v in (16, 400)] == [6, 30]


def test_sums_of_parameters_take_several_levels(spark):
    rows = [(k, k + 1, np.array([k, 2.0 * k, 1.0]).tobytes()) for k in range(600) if k % 5]
    learnt = spark.createDataFrame(rows, "shard long, n long, blob binary").repartition(7)
    got = lm._added(learnt, 600).collect()
    assert 1 < len(got) <= lm.FAN and sum(r["n"] for r in got) == sum(n for _, n, _ in rows)
    assert sum(np.frombuffer(bytes(r["blob"])) for r in got).tolist() == sum(np.frombuffer(b) for _, _, b in rows).tolist()


def test_score_is_the_probability_that_the_parameters_give(make, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 30)
    monkeypatch.setattr(lm, "CLASSES_PER_ROOT", 0.1)
    docs = make([*ODD, *[prose(i % 5, 50 + i) for i in range(30)], "unseen words here"])
    kept, whole = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: kept.append(whole(*a, **k)) or kept[-1])
    got = {r["doc_id"]: r["score"] for r in result(lm.score(docs))}
    model, words = kept[0], lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    spelt = Counter(w for i, ws in rows if held(i, 7) != 2 for w in ws if w not in model.classes)
    last, before, target, bias = (x.astype(float) for x in (model.last, model.before, model.target, model.bias))
    for i, ws in rows:
        want, c2, c1 = 0.0, lm.START, lm.START
        for w in [*ws, None]:
            c = lm.END if w is None else model.classes.get(w, lm.OTHER)
            logits = target @ (last[c1] + before[c2]) + bias
            want += (logits[c] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if c == lm.OTHER:
                want += math.log10((spelt[w] + 1) / (sum(spelt.values()) + len(spelt) + 1))
            c2, c1 = c1, c
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3), i


def test_no_training_rows(make):
    ids = [i for i in range(200) if held(i, 7) == 2][:3]
    got = result(lm.score(make([(i, "some words") for i in ids])))
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3


# ---- extraction ------------------------------------------------------------------------------
def enumerate_marginals(dom, model):
    """All labellings, weighed one by one."""
    n = len(dom.parent)
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        x = [bits >> i & 1 for i in range(n)]
        s = sum(x[i] * sum(model.unary[f] for f in dom.features[i]) for i in range(n))
        s += sum(model.pair[2 * x[dom.parent[i]] + x[i]] for i in range(1, n))
        total += math.exp(s)
        on += math.exp(s) * np.array(x)
    return on / total


def test_messages_give_exact_marginals():
    model = extraction.fit(rounds=20)
    for page in PAGES:
        dom = extraction.parse(page)
        if len(dom.parent) > 14:
            continue
        odds, _ = extraction.marginals(dom, model)
        assert 1 / (1 + np.exp(-np.array(odds))) == pytest.approx(enumerate_marginals(dom, model), rel=1e-6)


def test_pages_left_out_of_training():
    right = total = 0
    for k in range(0, len(PAGES), 4):
        model = extraction.fit([p for i, p in enumerate(PAGES) if i not in range(k, k + 4)])
        for page in PAGES[k : k + 4]:
            dom = extraction.parse(page)
            odds, _ = extraction.marginals(dom, model)
            right += sum((odds[n] > 0) == bool(dom.label[n]) for n, _ in dom.blocks)
            total += len(dom.blocks)
    assert right / total > 0.85


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Big  &amp; small</h1><script>var t="</p>";</script><p><b>One &lt;two&gt;&nbsp;three<br>four<p>Fi<i>ve</i>
 six.<!-- no --></p><div class="ad">Buy now!</div><p>&#233;nd</p><section class="comments"><p>Nice one, thanks a lot for this.</p></section></article><form><p>Your name</p></form><footer>(c)</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(0, "u", PAGE, "old"), (1, "u", None, ""), (2, "u", "", ""), (3, "u", "<<p>>a</ <!-- x", ""), (4, "u", "<p>" * 3000 + "deep" + "</div>" * 5, ""), (0, "u", PAGE, "old"), (5, "u", "<script>x", "")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    assert got[0] == "Big & small\nOne <two> three four\nFive six.\nénd"
    assert got[1] == got[2] == got[5] == "" and got[4] in ("deep", "")
    assert extraction.extract(pages).count() == 7 and extraction.extract(pages.limit(0)).count() == 0


def test_articles_of_all_pages_are_whole(spark):
    import re
    from html import unescape

    wrong = 0
    for r in extraction.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        wrong += r["text"] != "\n".join(b for b in blocks if b)
    assert wrong == 0


ARTICLE = "<p>The council met on Monday and spoke about the old bridge for two hours.</p><p>It will be closed in spring, said the mayor, and opened again in autumn.</p>"
WANTED = "The council met on Monday and spoke about the old bridge for two hours.\nIt will be closed in spring, said the mayor, and opened again in autumn."


@pytest.mark.parametrize("page", [
    f"<html><body><nav><svg class='i'/><a href=/>Home</a></nav><article><svg class=\"i\"/>{ARTICLE}</article></body></html>",
    f"<html><body><nav><ul><li><a href=/>Home<li><a href=/x>News</ul></nav><article>{ARTICLE}</article></body></html>",
    f"<html><body><nav><a href=/>Home</nav><article>{ARTICLE}</article></body></html>",
    f"<html><body><article><noscript>{ARTICLE}</article></body></html>",
    f"<html><body><article><iframe src=x>{ARTICLE}</article></body></html>",
    f"<html><body><article><iframe src=x />{ARTICLE}</article></body></html>",
    f"<html><body><article>{ARTICLE}</article><script>var a = '<p>no</p>';</body></html>".replace("<p>no</p>", ""),
    f"<html><body><article><svg><title>Icon</title><path d='M0'/></svg>{ARTICLE}</article></body></html>",
    f"<html><body><article><div class=notice>We use cookies on this page, please accept them all.</div>{ARTICLE}<div class='notice'><p>Read the notice about our cookies first, and then the rest of it.</p></div></article></body></html>",
    f"<html><body><article data-x='a>b' title=\"it's\">{ARTICLE}</article></body></html>",
    f"<html><body><article x=\"unclosed>{ARTICLE}</article></body></html>",
])
def test_articles_survive_odd_markup(page):
    assert extraction.main_text(page, extraction.fit()) == WANTED


def test_formulas_stay_in_their_sentence():
    page = "<html><body><article><p>The area of the field is <math><mi>a</mi><mo>=</mo><mn>12</mn></math> square miles, as the map of the county shows.</p></article></body></html>"
    assert extraction.main_text(page, extraction.fit()) == "The area of the field is a=12 square miles, as the map of the county shows."


@pytest.mark.parametrize("page", ['<a ' + '"x" ' * 50_000, "<a " * 50_000, '<a b="' * 50_000, "<a b='" * 50_001, "<!" * 50_000, "</" * 50_000, "<script>" * 20_000, "<svg/>" * 20_000, "<a =\"'" * 30_000, "<" * 100_000, "<a " + '"' * 100_000])
def test_markup_is_read_in_linear_time(page):
    start = time.time()
    extraction.parse(page)
    assert time.time() - start < 3
