"""Fill-in-the-middle, spelling variants and chat formatting: brute force, exact round trips, SQL, odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD, prose, result
from test_native import by_sql, same

from assaylake.llm import chat, fim, spelling, sql
from assaylake.llm.common import frozen
from assaylake.llm.queries import op11_fill_in_middle, op12_spelling_variants, op13_chat_format

SF = "/root/testdata/sf0.001"


# ---- fill in the middle ----------------------------------------------------------------------
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = ["a <P> b", "<S>", "x<M", "<<S>>", "one two <", "P> <P", "tail \n\n", "漢 字\u0085\u2028 x 😀 y", " \t lead"]


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_unit_tree(block):
    r = random.Random(block)
    for _ in range(400):
        text = "".join(r.choice("ab é\n 漢😀\x85 \t") for _ in range(r.randint(0, 50)))
        units, tree = UNITS.findall(text), fim.UnitTree(text.encode(), block)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_fill_in_middle(make):
    texts = ODD + MARKED + [prose(i, 40 + i) for i in range(60)] + ["w " * 200_000 + "é" * 50_000]
    docs = make(texts + [(3, "again and again"), (3, "again and again"), (None, "no id at all")])
    made = fim.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim"] and fim.fill_in_middle(made).columns[-1] == "fim_"
    rows = made.select("doc_id", "text", "fim.*", fim.restore(made["fim.output"], made["fim.form"]).alias("back")).collect()
    seen = Counter()
    for x in rows:
        text, key = x["text"] or "", "" if x["doc_id"] is None else x["doc_id"]
        units = UNITS.findall(text)
        h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (x["n"], x["form"], x["output"], x["back"]) == (len(units), form, want, text)
        assert (x["prefix_chars"], x["middle_chars"]) == ((None, None) if form == "plain" else (len(pre), len(mid)))
        seen[form] += 1
    assert min(seen[f] for f in ("plain", "psm", "spm")) > 2 and len(rows) == docs.count()
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    for marks in (("", "b", "c"), ("ab", "bc", "d"), ("x", "x", "y"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=marks)


def test_fill_in_middle_other_marks(make):
    docs = make([prose(i, 30) for i in range(40)])
    made = fim.fill_in_middle(docs, rate=100, suffix_first=50, seed=7, marks=("[pre]", "[suf]", "[mid]"))
    rows = made.select("text", "fim.form", fim.restore(made["fim.output"], made["fim.form"], ("[pre]", "[suf]", "[mid]")).alias("back")).collect()
    assert all(x["back"] == x["text"] for x in rows) and {x["form"] for x in rows} == {"psm", "spm"}


def test_fill_in_middle_sql(spark, make, monkeypatch):
    docs = make(ODD + MARKED + [prose(i, 25) for i in range(30)])
    from assaylake.sources import tables
    monkeypatch.setattr(tables.Tables, "__getattr__", lambda self, name: docs)
    same(result(op11_fill_in_middle(spark, "")), by_sql(sql.FIM, documents=docs), "doc_id")


# ---- chat ------------------------------------------------------------------------------------
PARTS = ["\\", "</turn>", "### Assistant: ", "### User: ", "### Role", "\n", "a", "</tu", "rn>", "###", " ", "#", '"', ":", "é"]


def test_turns_read_back():
    r = random.Random(5)
    roles = ["user", "assistant", "system", None, "", 'to"ol\\', "x\n</turn>\n### User: ", "Role", "User"]
    for _ in range(5000):
        turns = [(r.choice(roles), "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))) for _ in range(3)]
        made = [chat.render_turn(*t) for t in turns]
        assert chat.parse("".join(m[0] for m in made)) == turns
        for (_, text), (out, begin, end, rounds) in zip(turns, made, strict=True):
            assert chat.unescape(out[begin:end]) == text and (rounds > 0) == bool(re.search(r"</turn>|### (System: |User: |Assistant: |Role)", text))
    for broken in ("### User: x", "x", "### User: x\n</turn>", "### User: </turn> \n</turn>\n", "### User: ### User: \n</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(broken)


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("\\" * 500_000, "#" * 500_000, "### Role \"" * 50_000, "</turn>" * 100_000, '\\"' * 200_000):
        assert chat.parse(chat.render_turn(text, text)[0]) == [(text, text)]
    assert time.time() - start < 20


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, made int").repartition(4)


def test_chat_against_sql(spark, monkeypatch):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, 'a"b\\']), r.choice([None, "", prose(c * 50 + t, 20), "".join(r.choices(PARTS, k=9))]), "f", 1) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} \\</turn>", "f", 1) for t in range(3000)]  # one conversation holds most rows
    rows += [(51, 0, "assistant", "é" * 100_000 + "\n</turn>\n", "f", 1), (52, 1, "assistant", "same", "f", 1), (52, 1, "assistant", "same", "f", 1), (52, 1, "user", "same", "f", 1)]
    given = conversations(spark, rows)
    from assaylake.sources import tables
    monkeypatch.setattr(tables.Tables, "__getattr__", lambda self, name: given)
    got = result(op13_chat_format(spark, ""), "conv_id")
    same(got, by_sql(sql.CHAT, conversations=given.select("conv_id", "turn", "role", "text")), "conv_id")
    odd = next(x for x in got if x["conv_id"] == -7)
    text = "\\### Assistant: </turn> ok"
    assert odd["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and odd["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and odd["loss_chars"] == len(text)
    empty = chat.read_back(chat.format_turns(given.limit(0)))
    assert empty.count() == 0
    nulls = conversations(spark, [(None, 3, "assistant", "x", "f", 1), (None, None, None, None, "f", 1), (7, 0, "user", "y", "f", 1)])
    read = {x["conv_id"]: x for x in chat.read_back(chat.format_turns(nulls)).collect()}
    assert read[None]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nx\n").hexdigest() and read[None]["loss_chars"] == 1 and read[7]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_chat_other_columns(spark):
    df = spark.createDataFrame([("a", 1, "bot", "hi", 1), ("a", 0, "user", "</turn>", 2)], "cid string, pos int, who string, said string, conv_id int")
    turns = chat.format_turns(df, "cid", "pos", "who", "said", loss_roles=("bot",))
    whole = "".join(x["formatted"] for x in sorted(turns.collect(), key=lambda x: x["turn"]))
    assert chat.parse(whole) == [("user", "</turn>"), ("bot", "hi")]
    assert chat.read_back(turns).first()["loss_chars"] == 2


# ---- spelling --------------------------------------------------------------------------------
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants(counts, ratio=10):
    """Brute force: pairs by deletion sets, forms, roots."""
    ball = defaultdict(set)
    for w in counts:
        for k in range(len(w) + 1):
            ball[w[:k] + w[k + 1 :]].add(w)
    out = {}
    for w, n in counts.items():
        close = {x for k in range(len(w) + 1) for x in ball[w[:k] + w[k + 1 :]] if near(w, x)}
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= ratio * n else None, n, len(close)]
    rows = []
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append({"word": w, "form": form, "root": root, "n": n, "n_near": n_near, "form_n": counts[form] if form else None})
    return sorted(rows, key=lambda x: x["word"])


def vocabulary(rows, least=7, often=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


@pytest.mark.parametrize("seed", range(6))
def test_block_against_all_pairs(seed):
    r = random.Random(seed)
    for _ in range(8):
        letters = r.choice(["ab", "abc", "abcdefgh", "aé漢😀"])
        words = {"".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(r.randint(1, 120))} | {"a" * k for k in range(2, 12)}
        n = {w: r.randint(1, 4) for w in words}
        got = {}
        for side in (0, 1):
            for x in spelling.Block(n, side).ask(sorted(words)).to_pylist():
                total, best = got.get(x["word"], (0, (1, "")))
                got[x["word"]] = (total + x["n_near"], min(best, (-x["form_n"], x["form"])))
        for w in words:
            close = [(-n[x], x) for x in words if near(w, x)]
            assert got.get(w) == ((len(close), min(close)) if close else None)


def test_suffix_order():
    import numpy as np
    r = np.random.default_rng(3)
    for text in (r.integers(0, 3, 300), np.zeros(200, int), np.tile([0, 1, 1, 2], 60), r.integers(0, 5000, 400)):
        text = text.astype(np.int32)
        order = spelling.suffix_array(text, int(text.max()) + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("block", [3, 25, 50_000])
def test_variants_of_crowded_words(spark, block):
    """Small blocks send words through whole halves and cut indexes; the result stays that of all pairs."""
    r = random.Random(block)
    counts = {}
    for stem in ("aaaaaaa", "abcabca", "zebraes", "ééééééé"):
        for _ in range(60):
            w = list(stem)
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = r.choice(["a", "b", "é", "aa"])
            if len(w) >= 7:
                counts["".join(w)] = r.choice([2, 3, 20, 30, 200, 300, 3000])
    counts |= {"a" * k: 2 * 10 ** (k % 5) for k in range(7, 40)} | {"x" * 3000: 2, "x" * 2999: 40}
    words = frozen(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), "words")
    got = result(spelling.variant_groups(words, block=block, share=40, asked=16), "n")
    assert sorted(got, key=lambda x: x["word"]) == variants(counts)
    assert spelling.variant_groups(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(words, 1)


def test_spelling_variants(make):
    base = [prose(i, 300, 80) for i in range(30)]
    docs = make(ODD + base + [b.upper() for b in base[:3]] + ["Wörterbuch wörterbuch WÖRTERBUCH " * 40] * 3 + ["wörterbch wörterbch"] + [(3, base[0]), (3, base[0]), (None, base[1]), (None, base[1])])
    got = result(spelling.spelling_variants(docs), "n")
    want = variants(vocabulary([(x["doc_id"], x["text"]) for x in docs.collect()]))
    assert sorted(got, key=lambda x: x["word"]) == want and any(x["form"] for x in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_query_on_the_given_table(spark):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(op12_spelling_variants(spark, SF), "n")
    assert sorted(got, key=lambda x: x["word"]) == variants(vocabulary(rows))
