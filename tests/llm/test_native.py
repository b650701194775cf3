"""Licence scan, URL filter, quality rules and decontamination against their SQL, on odd rows too."""

from itertools import combinations

import duckdb
import pytest
from odd_rows import ODD, prose, result

from assaylake.llm import contamination, licenses, quality, sql, urls


def by_sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_rows", df.toPandas())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_rows")
    return [dict(zip([d[0] for d in cur.description], r, strict=True)) for cur in [con.execute(query)] for r in cur.fetchall()]


def same(got, want, key):
    order = lambda rows: sorted((tuple(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows), key=str)
    assert order(got) == order(want)


LICENSED = ["Gnu General\nPublic LICENSE gnu general public license", "mit. license", "mitlicense mit-license", "cc by-nc 4.0 licensed under", "x " * 31 + "apache license", "x " * 63 + "Apache License, Version 2.0 licensed under the",
            "licensed apache", "Released under the MIT License. " * 20, "license general gnu public", "gnu general public" + " x" * 40 + " license"]


def test_license_scan(make):
    docs = make(ODD + LICENSED + [(3, "mit license"), (3, "mit license"), (None, "cc by")])
    got = [r for r in result(licenses.scan(docs).select("doc_id", "license_scan.*"))]
    same(got, by_sql(sql.LICENSES, documents=docs), "doc_id")
    at = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert at[len(ODD)]["n_base"] == 2 and at[len(ODD) + 6]["base_labels"] == "" and at[0]["first_word"] is None
    assert licenses.scan(docs.limit(0)).count() == 0


RELATED = [("licensed under the terms of the GNU General Public License", "gpl"), ("Released under the terms of the Apache License", "apache"), ("Licensed under the Mozilla Public License version 2 0", ""), ("licensed under CC BY 4.0", "cc-by"),
           ("4 ideas by our team: 0 of them were licensed under pressure", ""), ("licensed under the terms of the GNU Lesser General Public License", "lgpl"), ("Licensed under the terms of the GNU Affero General Public License", "agpl"),
           ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("x " * 200_000 + "subject to the terms of the Mozilla Public License", "mpl"), ("released under terms of the MIT license", "mit")]


def test_relatives_of_a_license_are_told_apart(make):
    docs = make([t for t, _ in RELATED])
    got = result(licenses.scan(docs).select("doc_id", "license_scan.*"))
    assert [r["labels"] for r in got] == [w for _, w in RELATED]
    same(got, by_sql(sql.LICENSES, documents=docs), "doc_id")


URLS = [None, "", "no scheme", "http://a.NET", "http://a.NET/x?y", "https://net/", "x://example.net/en/a", "x://b.example.net/en", "x://notexample.com/de/", "x://w.example.com/de/q#f", "x://a.org/fr/", "x://org/fr/x", "x://a.org:80/fr/",
        "x://m.free-bets.example.com/", "x://free.bets.example.org/fr/", "x://a.com/casino", "x://a.com/casinos", "a://b://c.net/", "x://é.net/ü", "x://a.com?u=http://b.net/", "://net/", "x://a.com/CASINO/1"]


def test_url_filter(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(3, URLS[4], "h", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = result(urls.judge(pages).select("page_id", "url_filter.*"), "page_id")
    same(got, by_sql(sql.URLS, pages=pages), "page_id")
    rule = {r["page_id"]: (r["rule"], r["verdict"]) for r in got if r["page_id"] != 3}
    assert rule[4] == ("net/", "block") and rule[6] == ("example.net/en/", "allow") and rule[7][0] == "net/" and rule[9][0] == "example.com/de/" and rule[12][0] is None and rule[15] == (None, "block") and rule[16] == (None, "allow")
    assert urls.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, rules=(urls.Rule("*", "block", ".*", ()),))


def repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    return len(hit)


def test_quality_rules(make):
    texts = ODD + [prose(1, 80), prose(2, 40) + " " + prose(2, 40), "Home\n" + prose(3, 30) + "\nAll rights reserved\n" + prose(3, 30), "a b c d e f a b c d e g a b c d e", "a | b | c | d\n" * 30, "w w w w w w w", "\n".join(["same line here"] * 4 + [prose(4, 60)])]
    docs = make(texts + [(2, texts[-1]), (2, texts[-1])])
    df = quality.measure(docs)
    got = [{"doc_id": r["doc_id"]} | {k: r["quality"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")} for r in result(df)]
    same(got, by_sql(sql.QUALITY, documents=docs), "doc_id")
    for r in result(df):
        words = (r["text"] or "").split()
        if "ſ" not in (r["text"] or ""):
            assert r["quality"]["n_repeat_words"] == repeats(words)
    kept = {r["doc_id"]: r["quality"] for r in result(df)}
    assert kept[len(ODD)]["kept"] and "Home" not in kept[len(ODD) + 2]["clean_text"]
    assert df.columns == [*docs.columns, "quality"] and quality.measure(docs.limit(0)).count() == 0


def test_decontamination(spark, make):
    items = [(i, prose(100 + i, 30 + i)) for i in range(5)] + [(7, "two words"), (8, None), (9, ""), (10, "solitary"), (4, prose(104, 34))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    passage = items[1][1].split()
    one_off = [*passage]
    for k in (4, 12, 20):
        one_off[k] = "zzz"
    texts = ODD + [prose(50, 60) + " " + items[0][1].upper() + " " + prose(51, 20), " ".join(one_off), " ".join(passage[5:18]), " ".join(passage[5:13]), prose(60, 200), "these two words stand", "items[2] " + items[2][1] + "\n" + items[3][1], "solitary"]
    docs = make(texts)
    got = result(contamination.judge(docs, bench))
    for r in got:
        r["items"] = ",".join(map(str, r["items"]))
    same(got, by_sql(sql.CONTAMINATION, documents=docs, benchmark=bench), "doc_id")
    flag = {r["doc_id"]: r["contaminated"] for r in got}
    n = len(ODD)
    assert [flag[n + k] for k in range(8)] == [True, True, True, False, False, True, True, True]
    left = contamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {k for k, v in flag.items() if not v}
    assert contamination.judge(docs.limit(0), bench).count() == 0
    assert contamination.judge(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("length", range(4, 16))
def test_every_substitution_within_the_threshold_leaves_a_seed(length):
    others = min(length, contamination.WINDOW) - contamination.needed(min(length, contamination.WINDOW))
    masks = contamination.block_masks(length) if length < contamination.WINDOW else contamination.MASKS
    places = [(at, m) for m in masks for at in range(length - len(m) + 1)]
    for changed in combinations(range(length), others):
        assert any(all(not at <= i < at + len(m) or m[i - at] == "0" for i in changed) for at, m in places), changed


def test_short_items_are_found_with_any_allowed_substitution(spark, make):
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(3, 13)]
    texts, want = [], []
    for n, text in items:
        others = n - contamination.needed(n)
        for wrong in (others, others + 1):
            for changed in combinations(range(n), wrong):
                words = ["zzz" if k in changed else w for k, w in enumerate(text.split())]
                texts.append("some words before " + " ".join(words) + " and after")
                want.append(wrong <= others)
    docs, bench = make(texts), spark.createDataFrame(items, "item_id long, text string")
    got = result(contamination.judge(docs, bench))
    assert [r["contaminated"] for r in got] == want
    for r in got:
        r["items"] = ",".join(map(str, r["items"]))
    same(got, by_sql(sql.CONTAMINATION, documents=docs, benchmark=bench), "doc_id")


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_filter", "op6_quality_rules", "op8_decontamination"])
def test_native_plans_hold_no_python(spark, name):
    from assaylake.llm.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
