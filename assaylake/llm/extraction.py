"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Each block element is a node that is content or not. Its own tag, attributes and text give a unary potential,
each parent-child edge a pairwise one. Messages go up from the leaves and down from the root (sum-product), which
on a tree gives exact marginals. The weights are fitted by gradient ascent on the likelihood of labelled pages,
with the same messages for the expectations. Blocks of text whose node is more likely content than not are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.labelled_pages import PAGES

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q s samp small source span strike strong sub sup time tt u var wbr "
                   "math mi mn mo mrow ms mspace mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle semantics".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
#: Left out with all they hold.
DROPPED = "script|style|title|noscript|template|iframe|canvas|audio|video"
#: Elements that ``/>`` ends, besides all that stand inside one of them.
FOREIGN = frozenset(("svg", "math"))
#: Start tags that end an open element of the listed kinds, up to the nearest of the limits.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)),
    "option": ("option", ("select",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "body": ("head", ("html",)),
}
# Attributes up to the end of a tag. Nothing inside is tried twice (possessive), and a new tag ends an open one, so a
# page takes time in proportion to its length.
_INSIDE = r"""((?:[^<>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=]|<(?![a-zA-Z/!?]))*+)"""
# 1 and 2: a dropped element and its attributes; 3 to 5: end, name and attributes of a tag; 6: text
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({DROPPED})(?=[\s/>]){_INSIDE}>|<(/?)([a-zA-Z][^\s/><]*){_INSIDE}>|<[!?/][^<>]*+(?:>|\Z)?|([^<]+|<)", re.S | re.I)
#: Where a dropped element ends that has no end tag: at the next start or end tag.
NEXT_TAG = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden|data-main|data-not)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)

TAGS = {t: g for g, names in enumerate((
    "article main", "nav menu", "header", "footer address", "aside", "form button select textarea fieldset input dialog option", "h1 h2 h3 h4 h5 h6", "p", "ul ol dl", "li dt dd", "table thead tbody tfoot tr td th caption",
    "blockquote pre figure figcaption", "html body head")) for t in names.split()}
OTHER_TAG = max(TAGS.values()) + 1
WORDS = {w: k for k, names in enumerate((
    "article articlebody content post postbody entry story main maincontent text hentry",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar toc",
    "sidebar aside complementary widget related recommended recommendations popular trending rail more",
    "header masthead banner logo branding footer contentinfo copyright colophon legal bottom",
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted dfp adsense",
    "notice cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe signup paywall warning",
    "comment comments disqus respond reply replies discussion commentlist",
    "share sharing social follow tags meta byline author login search form print tools skip hidden",
)) for w in names.split()}
N_WORDS = max(WORDS.values()) + 1
F_TAG, F_WORD = 1, 2 + OTHER_TAG
F_HIDDEN, F_LINKS, F_SHORT, F_LONG, F_STOP, F_BARE = (F_WORD + N_WORDS + k for k in range(6))
N_FEATURES = F_BARE + 1
#: Text right below these stands in no region of the page.
OUTER = frozenset(("#root", "html", "body"))
PLAIN = OUTER | {"p", "h1", "h2", "h3", "blockquote"}


@dataclass
class Dom:
    parent: list[int]
    features: list[list[int]]
    blocks: list[tuple[int, str]]  # node and text
    label: list[int]


@lru_cache(maxsize=20_000)
def _attributes(raw: str) -> tuple[tuple[int, ...], bool | None]:
    """Features of an attribute string, and the label that a labelled page puts on the element."""
    found, label = set(), None
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "data-main":
            label = True
        elif name == "data-not":
            label = False
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add(F_HIDDEN)
        elif name in ("class", "id", "role"):
            found.update(F_WORD + WORDS[w] for w in re.findall("[a-z]+", value) if w in WORDS)
    return tuple(sorted(found)), label


def _after_dropped(html: str, name: str, raw: str, at: int, gone: dict[str, int]) -> int:
    """Where a dropped element ends: at its end tag, or at the next tag if it has none. ``gone`` holds names without end tags ahead."""
    if raw.endswith("/") and name not in ("script", "style", "title"):
        return at
    if gone.get(name) is None:
        end = re.compile(rf"</{name}\s*+>", re.I).search(html, at)
        if end:
            return end.end()
        gone[name] = at
    found = NEXT_TAG.search(html, at)
    return found.start() if found else len(html)


def parse(html: str) -> Dom:
    """Block elements in page order with their features, and the runs of text between block borders."""
    parent, features, label, names = [-1], [[0, F_TAG + OTHER_TAG]], [0], ["#root"]
    chars, linked = [0], [0]
    stack, blocks = [0], []
    run: list[str] = []
    link_depth = 0  # open elements where a link began, if one is open

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((stack[-1], text))

    def unlink():
        """A link ends with the element that it began in, whether it was closed or not."""
        nonlocal link_depth
        if link_depth > len(stack):
            link_depth = 0

    def close(kinds, limits=()):
        for at in range(len(stack) - 1, 0, -1):
            name = names[stack[at]]
            if name in kinds:
                flush()
                del stack[at:]
                unlink()
                return
            if name in limits:
                return

    at, gone = 0, {}
    while m := TOKEN.match(html, at):
        at = m.end()
        text = m[6]
        if text is not None:
            if "&" in text:
                text = unescape(text)
            run.append(text)
            n = len(text)
            chars[stack[-1]] += n
            if link_depth:
                linked[stack[-1]] += n
            continue
        if m[1]:
            at = _after_dropped(html, m[1].lower(), m[2], at, gone)
            continue
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            run.append(" ")
        elif name in INLINE:
            if name == "a":
                link_depth = 0 if m[3] else len(stack)
        elif m[3]:
            close((name,), ("table",) if name in ("p", "li", "div") else ())
        else:
            if names[stack[-1]] == "p":
                close(("p",))
            if name in CLOSES:
                kinds, limits = CLOSES[name]
                for _ in kinds.split():
                    close(kinds.split(), limits)
            flush()
            raw = m[5]
            if name in VOID and name != "input" or raw.endswith("/") and (name in FOREIGN or any(names[k] in FOREIGN for k in stack)):
                continue
            extra, mark = _attributes(raw) if raw and not raw.isspace() else ((), None)
            up = stack[-1]
            parent.append(up)
            features.append([0, F_TAG + TAGS.get(name, OTHER_TAG), *extra])
            label.append(label[up] if mark is None else int(mark))
            names.append(name)
            chars.append(0)
            linked.append(0)
            if name not in VOID:
                stack.append(len(parent) - 1)
    flush()
    own = [0] * len(parent)
    stops = [False] * len(parent)
    for node, text in blocks:
        own[node] += len(text)
        stops[node] |= text[-1] in ".!?…。:;\"'»”"
    for i in range(len(parent) - 1, 0, -1):  # links and text of all that an element holds
        chars[parent[i]] += chars[i]
        linked[parent[i]] += linked[i]
    for i, f in enumerate(features):
        if chars[i] and 2 * linked[i] > chars[i]:
            f.append(F_LINKS)
        if 0 < own[i] < 25:
            f.append(F_SHORT)
        if own[i] > 80:
            f.append(F_LONG)
        if stops[i]:
            f.append(F_STOP)
        if own[i] and names[i] in PLAIN and (i == 0 or names[parent[i]] in OUTER):
            f.append(F_BARE)
    return Dom(parent, features, blocks, label)


@dataclass
class TreeModel:
    unary: list[float]
    pair: list[float]  # log potentials of (parent, child) = 00, 01, 10, 11


def _soft(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(dom: Dom, model: TreeModel) -> tuple[list[float], list[float]]:
    """Log odds that each node is content, and of each node without its own subtree's word (its message from above)."""
    w, (p00, p01, p10, p11), parent = model.unary, model.pair, dom.parent
    up = [sum(map(w.__getitem__, f)) for f in dom.features]
    message = [0.0] * len(up)
    for i in range(len(up) - 1, 0, -1):  # children stand behind their parents
        message[i] = _soft(p10, p11 + up[i]) - _soft(p00, p01 + up[i])
        up[parent[i]] += message[i]
    down = [0.0] * len(up)
    for i in range(1, len(up)):
        rest = up[parent[i]] + down[parent[i]] - message[i]
        down[i] = _soft(p01, p11 + rest) - _soft(p00, p10 + rest)
    return [a + b for a, b in zip(up, down, strict=True)], down


def fit(pages: Sequence[str] = PAGES, rounds: int = 300, rate: float = 1.0, ridge: float = 0.0005) -> TreeModel:
    """Weights that maximise the likelihood of the labels (``data-main``, ``data-not``) of the pages."""
    doms = [parse(p) for p in pages]
    w, pair = np.zeros(N_FEATURES), np.array([1.0, -1.0, -1.0, 1.0])
    seen = np.full(N_FEATURES + 4, 1e-6)
    nodes = sum(len(d.parent) for d in doms)
    for _ in range(rounds):
        gw, gp = -ridge * w, -ridge * pair
        for d in doms:
            odds, down = marginals(d, TreeModel(w.tolist(), pair.tolist()))
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            for i, f in enumerate(d.features):
                gw[f] += (d.label[i] - p[i]) / nodes * 20
            for i in range(1, len(odds)):
                # joint of parent and child: the parent without this child, the child without the parent
                own = odds[i] - down[i]
                message = _soft(pair[2], pair[3] + own) - _soft(pair[0], pair[1] + own)
                rest = odds[d.parent[i]] - message
                joint = np.exp(np.array([pair[0], pair[1] + own, pair[2] + rest, pair[3] + rest + own]) - max(0, own, rest, own + rest))
                joint /= joint.sum()
                joint[2 * d.label[d.parent[i]] + d.label[i]] -= 1
                gp -= joint / nodes * 20
        grad = np.concatenate((gw, gp))
        seen += grad * grad
        step = rate * grad / np.sqrt(seen)
        w, pair = w + step[:N_FEATURES], pair + step[N_FEATURES:]
    return TreeModel(w.tolist(), pair.tolist())


def main_text(html: str, model: TreeModel) -> str:
    dom = parse(html)
    odds, _ = marginals(dom, model)
    return "\n".join(t for node, t in dom.blocks if odds[node] > 0)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", model: TreeModel | None = None) -> DataFrame:
    """All columns (one named like the result gives way) and the main text.

    Null and empty pages give an empty text. Pages are read whole, in time proportional to their length; repeated rows are
    read each; a block as likely content as not is left out; an empty table gives no rows.
    """
    fitted = model or fit()

    @arrow_udf("string")
    def text_of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), fitted) for h in html], pa.string())

    def text(column: Column) -> Column:
        return text_of(F.coalesce(column, F.lit("")))

    return pages.withColumn(name, text(F.col(f"`{html_col}`")))
