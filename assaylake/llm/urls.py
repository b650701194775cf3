"""URL filter: pattern rules filed under their rarest literal token.

The tokens of a URL fetch the rules filed under them; only those rules run their regular expression.
A rule is ``host/path``: it fits the host and its subdomains if the URL's path starts with the rule's path.
A rule with a ``*`` fits hosts by pattern. The longest fitting rule decides, blocks before allows on a tie.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import boxed, unboxed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on ``host + path``; ``literals`` are whole tokens that every fitting URL holds."""

    rule: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    base: bool = True


def host_rule(action: str, rule: str) -> Rule:
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", slash + path)  # the last token may go on in the URL
    return Rule(rule, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(dict.fromkeys(re.findall("[a-z0-9]+", host) + whole)))


def word_rule(action: str, words: str) -> Rule:
    """Fits URLs whose host or path holds the words as whole tokens, one after another with one separator between."""
    parts = words.split("-")
    inner = "[^A-Za-z0-9]".join(parts)
    return Rule(f"*{words}*", action, rf"(?i)(?:^|[^A-Za-z0-9]){inner}(?:$|[^A-Za-z0-9])", tuple(parts), base=False)


# fixed values: the rules of the contract
BASE_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: Word rules of the filter itself; they decide where no base rule fits.
WORD_RULES = tuple(word_rule("block", w) for w in (
    "casino", "poker", "free-bets", "bets", "betting", "cheap-pills", "pills", "viagra", "porn", "xxx", "adult-chat", "escort", "payday-loans", "replica-watches", "warez", "torrent", "crack-keygen"))
RULES = BASE_RULES + WORD_RULES


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+"), ""))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...], tokens: str = "tokens") -> DataFrame:
    """``token, rule, action, pattern, base`` with the literal that the fewest URLs hold (ties: the smaller token).

    A rule needs a literal: one without is refused. Literal counts are taken over all URLs.
    """
    if missing := [r.rule for r in rules if not r.literals]:
        raise ValueError(f"rules without a literal token: {missing}")
    spark = urls.sparkSession
    listed = spark.createDataFrame([(i, r.rule, r.action, r.pattern, r.base, list(r.literals)) for i, r in enumerate(rules)], "no int, rule string, action string, pattern string, base boolean, literals array<string>")
    literals = listed.select("no", F.explode("literals").alias("token"))
    wanted = literals.select("token").distinct()
    counts = urls.select(F.explode(tokens).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = literals.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    return rarest.join(listed, "no").select("token", "rule", "action", "pattern", "base")


def judge(pages: DataFrame, carry: Sequence[str] = ("page_id",), url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """The carried columns and ``url_filter``: struct of host, path, rule (base rules only, else null), verdict.

    Repeated rows are judged each. Null, empty and odd URLs have empty host and path, fit no base rule and,
    without a word rule, get the default. Of equally long rules a block wins over an allow.
    """
    host, path = host_and_path(F.col(url_col))
    rows = boxed(pages, carry, row_no=F.monotonically_increasing_id(), host=host, path=path).withColumn("tokens", url_tokens(F.concat("host", "path")))
    index = rule_index(rows, rules).withColumnRenamed("token", "filed_under")
    candidates = rows.select("box", "row_no", "host", "path", F.explode_outer("tokens").alias("token")).join(index, F.col("token") == F.col("filed_under"), "left")
    fits = F.expr("concat(host, path) rlike pattern")
    best = F.max(F.when(fits, F.struct("base", F.length("rule").alias("n"), (F.col("action") == "block").alias("block"), "rule", "action")))
    out = candidates.groupBy("row_no").agg(*[F.first(c).alias(c) for c in ("box", "host", "path")], best.alias("best"))
    rule = F.when(F.col("best.base"), F.col("best.rule"))
    return out.select(*unboxed(carry), F.struct("host", "path", rule.alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")).alias("url_filter"))
