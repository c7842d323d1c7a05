"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host//path`` with the literal tokens
that each matching URL must hold as whole tokens.  A rule is indexed under the
token that the fewest URLs of the table hold.  A URL's tokens fetch the
candidate rules from that index, and only these rules' expressions run on it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An index of up to this many rules goes into the plan as a literal map; a larger one is joined.
MAX_INLINE_RULES = 1_000
# No host holds a slash, so the text has one reading.
TEXT = "//"
BREAK = r"[./?#&=:_\s-]"
ENTRY = "listed boolean, weight int, place int, rule string, verdict string, pattern string"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs whose ``host//path`` matches ``pattern``; ``tokens`` are in every such URL.

    ``weight`` ranks the rules that match (highest first, then ``name``); a rule
    with ``listed`` false gives a verdict only where no listed rule matches.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = True


def prefix_rule(rule: str, verdict: str) -> Rule:
    """Rule ``host/path``: the host and its subdomains, paths that start with the path."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    # the last run of path characters may go on in the URL, unless a break ends it
    whole = [t for t in re.split(BREAK + "+", host) if t]
    bits = re.split(BREAK + "+", path)
    whole += [t for t in bits[:-1] if t]
    return Rule(rule, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{TEXT}{re.escape(path)}", tuple(dict.fromkeys(whole)), len(rule))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Rule for URLs that hold ``word`` as a whole token of host or path."""
    return Rule(word, verdict, f"(?:^|{BREAK}){re.escape(word)}(?:$|{BREAK})", (word,), len(word), False)


#: The given rules, and the method's own words for URLs that no given rule fits.
LISTED = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
WORDS = ("adult", "betting", "casino", "escort", "gambling", "porn", "sex", "slots", "viagra", "xxx")
RULES = tuple(prefix_rule(*r) for r in LISTED) + tuple(word_rule(w) for w in WORDS)


def host_path(url):
    """(host, path) columns: host after the first ``://`` up to / ? # (A-Z lower-cased), path then up to ? #."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def url_text():
    return F.concat_ws(TEXT, "host", "path")


def url_tokens():
    return F.filter(F.array_distinct(F.split(url_text(), BREAK + "+")), lambda t: t != "")


def index_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(token, entry): each rule under its rarest token in ``urls`` (host, path); ties to the first token.

    The token counts cover all URLs; only tokens that rules hold are counted.
    ``entry.place`` is higher for names that sort first.
    """
    spark = urls.sparkSession
    names = {r.name: -k for k, r in enumerate(sorted(rules, key=lambda r: r.name))}
    rows = spark.createDataFrame(
        [(i, t, (r.listed, r.weight, names[r.name], r.name, r.verdict, r.pattern)) for i, r in enumerate(rules) for t in r.tokens],
        f"id int, token string, entry struct<{ENTRY}>")
    held = urls.select(F.explode(url_tokens()).alias("token"))
    wanted = {t for r in rules for t in r.tokens}
    if len(wanted) <= MAX_INLINE_RULES:
        held = held.where(F.col("token").isin(sorted(wanted)))
    # summed in each task before the shuffle: a token that most URLs hold is one row a task
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = (rows.join(counts, "token", "left").groupBy("id", "entry")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    return best.select("token", "entry")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow",
               inline: int = MAX_INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``; other columns are not read.

    A NULL url, or one without ``://``, has empty host and path and gets the
    default verdict.  Of several listed rules that fit the longest wins (then
    the first by name); where none fits ``rule`` is NULL, and the verdict is that of
    the longest matching word rule, else ``default``.  Repeated rows and NULL
    page_ids keep one row each; an empty table gives no rows.  Up to ``inline``
    rules the URLs are only scanned; more rules give the same rows by a join.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token: " + next(r.name for r in rules if not r.tokens))
    host, path = host_path(F.col("_url"))
    urls = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    index = index_rules(urls, rules)
    found = _by_literal(urls, index) if len(rules) <= inline else _by_join(urls, index)
    hit = F.col("hit")
    return found.select("page_id", "host", "path", F.when(hit["listed"], hit["rule"]).alias("rule"),
                        F.coalesce(hit["verdict"], F.lit(default)).alias("verdict"))


def _by_literal(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The index as one literal map: a URL's tokens fetch their rules, then those expressions run."""
    lists: dict[str, list] = {}
    for r in index.collect():  # one row per rule
        lists.setdefault(r["token"], []).append(r["entry"].asDict())
    fetch = F.from_json(F.lit(json.dumps(lists)), f"map<string, array<struct<{ENTRY}>>>")
    candidates = F.flatten(F.filter(F.transform(url_tokens(), lambda t: F.try_element_at(fetch, t)), lambda r: r.isNotNull()))
    fits = F.filter(candidates, lambda r: F.rlike(url_text(), r["pattern"]))
    return urls.withColumn("hit", F.array_max(fits))


def _by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Each distinct URL's tokens joined with the index.

    Copies of a URL are judged once; the join back is a skew join for Spark to split.
    """
    fetched = (urls.select("host", "path").distinct().select("host", "path", F.explode(url_tokens()).alias("token"))
               .join(index, "token").where(F.rlike(url_text(), F.col("entry.pattern"))))
    best = fetched.groupBy("host", "path").agg(F.max("entry").alias("hit"))
    return urls.join(best, ["host", "path"], "left")
