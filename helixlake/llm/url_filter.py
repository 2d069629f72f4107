"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens that any matching URL must contain. A rule
is filed under the one of its tokens that the fewest URLs contain, counted over the whole table. A URL's own tokens look
up candidate rules, and only these run their expressions. All of it is Spark functions. A list of rules is a literal of the
plan, and one map-only pass after the count (``filter_urls``). A table of rules of any size is joined to the URLs' tokens
(``filter_urls_by_table``).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, unused

#: Rules that a plan holds as literals, at most; ``filter_urls`` takes longer lists to a table.
LITERAL_RULES = 2_000


@dataclass(frozen=True)
class UrlRule:
    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    #: Explicit rules win over the method's own patterns; among equals the longer rule wins.
    explicit: bool = True

    @property
    def size(self) -> int:
        return len(self.name)


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host, all its subdomains, and the paths that start with ``path``. The last token of a path prefix
    may be part of a longer one in a URL, so it is no key."""
    end = re.escape(path) if path else r"(?:/|\z)"
    head = re.findall(r"[0-9a-z]+", re.sub(r"[0-9A-Za-z]+\Z", "", path).lower())
    return UrlRule(host + path, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{end}", verdict, tuple(re.findall(r"[0-9a-z]+", host)) + tuple(head))


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A pattern of the method itself: the host has a label, or hyphen-separated part of one, equal to ``word``."""
    return UrlRule(word, rf"(?s)^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|\z)", verdict, tuple(re.findall(r"[0-9a-z]+", word)), False)


def segment_rule(*words: str, verdict: str = "block") -> UrlRule:
    """A pattern of the method itself: the path has these segments one after the other, whatever their case."""
    path = "/".join(words)
    return UrlRule(f"/{path}", rf"(?s)^[^/]*/(?:.*/)?(?i:{re.escape(path)})(?:/.*)?\z", verdict, tuple(re.findall(r"[0-9a-z]+", path)), False)


RULES = (host_rule("org", "/", "allow"), host_rule("example.org", "/es/", "block"), host_rule("example.org", "/en/1", "block"), host_rule("com", "/fr/", "allow"), host_rule("com", "/de/", "block"))
#: Words that a host's label says of itself, alone or with one of the additions, and paths of trackers and link exchanges.
HOST_WORDS = ("casino", "porn", "xxx", "viagra", "spam-farm", "link-farm", "payday-loan", "escort", "replica-watches", "torrent", "warez", "clickbait")
ADDED = ("best", "buy", "cheap", "free", "hot", "live", "online", "top", "vip", "win")
TRACKERS = (("track", "click"), ("aff", "out"), ("ad", "redirect"), ("link-exchange", "add"))
PATTERNS = tuple(word_rule(w) for word in HOST_WORDS for w in (word, *(f"{a}{word}" for a in ADDED), *(f"{word}{a}" for a in ADDED))) + tuple(segment_rule(*t) for t in TRACKERS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0)))


def _literal(value: object, kind: str) -> Column:
    """A list or map as one literal, which the planner folds: hundreds of single ones would cost it seconds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _ranked(rules: tuple[UrlRule, ...]) -> tuple[UrlRule, ...]:
    """Explicit rules after the method's own, longer after shorter: the last one that fits wins."""
    return tuple(sorted(rules, key=lambda r: (r.explicit, r.size, r.name)))


def filter_urls(df: DataFrame, rules: tuple[UrlRule, ...], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the explicit rule that holds, else null), verdict, and pattern (the method's own pattern
    that blocked, else null). Null or malformed URLs have an empty host and path, fit no rule and take ``default``.
    Columns of ``df`` with these names are replaced. Rows are kept as they are: repeated ones stay, none is dropped; an
    empty table gives an empty one."""
    rules = _ranked(rules)
    if len(rules) > LITERAL_RULES:
        return filter_urls_by_table(df, rule_table(df.sparkSession, rules), url_col, default)
    host, path = url_parts(F.col(url_col))
    keys = sorted({t for r in rules for t in r.tokens})
    tokens = url_tokens(F.concat(host, path))
    counts = df.select(F.explode(F.array_intersect(tokens, _literal(keys, "array<string>"))).alias("t")).groupBy("t").count() if keys else None
    seen = {r["t"]: r["count"] for r in counts.collect()} if keys else {}  # one row a rule token at most
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else "", []).append(i)
    u, c, best = unused(df, "url_parts"), unused(df, "url_rules"), unused(df, "url_best")
    bare = index.pop("", [])
    named = lambda own: [{"i": i, "pattern": rules[i].pattern} for i in own]
    fetch = _literal(named(bare), "array<struct<i:int,pattern:string>>")
    if index:
        filed = _literal({t: named(own) for t, own in sorted(index.items())}, "map<string,array<struct<i:int,pattern:string>>>")
        hit = F.array_intersect(F.col(u)["tokens"], _literal(sorted(index), "array<string>"))
        fetch = F.concat(fetch, F.flatten(F.transform(hit, lambda t: filed[t])))
    out = df.withColumn(u, F.struct(host.alias("host"), path.alias("path"), tokens.alias("tokens")))
    out = out.withColumn(c, fetch)
    full = F.concat(F.col(u)["host"], F.col(u)["path"])
    fits = F.array_max(F.transform(F.filter(F.col(c), lambda x: F.call_function("rlike", full, x["pattern"])), lambda x: x["i"]))
    out = out.withColumn(best, F.coalesce(fits, F.lit(-1)))
    pick = lambda f: F.element_at(_literal([None, *map(f, rules)], "array<string>"), F.col(best) + 2)
    cols = {"host": F.col(u)["host"], "path": F.col(u)["path"], "rule": pick(lambda r: r.name if r.explicit else None), "verdict": F.coalesce(pick(lambda r: r.verdict), F.lit(default)), "pattern": pick(lambda r: None if r.explicit else r.name)}
    return out.withColumns(cols).drop(u, c, best)


_RULE = "place long, name string, pattern string, verdict string, tokens array<string>, explicit boolean"


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Rules as ``filter_urls_by_table`` takes them; of those that fit, the one with the greatest ``place`` holds."""
    return spark.createDataFrame([(i, r.name, r.pattern, r.verdict, list(r.tokens), r.explicit) for i, r in enumerate(_ranked(rules))], _RULE)


def filter_urls_by_table(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """As ``filter_urls``, with a table of rules (place, name, pattern, verdict, tokens, explicit) of any number. Different
    URLs are judged once. Every rule must have a token. Tokens that no rule is filed under are joined with nothing; a rule
    is filed under its rarest token, so a common token brings candidates only to rules that have no rarer one."""
    host, path = url_parts(F.col(url_col))
    urls = df.select(F.concat(host, path).alias("full")).distinct().select("full", url_tokens(F.col("full")).alias("tokens"))
    urls = materialize(urls, "urls")
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = rules.withColumn("token", F.explode(F.array_distinct("tokens"))).join(seen, "token", "left")
    filed = filed.groupBy("place").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")).join(rules.drop("tokens"), "place")
    near = urls.select("full", F.explode("tokens").alias("token")).join(filed.select("token", "place", "pattern"), "token").where(F.call_function("rlike", F.col("full"), F.col("pattern")))
    best = near.groupBy("full").agg(F.max("place").alias("place")).join(rules.select("place", "name", "verdict", "explicit"), "place")
    full, own = unused(df, "url_full"), unused(df, "url_rule")
    best = best.select(F.col("full").alias(full), F.struct("name", "verdict", "explicit").alias(own))
    out = df.withColumn(full, F.concat(host, path)).join(best, full, "left")
    r = F.col(own)
    cols = {"host": host, "path": path, "rule": F.when(r["explicit"], r["name"]), "verdict": F.coalesce(r["verdict"], F.lit(default)), "pattern": F.when(~r["explicit"], r["name"])}
    return out.withColumns(cols).drop(full, own)


def op9_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


_WORDS = "|".join(f"(?:{'|'.join(ADDED)})?{w}|{w}(?:{'|'.join(ADDED)})" for w in HOST_WORDS)
_PATHS = "|".join("/".join(t) for t in TRACKERS)
SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(r.h || r.p, length(r.h || r.p)) FROM rules r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS rule,
  coalesce((SELECT arg_max(r.v, length(r.h || r.p)) FROM rules r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)),
    CASE WHEN regexp_matches(p.host, '(^|[.-])({words})([.-]|$)') OR regexp_matches(p.path, '(?is)(^|/)({paths})(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p
""".replace("{words}", _WORDS).replace("{paths}", _PATHS)
