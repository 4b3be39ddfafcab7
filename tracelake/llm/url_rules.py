"""URL rules indexed by their rarest literal token, with DataFrame functions only.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path
starts with the rule's path; of the rules that fit, the longest decides, a block before an
allow of equal length. The tokens of a rule that every fitting url must hold (its host's
labels and the whole segments of its path) are looked up in the corpus' token counts; the
rarest one is the rule's key. A url fetches the rules keyed by its own tokens, and only those
run their regular expression.

A list of up to ``MOST_INLINE`` rules is a map from key to rules that stands in the plan; longer
lists are a table that the urls' tokens are joined with, so a list may have any length.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the
default verdict; repeated rows stay repeated; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import UPPER, read

#: (verdict, rule); a rule is written host + path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rules that stand in the plan, and rules that may be sent to every task; more are joined by a shuffle.
MOST_INLINE, MOST_SENT = 100, 100_000

_RULE = "struct<length:int,block:int,rule:string,pattern:string>"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Labels of the host as ``.label`` and segments of the path that a slash ends as ``/segment``."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("."), t))
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.concat(F.lit("/"), t))
    return F.array_distinct(F.concat(labels, segments))


def _rule_tokens(rule: str) -> list[str]:
    host, slash, path = rule.partition("/")
    segments = (slash + path).split("/")[:-1]
    return list(dict.fromkeys([*(f".{x}" for x in host.split(".")), *(f"/{x}" for x in segments)]))


def _pattern(rule: str) -> str:
    host, slash, path = rule.partition("/")
    quote = lambda s: re.sub(r"([^0-9A-Za-z_/])", r"\\\1", s)
    return rf"^(?:[^/]*\.)?{quote(host)}{quote(slash + path)}"


def _sent(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= MOST_SENT else df


def _keyed(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """token and the entry of every rule, the token being the rule's that fewest urls hold."""
    spark = urls.sparkSession
    rows = [{"i": i, "verdict": v, "rule": r, "pattern": _pattern(r), "tokens": _rule_tokens(r)} for i, (v, r) in enumerate(dict.fromkeys(map(tuple, rules)))]
    given = F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,verdict:string,rule:string,pattern:string,tokens:array<string>>>")
    tokens = spark.range(1).select(F.inline(given)).select("i", "verdict", "rule", "pattern", F.explode("tokens").alias("token"))
    held = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = held.join(_sent(tokens.select("token").distinct(), rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    entry = F.struct(F.length("rule").alias("length"), (F.col("verdict") == "block").cast("int").alias("block"), "rule", "pattern")
    ranked = tokens.join(counts, "token", "left").groupBy("i", entry.alias("entry")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key"))
    return ranked.select(F.col("key.token").alias("token"), "entry")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", most_inline: int = MOST_INLINE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    whole, tokens = F.concat("host", "path"), url_tokens(F.col("host"), F.col("path"))
    none = F.array().cast(f"array<{_RULE}>")
    if not rules:
        out = urls.withColumn("best", F.lit(None).cast(_RULE))
    elif len(rules) <= most_inline:
        index: dict[str, list] = {}
        for r in _keyed(urls, rules).collect():  # a row for each rule
            index.setdefault(r["token"], []).append(r["entry"])
        lit = lambda e: F.struct(F.lit(e["length"]).alias("length"), F.lit(e["block"]).alias("block"), F.lit(e["rule"]).alias("rule"), F.lit(e["pattern"]).alias("pattern"))
        table = F.create_map(*[c for t, found in index.items() for c in (F.lit(t), F.array(*map(lit, found)))])
        fetched = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), none)))
        out = urls.withColumn("best", F.array_max(F.filter(fetched, lambda r: F.regexp_like(whole, r["pattern"]))))
    else:
        keyed = _sent(_keyed(urls, rules), rules)
        places = urls.select("host", "path").distinct()  # a url is judged once, however many pages have it
        fetched = places.withColumn("token", F.explode(tokens)).join(keyed, "token").filter(F.regexp_like(whole, F.col("entry.pattern")))
        best = fetched.groupBy("host", "path").agg(F.max("entry").alias("best"))
        out = urls.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block") == 1, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


ORACLE = r"""
WITH r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hit AS (
  SELECT page_id, host, path, max(struct_pack(l := length(rule), v := verdict, r := rule)) AS best
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT u.page_id, u.host, u.path, hit.best.r AS rule, coalesce(hit.best.v, 'allow') AS verdict
FROM u LEFT JOIN hit ON u.page_id = hit.page_id AND u.host = hit.host AND u.path = hit.path
"""


def query(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"))
