"""URL filtering with pattern rules indexed by their rarest literal token; DataFrame functions only.

Every rule is a regular expression plus the literal tokens (runs of letters and digits) that any url it matches
must contain as whole tokens. Token counts over the urls at hand tell the rarest of them, under which
the rule is filed. A url's own tokens fetch candidate rules; only those run their expression.

Two kinds of rule: host rules (``example.net/en/``: the host or a subdomain, with the path's beginning) look at host
and path, the longest that fits wins; word rules (``spam-farm``: the words in a row, with no letter or digit beside
them) look at the whole lower-cased url and block it when no host rule has decided. Any other url is allowed.

A null url, or one without ``://``, has an empty host and path and fits no host rule. Repeated rows are judged each.
Nothing but the id and the url is looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 50_000  # a larger index is joined by shuffling


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # host or word
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(name: str, verdict: str) -> Rule:
    host, slash, path = name.partition("/")
    path = slash + path
    # the last token of a path that ends in a letter or digit may go on in the url, so it isn't whole
    inner = re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = re.findall(r"[a-z0-9]+", f"{host} {inner}".lower())
    return Rule(name, "host", verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path) if path else '(?:/|$)'}", tuple(tokens))


def word_rule(name: str) -> Rule:
    words = re.findall(r"[a-z0-9]+", name.lower())
    return Rule(name, "word", "block", rf"(?:^|[^a-z0-9]){re.escape(name.lower())}(?:[^a-z0-9]|$)", tuple(words))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.lower("url"), F.lit("")).alias("whole"), F.monotonically_increasing_id().alias("row"))
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "whole", "host", "path")), "[^a-z0-9]+"))

    literal = spark.createDataFrame(sorted({(t,) for r in rules for t in r.tokens}) or [("",)], "token string")
    seen = urls.select(F.explode(tokens).alias("token"))
    few = len(rules) <= BROADCAST_RULES
    counts = dict(seen.join(F.broadcast(literal) if few else literal, "token").groupBy("token").count().collect()) if rules else {}
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), r.name, r.kind, r.verdict, r.pattern, len(r.name)) for r in rules if r.tokens]
    if len(filed) < len(rules):
        raise ValueError("every rule needs a literal token")
    index = spark.createDataFrame(filed, "token string, name string, kind string, judged string, pattern string, long int")

    hits = urls.select("*", F.explode(tokens).alias("token")).join(F.broadcast(index) if few else index, "token", "left")
    fits = F.expr("pattern is not null and if(kind = 'host', concat(host, path), whole) rlike pattern")
    best = F.max(F.when(fits & (F.col("kind") == "host"), F.struct("long", "name", "judged"))).alias("best")
    words = F.coalesce(F.max(fits & (F.col("kind") == "word")), F.lit(False)).alias("words")
    judged = hits.groupBy("row", "page_id", "host", "path").agg(best, words)
    return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.judged", F.when(F.col("words"), "block").otherwise("allow")).alias("verdict"))
