"""URL filters: host-suffix and path-prefix expressions joined on hash prefixes.

A URL is expanded into one expression per pair of a host suffix (whole labels) and a path
prefix of a length that some rule has. Expressions meet rules on the first characters of
their digests; the full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import ascii_lower, stage

PREFIX_CHARS = 8


class UrlParts(NamedTuple):
    host: Column
    path: Column


def url_parts(url: Column) -> UrlParts:
    """Host after the first ``://`` in lower case, and path; both empty for null or without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return UrlParts(ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2))


def rule_table(rules: DataFrame) -> DataFrame:
    """Digests of rules (action, host, path); a path is empty or starts with ``/``."""
    text = F.concat("host", "path")
    digest = F.sha2(text, 256)
    return rules.select(
        F.substring(digest, 1, PREFIX_CHARS).alias("prefix"),
        digest.alias("digest"),
        F.struct(
            F.length(text).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("action") == "block").alias("blocks"),
            text.alias("rule"),
            F.col("action").alias("action"),
        ).alias("found"),
    ).where(F.col("digest").isNotNull())


def url_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action) for every distinct URL that a rule fits; other URLs are left out.

    ``urls`` has a column ``url``, ``rules`` action, host and path. Among fitting rules the one
    with more characters wins, then the longer host, then ``block``. Null URLs fit no rule, an
    empty rule table fits no URL.
    """
    shape = rules.agg(
        F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", "\\."))).alias("labels")
    ).first()  # distinct lengths, so never more than the longest rule has characters
    parts = url_parts(F.col("url"))
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    split = distinct.select("url", parts.host.alias("host"), parts.path.alias("path")).withColumn("labels", F.split("host", "\\."))
    counts = F.filter(F.array(*[F.lit(n) for n in sorted(shape.labels)]).cast("array<int>"), lambda n: n <= F.size("labels"))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(shape.paths)]).cast("array<int>"), lambda n: n <= F.length("path"))
    hosts = F.transform(counts, lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    paths = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, p), 256))))
    probes = split.select("url", F.explode(expressions).alias("asked")).withColumn("prefix", F.substring("asked", 1, PREFIX_CHARS))
    hits = probes.join(rule_table(rules), "prefix").where(F.col("asked") == F.col("digest"))
    best = hits.groupBy("url").agg(F.max("found").alias("found"))
    return best.select("url", "found.rule", "found.action")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per page; without a fitting rule the verdict is ``default``.

    Pages with null, empty or repeated URLs each keep their row; no other column is read.
    """
    rows = pages.select("page_id", "url")
    parts = url_parts(F.col("url"))
    # stored and merged, so that the join can split a URL of many pages; null URLs stay out of it
    found = stage(url_rules(rows, rules), "urls")
    joined = rows.where(F.col("url").isNotNull()).join(found.hint("merge"), "url", "left")
    every = joined.unionByName(rows.where(F.col("url").isNull()), allowMissingColumns=True)
    return every.select(
        "page_id", parts.host.alias("host"), parts.path.alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
