"""URL filters by hash-prefix lists: every URL is expanded into host-suffix and path-prefix
expressions, these meet the rules by an equi-join on 32 bits of their digest, full digests confirm,
and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' for null or no '://'."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; '' for null or no '://'."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) as (prefix, digest, rule, action, width, labels, path_length).

    Null hosts or actions are no rule; a null path is empty; of a rule given twice with both actions
    'allow' holds."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host is not null and action is not null")
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action"))
    rule = F.concat("host", "path")
    return rules.select(F.substring(_digest(rule), 1, PREFIX_HEX).alias("prefix"), _digest(rule).alias("digest"), rule.alias("rule"), "action", F.length(rule).alias("width"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting
    rule wins (host plus path in characters). Without one rule is null and verdict is the default.
    Only those suffix label counts and prefix lengths that some rule has are expanded: their number
    follows the rules, not the URL. Expressions are made distinct before they meet the rules, so one that
    many URLs have, such as a top-level domain, is no hot key there; the joins carry no hint, and Spark
    broadcasts a side only below its size threshold. Rows that are equal in key, host and path are judged once and come back as
    often as they were; null keys and null URLs are rows like any other; no rows give no rows.
    """
    prepared = prepare_rules(rules)
    shapes = prepared.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    base = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    base = base.groupBy("key", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])
    if not labels:
        return base.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).drop("i")
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in labels]))
    cut = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(cut, lambda p: F.concat(s, p))))
    looked = base.select("key", "host", "path", "copies", F.explode(expressions).alias("expression"))
    # each expression meets the rules once, however many URLs have it: what is left fits a rule
    each = looked.select("expression").distinct().withColumn("full", _digest(F.col("expression"))).withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    fits = written(each.join(prepared, "prefix").where(F.col("full") == F.col("digest")).select("expression", F.struct("width", "rule", "action").alias("fit")), "url-rules")
    judged = looked.join(fits, "expression", "left").groupBy("key", "host", "path", "copies").agg(F.max("fit").alias("best"))
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i")).drop("i")
