"""Sharding by rendezvous hashing: each record goes to the shard with the best weighted score for its
key, so another shard takes records only into itself and leaves all others where they were.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import quoted

BUCKETS = 4096


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on key and shard alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _best(scores: list[Column]) -> Column:
    return F.array_max(F.array(*scores))["shard"]


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key: the largest of -weight / ln(u), ties to the larger shard number.

    A null key counts as the text 'null'; shards of weight 0 or less get nothing; without any shard
    the result is null."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((F.lit(-float(w)) / F.log(_unit(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items()) if w > 0]
    return _best(scores) if scores else F.lit(None).cast("int")


def _bucket(columns: list[str]) -> Column:
    """0 to BUCKETS - 1 by three hexadecimal digits of the columns' digest."""
    texts = [F.coalesce(quoted(c).cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 3), 16, 10).cast("int")


def shard_records(df: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep columns and key of each row, with shard, its slot there (gapless from 0) and, if grown
    weights are given, the shard it would have with those.

    Slots need no task that holds a shard: a shard's rows are dealt to BUCKETS buckets by hash,
    numbered inside them, and offset by the counts of the buckets before; they depend on the rows
    alone, not on the cluster. Rows that are equal in key
    and keep are counted, numbered as one run and spread again, so a key that many rows share is no
    hot group. Null keys are one key; empty input gives no rows; other columns, whatever their names,
    are not read.
    """
    keep = [c for c in (keep or []) if c != key]
    cols = [key, *keep]
    base = df.select(
        F.struct(*map(quoted, cols)).alias("row"),
        rendezvous(quoted(key), weights).cast("int").alias("shard"),
        (rendezvous(quoted(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        _bucket(cols).alias("bucket"),
    )
    # written, as both steps below read them: every row is hashed once
    runs = written(base.groupBy("row", "shard", "grown_shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "runs")
    # at most shards x BUCKETS rows, whatever the input
    sums = runs.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    start = F.col("offset") + F.col("first")
    return numbered.withColumn("slot", F.explode(F.sequence(start, start + F.col("n") - 1))).select("row.*", "shard", "slot", "grown_shard")
