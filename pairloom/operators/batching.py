"""Batches of clips of like length for a model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CS = 5


def plan_batches(clips: DataFrame, key: str = "clip_id", cs: str = "duration_cs", max_items: int = 16, max_cs: int = 24_000, partitions: int | None = None) -> DataFrame:
    """key, cs, shard and batch: clips by rising duration, cut so that a batch has at most max_items
    clips and items times the longest is at most max_cs (a single longer clip is a batch).

    Clips are range-partitioned by duration and each range is cut on its own, streaming: as neighbours
    have like length, a range adds at most one short batch."""
    n = partitions or int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = clips.select(F.col(key).alias("key"), F.coalesce(F.col(cs), F.lit(0)).cast("int").alias("cs"))
    ordered = rows.repartitionByRange(n, "cs", "key").sortWithinPartitions("cs", "key").withColumn("shard", F.spark_partition_id())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = items = 0
        for frame in frames:
            numbers = []
            for d in frame["cs"]:
                if items and (items >= max_items or (items + 1) * max(d, LEAST_CS) > max_cs):
                    batch, items = batch + 1, 0
                items += 1
                numbers.append(batch)
            yield frame.assign(batch=numbers)

    kind = dict(clips.dtypes)[key]
    return ordered.mapInPandas(cut, f"key {kind}, cs int, shard int, batch int").withColumnRenamed("key", key).withColumnRenamed("cs", cs)


def padding_waste(batches: DataFrame, cs: str = "duration_cs") -> DataFrame:
    """Batches, clips, and the percent of padded time that holds no signal."""
    each = batches.groupBy("shard", "batch").agg(F.max(cs).alias("longest"), F.count(F.lit(1)).alias("n"), F.sum(cs).alias("used"))
    padded = F.sum(F.col("longest") * F.col("n"))
    return each.agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("clips"), F.round(100 * F.try_divide(padded - F.sum("used"), padded), 2).alias("waste_percent"))
