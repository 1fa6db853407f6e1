"""Dictionary encoding of paths and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import durations
from ..storage import n_partitions, written


def path_dictionary(*columns: tuple[DataFrame, str], partitions: int | None = None) -> DataFrame:
    """path_id and path: dense ids from 0 by sorted distinct path.

    The distinct paths are cut into ranges and written once with the number of their range; numbers
    inside a range are offset by the counts of those before, so no task sees all paths."""
    paths = None
    for df, c in columns:
        one = df.select(F.col(c).alias("path"))
        paths = one if paths is None else paths.unionByName(one)
    return dense_ids(paths.where("path is not null").distinct(), "path", "path_id", partitions).withColumn("path_id", F.col("path_id").cast("int"))


def dense_ids(df: DataFrame, column: str, name: str, partitions: int | None = None) -> DataFrame:
    """name and column: numbers from 0 by rising value of a column of distinct values. Ranges as in
    path_dictionary()."""
    spark = df.sparkSession
    ranged = df.select(column).repartitionByRange(partitions or n_partitions(spark), column)
    ranges = written(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    offsets, before = [], 0
    for part, n in sorted(tuple(r) for r in ranges.groupBy("part").agg(F.count(F.lit(1))).collect()):  # a row a range
        offsets.append((part, before))
        before += n
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column))
    start = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    return ranges.withColumn("rank", inside).join(start, "part").select((F.col("offset") + F.col("rank") - 1).alias(name), column)


def encode_trials(trials: DataFrame, dictionary: DataFrame, largest_cs: int | None = None) -> DataFrame:
    """enroll_id, test_id and duration_diff_cs (-1 for missing, in the smallest type that holds the
    largest difference) of trials with enroll_path, test_path and diff_cs. A path that the dictionary
    lacks is an error at read time of its row."""
    if largest_cs is None:
        largest_cs = trials.agg(F.max("diff_cs")).first()[0] or 0
    out = trials
    for side in ("enroll", "test"):
        ids = dictionary.select(F.col("path_id").alias(f"{side}_id"), F.col("path").alias(f"{side}_path"))
        out = out.join(ids, f"{side}_path", "left").withColumn(f"{side}_id", F.coalesce(F.col(f"{side}_id"), F.raise_error(F.concat(F.lit("no id for "), F.col(f"{side}_path"))).cast("int")))
    return out.select("enroll_id", "test_id", durations.to_sentinel(F.col("diff_cs")).cast(durations.narrow_type(largest_cs)).alias("duration_diff_cs"))


def decode_trials(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    out = encoded.withColumn("diff_cs", durations.from_sentinel(F.col("duration_diff_cs").cast("int")))
    for side in ("enroll", "test"):
        out = out.join(dictionary.select(F.col("path_id").alias(f"{side}_id"), F.col("path").alias(f"{side}_path")), f"{side}_id")
    return out.select("enroll_path", "test_path", "diff_cs")


def unknown_paths(df: DataFrame, dictionary: DataFrame, path: str) -> DataFrame:
    """Rows whose path has no id; must be empty before rows are encoded."""
    return df.join(dictionary.select(F.col("path").alias(path)), path, "left_anti")


def compression(encoded_bytes: int, text_bytes: int) -> float:
    return round(text_bytes / encoded_bytes, 1) if encoded_bytes else 0.0
