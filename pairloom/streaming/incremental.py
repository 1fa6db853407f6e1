"""Resumable processing: what succeeded is kept, what failed or is new is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Work = Callable[[DataFrame], DataFrame]


def succeeded(done: DataFrame, value: str, error: str = "error") -> DataFrame:
    """Rows without an error that have a value."""
    return done.where((F.coalesce(F.col(error), F.lit("")) == "") & F.col(value).isNotNull())


def todo(all_rows: DataFrame, done: DataFrame, key: str, value: str, error: str = "error") -> DataFrame:
    """Rows of all_rows whose key has not succeeded."""
    return all_rows.join(succeeded(done, value, error).select(key), key, "left_anti")


def errors(done: DataFrame, columns: list[str], error: str = "error") -> DataFrame:
    """The side table of failures."""
    return done.where(F.coalesce(F.col(error), F.lit("")) != "").select(*columns, error)


def latest(done: DataFrame, key: str, value: str, error: str = "error") -> DataFrame:
    """One row a key: a success if there is one (retries append, failures stay in the table)."""
    rank = F.struct(((F.coalesce(F.col(error), F.lit("")) == "") & F.col(value).isNotNull()).alias("ok"), *[c for c in done.columns if c != key])
    return done.groupBy(key).agg(F.max(rank).alias("best")).select(key, *[f"best.{c}" for c in done.columns if c != key])


def resume(all_rows: DataFrame, path: str, work: Work, key: str, value: str, error: str = "error") -> int:
    """Do what is left and append it to the table at path; the number of keys that were left."""
    spark = all_rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        all_rows = todo(all_rows, spark.read.parquet(path), key, value, error)
    left = all_rows.count()
    if left:
        work(all_rows).write.mode("append").parquet(path)
    return left


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, work: Work, key: str, file_format: str = "parquet"):
    """A stream that does new files of source once, appending to path; restarts from its checkpoint.

    Each batch is a partition `epoch` of the output that a retry after a failure writes anew, so its rows
    are there once, and no batch reads what earlier ones wrote. Of rows with one key in a batch one is
    done; a key that comes again in a later batch is done again, and latest() picks one. It ends when all
    files of now are done."""

    def batch(rows: DataFrame, epoch: int) -> None:
        out = work(rows.dropDuplicates([key])).withColumn("epoch", F.lit(epoch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    stream = spark.readStream.format(file_format).schema(schema).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
