"""Tables between steps: written once to a folder that driver and executors share."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local
    session gets a temporary one; a cluster session without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        pass


def n_partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the session is sized for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file with these bytes, through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path is in the file system that Python opens files of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def put_files(rows: DataFrame, root: str) -> None:
    """A file below root for each of rows (path, from there, and content).

    In a local or mounted file system the tasks write them; elsewhere, as Python has no way to Spark's
    file system in a task, the driver does, some at a time. A file appears whole, and a task that runs
    again writes the same files."""
    spark, rows = rows.sparkSession, rows.select("path", "content")
    if not is_local(spark, root):
        with ThreadPoolExecutor(16) as pool:
            for some in itertools.batched(rows.toLocalIterator(), 256):
                list(pool.map(lambda r: put(spark, f"{root}/{r['path']}", r["content"]), some))
        return
    folder = root.removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at, _, last = f"{folder}/{name}".rpartition("/")
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                part = f"{at}/.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, f"{at}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    rows.mapInArrow(write, "n long").agg({"n": "sum"}).collect()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither recompute it nor depend on any
    one executor. The table goes when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
