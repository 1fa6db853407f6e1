"""What several operators share: reading tables, Arrow batches by key."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions as the session is sized for its data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], name: str) -> str:
    """name, or name with underscores after it, so that no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low or f"{name}_key".lower() in low:
        name += "_"
    return name


def replayable(df: DataFrame, name: str) -> DataFrame:
    """df if its rows come from files in an order that a repeated task gives again; if they come out of an
    exchange, whose order may change, df as a written table."""
    return written(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def binary(column: pa.ChunkedArray | pa.Array) -> list:
    """A string column's values as UTF-8 bytes (None for null)."""
    return column.cast(pa.binary()).to_pylist()


def short(batches: Iterable[pa.RecordBatch], text: int | str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut where their texts pass another `most` bytes: what is made of
    the texts is held for so many at a time. A longer text is whole in a batch; nulls count as empty."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = (np.flatnonzero(np.diff(upto // most)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with what the worker has freed given back to the system at the task's end:
    Spark keeps workers, and what they hold on to counts beside the steps that use no Python."""

    def run_and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run_and_give_back


def rounds(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Batches sorted by key, as (key, slices with that key): only one key's slices are held."""
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != now:
                yield now, held
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held
