"""Agreement of two file sets, transcripts for files, and plans of file moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def parity(a: DataFrame, b: DataFrame, key: str, path: str) -> DataFrame:
    """key, a_path, b_path and state ('pair', 'only_a', 'only_b') of each key."""
    left, right = a.select(key, F.col(path).alias("a_path")), b.select(key, F.col(path).alias("b_path"))
    state = F.when(F.col("a_path").isNull(), "only_b").when(F.col("b_path").isNull(), "only_a").otherwise("pair")
    return left.join(right, key, "full").withColumn("state", state)


def parity_totals(states: DataFrame) -> DataFrame:
    return states.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("pair", "pairs"), ("only_a", "orphans_a"), ("only_b", "orphans_b"))])


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("r")).select(key, *[f"r.{c}" for c in others])


def with_transcripts(files: DataFrame, annotations: DataFrame, key: str, order: str) -> DataFrame:
    """Files with the transcript of their key; of several annotations of a key the last holds."""
    return files.join(last_by_key(annotations, key, order), key)


def strict_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a joined to b, a row of a without one being an error at read time."""
    marked = a.join(b.withColumn("__found", F.lit(True)), key, "left")
    checked = F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast(dict(a.dtypes)[key]))
    return marked.withColumn(key, checked).drop("__found")


def rename_plan(files: DataFrame, path: str, tag: str) -> DataFrame:
    """source, target and action ('rename' or 'skip') of files in the original name form."""
    folder, name = F.regexp_extract(path, "^(.*/)?[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    new = names.renamed(name, tag)
    return files.select(F.col(path).alias("source"), F.concat(folder, new).alias("target"), F.when(new.isNotNull(), "rename").otherwise("skip").alias("action"))


def move_plan(files: DataFrame, path: str, tag: str) -> DataFrame:
    """source, target and action ('move', 'keep' or 'skip') that put mic/split/.../name under
    mic/split/speaker."""
    place = r"(?i)^((?:.*/)?(?:ihm|sdm)/(?:train|dev|eval))/(?:.*/)?([^/]+)$"
    base, name = F.regexp_extract(path, place, 1), F.regexp_extract(path, place, 2)
    target = F.when(name != "", F.concat_ws("/", base, names.speaker_folder(name, tag), name))
    return files.select(F.col(path).alias("source"), target.alias("target"), F.when(target.isNull(), "skip").when(target == F.col(path), "keep").otherwise("move").alias("action"))


def empty_folders(folders: DataFrame, files: DataFrame, folder: str, path: str) -> DataFrame:
    """Folders without a file at any depth, deepest first."""
    used = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/")) - 1), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))).alias(folder)).distinct()
    return folders.join(used, folder, "left_anti").orderBy(F.desc(F.size(F.split(folder, "/"))), folder)


def quarantine_plan(states: DataFrame, folder: str) -> DataFrame:
    """Moves of files without a partner into a folder."""
    path = F.coalesce("a_path", "b_path")
    return states.where("state <> 'pair'").select(path.alias("source"), F.concat_ws("/", F.lit(folder), F.regexp_extract(path, "([^/]*)$", 1)).alias("target"), F.lit("move").alias("action"))


def standardise_plan(decoded: DataFrame, rate: int = 16_000) -> DataFrame:
    """Files that are not mono of the rate, with what would be converted."""
    return decoded.where("error is null").where((F.col("sample_rate") != rate) | (F.col("channels") != 1)).select(F.col("path").alias("source"), F.col("path").alias("target"), F.format_string("convert %d Hz, %d channel(s) to %d Hz mono", "sample_rate", "channels", F.lit(rate)).alias("action"))


def running_max(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(x, F.max(x).over(w))
