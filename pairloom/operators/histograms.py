"""Histograms, quantile bins and percentile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning
from . import ranks


def limits(df: DataFrame, x: str) -> tuple[Column, Column]:
    """The least and the largest value as constants (null without values): one aggregate, whose single
    row needs no join."""
    row = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    return F.lit(row["lo"]).cast("double"), F.lit(row["hi"]).cast("double")


def equal_width(df: DataFrame, x: str, n: int = 50) -> DataFrame:
    """index, lower, upper, width and count of n bins over [min, max], the last closed; empty bins too,
    but no bins without values."""
    lo, hi = limits(df, x)
    v = F.col(x).cast("double")
    counts = df.select(binning.width_bin(v, lo, hi, n).alias("index")).where("index is not null").groupBy("index").agg(F.count(F.lit(1)).alias("count"))
    step = (hi - lo) / n
    frame = df.sparkSession.range(n).select(F.col("id").cast("int").alias("index")).where(lo.isNotNull())
    bins = frame.select("index", F.round(lo + step * F.col("index"), 4).alias("lower"), F.round(lo + step * (F.col("index") + 1), 4).alias("upper"), F.round(step, 4).alias("width"))
    return bins.join(counts, "index", "left").na.fill(0, ["count"])


def equal_count(df: DataFrame, x: str, n: int = 20) -> DataFrame:
    """index, lower, upper, width and count of bins between the percentiles at k/n; equal percentiles
    are one edge, so there may be fewer than n bins."""
    values = ranks.value_counts(df, x)
    edges = sorted({e for e in ranks.at(values, [k / n for k in range(n + 1)]) if e is not None})
    counts = values.groupBy(binning.edge_bin(F.col("v"), F.array(*map(F.lit, edges)).cast("array<double>")).alias("index")).agg(F.sum("n").alias("count"))
    bins = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "index int, a double, b double")
    bins = bins.select("index", F.round("a", 4).alias("lower"), F.round("b", 4).alias("upper"), F.round(F.col("b") - F.col("a"), 4).alias("width"))
    return bins.join(counts, "index", "left").na.fill(0, ["count"])


def percentile_grid(df: DataFrame, x: str, step: int = 5) -> DataFrame:
    """percentile and value at 1, step, 2 step ... 99, exact and interpolated."""
    at = sorted({1, *range(step, 100, step), 99})
    found = ranks.percentiles(df, x, [p / 100 for p in at])
    return df.sparkSession.createDataFrame(list(zip(at, found)), "percentile int, value double").withColumn("value", F.round("value", 6))


def moments(df: DataFrame, x: str) -> DataFrame:
    """n, mean, stdev, min, max and the exact median of a column's values."""
    v = F.col(x).cast("double")
    median = ranks.percentiles(df, x, [0.5])[0]
    return df.agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.lit(median).cast("double"), 6).alias("median"))


def by_bin_and_mic(df: DataFrame, x: str, n: int, mic: Column) -> DataFrame:
    """Counts of each equal-width bin by microphone: index, ihm_ihm_count, ihm_sdm_count, total_count."""
    lo, hi = limits(df, x)
    binned = df.select(binning.width_bin(F.col(x).cast("double"), lo, hi, n).alias("index"), mic.alias("mic"))
    return binned.where("index is not null").groupBy("index").agg(F.count_if(F.col("mic") == "ihm").alias("ihm_ihm_count"), F.count_if(F.col("mic") == "sdm").alias("ihm_sdm_count"), F.count(F.lit(1)).alias("total_count"))


def check_bins(bins: DataFrame, mics: DataFrame) -> DataFrame:
    """Bins whose count is not the sum over microphones."""
    return bins.join(mics, "index", "left").select("index", "count", F.coalesce(F.col("ihm_ihm_count") + F.col("ihm_sdm_count"), F.lit(0)).alias("mic_count")).where("count <> mic_count")


def aligned_bins(bins: DataFrame, mics: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """bins with mic counts joined on index; edges that differ by more than the tolerance are an error
    at read time."""
    other = mics.select("index", F.col("lower").alias("l"), F.col("upper").alias("u"), *[c for c in mics.columns if c not in ("index", "lower", "upper")])
    joined = bins.join(other, "index")
    ok = (F.abs(F.col("lower") - F.col("l")) <= tolerance) & (F.abs(F.col("upper") - F.col("u")) <= tolerance)
    return joined.withColumn("index", F.when(ok, F.col("index")).otherwise(F.raise_error(F.lit("bin edges differ")).cast("int"))).drop("l", "u")


def density(df: DataFrame, x: str, n: int = 50, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """index, lower, upper and density of n bins between two percentiles; the densities of the values
    inside sum to one over the bins' widths."""
    values = ranks.value_counts(df, x)
    found = ranks.at(values, [low, high])
    lo, hi = (F.lit(b).cast("double") for b in found)
    counts = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(binning.width_bin(F.col("v"), lo, hi, n).alias("index")).agg(F.sum("n").alias("n"))
    step = (hi - lo) / n
    # n bins at most, so one window over all of them
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("index", F.round(lo + step * F.col("index"), 6).alias("lower"), F.round(lo + step * (F.col("index") + 1), 6).alias("upper"), F.round(F.col("n") / (total * step), 6).alias("density"))
