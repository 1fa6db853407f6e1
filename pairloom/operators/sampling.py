"""Stratified samples of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

MODULUS = 2_147_483_647
SLICES = 4096


def order_key(*ids: Column, seed: int = 42) -> Column:
    """A pseudo-random number of integer ids by integer arithmetic alone, the same in any engine."""
    out = F.lit(seed)
    for k, i in enumerate(ids):
        out = (out * 48_271 + i.cast("long") * (1_000_003 if k == 0 else 7_919) + 1) % MODULUS
        out = (out * 16_807 + 12_345) % MODULUS
    return out


def targets(positives: DataFrame, strata: list[str], ratio: int) -> DataFrame:
    """target rows of each stratum: ratio times its positives."""
    return positives.groupBy(*strata).agg((F.count(F.lit(1)) * ratio).alias("target"))


def sample(candidates: DataFrame, targets: DataFrame, strata: list[str], order: Column, ties: list[str]) -> DataFrame:
    """Exactly min(target, seen) rows of each stratum of candidates, those of least order."""
    return draw(candidates, targets, strata, order, ties)[0]


def draw(candidates: DataFrame, targets: DataFrame, strata: list[str], order: Column, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """sample(), and the number of candidates seen in each stratum (strata and seen).

    order is a number in [0, MODULUS) that depends on the row alone. The candidates, which may come from
    a join that makes billions of them, are made once and written with their slice, one of SLICES of the
    order. Counts by stratum and slice, a small table, say which slices are taken whole and in which one
    the target ends; only that slice's rows are ranked, so no task sees a stratum."""
    key, slice_ = "__order", "__slice"
    keyed = candidates.withColumn(key, order)
    keyed = written(keyed.withColumn(slice_, F.floor(F.col(key) * F.lit(SLICES) / F.lit(MODULUS)).cast("int")), "candidates")
    counts = written(keyed.groupBy(*strata, slice_).agg(F.count(F.lit(1)).alias("n")), "slices")
    upto = F.sum("n").over(Window.partitionBy(*strata).orderBy(slice_))
    plan = counts.withColumn("before", upto - F.col("n")).join(targets, strata).where("before < target")
    plan = written(plan.select(*strata, slice_, F.when(F.col("before") + F.col("n") <= F.col("target"), None).otherwise(F.col("target") - F.col("before")).alias("__rest")), "plan")
    kept = keyed.join(plan, [*strata, slice_])
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(key, *ties))
    cut = kept.where("__rest is not null").withColumn("__rank", rank).where("__rank <= __rest")
    out = kept.where("__rest is null").select(*candidates.columns).unionByName(cut.select(*candidates.columns))
    return out, counts.groupBy(*strata).agg(F.sum("n").alias("seen"))


def report(targets: DataFrame, sample: DataFrame, seen: DataFrame, strata: list[str]) -> DataFrame:
    """Of each stratum: target, actual, shortfall, candidates seen (of draw())."""
    actual = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("actual"))
    out = targets.join(actual, strata, "left").join(seen.withColumnRenamed("seen", "candidates_seen"), strata, "left").na.fill(0, ["actual", "candidates_seen"])
    return out.withColumn("shortfall", F.greatest(F.lit(0), F.col("target") - F.col("actual")))


def outside(candidates: DataFrame, bin_: Column) -> DataFrame:
    """candidates and how many of them lie outside all bins, which a sample by bins leaves out."""
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(bin_.isNull()).alias("outside"))


def totals(report: DataFrame) -> DataFrame:
    return report.agg(*[F.sum(c).alias(c) for c in ("target", "actual", "shortfall", "candidates_seen")])


def ratio_deviation(report: DataFrame, ratio: int) -> DataFrame:
    """The largest distance of a stratum's negatives per positive from the ratio."""
    return report.where("target > 0").agg(F.round(F.max(F.abs(F.col("actual") * ratio / F.col("target") - ratio)), 6).alias("max_deviation"))


def take(df: DataFrame, n: int, order: Column, ties: list[str]) -> DataFrame:
    """n rows without replacement, for pictures and checks: a bounded top-k by the order."""
    return df.orderBy(order, *ties).limit(n)


def every(df: DataFrame, index: str, n: int = 5) -> DataFrame:
    """Every n-th row by its index."""
    return df.where(F.pmod(F.col(index), F.lit(n)) == 0)
