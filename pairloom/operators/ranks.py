"""Exact order statistics without a task that sees all values.

Values are counted, the distinct ones range-partitioned and written with the number of their range. The
counts of the ranges, as many as there are partitions, say which few ranges hold the ranks that are
asked for, and only those are walked.

Where the likely range of the values is known and rows are cheap to make again, nothing of them need be
written: spans() counts them by equal parts of that range, and only values of the parts that hold the
ranks are counted one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import n_partitions, written

#: Parts that span() cuts a range into.
SPANS = 8192


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """v, n and part: the distinct values of x as doubles, how often they occur, and the number of their
    range; ranges follow the values. Nulls and NaN take no part."""
    v = F.col(x).cast("double")
    counts = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.repartitionByRange(n_partitions(df.sparkSession), "v").withColumn("part", F.spark_partition_id()), "values")


def at(counts: DataFrame, shares: list[float]) -> list[float | None]:
    """The percentiles at these shares (0 to 1) of value_counts(), interpolated between neighbours; None
    without values."""
    sums = sorted((r["part"], r["n"]) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return [None] * len(shares)
    places, ranks = _places(total, shares)
    value = _values(counts, sums, ranks)
    return [_between(value[math.floor(p)], value[math.ceil(p)], p - math.floor(p)) for p in places]


def _places(total: int, shares: list[float]) -> tuple[list[float], list[int]]:
    """The shares as places among that many values, and the ranks beside them."""
    places = [s * (total - 1) for s in shares]
    return places, sorted({r for p in places for r in (math.floor(p), math.ceil(p))})


def _values(counts: DataFrame, sums: list[tuple[int, int]], ranks: list[int]) -> dict[int, float]:
    """The values of these ranks of value_counts(), given the sums of its parts in order."""
    wanted, before = [], 0
    for part, n in sums:
        wanted += [(part, before, r) for r in ranks if before <= r < before + n]
        before += n
    parts = {p: b for p, b, _ in wanted}
    walked = counts.where(F.col("part").isin(sorted(parts))).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    # of each wanted rank the one value whose run holds it: at most as many rows as ranks
    hits = [(F.col("part") == p) & (F.col("upto") > r - b) & (F.col("upto") - F.col("n") <= r - b) for p, b, r in wanted]
    found = [(r["part"], r["upto"], r["n"], r["v"]) for r in walked.where(_any(hits)).collect()]
    return {r: next(v for part, upto, n, v in found if part == p and upto - n <= r - b < upto) for p, b, r in wanted}


def span(v: Column, low: float, high: float) -> Column:
    """The part, 0 to SPANS - 1, of [low, high] that a value (neither null nor NaN) lies in; values
    outside belong to the first or last part. Parts follow the values."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.greatest(F.floor(share * SPANS), F.lit(0)), F.lit(SPANS - 1)).cast("int")


def narrowed(df: DataFrame, x: str, shares: list[float], low: float, high: float) -> list[float | None]:
    """Exact percentiles of a column, of which most values lie between low and high.

    Rows are read twice. The first time they are counted by part, with each part's least and greatest
    value; the second time values of the parts that hold the wanted ranks are counted one by one. A wrong
    guess of the range costs work and changes no result, as all values of a part would be counted then."""
    v = F.col(x).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = rows.groupBy(span(F.col("v"), low, high).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    total = sum(p["n"] for p in parts)
    if not total:
        return [None] * len(shares)
    places, ranks = _places(total, shares)
    value, before, held = {}, 0, []
    for p in sorted(parts, key=lambda p: p["k"]):
        own = [r - before for r in ranks if before <= r < before + p["n"]]
        if own and p["lo"] == p["hi"]:
            value |= {r + before: p["lo"] for r in own}
        elif own:
            held.append((before, p, own))
        before += p["n"]
    if held:
        counts = value_counts(rows.where(_any([F.col("v").between(p["lo"], p["hi"]) for _, p, _ in held])), "v")
        for before, p, own in held:
            mine = counts.where(F.col("v").between(p["lo"], p["hi"]))
            sums = sorted((r["part"], r["n"]) for r in mine.groupBy("part").agg(F.sum("n").alias("n")).collect())
            value |= {r + before: x for r, x in _values(mine, sums, own).items()}
    return [_between(value[math.floor(p)], value[math.ceil(p)], p - math.floor(p)) for p in places]


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _between(low: float, high: float, share: float) -> float:
    return low if low == high else low * (1 - share) + high * share


def percentiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column."""
    return at(value_counts(df, x), shares)
