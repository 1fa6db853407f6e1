"""Values to bins. None of these is a range join: a bin is computed from the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width_bin(x: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """The bin 0 to n-1 of equal width over [lo, hi], the last one closed; values below go to bin 0,
    values above hi to none."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    step = F.floor((x - lo) * n / (hi - lo)).cast("int")
    inside = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(F.when(hi > lo, step), F.lit(0))))
    return F.when(x <= hi, inside)


def edge_bin(x: Column, edges: Column) -> Column:
    """The bin of sorted edges [e0, e1), ..., [e(n-1), en]: below e0 bin 0, above en none."""
    last = F.size(edges) - 2
    below = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.when(x <= F.element_at(edges, -1), F.greatest(F.lit(0), F.least(last, below)))


def bucket_index(x: Column, edges: list[int]) -> Column:
    """How many edges are at or below x: buckets [e(k-1), ek), open at both ends. A chain of comparisons
    that stays in generated code."""
    chain = F.when(x < edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        chain = chain.when(x < e, k)
    return chain.when(x.isNotNull(), len(edges))


def bucket_label(x: Column, edges: list[int], labels: list[str]) -> Column:
    """The label of bucket_index()."""
    chain = F.when(x < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        chain = chain.when(x < e, label)
    return chain.when(x.isNotNull(), labels[-1])


def score_bin(score: Column, lo: Column | float, hi: Column | float, n: int = 20_000) -> Column:
    """The score's bin of n over [lo, hi]; scores outside go to the first or last bin."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((score - lo) / (hi - lo) * n).cast("int")))
