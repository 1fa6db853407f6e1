"""Equal-error rates, exact and from histograms, and density curves."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning
from ..storage import n_partitions, written
from . import ranks
from .features import dimension

BINS = 20_000
MIN_TRIALS = 50
KDE_VALUES = 65_536


def _cumulative(keys: list[str], order: str, descending: bool = False) -> Window:
    by = F.desc(order) if descending else F.asc(order)
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def eer_exact(trials: DataFrame, score: str, target: str, *keys: str, buckets: int | None = None, likely: tuple[float, float] | None = None) -> DataFrame:
    """keys, n_target, n_nontarget, eer and threshold of each group of scored trials (target: boolean).

    Scores are walked from the highest, of equal ones targets first; after each trial the false-accept
    and false-reject rates are compared, and the first step where they are nearest gives their mean.
    Null and NaN scores take no part; a group without both kinds has null rates.

    No task sees all trials of a group: they are counted by distinct score, and these are range-
    partitioned by group and falling score, so that each range, a bucket of the walk, holds a like
    number of scores however they lie. The counts are written once with their bucket, as several steps
    read them. The difference of the rates only rises along the walk, so it changes sign in one bucket,
    and only that bucket's scores are walked; inside one score the walk is two straight lines, whose
    nearest integers are computed.

    With the likely range of the scores trials are read twice, and only those of one part of that range
    are counted by score: see _narrowed()."""
    keys = list(keys)
    rows = trials.select(*keys, F.col(score).cast("double").alias("s"), F.col(target).alias("t")).where("s is not null and not isnan(s) and t is not null")
    counts = _narrowed(rows, keys, *likely) if likely else _by_score(rows, keys)
    ranged = counts.repartitionByRange(buckets or n_partitions(trials.sparkSession), *keys, F.desc("s"))
    counts = written(ranged.withColumn("bucket", F.spark_partition_id()), "scores")
    sums = counts.groupBy(*keys).agg(F.sum("a").alias("nt"), F.sum("b").alias("nn"))
    on = keys
    joined = counts.join(sums, on) if on else counts.join(F.broadcast(sums))
    marked = joined.where("nt > 0 and nn > 0")
    totals = marked.groupBy(*keys, "bucket", "nt", "nn").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = _cumulative(keys, "bucket")
    walked = totals.withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w)})
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of counts may pass 64 bits
    gap = wide(F.col("tb")) * wide(F.col("nt")) - wide(F.col("nt") - F.col("ta")) * wide(F.col("nn"))
    # the first bucket after which the difference is not negative holds the crossing; the step just
    # before it is the last of an earlier bucket that has trials, so that one's last score comes along
    first = walked.where(gap >= 0).groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("ta") - F.col("a")).alias("pa"), (F.col("tb") - F.col("b")).alias("pb"))).alias("f"))
    before = walked.where(gap < 0).groupBy(*keys).agg(F.max("bucket").alias("last"))
    edge = first.join(before, on, "left") if on else first.join(F.broadcast(before), how="left")
    near = marked.join(edge, on) if on else marked.join(F.broadcast(edge))
    inside = near.where(F.col("bucket") == F.col("f.bucket"))
    w = _cumulative(keys, "s", True)
    inside = inside.withColumns({"pa": F.col("f.pa") + F.sum("a").over(w) - F.col("a"), "pb": F.col("f.pb") + F.sum("b").over(w) - F.col("b")})
    cols = [*keys, "s", "a", "b", "pa", "pb", "nt", "nn"]
    steps = inside.select(*cols)
    tail = near.where(F.col("bucket") == F.col("last")).groupBy(*keys, "nt", "nn").agg(F.min(F.struct("s")).alias("m"), F.first("f").alias("f"))
    tail = tail.select(*keys, F.col("m.s").alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("f.pa").alias("pa"), F.col("f.pb").alias("pb"), "nt", "nn")
    ends = steps.unionByName(tail)
    # a score's own steps accept something of it; the tail stands for its bucket's last step
    best = ends.select(*keys, "nt", "nn", "s", "a", "b", "pa", "pb", F.explode(_nearest_steps()).alias("p")).where("p.t + p.n > pa + pb or a + b = 0")
    distance = F.abs(wide(F.col("p.n")) * wide(F.col("nt")) - wide(F.col("nt") - F.col("p.t")) * wide(F.col("nn")))
    rate = (F.try_divide(F.col("p.n"), F.col("nn")) + F.try_divide(F.col("nt") - F.col("p.t"), F.col("nt"))) / 2
    best = best.where("p.t + p.n > 0").select(*keys, F.struct(distance.alias("d"), (F.col("p.t") + F.col("p.n")).alias("step"), rate.alias("eer"), F.col("s").alias("threshold")).alias("x")).groupBy(*keys).agg(F.min("x").alias("x"))
    out = sums.join(best, on, "left") if on else sums.join(F.broadcast(best), how="left")
    ok = (F.col("nt") > 0) & (F.col("nn") > 0)
    return out.select(*keys, F.col("nt").alias("n_target"), F.col("nn").alias("n_nontarget"), F.when(ok, F.col("x.eer")).alias("eer"), F.when(ok, F.col("x.threshold")).alias("threshold"))


def _by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "s").agg(F.count_if(F.col("t")).alias("a"), F.count_if(~F.col("t")).alias("b"))


def _narrowed(rows: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Counts by score as the walk needs them, of rows (keys, s, t): the trials of each part of the range
    [low, high] count at its least score, but for the part of each group after which the difference of the
    rates is first not negative, which is counted score by score.

    The nearest step is in that part or is the last step before it, which is the last step of a part: one
    at its least score. Scores outside the range belong to its first or last part, so a wrong guess
    costs work and changes no result."""
    keyed = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    parts = rows.groupBy(*keys, ranks.span(F.col("s"), low, high).alias("k")).agg(F.count_if(F.col("t")).alias("a"), F.count_if(~F.col("t")).alias("b"), F.min("s").alias("s"), F.max("s").alias("top"))
    parts = written(parts, "parts")
    w, whole = _cumulative(keys, "k", True), Window.partitionBy(*keys)
    walked = parts.withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w), "nt": F.sum("a").over(whole), "nn": F.sum("b").over(whole)})
    wide = lambda c: c.cast("decimal(19,0)")
    over = wide(F.col("tb")) * wide(F.col("nt")) >= wide(F.col("nt") - F.col("ta")) * wide(F.col("nn"))
    edge = walked.where(over).groupBy(*keys).agg(F.max(F.struct("k", "s", "top")).alias("e"))
    edge = edge.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("e.k").alias("__k"), F.col("e.s").alias("__low"), F.col("e.top").alias("__top"))
    edge = dimension(written(edge, "edges"), 64)
    on = lambda *more: functools.reduce(Column.__and__, [*keyed, *more])
    rest = parts.join(edge, on(F.col("k") == F.col("__k")), "left_anti").select(*keys, "s", "a", "b")
    return rest.unionByName(_by_score(rows.join(edge, on(F.col("s").between(F.col("__low"), F.col("__top"))), "left_semi"), keys))


def _nearest_steps() -> Column:
    """Steps (t targets, n others accepted) of one score's two lines that may be nearest: the whole
    numbers around each line's zero, and the lines' ends."""
    nt, nn, a, b, pa, pb = (F.col(c) for c in ("nt", "nn", "a", "b", "pa", "pb"))
    root_a = nt - F.try_divide(pb * nt.cast("double"), nn) - pa  # targets of this score to accept for equal rates
    root_b = F.try_divide((nt - pa - a) * nn.cast("double"), nt) - pb
    some = lambda root, most: F.array(*[F.greatest(F.lit(0), F.least(most, F.floor(root) + k)).cast("long") for k in (-1, 0, 1, 2)], most)
    first = F.transform(some(root_a, a), lambda i: F.struct((pa + F.greatest(i, F.least(F.lit(1), a))).alias("t"), pb.alias("n")))
    second = F.transform(some(root_b, b), lambda j: F.struct((pa + a).alias("t"), (pb + j).alias("n")))
    return F.concat(first, second)


def score_range(trials: DataFrame, score: str, low: float = 0.0001, high: float = 0.9999, likely: tuple[float, float] | None = None) -> DataFrame:
    """lo and hi, one row: two exact percentiles over all scores but null and NaN ones. With the likely
    range of the scores trials are read twice and not counted by score."""
    found = ranks.narrowed(trials, score, [low, high], *likely) if likely else ranks.percentiles(trials, score, [low, high])
    return trials.sparkSession.createDataFrame([tuple(found)], "lo double, hi double")


def score_histogram(trials: DataFrame, score: str, target: str, bounds: DataFrame, groupings: list[list[str]], bins: int = BINS) -> DataFrame:
    """grouping, the groupings' columns (null where not part of one), bin, hp and hn: counts of targets
    and others, for all groupings in one pass over the trials."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    binned = trials.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).join(F.broadcast(bounds)).select(*columns, binning.score_bin(F.col(score), F.col("lo"), F.col("hi"), bins).alias("bin"), F.col(target).alias("t"))
    # counted once at the finest level; the groupings are then sums over counts
    fine = binned.groupBy(*columns, "bin").agg(F.count_if(F.col("t")).alias("hp"), F.count_if(~F.col("t")).alias("hn"))
    out = None
    for k, g in enumerate(groupings):
        kept = fine
        for c in g:
            kept = kept.where(F.col(c).isNotNull())
        one = kept.groupBy(*g, "bin").agg(F.sum("hp").alias("hp"), F.sum("hn").alias("hn"))
        one = one.select(F.lit(k).alias("grouping"), *[F.col(c) if c in g else F.lit(None).cast(dict(fine.dtypes)[c]).alias(c) for c in columns], "bin", "hp", "hn")
        out = one if out is None else out.unionByName(one)
    return out


def eer_histogram(hist: DataFrame, bounds: DataFrame, keys: list[str], bins: int = BINS, at_least: int = MIN_TRIALS) -> DataFrame:
    """keys, n_genuine, n_impostor, eer, median_genuine and median_impostor of each group's histogram.

    The walk starts before the first bin, where nothing is rejected; empty bins change nothing, so only
    bins with trials are walked (at most `bins` rows a group). Groups with fewer than at_least trials of
    either kind have null rates. The histogram is written first, as it is read twice and its trials must
    not be."""
    hist = written(hist.select(*keys, "bin", "hp", "hn"), "histogram")
    start = hist.select(*keys).distinct().select(*keys, F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("hp"), F.lit(0).cast("long").alias("hn"))
    rows = hist.unionByName(start)
    w, whole = _cumulative(keys, "bin"), Window.partitionBy(*keys)
    walked = rows.withColumns({"cp": F.sum("hp").over(w), "cn": F.sum("hn").over(w), "p": F.sum("hp").over(whole), "n": F.sum("hn").over(whole)})
    frr, far = F.col("cp") / F.col("p"), 1 - F.col("cn") / F.col("n")
    both = (F.col("p") > 0) & (F.col("n") > 0)
    walked = walked.withColumns({"frr": F.when(both, frr), "far": F.when(both, far)})
    gap = F.abs(F.col("cp") * F.col("n") - (F.col("n") - F.col("cn")) * F.col("p"))
    half = lambda c, total: F.min(F.when((F.col("bin") >= 0) & (F.col(c) * 2 >= F.col(total)), F.col("bin")))
    out = walked.groupBy(*keys).agg(F.max("p").alias("n_genuine"), F.max("n").alias("n_impostor"), F.min_by(F.struct("far", "frr"), F.struct(gap, F.col("bin"))).alias("x"), half("cp", "p").alias("mp"), half("cn", "n").alias("mn")).join(F.broadcast(bounds))
    enough = (F.col("n_genuine") >= at_least) & (F.col("n_impostor") >= at_least)
    middle = lambda m: F.when(enough, F.round(F.col("lo") + (F.col(m) + 0.5) * (F.col("hi") - F.col("lo")) / bins, 6))
    return out.select(*keys, "n_genuine", "n_impostor", F.when(enough, F.round((F.col("x.far") + F.col("x.frr")) / 2, 6)).alias("eer"), middle("mp").alias("median_genuine"), middle("mn").alias("median_impostor"))


def eer_table(trials: DataFrame, score: str, target: str, bucket: str, bounds: DataFrame, mic: str = "mic", bins: int = BINS, at_least: int = MIN_TRIALS) -> DataFrame:
    """EER by bucket and microphone: for each bucket and for all ('all'), each microphone and both
    ('overall'), from one histogram."""
    known = trials.where(F.col(bucket).isNotNull() & F.col(mic).isNotNull())
    hist = score_histogram(known, score, target, bounds, [[bucket, mic]], bins)
    return eer_histogram(_rolled(hist, [bucket, mic]), bounds, [bucket, mic], bins, at_least)


def _rolled(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram with each key also summed over ('all' for the first, 'overall' for the last)."""
    for c in keys:
        over = "overall" if c == keys[-1] else "all"
        hist = hist.withColumn(c, F.explode(F.array(F.col(c), F.lit(over))))
    return hist.groupBy(*keys, "bin").agg(F.sum("hp").alias("hp"), F.sum("hn").alias("hn"))


def eer_overall(trials: DataFrame, score: str, target: str, bounds: DataFrame, mic: str = "mic", bins: int = BINS, at_least: int = MIN_TRIALS) -> DataFrame:
    """EER by microphone and over both."""
    hist = score_histogram(trials.where(F.col(mic).isNotNull()), score, target, bounds, [[mic]], bins)
    return eer_histogram(_rolled(hist, [mic]), bounds, [mic], bins, at_least)


def eer_matrix(trials: DataFrame, score: str, target: str, enroll: str, test: str, bounds: DataFrame, mic: str = "mic", bins: int = BINS, at_least: int = MIN_TRIALS) -> DataFrame:
    """EER by enroll and test bucket and microphone, both microphones as 'overall'."""
    known = trials.where(F.col(enroll).isNotNull() & F.col(test).isNotNull() & F.col(mic).isNotNull())
    hist = score_histogram(known, score, target, bounds, [[enroll, test, mic]], bins).withColumn(mic, F.explode(F.array(F.col(mic), F.lit("overall"))))
    hist = hist.groupBy(enroll, test, mic, "bin").agg(F.sum("hp").alias("hp"), F.sum("hn").alias("hn"))
    return eer_histogram(hist, bounds, [enroll, test, mic], bins, at_least)


def kde(df: DataFrame, x: str, points: int = 400, low: float = 0.005, high: float = 0.995, start: float | None = None) -> DataFrame:
    """grid and density of a Gaussian kernel estimate, bandwidth stdev * n ** -0.2, on an even grid
    between two percentiles (or from start).

    Equal values are counted first. Up to KDE_VALUES distinct ones the estimate is exact; of more, those
    in each KDE_VALUES-th of the range count at their mean, so work is bounded by KDE_VALUES times points
    whatever the number of rows, and the estimate differs by less than the kernel does over such a step.
    Each task sums its part; no rows give no grid."""
    values = ranks.value_counts(df, x)
    lo, hi = ranks.at(values, [low, high])
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    n, distinct, first, last, centre = values.agg(F.sum("n"), F.count(F.lit(1)), F.min("v"), F.max("v"), mean).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "i int, grid double, density double")
    sd = values.agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("v") - F.lit(centre), F.lit(2.0))) / n)).first()[0]
    h = sd * n**-0.2 if sd > 0 else 1e-6
    lo = lo if start is None else start
    if distinct > KDE_VALUES:
        step = F.floor((F.col("v") - first) / (last - first) * KDE_VALUES)
        values = values.groupBy(step.alias("step")).agg(mean.alias("v"), F.sum("n").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + F.lit(hi - lo) * i / (points - 1))
    z = (F.col("grid") - F.col("v")) / h
    summed = values.select("v", "n", F.posexplode(at).alias("i", "grid")).groupBy("i", "grid").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("s"))
    return summed.select("i", F.round("grid", 6).alias("grid"), F.round(F.col("s") / (n * h * 2.5066282746310002), 6).alias("density"))
