"""Corpus profiles: counts, durations, text, demographics, leakage and feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text

ENROLL_MIN_CS, TEST_LOW_CS, TEST_HIGH_CS, ENROLL_NEEDED = 450, 180, 320, 6
UNKNOWN = 30


def counts_by(df: DataFrame, *dims: str) -> DataFrame:
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def token_by_folder(df: DataFrame, token: str, folder: str, folders: list[str]) -> DataFrame:
    """Counts of each token, a column a folder; the folders are given, so no extra pass finds them."""
    return df.groupBy(token).pivot(folder, folders).count().na.fill(0, folders)


def top_tokens(df: DataFrame, token: str, n: int = UNKNOWN) -> DataFrame:
    """The n commonest tokens, ties by name: partial counts, then a bounded top-k."""
    return counts_by(df, token).orderBy(F.desc("n"), token).limit(n)


def flags(df: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def duration_summary(df: DataFrame, cs: str) -> DataFrame:
    x = F.col(cs)
    return df.agg(F.count(x).alias("n"), F.round(F.sum(x) / 360_000, 6).alias("hours"), F.round(F.avg(x) / 100, 6).alias("mean_s"), F.round(F.median(x) / 100, 6).alias("median_s"), F.round(F.stddev_pop(x) / 100, 6).alias("stdev_s"), (F.min(x) / 100).alias("min_s"), (F.max(x) / 100).alias("max_s"))


def hours_by(df: DataFrame, cs: str, *dims: str) -> DataFrame:
    return df.groupBy(*dims).agg(F.round(F.sum(cs) / 360_000, 6).alias("hours"))


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(name) for name, c in columns.items()])


def text_summary(df: DataFrame, body: str, *dims: str) -> DataFrame:
    stats = df.select(*dims, text.text_stats(F.col(body)).alias("t"))
    return stats.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.word_count").cast("long")).alias("total_words"), F.round(F.avg("t.word_count"), 6).alias("mean_words"), F.median("t.word_count").alias("median_words"), F.sum(F.col("t.char_count").cast("long")).alias("total_chars"))


def crosstab(df: DataFrame, split: str, attributes: list[str], speaker: str) -> DataFrame:
    """Utterances and distinct speakers by attribute value, per split and overall (split null), for all
    attributes at once.

    Rows are first counted by speaker, so the distinct counts see one row a speaker, split and value."""
    pairs = df.select(split, speaker, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("a"))
    small = pairs.groupBy("a.attribute", "a.value", split, speaker).agg(F.count(F.lit(1)).alias("n"))
    each = small.groupBy("attribute", "value", split).agg(F.sum("n").alias("utterances"), F.count(speaker).alias("speakers"))
    overall = small.groupBy("attribute", "value").agg(F.sum("n").alias("utterances"), F.countDistinct(speaker).alias("speakers"))
    return each.unionByName(overall.withColumn(split, F.lit(None).cast(dict(df.dtypes)[split])))


def crosscheck(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row: keys compared, keys in which the measures differ or one side lacks, and whether all agree."""
    left, right = a.select(*keys, F.struct(*measures).alias("left")), b.select(*keys, F.struct(*measures).alias("right"))
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(right[k])
        condition = same if condition is None else condition & same
    joined = left.join(right, condition, "full")
    differ = ~F.col("left").eqNullSafe(F.col("right"))
    return joined.agg(F.count(F.lit(1)).alias("compared"), F.count_if(differ).alias("different"), (F.count_if(differ) == 0).alias("equal"))


def leakage(df: DataFrame, split: str, speaker: str) -> DataFrame:
    """Speakers that occur in several splits, by pair of splits."""
    by = df.select(split, speaker).distinct()
    a, b = by.select(F.col(split).alias("split_a"), speaker), by.select(F.col(split).alias("split_b"), speaker)
    return a.join(b, speaker).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared_speakers"))


def feasibility(df: DataFrame, split: str, mic: str, speaker: str, cs: str) -> DataFrame:
    """Per split: speakers by microphone, those with enough clips long enough to enroll, and how many
    clips of test length these have."""
    by = df.groupBy(split, mic, speaker).agg(F.count_if(F.col(cs) >= ENROLL_MIN_CS).alias("e"), F.count_if(F.col(cs).between(TEST_LOW_CS, TEST_HIGH_CS)).alias("t"))
    fit = F.col("e") >= ENROLL_NEEDED
    return by.groupBy(split).agg(F.count(F.lit(1)).alias("conditions"), F.count_if(fit).alias("eligible"), F.sum(F.when(fit, F.col("t")).otherwise(0)).alias("test_pool"))


def known_mics(df: DataFrame, mic: str) -> DataFrame:
    """Rows of the two microphones, trimmed and lower-cased."""
    return df.withColumn(mic, F.lower(F.trim(mic))).where(F.col(mic).isin("ihm", "sdm"))


def speaker_meeting_mic(df: DataFrame, speaker: str = "speaker_id", meeting: str = "meeting_id", mic: str = "mic_type") -> DataFrame:
    """Clips of each speaker and meeting by microphone, columns ihm and sdm."""
    return known_mics(df.where(F.col(speaker).isNotNull() & F.col(meeting).isNotNull()), mic).groupBy(speaker, meeting).agg(F.count_if(F.col(mic) == "ihm").alias("ihm"), F.count_if(F.col(mic) == "sdm").alias("sdm"))


def undecodable(df: DataFrame, speaker: str) -> DataFrame:
    """Speakers whose id does not say what speaker ids say, with their rows: they are left out of splits
    and counts by gender."""
    return df.where(F.col(speaker).isNotNull() & names.decode_speaker(F.col(speaker)).isNull()).groupBy(speaker).agg(F.count(F.lit(1)).alias("n"))
