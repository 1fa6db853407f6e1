"""Pairs: positives, negative candidates, and their exact numbers without making them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import durations, names

#: Partitions over which a gender's enrollment clips are dealt, as gender alone has two keys.
SALT = 32


def _side(df: DataFrame, side: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def gender_of(speaker: Column) -> Column:
    return names.gender_code(speaker)


COLUMNS = ("clip_id", "speaker_id", "meeting_id", "mic_type", "duration_cs")


def positive_trials(enroll: DataFrame, test: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """All pairs of an enroll and a test clip of the same speaker, with diff_cs, null if a duration is.

    An equi-join on the speaker: speakers with many clips are split by the adaptive skew join."""
    e, t = _side(enroll, "enroll", columns), _side(test, "test", columns)
    return e.join(t, e["enroll_speaker_id"] == t["test_speaker_id"]).withColumn("diff_cs", durations.abs_diff_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs")))


def negative_candidates(enroll: DataFrame, test: DataFrame, other_meeting: bool = True, salt: int = SALT, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Pairs of clips of different speakers of the same gender and, unless told otherwise, different
    meetings; rows without speaker, meeting or duration take no part.

    Two genders are two join keys, so enroll clips are dealt over `salt` values and test clips copied
    to each: salt x 2 keys of equal size."""
    ok = "speaker_id is not null and meeting_id is not null and duration_cs is not null"
    e = _side(enroll.where(ok), "enroll", columns).withColumns({"gender": gender_of(F.col("enroll_speaker_id")), "salt": F.pmod(F.xxhash64("enroll_clip_id"), F.lit(salt)).cast("int")})
    t = _side(test.where(ok), "test", columns).withColumns({"gender": gender_of(F.col("test_speaker_id")), "salt": F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))})
    apart = F.col("enroll_speaker_id") != F.col("test_speaker_id")
    if other_meeting:
        apart &= F.col("enroll_meeting_id") != F.col("test_meeting_id")
    return e.join(t, ["gender", "salt"]).where(apart).drop("salt").withColumn("diff_cs", durations.abs_diff_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs")))


def disjointness(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Speakers and meetings that both sides have (none, if the split is right)."""
    return enroll_counts.select("speaker_id", "meeting_id").intersect(test_counts.select("speaker_id", "meeting_id"))


def _by_meeting(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    e = enroll_counts.select("speaker_id", "meeting_id", F.col("ihm").alias("e_ihm"))
    t = test_counts.select("speaker_id", "meeting_id", F.col("ihm").alias("t_ihm"), F.col("sdm").alias("t_sdm"))
    return e.join(t, ["speaker_id", "meeting_id"], "full").na.fill(0, ["e_ihm", "t_ihm", "t_sdm"])


def meeting_breakdown(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Clips of each speaker and meeting on both sides, and which side the meeting is on."""
    both = (F.col("e_ihm") > 0) & (F.col("t_ihm") + F.col("t_sdm") > 0)
    return _by_meeting(enroll_counts, test_counts).withColumn("side", F.when(both, "both").when(F.col("e_ihm") > 0, "enroll").otherwise("test"))


def count_positives(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Exact positive pairs of each speaker from counts alone: all, within a meeting (excluded), and
    the rest by test microphone. Takes speaker_meeting_mic() of both sides."""
    m = _by_meeting(enroll_counts, test_counts)
    sums = m.groupBy("speaker_id").agg(F.sum("e_ihm").alias("e"), F.sum("t_ihm").alias("ti"), F.sum("t_sdm").alias("ts"), F.sum(F.col("e_ihm") * F.col("t_ihm")).alias("same_i"), F.sum(F.col("e_ihm") * F.col("t_sdm")).alias("same_s"))
    raw = F.col("e") * (F.col("ti") + F.col("ts"))
    same = F.col("same_i") + F.col("same_s")
    return sums.select("speaker_id", raw.alias("raw"), same.alias("same_meeting"), (raw - same).alias("positives"), (F.col("e") * F.col("ti") - F.col("same_i")).alias("ihm_ihm"), (F.col("e") * F.col("ts") - F.col("same_s")).alias("ihm_sdm"))


def count_negatives(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Exact negative pairs of each gender from counts alone: raw (different speakers), excluded (same
    meeting), surviving.

    Different speakers are all pairs less the same speaker's; of each meeting, all pairs less the same
    speaker's. So sums by speaker, meeting and gender suffice and no speakers are paired."""
    m = _by_meeting(enroll_counts, test_counts).select(gender_of(F.col("speaker_id")).alias("gender"), "speaker_id", "meeting_id", F.col("e_ihm").alias("e"), (F.col("t_ihm") + F.col("t_sdm")).alias("t")).where("gender is not null")
    product = lambda df, *keys: df.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("t").alias("t")).groupBy("gender").agg(F.sum(F.col("e") * F.col("t")).alias("p"))
    parts = {"all_pairs": ["gender"], "own": ["gender", "speaker_id"], "meeting": ["gender", "meeting_id"], "own_meeting": ["gender", "speaker_id", "meeting_id"]}
    out = None
    for name, keys in parts.items():
        one = product(m, *keys).withColumnRenamed("p", name)
        out = one if out is None else out.join(one, "gender")
    raw, excluded = F.col("all_pairs") - F.col("own"), F.col("meeting") - F.col("own_meeting")
    return out.select("gender", raw.alias("raw"), excluded.alias("excluded"), (raw - excluded).alias("surviving"))


def acquaintance(enroll_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Of each gender the unordered pairs of speakers: those that share a meeting between one's enroll
    and the other's test side (teammates), and the others (strangers)."""
    e = enroll_counts.where("ihm > 0").select("speaker_id", "meeting_id").distinct()
    t = test_counts.where("ihm + sdm > 0").select("speaker_id", "meeting_id").distinct()
    a, b = e.select(F.col("speaker_id").alias("a"), "meeting_id"), t.select(F.col("speaker_id").alias("b"), "meeting_id")
    met = a.join(b, "meeting_id").where(gender_of(F.col("a")) == gender_of(F.col("b"))).where("a <> b")
    teams = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy(gender_of(F.col("a")).alias("gender")).agg(F.count(F.lit(1)).alias("teammate_pairs"))
    people = e.select("speaker_id").union(t.select("speaker_id")).distinct().groupBy(gender_of(F.col("speaker_id")).alias("gender")).agg(F.count(F.lit(1)).alias("n")).where("gender is not null")
    total = F.expr("n * (n - 1) div 2")
    return people.join(teams, "gender", "left").na.fill(0, ["teammate_pairs"]).select("gender", "teammate_pairs", (total - F.col("teammate_pairs")).alias("stranger_pairs"))
