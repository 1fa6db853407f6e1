"""Evaluation speakers and the division of each speaker's meetings into enroll and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_per_group(df: DataFrame, group: str, sizes: dict[str, int], order: Column, tie: str) -> DataFrame:
    """Exactly sizes[g] rows of each group g (all, if it has fewer), by an order that depends on the row
    alone. Each group is a bounded top-k."""
    parts = [df.where(F.col(group) == g).orderBy(order, tie).limit(k) for g, k in sorted(sizes.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remainder(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def meeting_split(clips: DataFrame, speaker: str = "speaker_id", meeting: str = "meeting_id") -> DataFrame:
    """speaker, meeting, n_meetings and side: of a speaker's n distinct meetings in alphabetical order
    the first half (rounded down) is 'enroll', the rest 'test'. Speakers of one meeting are left out.

    The window sees one row a speaker and meeting, never the clips."""
    meetings = clips.where(F.col(speaker).isNotNull() & F.col(meeting).isNotNull()).select(speaker, meeting).distinct()
    ranked = meetings.withColumn("rank", F.row_number().over(Window.partitionBy(speaker).orderBy(meeting))).withColumn("n_meetings", F.count(F.lit(1)).over(Window.partitionBy(speaker)))
    side = F.when(F.col("rank") <= F.floor(F.col("n_meetings") / 2), "enroll").otherwise("test")
    return ranked.where("n_meetings >= 2").select(speaker, meeting, F.col("n_meetings").cast("long").alias("n_meetings"), side.alias("side"))


def dropped_speakers(clips: DataFrame, speaker: str = "speaker_id", meeting: str = "meeting_id") -> DataFrame:
    """Speakers that meeting_split() leaves out, with the reason."""
    by = clips.groupBy(speaker).agg(F.countDistinct(meeting).alias("n_meetings"))
    return by.where("n_meetings < 2").withColumn("reason", F.format_string("only %d meeting(s)", "n_meetings"))


def side_rows(clips: DataFrame, split: DataFrame, side: str, mics: tuple[str, ...], speaker: str = "speaker_id", meeting: str = "meeting_id", mic: str = "mic_type") -> DataFrame:
    """Clips of the given microphones in the speaker's meetings on that side."""
    return clips.where(F.col(mic).isin(*mics)).join(split.where(F.col("side") == side).select(speaker, meeting), [speaker, meeting], "left_semi")


def enroll_rows(clips: DataFrame, split: DataFrame) -> DataFrame:
    """Enrollment clips: headset only."""
    return side_rows(clips, split, "enroll", ("ihm",))


def test_rows(clips: DataFrame, split: DataFrame) -> DataFrame:
    """Test clips: headset and distant microphone."""
    return side_rows(clips, split, "test", ("ihm", "sdm"))


def split_detail(clips: DataFrame, split: DataFrame, speaker: str = "speaker_id", meeting: str = "meeting_id") -> DataFrame:
    """A row a speaker: number of meetings, both sides' meetings joined, and their numbers of clips."""
    lists = split.groupBy(speaker).agg(
        F.first("n_meetings").alias("n_meetings"),
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col(meeting)))), ", ").alias(f"{s}_meetings") for s in ("enroll", "test")],
    )
    rows = None
    for side, frame in (("enroll", enroll_rows(clips, split)), ("test", test_rows(clips, split))):
        counted = frame.groupBy(speaker).agg(F.count(F.lit(1)).alias(f"{side}_row_count"))
        rows = counted if rows is None else rows.join(counted, speaker, "full")
    return lists.join(rows, speaker, "left").na.fill(0, ["enroll_row_count", "test_row_count"])
