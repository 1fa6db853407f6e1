"""Transcript statistics and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))


def text_stats(text: Column) -> Column:
    words = text_words(text)
    return F.struct(F.length(text).alias("char_count"), F.size(words).alias("word_count"), F.size(F.array_distinct(F.transform(words, F.lower))).alias("unique_words"))


def split_annotation(line: Column) -> Column:
    """An annotation line as (utterance, transcript), split at its first space; null for a blank line."""
    trimmed = F.trim(line)
    parts = F.split(trimmed, " ", 2)
    return F.when(trimmed != "", F.struct(parts[0].alias("utterance"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("transcript")))


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def bucket_labels(edges: list[float], unit: str = "s") -> list[str]:
    """'<a', 'a-b' ..., '>=z' for the buckets that edges cut."""
    shown = [f"{e:g}" for e in edges]
    return [f"<{shown[0]}{unit}", *[f"{a}-{b}{unit}" for a, b in zip(shown, shown[1:])], f">={shown[-1]}{unit}"]


def _shown(x: Column, places: int, unit: str) -> Column:
    """A number with so many places, halves to the even digit, and a unit."""
    return F.format_string(f"%.{places}f{unit.replace('%', '%%')}", F.bround(x, places))


def human_size(n_bytes: Column) -> Column:
    """Bytes in the largest unit of 1024s with two places."""
    out = None
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        shown = _shown(n_bytes / float(1024**power), 2, f" {unit}")
        out = F.when(n_bytes >= 1024**power, shown) if out is None else out.when(n_bytes >= 1024**power, shown)
    return out.otherwise(F.format_string("%.2f B", n_bytes.cast("double")))


def short_count(n: Column) -> Column:
    """1234567 as 1.23M, 1234 as 1K, smaller numbers as they are."""
    return F.when(n >= 1_000_000, _shown(n / 1e6, 2, "M")).when(n >= 1_000, _shown(n / 1e3, 0, "K")).otherwise(n.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """Percent as text with one place, 'n/a' of nothing."""
    return F.when(whole != 0, _shown(part * 100.0 / whole, 1, "%")).otherwise("n/a")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def one_to(positives: Column, negatives: Column) -> Column:
    """'1 : n' with two places, null without positives."""
    return F.when(positives > 0, F.concat(F.lit("1 : "), _shown(negatives / positives.cast("double"), 2, "")))
