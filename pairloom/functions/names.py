"""Clip names, paths and identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name formats and codes.
STEM = r"^([a-zA-Z0-9]+)_([a-zA-Z0-9]+)_(train|dev|eval)_([a-zA-Z0-9]+)_([0-9]+)-([0-9]+)$"
STEM_WITHOUT_SEGMENT = r"^([a-zA-Z0-9]+)_([a-zA-Z0-9]+)_(train|dev|eval)_([a-zA-Z0-9]+)$"
GENDERS = {"f": "Female", "m": "Male"}
LOCATIONS = {"i": "Idiap", "e": "Edinburgh", "t": "TNO"}
LANGUAGES = {"e": "English", "d": "Dutch", "o": "Other"}
BROKEN_DISTANT_MEETINGS = ("IS1003b", "IS1007d")


def _group(column: Column, pattern: str, index: int) -> Column:
    """A group of the pattern, null where it does not match or the group is empty."""
    return F.nullif(F.regexp_extract(column, pattern, index), F.lit(""))


def _one_of(column: Column, values: dict[str, str]) -> Column:
    chain = F.lit(None).cast("string")
    for code, name in values.items():
        chain = F.when(column == code, name).otherwise(chain)
    return chain


def mic_canonical(code: Column) -> Column:
    """'sdm', 'ihm' for headset codes (h and digits, any case), else 'unknown_mic_code'."""
    return F.when(F.lower(code) == "sdm", "sdm").when(code.rlike("(?i)^h[0-9]+$"), "ihm").when(code.isNotNull(), "unknown_mic_code")


def headset_channel(code: Column) -> Column:
    return F.regexp_extract(code, "(?i)^h([0-9]+)$", 1).try_cast("int")


def meeting_series(meeting: Column) -> Column:
    return F.upper(F.substring(meeting, 1, 2))


def parse_stem(stem: Column) -> Column:
    """A struct of what a clip's stem says; null if the stem has neither form.

    Times are hundredths of a second, duration_from_name_s seconds to three places."""
    whole, short = stem.rlike(STEM), stem.rlike(STEM_WITHOUT_SEGMENT)

    def part(i: int) -> Column:
        return F.when(whole, F.regexp_extract(stem, STEM, i)).otherwise(F.regexp_extract(stem, STEM_WITHOUT_SEGMENT, i))

    begin, end = (_group(stem, STEM, i).try_cast("int") for i in (5, 6))
    code = part(4)
    fields = F.struct(
        part(1).alias("sid"),
        part(2).alias("meeting"),
        part(3).alias("split_in_name"),
        code.alias("miccode"),
        whole.alias("has_segment"),
        begin.alias("begin_i"),
        end.alias("end_i"),
        F.round((end - begin) / 100.0, 3).alias("duration_from_name_s"),
        F.coalesce(begin == end, F.lit(False)).alias("zero_duration"),
        meeting_series(part(2)).alias("meeting_series"),
        mic_canonical(code).alias("mic_canonical"),
        headset_channel(code).alias("headset_channel"),
    )
    return F.when(whole | short, fields)


def decode_speaker(sid: Column) -> Column:
    """Gender, location, language, number and role suffix of a speaker id; null if it is no such id."""
    low = F.lower(sid)
    gender, location, language = (_one_of(F.substring(low, i, 1), v) for i, v in ((1, GENDERS), (2, LOCATIONS), (3, LANGUAGES)))
    tail = F.substring(sid, 4, 1_000)
    known = gender.isNotNull() & location.isNotNull() & language.isNotNull() & tail.rlike("^[0-9]+[a-zA-Z]*$")
    fields = F.struct(gender.alias("gender"), location.alias("location"), language.alias("language"), F.regexp_extract(tail, "^([0-9]+)", 1).alias("number"), _group(tail, "^[0-9]+([a-zA-Z]*)$", 1).alias("role_suffix"))
    return F.when(known, fields)


def gender_code(sid: Column) -> Column:
    """'f', 'm' or null by the first letter, any case."""
    first = F.lower(F.substring(sid, 1, 1))
    return F.when(first.isin("f", "m"), first)


def shorten_path(path: Column, mic: Column) -> Column:
    """The path from its first '/mic/' on; unchanged without one."""
    at = F.instr(path, F.concat(F.lit("/"), mic, F.lit("/")))
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def mic_from_path(path: Column) -> Column:
    """'ihm' or 'sdm' by the folder in the path, else 'other'."""
    return F.when(path.contains("/ihm/"), "ihm").when(path.contains("/sdm/"), "sdm").when(path.isNotNull(), "other")


def _stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0)))


def agnostic_name(name: Column) -> Column:
    """A file name's stem without its fourth part, the microphone."""
    parts = F.split(_stem(name), "_")
    rest = F.concat(F.slice(parts, 1, 3), F.slice(parts, 5, 1_000))
    return F.when(F.size(parts) >= 4, F.concat_ws("_", rest)).otherwise(_stem(name))


def agnostic_key(path: Column) -> Column:
    """agnostic_name() under the file's folder; a name of fewer than four parts is left as it is."""
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    short = F.size(F.split(_stem(name), "_")) < 4
    return F.when(short, path).when(folder == "", agnostic_name(name)).otherwise(F.concat_ws("/", folder, agnostic_name(name)))


def annotation_key(utterance: Column, split: Column) -> Column:
    """The agnostic key of an annotation id (corpus_meeting_mic_speaker[_begin_end]); null under four parts."""
    parts = F.split(utterance, "_")
    base = F.concat_ws("_", F.lower(F.get(parts, F.lit(3))), F.lower(F.get(parts, F.lit(1))), split)
    segment = F.concat_ws("-", F.get(parts, F.lit(4)), F.get(parts, F.lit(5)))
    return F.when(F.size(parts) >= 6, F.concat_ws("_", base, segment)).when(F.size(parts) >= 4, base)


def _original(parts: Column, tag: str) -> Column:
    return (F.size(parts) >= 5) & (F.get(parts, F.lit(1)) == tag)


def renamed(name: Column, tag: str) -> Column:
    """New name of a file in the original form split_tag_meeting_mic_speaker[_begin_end].wav; null for
    any other form or number of parts."""
    parts = F.split(_stem(name), "_")
    base = F.concat_ws("_", *[F.get(parts, F.lit(i)) for i in (4, 2, 0, 3)])
    segment = F.concat_ws("-", F.get(parts, F.lit(5)), F.get(parts, F.lit(6)))
    new = F.when(F.size(parts) == 7, F.concat_ws("_", base, segment)).when(F.size(parts) == 5, base)
    return F.when(_original(parts, tag), F.concat(new, F.lit(".wav")))


def speaker_folder(name: Column, tag: str) -> Column:
    """The speaker in a file name of the original or the renamed form."""
    parts = F.split(_stem(name), "_")
    return F.when(_original(parts, tag), F.get(parts, F.lit(4))).otherwise(F.get(parts, F.lit(0)))


def parse_utterance(utterance: Column) -> Column:
    """Meeting, microphone, speaker, begin and end (seconds) of corpus_meeting_mic_speaker_begin_end;
    null unless it has six parts."""
    parts = F.split(utterance, "_")
    at = [F.get(parts, F.lit(i)) for i in range(6)]
    fields = F.struct(at[1].alias("meeting_id"), at[2].alias("microphone_id"), at[3].alias("speaker_id"), (at[4].try_cast("int") / 100).alias("begin_time"), (at[5].try_cast("int") / 100).alias("end_time"))
    return F.when(F.size(parts) == 6, fields)


def distant_utterance(utterance: Column) -> Column:
    """The id for the distant microphone: third part 'sdm'."""
    parts = F.split(utterance, "_")
    return F.concat_ws("_", F.slice(parts, 1, 2), F.lit("sdm"), F.slice(parts, 4, 1_000))


def audio_file_name(split: Column, utterance: Column) -> Column:
    return F.concat(F.concat_ws("_", split, F.lower(utterance)), F.lit(".wav"))


def resolve_path(root: str, stored: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(stored, F.lit("/")))


def archive_url(template: str, **parts: Column) -> Column:
    """A remote archive's address: '{name}' in the template becomes the column's value."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
