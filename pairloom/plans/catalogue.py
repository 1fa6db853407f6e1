"""The registered queries over the analog tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning, durations, names, text, vectors
from ..operators import batching, encode, features, histograms, metrics, parity, profile, sampling, split, trials
from ..sources import files
from ..streaming import incremental
from . import stored  # noqa: F401  registers its queries
from .clips import clips, negatives, positives, scored, sides, table, utterances, with_
from .registry import QUERIES, SQL, query  # noqa: F401

# ---- names and manifests

_STEMS = """stems AS (SELECT regexp_extract(path, '([^/]+)[.]wav$', 1) AS good, clip_id, mic_type, native_split, speaker_id FROM clips),
all_stems AS (SELECT clip_id, mic_type AS mic_config, native_split AS split, speaker_id AS speaker_folder, CASE clip_id % 7 WHEN 0 THEN regexp_replace(good, '_[0-9]+-[0-9]+$', '')
  WHEN 1 THEN replace(good, '_sdm_', '_h03_') WHEN 2 THEN replace(good, '_', '-') WHEN 3 THEN replace(good, '_h00_', '_x1_') ELSE good END AS stem FROM stems)"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the clips, some without a segment, with other codes or broken."""
    good = F.regexp_extract("path", "([^/]+)[.]wav$", 1)
    kind = F.pmod("clip_id", F.lit(7))
    stem = F.when(kind == 0, F.regexp_replace(good, "_[0-9]+-[0-9]+$", "")).when(kind == 1, F.replace(good, F.lit("_sdm_"), F.lit("_h03_"))).when(kind == 2, F.replace(good, F.lit("_"), F.lit("-"))).when(kind == 3, F.replace(good, F.lit("_h00_"), F.lit("_x1_"))).otherwise(good)
    return clips(spark, sf_dir).select("clip_id", F.col("mic_type").alias("mic_config"), F.col("native_split").alias("split"), F.col("speaker_id").alias("speaker_folder"), stem.alias("stem"))


@query(
    with_("clips")
    + ", "
    + _STEMS
    + r""", p AS (SELECT *, regexp_extract(stem, '^([a-zA-Z0-9]+)_([a-zA-Z0-9]+)_(train|dev|eval)_([a-zA-Z0-9]+)(?:_([0-9]+)-([0-9]+))?$', ['sid', 'meeting', 'split_in_name', 'miccode', 'b', 'e']) AS g FROM all_stems
  WHERE regexp_full_match(stem, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)_(train|dev|eval)_([a-zA-Z0-9]+)(_[0-9]+-[0-9]+)?'))
SELECT clip_id, g.sid AS sid, g.meeting AS meeting, g.split_in_name AS split_in_name, g.miccode AS miccode, g.b <> '' AS has_segment, try_cast(g.b AS INT) AS begin_i, try_cast(g.e AS INT) AS end_i,
  round((try_cast(g.e AS INT) - try_cast(g.b AS INT)) / 100.0::DOUBLE, 3) AS duration_from_name_s, coalesce(try_cast(g.b AS INT) = try_cast(g.e AS INT), false) AS zero_duration, upper(substr(g.meeting, 1, 2)) AS meeting_series,
  CASE WHEN lower(g.miccode) = 'sdm' THEN 'sdm' WHEN regexp_full_match(g.miccode, '[hH][0-9]+') THEN 'ihm' ELSE 'unknown_mic_code' END AS mic_canonical,
  CASE WHEN regexp_full_match(g.miccode, '[hH][0-9]+') THEN try_cast(substr(g.miccode, 2) AS INT) END AS headset_channel,
  g.split_in_name = split AS split_matches_folder, CASE WHEN lower(g.miccode) = 'sdm' THEN 'sdm' WHEN regexp_full_match(g.miccode, '[hH][0-9]+') THEN 'ihm' ELSE 'unknown_mic_code' END = mic_config AS mic_matches_folder,
  lower(g.sid) = lower(speaker_folder) AS sid_matches_folder FROM p"""
)
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decode_manifest(_stems(spark, sf_dir)).where("parsed").drop("mic_config", "split", "speaker_folder", "stem", "parsed")


@query(with_("clips") + ", " + _STEMS + r" SELECT clip_id, stem FROM all_stems WHERE NOT regexp_full_match(stem, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)_(train|dev|eval)_([a-zA-Z0-9]+)(_[0-9]+-[0-9]+)?')")
def manifest_bad_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decode_manifest(_stems(spark, sf_dir)).where("not parsed").select("clip_id", "stem")


_IDS = "SELECT DISTINCT CASE l_suppkey % 5 WHEN 0 THEN 'x' || substr(speaker_id, 2) WHEN 1 THEN upper(speaker_id) WHEN 2 THEN speaker_id || 'pm' ELSE speaker_id END AS sid FROM utterances"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_IDS.replace("utterances", "{utterances}"), utterances=utterances(spark, sf_dir))


@query(
    with_("utterances", ids=_IDS)
    + r"""SELECT sid, CASE lower(sid[1]) WHEN 'f' THEN 'Female' WHEN 'm' THEN 'Male' END AS gender, CASE lower(sid[2]) WHEN 'i' THEN 'Idiap' WHEN 'e' THEN 'Edinburgh' WHEN 't' THEN 'TNO' END AS location,
  CASE lower(sid[3]) WHEN 'e' THEN 'English' WHEN 'd' THEN 'Dutch' WHEN 'o' THEN 'Other' END AS language, regexp_extract(sid[4:], '^([0-9]+)', 1) AS number, nullif(regexp_extract(sid[4:], '^[0-9]+([a-zA-Z]*)$', 1), '') AS role_suffix
  FROM ids WHERE regexp_full_match(sid, '[fmFM][ietIET][edoEDO][0-9]+[a-zA-Z]*')"""
)
def speaker_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).withColumn("d", names.decode_speaker(F.col("sid"))).where("d is not null").select("sid", "d.*")


@query(with_("utterances", ids=_IDS) + "SELECT CASE WHEN lower(sid[1]) IN ('f', 'm') THEN lower(sid[1]) END AS gender, count(*) AS n FROM ids GROUP BY 1")
def gender_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts_by(_ids(spark, sf_dir).select(names.gender_code(F.col("sid")).alias("gender")), "gender")


@query(
    with_("clips")
    + r"""SELECT clip_id, 'audio' || path AS stored, path AS short, mic_type AS mic, concat_ws('_', speaker_id, meeting_id, native_split, split_part(regexp_extract(path, '([^/]+)[.]wav$', 1), '_', 5)) AS agnostic,
  '/data' || path AS resolved FROM clips"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04 to P-07, P-14: short path, microphone, microphone-free key and resolved path."""
    stored = F.concat(F.lit("audio"), F.col("path"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return clips(spark, sf_dir).select("clip_id", stored.alias("stored"), names.shorten_path(stored, F.col("mic_type")).alias("short"), names.mic_from_path(stored).alias("mic"), names.agnostic_name(name).alias("agnostic"), names.resolve_path("/data/", F.col("path")).alias("resolved"))


_OLD = "concat_ws('_', native_split, 'corp', meeting_id, 'h00', speaker_id, lpad(CAST(clip_id AS VARCHAR(10)), 7, '0'), lpad(CAST(clip_id + duration_cs AS VARCHAR(10)), 7, '0')) || '.wav'"


@query(
    with_("clips")
    + f"""SELECT clip_id, CASE WHEN clip_id % 5 = 0 THEN 'odd.wav' ELSE {_OLD} END AS source, CASE WHEN clip_id % 5 <> 0 THEN concat_ws('_', speaker_id, meeting_id, native_split, 'h00',
  lpad(CAST(clip_id AS VARCHAR(10)), 7, '0') || '-' || lpad(CAST(clip_id + duration_cs AS VARCHAR(10)), 7, '0')) || '.wav' END AS target, CASE WHEN clip_id % 5 = 0 THEN 'skip' ELSE 'rename' END AS action,
  CASE WHEN clip_id % 5 = 0 THEN 'odd' ELSE speaker_id END AS folder FROM clips"""
)
def rename_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = clips(spark, sf_dir).selectExpr("clip_id", f"CASE WHEN clip_id % 5 = 0 THEN 'odd.wav' ELSE {_OLD} END AS source")
    plan = parity.rename_plan(old, "source", "corp")
    return old.join(plan.distinct(), "source").select("clip_id", "source", "target", "action", names.speaker_folder(F.col("source"), "corp").alias("folder"))


_UTT = "concat_ws('_', 'CORP', upper(meeting_id), 'H00', upper(speaker_id), lpad(CAST(clip_id AS VARCHAR(10)), 7, '0'), lpad(CAST(clip_id + duration_cs AS VARCHAR(10)), 7, '0'))"


@query(
    with_("clips", u=f"SELECT clip_id, native_split, meeting_id, speaker_id, duration_cs, {_UTT} AS utterance FROM clips")
    + """SELECT clip_id, utterance, upper(meeting_id) AS meeting_id, 'H00' AS microphone_id, upper(speaker_id) AS speaker_id, clip_id / 100 AS begin_time, (clip_id + duration_cs) / 100 AS end_time,
  replace(utterance, '_H00_', '_sdm_') AS distant, native_split || '_' || lower(utterance) || '.wav' AS file_name,
  concat_ws('_', speaker_id, meeting_id, native_split, lpad(CAST(clip_id AS VARCHAR(10)), 7, '0') || '-' || lpad(CAST(clip_id + duration_cs AS VARCHAR(10)), 7, '0')) AS agnostic FROM u"""
)
def transcript_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = clips(spark, sf_dir).selectExpr("clip_id", "native_split", f"{_UTT} AS utterance")
    return u.select("clip_id", "utterance", names.parse_utterance(F.col("utterance")).alias("p"), names.distant_utterance(F.col("utterance")).alias("distant"), names.audio_file_name(F.col("native_split"), F.col("utterance")).alias("file_name"), names.annotation_key(F.col("utterance"), F.col("native_split")).alias("agnostic")).select("clip_id", "utterance", "p.*", "distant", "file_name", "agnostic")


@query(
    """WITH w AS (SELECT lang, length(text) AS c, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS ws FROM documents)
SELECT lang, count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS total_words, round(avg(len(ws)), 6) AS mean_words, median(len(ws)) AS median_words, CAST(sum(c) AS BIGINT) AS total_chars FROM w GROUP BY lang"""
)
def text_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.text_summary(table(spark, sf_dir, "documents"), "text", "lang")


@query("SELECT doc_id, length(text) AS char_count, CAST(len(w) AS INT) AS word_count, CAST(len(list_distinct(w)) AS INT) AS unique_words FROM (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM documents)")
def text_stats_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.text_stats(F.col("text")).alias("t")).select("doc_id", "t.*")


# ---- durations and profiles


@query(
    with_("clips")
    + """SELECT clip_id, duration_cs AS cs, duration_cs / 100 AS seconds, CASE WHEN duration_cs > 0 THEN duration_cs END AS positive_cs,
  CASE WHEN duration_cs / 100 < 1 THEN '<1s (likely backchannel)' WHEN duration_cs / 100 < 3 THEN '1-3s' WHEN duration_cs / 100 < 10 THEN '3-10s' ELSE '>10s' END AS bucket,
  CASE WHEN clip_id % 2 = 0 THEN duration_cs / 100 ELSE (32044 - 44) / 32000.0::DOUBLE END AS guess_s, duration_cs AS from_text FROM clips"""
)
def duration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    path = F.col("path")
    named = F.when(F.col("clip_id") % 2 == 0, path).otherwise("other.wav")
    seconds = durations.duration_s(path)
    return c.select("clip_id", durations.duration_cs(path).alias("cs"), seconds.alias("seconds"), durations.positive_cs(path).alias("positive_cs"), durations.duration_bucket(seconds).alias("bucket"), durations.guess_duration_s(named, F.lit(32_044)).alias("guess_s"), durations.to_cs(F.format_string("%.2f", seconds)).alias("from_text"))


@query(with_("utterances") + "SELECT CASE WHEN duration_cs < 100 THEN '<1s (likely backchannel)' WHEN duration_cs < 300 THEN '1-3s' WHEN duration_cs < 1000 THEN '3-10s' ELSE '>10s' END AS bucket, count(*) AS n FROM utterances GROUP BY 1")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts_by(utterances(spark, sf_dir).select(durations.duration_bucket(durations.to_seconds(F.col("duration_cs"))).alias("bucket")), "bucket")


@query(with_("utterances") + "SELECT count(*) AS n, round(sum(duration_cs) / 360000, 6) AS hours, round(avg(duration_cs) / 100, 6) AS mean_s, round(median(duration_cs) / 100, 6) AS median_s, round(stddev_pop(duration_cs) / 100, 6) AS stdev_s, min(duration_cs) / 100 AS min_s, max(duration_cs) / 100 AS max_s FROM utterances")
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duration_summary(utterances(spark, sf_dir), "duration_cs")


@query(with_("utterances") + "SELECT native_split, mic_type, round(sum(duration_cs) / 360000, 6) AS hours FROM utterances GROUP BY ALL")
def hours_by_split_mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.hours_by(utterances(spark, sf_dir), "duration_cs", "native_split", "mic_type")


@query(with_("utterances") + "SELECT native_split, mic_type, meeting_id, count(*) AS n FROM utterances GROUP BY ALL")
def counts_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts_by(utterances(spark, sf_dir), "native_split", "mic_type", "meeting_id")


@query("SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS \"even\", count(*) FILTER (user_id % 2 = 1) AS \"odd\" FROM events GROUP BY 1")
def token_by_folder_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("folder", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return profile.token_by_folder(e, "event_type", "folder", ["even", "odd"])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 30")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_tokens(table(spark, sf_dir, "events"), "user_id")


@query(with_("utterances") + "SELECT count(*) AS n, count(*) FILTER (duration_cs < 100) AS short, count(*) FILTER (mic_type = 'sdm' AND native_split = 'dev') AS distant_dev, count(*) FILTER (duration_cs = 0) AS zero FROM utterances")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.flags(utterances(spark, sf_dir), short=F.col("duration_cs") < 100, distant_dev=(F.col("mic_type") == "sdm") & (F.col("native_split") == "dev"), zero=F.col("duration_cs") == 0)


@query(with_("utterances") + "SELECT count(DISTINCT speaker_id) AS speakers, count(DISTINCT meeting_id) AS meetings FROM utterances")
def distinct_speakers_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(utterances(spark, sf_dir), speakers="speaker_id", meetings="meeting_id")


_PEOPLE = "SELECT u.native_split, u.mic_type, u.speaker_id, left(u.speaker_id, 1) AS gender, n.n_name AS location, r.r_name AS language FROM utterances u JOIN supplier s ON u.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    sql = _PEOPLE.replace("FROM utterances u", "FROM {utterances} u").replace("JOIN supplier s", "JOIN {supplier} s").replace("JOIN nation n", "JOIN {nation} n").replace("JOIN region r", "JOIN {region} r")
    return spark.sql(sql, utterances=utterances(spark, sf_dir), **t)


@query(
    with_("utterances", people=_PEOPLE, long="SELECT native_split, speaker_id, unnest(['gender', 'location', 'language']) AS attribute, unnest([gender, location, language]) AS value FROM people")
    + "SELECT attribute, value, native_split, count(*) AS utterances, count(DISTINCT speaker_id) AS speakers FROM long GROUP BY GROUPING SETS ((attribute, value, native_split), (attribute, value))"
)
def demographics_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(_people(spark, sf_dir), "native_split", ["gender", "location", "language"], "speaker_id")


@query(
    with_("utterances", people=_PEOPLE, c="SELECT gender, mic_type, count(*) AS n, count(DISTINCT speaker_id) AS s FROM people GROUP BY ALL")
    + "SELECT count(*) AS compared, count(*) FILTER (a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s) AS different, count(*) FILTER (a.n IS DISTINCT FROM b.n OR a.s IS DISTINCT FROM b.s) = 0 AS equal FROM (SELECT * FROM c WHERE mic_type = 'ihm') a FULL JOIN (SELECT * FROM c WHERE mic_type = 'sdm') b ON a.gender = b.gender"
)
def demographics_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _people(spark, sf_dir).groupBy("gender", "mic_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_id").alias("s"))
    return profile.crosscheck(c.where("mic_type = 'ihm'"), c.where("mic_type = 'sdm'"), ["gender"], ["n", "s"])


@query(with_("utterances", d="SELECT DISTINCT native_split, speaker_id FROM utterances") + "SELECT a.native_split AS split_a, b.native_split AS split_b, count(*) AS shared_speakers FROM d a JOIN d b ON a.speaker_id = b.speaker_id AND a.native_split < b.native_split GROUP BY ALL")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leakage(utterances(spark, sf_dir), "native_split", "speaker_id")


@query(
    with_("utterances", d="SELECT native_split, mic_type, speaker_id, count(*) FILTER (duration_cs >= 450) AS e, count(*) FILTER (duration_cs BETWEEN 180 AND 320) AS t FROM utterances GROUP BY ALL")
    + "SELECT native_split, count(*) AS conditions, count(*) FILTER (e >= 6) AS eligible, CAST(coalesce(sum(t) FILTER (e >= 6), 0) AS BIGINT) AS test_pool FROM d GROUP BY 1"
)
def enroll_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feasibility(utterances(spark, sf_dir), "native_split", "mic_type", "speaker_id", "duration_cs")


# ---- splits

_EVAL = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender, (s_suppkey * 7919) % 104729 AS k FROM supplier"


def _eval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = spark.sql(_EVAL.replace("supplier", "{supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return s, split.sample_per_group(s, "gender", {"m": 7, "f": 3}, F.col("k"), "s_suppkey").select("s_suppkey", "gender")


_EVAL_SQL = f"WITH s AS ({_EVAL}), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY k, s_suppkey) AS r FROM s) WHERE r <= CASE gender WHEN 'm' THEN 7 ELSE 3 END) "


@query(_EVAL_SQL + "SELECT s_suppkey, gender FROM e")
def eval_speaker_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir)[1]


@query(_EVAL_SQL + "SELECT s_suppkey, gender FROM s ANTI JOIN e USING (s_suppkey)")
def train_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone, taken = _eval(spark, sf_dir)
    return split.remainder(everyone, taken, "s_suppkey").select("s_suppkey", "gender")


@query(with_("divided") + "SELECT * FROM divided")
def meeting_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.meeting_split(clips(spark, sf_dir))


@query(with_("utterances") + ", meetings AS (SELECT DISTINCT speaker_id, meeting_id FROM utterances), divided AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY meeting_id) AS r, count(*) OVER (PARTITION BY speaker_id) AS n FROM meetings) SELECT CASE WHEN r <= floor(n / 2) THEN 'enroll' ELSE 'test' END AS side, count(*) AS meetings, count(DISTINCT speaker_id) AS speakers FROM divided WHERE n >= 2 GROUP BY 1")
def meeting_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.meeting_split(utterances(spark, sf_dir)).groupBy("side").agg(F.count(F.lit(1)).alias("meetings"), F.countDistinct("speaker_id").alias("speakers"))


@query(
    with_("enroll", "test")
    + """SELECT d.speaker_id, any_value(n_meetings) AS n_meetings, string_agg(meeting_id, ', ' ORDER BY meeting_id) FILTER (side = 'enroll') AS enroll_meetings, string_agg(meeting_id, ', ' ORDER BY meeting_id) FILTER (side = 'test') AS test_meetings,
  (SELECT count(*) FROM enroll e WHERE e.speaker_id = d.speaker_id) AS enroll_row_count, (SELECT count(*) FROM test t WHERE t.speaker_id = d.speaker_id) AS test_row_count FROM divided d GROUP BY d.speaker_id"""
)
def split_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    return split.split_detail(c, split.meeting_split(c))


@query(with_("clips") + "SELECT speaker_id, count(DISTINCT meeting_id) AS n_meetings, 'only ' || count(DISTINCT meeting_id) || ' meeting(s)' AS reason FROM clips GROUP BY 1 HAVING count(DISTINCT meeting_id) < 2")
def dropped_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.dropped_speakers(clips(spark, sf_dir))


@query(with_("enroll") + "SELECT clip_id, path, speaker_id, meeting_id, mic_type FROM enroll")
def enroll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir)[0].select("clip_id", "path", "speaker_id", "meeting_id", "mic_type")


@query(with_("test") + "SELECT clip_id, path, speaker_id, meeting_id, mic_type FROM test")
def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir)[1].select("clip_id", "path", "speaker_id", "meeting_id", "mic_type")


# ---- parity and transcripts

_KEYED = "SELECT clip_id, path, mic_type, concat_ws('_', speaker_id, meeting_id, CAST(clip_id % 4 + clip_id // 8 * 4 AS VARCHAR(10)), CASE WHEN clip_id % 11 = 3 THEN mic_type END) AS k FROM clips"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_KEYED.replace("clip_id // 8", "clip_id div 8").replace("FROM clips", "FROM {clips}"), clips=clips(spark, sf_dir))


_PARITY = "p AS (SELECT coalesce(a.k, b.k) AS k, a.path AS a_path, b.path AS b_path, CASE WHEN a.path IS NULL THEN 'only_b' WHEN b.path IS NULL THEN 'only_a' ELSE 'pair' END AS state FROM (SELECT * FROM keyed WHERE mic_type = 'ihm') a FULL JOIN (SELECT * FROM keyed WHERE mic_type = 'sdm') b ON a.k = b.k)"


def _parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    return parity.parity(k.where("mic_type = 'ihm'"), k.where("mic_type = 'sdm'"), "k", "path")


@query(with_("clips", keyed=_KEYED) + ", " + _PARITY + " SELECT k, a_path, b_path, state FROM p")
def parity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parity(spark, sf_dir)


@query(with_("clips", keyed=_KEYED) + ", " + _PARITY + " SELECT count(*) FILTER (state = 'pair') AS pairs, count(*) FILTER (state = 'only_a') AS orphans_a, count(*) FILTER (state = 'only_b') AS orphans_b FROM p")
def parity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.parity_totals(_parity(spark, sf_dir))


@query(with_("clips", keyed=_KEYED) + ", " + _PARITY + " SELECT coalesce(a_path, b_path) AS source, 'quarantine/' || regexp_extract(coalesce(a_path, b_path), '([^/]*)$', 1) AS target, 'move' AS action FROM p WHERE state <> 'pair'")
def parity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.quarantine_plan(_parity(spark, sf_dir), "quarantine")


@query("SELECT l.doc_id, l.quality, arg_max(d.lang, d.doc_id) AS lang FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("at"), "lang")
    return parity.with_transcripts(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id", "at").select("doc_id", "quality", "lang")


@query("SELECT doc_id, d.doc_id IS NOT NULL AS has_wav, l.doc_id IS NOT NULL AS has_txt FROM documents d FULL JOIN (SELECT * FROM labels WHERE quality = 1) l USING (doc_id)")
def wav_txt_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"), F.lit(1).alias("length"))
    rows = row(table(spark, sf_dir, "documents"), "wav").unionByName(row(table(spark, sf_dir, "labels").where("quality = 1"), "txt"))
    return files.pair_files(rows, ["doc_id"]).drop("file_size_bytes")


# ---- trials


@query(with_("positives") + "SELECT enroll_clip_id, test_clip_id, diff_cs, mic FROM positives")
def positive_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positives(spark, sf_dir).select("enroll_clip_id", "test_clip_id", "diff_cs", "mic")


_COUNTS = {side: f"SELECT speaker_id, meeting_id, count(*) FILTER (mic_type = 'ihm') AS ihm, count(*) FILTER (mic_type = 'sdm') AS sdm FROM {side} GROUP BY ALL" for side in ("enroll", "test")}


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, t = sides(spark, sf_dir)
    return profile.speaker_meeting_mic(e), profile.speaker_meeting_mic(t)


@query(with_("positives") + "SELECT enroll_speaker_id AS speaker_id, count(*) AS raw, CAST(0 AS BIGINT) AS same_meeting, count(*) AS positives, count(*) FILTER (mic = 'ihm') AS ihm_ihm, count(*) FILTER (mic = 'sdm') AS ihm_sdm FROM positives GROUP BY 1")
def positive_counts_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.count_positives(*_counts(spark, sf_dir))


_HALVES = {"e": "SELECT speaker_id, meeting_id, count(*) AS ihm, CAST(0 AS BIGINT) AS sdm FROM utterances WHERE mic_type = 'ihm' GROUP BY ALL", "t": "SELECT speaker_id, meeting_id, count(*) FILTER (mic_type = 'ihm') AS ihm, count(*) FILTER (mic_type = 'sdm') AS sdm FROM utterances WHERE native_split <> 'dev' GROUP BY ALL"}


def _large_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = utterances(spark, sf_dir)
    return profile.speaker_meeting_mic(u.where("mic_type = 'ihm'")), profile.speaker_meeting_mic(u.where("native_split <> 'dev'"))


@query(
    with_("utterances", **_HALVES)
    + """, s AS (SELECT e.speaker_id, CAST(sum(ihm) AS BIGINT) AS e FROM e GROUP BY 1), r AS (SELECT speaker_id, CAST(sum(ihm) AS BIGINT) AS ti, CAST(sum(sdm) AS BIGINT) AS ts FROM t GROUP BY 1),
x AS (SELECT e.speaker_id, CAST(sum(e.ihm * t.ihm) AS BIGINT) AS si, CAST(sum(e.ihm * t.sdm) AS BIGINT) AS ss FROM e JOIN t ON e.speaker_id = t.speaker_id AND e.meeting_id = t.meeting_id GROUP BY 1),
j AS (SELECT speaker_id, coalesce(e, 0) AS e, coalesce(ti, 0) AS ti, coalesce(ts, 0) AS ts, coalesce(si, 0) AS si, coalesce(ss, 0) AS ss FROM s FULL JOIN r USING (speaker_id) LEFT JOIN x USING (speaker_id))
SELECT speaker_id, e * (ti + ts) AS raw, si + ss AS same_meeting, e * (ti + ts) - si - ss AS positives, e * ti - si AS ihm_ihm, e * ts - ss AS ihm_sdm FROM j"""
)
def positives_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.count_positives(*_large_counts(spark, sf_dir))


@query(with_("enroll", "test") + "SELECT count(*) AS shared FROM (SELECT speaker_id, meeting_id FROM enroll INTERSECT SELECT speaker_id, meeting_id FROM test)")
def disjointness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.disjointness(*_counts(spark, sf_dir)).agg(F.count(F.lit(1)).alias("shared"))


@query(with_("enroll", "test", ec=_COUNTS["enroll"], tc=_COUNTS["test"]) + "SELECT coalesce(ec.speaker_id, tc.speaker_id) AS speaker_id, coalesce(ec.meeting_id, tc.meeting_id) AS meeting_id, coalesce(ec.ihm, 0) AS e_ihm, coalesce(tc.ihm, 0) AS t_ihm, coalesce(tc.sdm, 0) AS t_sdm, CASE WHEN ec.ihm > 0 AND tc.ihm + tc.sdm > 0 THEN 'both' WHEN ec.ihm > 0 THEN 'enroll' ELSE 'test' END AS side FROM ec FULL JOIN tc ON ec.speaker_id = tc.speaker_id AND ec.meeting_id = tc.meeting_id")
def meeting_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.meeting_breakdown(*_counts(spark, sf_dir))


@query(with_("candidates") + "SELECT enroll_clip_id, test_clip_id, diff_cs, mic FROM candidates")
def negative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives(spark, sf_dir).select("enroll_clip_id", "test_clip_id", "diff_cs", "mic")


@query(
    with_("enroll", "test")
    + "SELECT left(e.speaker_id, 1) AS gender, count(*) AS raw, count(*) FILTER (e.meeting_id = t.meeting_id) AS excluded, count(*) FILTER (e.meeting_id <> t.meeting_id) AS surviving FROM enroll e JOIN test t ON left(e.speaker_id, 1) = left(t.speaker_id, 1) AND e.speaker_id <> t.speaker_id GROUP BY 1"
)
def negative_counts_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.count_negatives(*_counts(spark, sf_dir))


@query(
    with_("utterances", **_HALVES)
    + """, a AS (SELECT left(speaker_id, 1) AS gender, speaker_id, meeting_id, ihm AS n FROM e), b AS (SELECT left(speaker_id, 1) AS gender, speaker_id, meeting_id, ihm + sdm AS n FROM t),
g AS (SELECT a.gender, sum(a.n) AS e FROM a GROUP BY 1), h AS (SELECT b.gender, sum(b.n) AS t FROM b GROUP BY 1),
own AS (SELECT gender, sum(e * t) AS p FROM (SELECT gender, speaker_id, sum(n) AS e FROM a GROUP BY ALL) JOIN (SELECT gender, speaker_id, sum(n) AS t FROM b GROUP BY ALL) USING (gender, speaker_id) GROUP BY 1),
x AS (SELECT a.gender, sum(a.n * b.n) AS p FROM a JOIN b ON a.gender = b.gender AND a.meeting_id = b.meeting_id AND a.speaker_id <> b.speaker_id GROUP BY 1)
SELECT gender, CAST(e * t - own.p AS BIGINT) AS raw, CAST(x.p AS BIGINT) AS excluded, CAST(e * t - own.p - x.p AS BIGINT) AS surviving FROM g JOIN h USING (gender) JOIN own USING (gender) JOIN x USING (gender)"""
)
def negative_by_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.count_negatives(*_large_counts(spark, sf_dir))


@query(
    with_("enroll", "test")
    + """, met AS (SELECT DISTINCT least(e.speaker_id, t.speaker_id) AS a, greatest(e.speaker_id, t.speaker_id) AS b FROM enroll e JOIN test t ON e.meeting_id = t.meeting_id AND left(e.speaker_id, 1) = left(t.speaker_id, 1) AND e.speaker_id <> t.speaker_id),
people AS (SELECT left(speaker_id, 1) AS gender, count(*) AS n FROM (SELECT speaker_id FROM enroll UNION SELECT speaker_id FROM test) GROUP BY 1)
SELECT gender, coalesce(m, 0) AS teammate_pairs, n * (n - 1) // 2 - coalesce(m, 0) AS stranger_pairs FROM people LEFT JOIN (SELECT left(a, 1) AS gender, count(*) AS m FROM met GROUP BY 1) USING (gender)"""
)
def teammate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.acquaintance(*_counts(spark, sf_dir))


# ---- dictionary


def _pathed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.positive_trials(*sides(spark, sf_dir), columns=("speaker_id", "path", "duration_cs"))


_DICT = "SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS path_id, path FROM (SELECT enroll_path AS path FROM positives UNION SELECT test_path FROM positives)"


@query(with_("positives") + _DICT)
def path_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = sides(spark, sf_dir)
    shared = e.select("speaker_id").intersect(t.select("speaker_id"))
    return encode.path_dictionary(*[(x.join(shared, "speaker_id", "left_semi"), "path") for x in (e, t)])


@query(with_("positives", d=_DICT) + "SELECT a.path_id AS enroll_id, b.path_id AS test_id, CAST(diff_cs AS SMALLINT) AS duration_diff_cs FROM positives JOIN d a ON a.path = enroll_path JOIN d b ON b.path = test_path")
def encoded_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_trials(_pathed(spark, sf_dir), path_dictionary(spark, sf_dir))


@query(with_("positives") + "SELECT enroll_path, test_path, diff_cs FROM positives")
def encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = path_dictionary(spark, sf_dir)
    return encode.decode_trials(encode.encode_trials(_pathed(spark, sf_dir), d), d)


# ---- histograms

_WIDTH = """lo AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
hist AS (SELECT greatest(0, least({n} - 1, CAST(floor((x - lo) * {n} / (hi - lo)) AS INT))) AS index, count(*) AS n FROM v, lo GROUP BY 1)
SELECT i AS index, round(lo + (hi - lo) / {n} * i, 4) AS lower, round(lo + (hi - lo) / {n} * (i + 1), 4) AS upper, round((hi - lo) / {n}, 4) AS width, coalesce(n, 0) AS count FROM lo, (SELECT CAST(range AS INT) AS i FROM range({n})) LEFT JOIN hist ON i = hist.index"""
_V = "SELECT CAST(diff_cs AS DOUBLE) AS x FROM positives"


@query(with_("positives", v=_V) + ", " + _WIDTH.format(n=50))
def width_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.equal_width(positives(spark, sf_dir), "diff_cs", 50)


@query("WITH v AS (SELECT l_extendedprice AS x FROM lineitem), " + _WIDTH.format(n=50))
def width_hist_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.equal_width(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


_AT20 = "[" + ", ".join(str(k / 20) for k in range(21)) + "]"


@query(
    with_("positives", v=_V)
    + f""", q AS (SELECT list_sort(list_distinct(quantile_cont(x, {_AT20}))) AS e FROM v),
b AS (SELECT unnest(range(1, len(e))) AS i, e FROM q), hist AS (SELECT greatest(0, least(len(e) - 2, len(list_filter(e, lambda y: y <= x)) - 1)) AS index, count(*) AS n FROM v, q GROUP BY 1)
SELECT CAST(i - 1 AS INT) AS index, round(e[i], 4) AS lower, round(e[i + 1], 4) AS upper, round(e[i + 1] - e[i], 4) AS width, coalesce(n, 0) AS count FROM b LEFT JOIN hist ON hist.index = i - 1"""
)
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.equal_count(positives(spark, sf_dir), "diff_cs", 20)


_GRID = sorted({1, *range(5, 100, 5), 99})


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, [" + ", ".join(str(p / 100) for p in _GRID) + f"]) AS v FROM lineitem) SELECT unnest({_GRID}) AS percentile, round(unnest(v), 6) AS value FROM q")
def percentile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.percentile_grid(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(with_("positives", v=_V) + "SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS stdev, min(x) AS min, max(x) AS max, round(median(x), 6) AS median FROM v")
def diff_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.moments(positives(spark, sf_dir), "diff_cs")


_MIC_BINS = "SELECT greatest(0, least(49, CAST(floor((diff_cs - lo) * 50 / (hi - lo)) AS INT))) AS index, count(*) FILTER (mic = 'ihm') AS ihm_ihm_count, count(*) FILTER (mic = 'sdm') AS ihm_sdm_count, count(*) AS total_count FROM positives, (SELECT CAST(min(diff_cs) AS DOUBLE) AS lo, CAST(max(diff_cs) AS DOUBLE) AS hi FROM positives) GROUP BY 1"


@query(with_("positives") + _MIC_BINS)
def bin_mic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.by_bin_and_mic(positives(spark, sf_dir), "diff_cs", 50, F.col("mic"))


@query(
    with_("positives", m=_MIC_BINS)
    + """SELECT 'both microphones' AS compared, count(*) FILTER (total_count <> ihm_ihm_count + ihm_sdm_count) AS mismatches, CAST(coalesce(sum(abs(total_count - ihm_ihm_count - ihm_sdm_count)), 0) AS BIGINT) AS missing FROM m
UNION ALL SELECT 'headset only', count(*) FILTER (total_count <> ihm_ihm_count), CAST(sum(total_count - ihm_ihm_count) AS BIGINT) FROM m"""
)
def bin_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins against their sums over microphones, and against one microphone's, which must not add up."""
    p = positives(spark, sf_dir)
    bins, mics = histograms.equal_width(p, "diff_cs", 50), histograms.by_bin_and_mic(p, "diff_cs", 50, F.col("mic"))
    out = None
    for name, some in (("both microphones", mics), ("headset only", mics.withColumn("ihm_sdm_count", F.lit(0)))):
        wrong = histograms.check_bins(bins, some).agg(F.count(F.lit(1)).alias("mismatches"), F.coalesce(F.sum(F.abs(F.col("count") - F.col("mic_count"))), F.lit(0)).alias("missing"))
        one = wrong.select(F.lit(name).alias("compared"), "mismatches", "missing")
        out = one if out is None else out.unionByName(one)
    return out


# ---- sampling

_EDGES = "(SELECT CAST(min(diff_cs) AS DOUBLE) AS lo, CAST(max(diff_cs) AS DOUBLE) AS hi FROM positives)"
_ORDER = "((((42 * 48271 + enroll_clip_id * 1000003 + 1) % 2147483647 * 16807 + 12345) % 2147483647 * 48271 + test_clip_id * 7919 + 1) % 2147483647 * 16807 + 12345) % 2147483647"
_SAMPLING = {
    "bp": f"SELECT greatest(0, least(9, CAST(floor((diff_cs - lo) * 10 / (hi - lo)) AS INT))) AS bin, mic FROM positives, {_EDGES}",
    "goals": "SELECT bin, mic, count(*) * {ratio} AS target FROM bp GROUP BY ALL",
    "bc": f"SELECT enroll_clip_id, test_clip_id, diff_cs, mic, greatest(0, least(9, CAST(floor((diff_cs - lo) * 10 / (hi - lo)) AS INT))) AS bin, {_ORDER} AS k FROM candidates, {_EDGES} WHERE diff_cs <= hi",
    "drawn": "SELECT * FROM (SELECT bc.*, target, row_number() OVER (PARTITION BY bc.bin, bc.mic ORDER BY k, enroll_clip_id, test_clip_id) AS r FROM bc JOIN goals ON bc.bin = goals.bin AND bc.mic = goals.mic) WHERE r <= target",
}


def _sampling_sql(ratio: int) -> str:
    return with_("positives", "candidates", **{k: v.replace("{ratio}", str(ratio)) for k, v in _SAMPLING.items()})


def _sampled(spark: SparkSession, sf_dir: str, ratio: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, sample and numbers of candidates in range, by ten bins of the positives' difference and mic."""
    p, n = positives(spark, sf_dir), negatives(spark, sf_dir)
    lo, hi = histograms.limits(p, "diff_cs")
    binned = lambda df: df.withColumn("bin", binning.width_bin(F.col("diff_cs").cast("double"), lo, hi, 10)).where("bin is not null")
    goals = sampling.targets(binned(p), ["bin", "mic"], ratio)
    candidates = binned(n.select("enroll_clip_id", "test_clip_id", "diff_cs", "mic"))
    order = sampling.order_key(F.col("enroll_clip_id"), F.col("test_clip_id"))
    return goals, *sampling.draw(candidates, goals, ["bin", "mic"], order, ["enroll_clip_id", "test_clip_id"])


@query(_sampling_sql(1) + "SELECT enroll_clip_id, test_clip_id, diff_cs, mic, bin FROM drawn")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, 1)[1]


_REPORT = ", rep AS (SELECT goals.bin, goals.mic, target, (SELECT count(*) FROM drawn d WHERE d.bin = goals.bin AND d.mic = goals.mic) AS actual, (SELECT count(*) FROM bc WHERE bc.bin = goals.bin AND bc.mic = goals.mic) AS candidates_seen FROM goals)"


@query(_sampling_sql(10) + _REPORT + "SELECT *, greatest(0, target - actual) AS shortfall FROM rep")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals, drawn, seen = _sampled(spark, sf_dir, 10)
    return sampling.report(goals, drawn, seen, ["bin", "mic"])


@query(_sampling_sql(2) + _REPORT + "SELECT round(max(abs(actual * 2 / target - 2)), 6) AS max_deviation FROM rep WHERE target > 0")
def ratio_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals, drawn, seen = _sampled(spark, sf_dir, 2)
    return sampling.ratio_deviation(sampling.report(goals, drawn, seen, ["bin", "mic"]), 2)


# ---- features and scores

_FEATURES = "SELECT vec_id AS id, CASE WHEN vec_id % 13 = 5 THEN NULL ELSE (vec_id * 37) % 101 / 10.0::DOUBLE END AS energy_db FROM embeddings"


#: Features of some clips stand under another path, so trials miss them.
_OTHER_PATHS = "SELECT clip_id AS id, CASE WHEN clip_id % 7 = 2 THEN concat('/moved', path) ELSE path END AS path FROM clips"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id % 13 = 5 THEN NULL ELSE (vec_id * 37) % 101 / 10.0D END AS energy_db")


@query(with_("positives", f=_FEATURES) + "SELECT enroll_clip_id, test_clip_id, a.energy_db AS enroll_energy_db, b.energy_db AS test_energy_db, round(abs(b.energy_db - a.energy_db), 6) AS energy_db_diff FROM positives LEFT JOIN f a ON a.id = enroll_clip_id LEFT JOIN f b ON b.id = test_clip_id")
def feature_join_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positives(spark, sf_dir).select("enroll_clip_id", "test_clip_id")
    out = features.feature_diffs(features.attach(p, _features(spark, sf_dir), ["energy_db"], "id", "enroll_clip_id", "test_clip_id"), ["energy_db"])
    return out.withColumn("energy_db_diff", F.round("energy_db_diff", 6))


@query(with_("positives", f=_FEATURES, o=_OTHER_PATHS) + "SELECT enroll_path, test_path, a.energy_db AS enroll_energy_db, b.energy_db AS test_energy_db FROM positives LEFT JOIN (SELECT path, energy_db FROM f JOIN o USING (id)) a ON a.path = enroll_path LEFT JOIN (SELECT path, energy_db FROM f JOIN o USING (id)) b ON b.path = test_path")
def feature_join_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = spark.sql(_OTHER_PATHS.replace("FROM clips", "FROM {clips}"), clips=clips(spark, sf_dir))
    f = _features(spark, sf_dir).join(others, "id")
    return features.attach(_pathed(spark, sf_dir).select("enroll_path", "test_path"), f, ["energy_db"], "path", "enroll_path", "test_path", bytes_a_row=256)


@query(with_("positives", f=_FEATURES) + "SELECT count(*) AS n, count(*) FILTER (a.energy_db IS NULL) AS missing_enroll_energy_db, count(*) FILTER (b.energy_db IS NULL) AS missing_test_energy_db FROM positives LEFT JOIN f a ON a.id = enroll_clip_id LEFT JOIN f b ON b.id = test_clip_id")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.missing(feature_join_id(spark, sf_dir), ["enroll_energy_db", "test_energy_db"])


@query(with_("scored") + "SELECT enroll_clip_id, test_clip_id, target, round(score, 6) AS score FROM scored")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "enroll_clip_id", "test_clip_id", decimals=6)


@query(with_("scored") + "SELECT target, mic, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM scored GROUP BY ALL")
def cosine_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "test_mic_type").groupBy("target", F.col("test_mic_type").alias("mic")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("lo"), F.round(F.max("score"), 6).alias("hi"))


@query(with_("dots") + "SELECT vec_id, round(10 * log10(list_avg(list_transform(v, lambda x: x * x)) + 1e-12), 6) AS energy_db FROM dots")
def energy_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.energy_db(F.col("embedding")), 6).alias("energy_db"))


@query(with_("dots", c="SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS c FROM dots", p="SELECT vec_id, c, list_max(list_transform(c, lambda x: abs(x))) AS p FROM c") + "SELECT vec_id, round(list_max(list_transform(c, lambda x: x / (1.01 * p))), 6) AS high, round(list_min(list_transform(c, lambda x: x / (1.01 * p))), 6) AS low, round(list_sum(list_transform(c, lambda x: abs(x / (1.01 * p)))), 6) AS total FROM p")
def dc_peak_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.centre_and_scale(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.array_max("v"), 6).alias("high"), F.round(F.array_min("v"), 6).alias("low"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query(with_("dots") + "SELECT vec_id, 100 AS n, round(list_sum(v || v[1:36]), 6) AS total, round(v[36], 6) AS last FROM dots")
def tile_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", vectors.tile(F.col("embedding").cast("array<double>"), 100).alias("t"))
    return t.select("vec_id", F.size("t").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("t", -1), 6).alias("last"))


@query(with_("dots", m="SELECT vec_id, list_transform(v, lambda x: abs(x) + 1e-10) AS m FROM dots") + "SELECT vec_id, round(ln(list_avg(m)) - list_avg(list_transform(m, lambda x: ln(x))), 6) AS g FROM m")
def wada_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.wada_g(F.col("embedding")), 6).alias("g"))


@query()
def wada_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and SNR of the signals; checked against a plain interpolation in the tests."""
    return features.signal_features(table(spark, sf_dir, "embeddings"), "embedding", vectors.calibration(), "vec_id")


@query(with_("clips") + "SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM clips WHERE duration_cs > 0), 6) AS share, (SELECT median(duration_cs) / 100 FROM clips WHERE duration_cs > 0) AS median_s FROM (SELECT CASE WHEN duration_cs < 100 THEN '<1s' WHEN duration_cs < 200 THEN '1-2s' WHEN duration_cs < 400 THEN '2-4s' ELSE '>=4s' END AS bucket FROM clips WHERE duration_cs > 0) GROUP BY 1")
def length_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.length_shares(clips(spark, sf_dir), "duration_cs", [100, 200, 400], text.bucket_labels([1, 2, 4]))


# ---- equal-error rates


def _eer_sql(source: str, score: str, keys: str = "") -> str:
    """Row by row: rank by score, targets first, compare the rates after each trial."""
    by = f"PARTITION BY {keys} " if keys else ""
    pre, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f""", s AS (SELECT {pre}{score} AS s, target FROM {source} WHERE {score} IS NOT NULL),
w AS (SELECT {pre}s, row_number() OVER o AS r, count(*) FILTER (target) OVER o AS t, count(*) FILTER (NOT target) OVER o AS n, count(*) FILTER (target) OVER ({by.strip()}) AS nt, count(*) FILTER (NOT target) OVER ({by.strip()}) AS nn FROM s
  WINDOW o AS ({by}ORDER BY s DESC, target DESC ROWS UNBOUNDED PRECEDING))
SELECT {pre}max(nt) AS n_target, max(nn) AS n_nontarget, round(arg_min((n / nn + (nt - t) / nt) / 2, abs(CAST(n AS HUGEINT) * nt - (nt - t) * nn) * 100000000::HUGEINT + r), 9) AS eer, round(arg_min(s, abs(CAST(n AS HUGEINT) * nt - (nt - t) * nn) * 100000000::HUGEINT + r), 6) AS threshold FROM w{group}"""


_COSINES = (-1.0, 1.0)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"eer": F.round("eer", 9), "threshold": F.round("threshold", 6)})


@query(with_("scored", sc="SELECT *, round(score, 9) AS rs FROM scored") + _eer_sql("sc", "rs"))
def eer_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.eer_exact(scored(spark, sf_dir, decimals=9), "score", "target", likely=_COSINES))


@query(with_("trials", d="SELECT CAST(-diff_cs AS DOUBLE) AS x, target FROM trials") + _eer_sql("d", "x"))
def eer_exact_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = positives(spark, sf_dir).select("diff_cs", F.lit(True).alias("target")).unionByName(negatives(spark, sf_dir).select("diff_cs", F.lit(False).alias("target")))
    return _rounded(metrics.eer_exact(both.select(features.orient_confound(F.col("diff_cs")).alias("x"), "target"), "x", "target"))


@query(with_("scored", sc="SELECT *, round(score, 9) AS rs FROM scored") + _eer_sql("sc", "rs", "mic"))
def eer_by_mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = scored(spark, sf_dir, "test_mic_type", decimals=9).withColumnRenamed("test_mic_type", "mic")
    return _rounded(metrics.eer_exact(trials, "score", "target", "mic", likely=_COSINES))


_HIST_STEPS = {
    "b": "SELECT quantile_cont(s, 0.0001) AS lo, quantile_cont(s, 0.9999) AS hi FROM (SELECT round(score, 9) AS s FROM scored)",
    "sb": """SELECT *, greatest(0, least(19999, CAST(trunc((round(score, 9) - lo) / (hi - lo) * 20000) AS INT))) AS bin FROM scored, b""",
}


def _bucket_sql(x: str, edges: list[int], labels: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" WHEN {x} IS NOT NULL THEN '{labels[-1]}' END"


def _hist_sql(keys: dict[str, str], rolled: list[str], where: str = "true", at_least: int = 50) -> str:
    """EER by the keys, each of `rolled` also over all its values."""
    names_ = ", ".join(keys)
    over = {c: "overall" if c == "mic" else "all" for c in rolled}
    steps = dict(_HIST_STEPS)
    steps["k"] = f"SELECT {', '.join(f'{sql} AS {c}' for c, sql in keys.items())}, bin, target, lo, hi FROM sb WHERE {where}"
    last = "k"
    for i, c in enumerate(rolled):
        others = "".join(f"{x}, " for x in keys if x != c)
        steps[f"k{i}"] = f"SELECT {others}unnest([{c}, '{over[c]}']) AS {c}, bin, target, lo, hi FROM {last} WHERE {c} IS NOT NULL"
        last = f"k{i}"
    steps["h"] = f"SELECT {names_}, bin, count(*) FILTER (target) AS hp, count(*) FILTER (NOT target) AS hn FROM {last} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in keys)} GROUP BY {names_}, bin UNION ALL SELECT DISTINCT {names_}, -1, 0, 0 FROM {last} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in keys)}"
    steps["w"] = f"SELECT *, sum(hp) OVER o AS cp, sum(hn) OVER o AS cn, sum(hp) OVER a AS p, sum(hn) OVER a AS n FROM h WINDOW o AS (PARTITION BY {names_} ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {names_})"
    enough = f"max(p) >= {at_least} AND max(n) >= {at_least}"
    middle = lambda c, t: f"CASE WHEN {enough} THEN round(max(lo) + (min(bin) FILTER (bin >= 0 AND {c} * 2 >= {t}) + 0.5) * (max(hi) - max(lo)) / 20000, 6) END"
    tail = f"""SELECT {names_}, CAST(max(p) AS BIGINT) AS n_genuine, CAST(max(n) AS BIGINT) AS n_impostor, CASE WHEN {enough} THEN round(arg_min((1 - cn / n + cp / p) / 2, abs(cp * n - (n - cn) * p) * 100000 + bin), 6) END AS eer,
  {middle('cp', 'p')} AS median_genuine, {middle('cn', 'n')} AS median_impostor FROM w, b GROUP BY {names_}"""
    return with_("scored", **steps) + tail


_E4, _L4 = [100, 200, 400], text.bucket_labels([1, 2, 4])


def _bounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scored trials and the range of their scores. Both are read from blocks of clips, and trials are
    scored again wherever they are read: kept, they would take many times the input."""
    s = scored(spark, sf_dir, "test_mic_type", "enroll_duration_cs", "test_duration_cs", decimals=9).withColumnRenamed("test_mic_type", "mic")
    return s, metrics.score_range(scored(spark, sf_dir, decimals=9), "score", likely=_COSINES)


@query(_hist_sql({"mic": "mic"}, ["mic"]))
def eer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    return metrics.eer_overall(s, "score", "target", b)


@query(_hist_sql({"shorter_clip": _bucket_sql("least(enroll_duration_cs, test_duration_cs)", _E4, _L4), "mic": "mic"}, ["shorter_clip", "mic"]))
def eer_by_shorter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    shorter = durations.shorter_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs"))
    return metrics.eer_table(s.withColumn("shorter_clip", binning.bucket_label(shorter, _E4, _L4)), "score", "target", "shorter_clip", b)


_ED, _LD = [50, 100, 200, 400], text.bucket_labels([0.5, 1, 2, 4])


@query(_hist_sql({"bucket": _bucket_sql("abs(test_duration_cs - enroll_duration_cs)", _ED, _LD), "mic": "mic"}, ["bucket", "mic"]))
def eer_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    diff = durations.abs_diff_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs"))
    return metrics.eer_table(s.withColumn("bucket", binning.bucket_label(diff, _ED, _LD)), "score", "target", "bucket", b)


_ES, _LS = [-400, -200, 0, 200, 400], text.bucket_labels([-4, -2, 0, 2, 4])


@query(_hist_sql({"bucket": _bucket_sql("test_duration_cs - enroll_duration_cs", _ES, _LS), "mic": "mic"}, ["bucket", "mic"]))
def eer_signed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    diff = durations.signed_diff_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs"))
    return metrics.eer_table(s.withColumn("bucket", binning.bucket_label(diff, _ES, _LS)), "score", "target", "bucket", b)


@query(_hist_sql({"bucket": _bucket_sql("test_duration_cs", _E4, _L4), "mic": "mic"}, ["bucket", "mic"], "enroll_duration_cs >= 400"))
def eer_enroll_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    return metrics.eer_table(s.where("enroll_duration_cs >= 400").withColumn("bucket", binning.bucket_label(F.col("test_duration_cs"), _E4, _L4)), "score", "target", "bucket", b)


@query(_hist_sql({"bucket": _bucket_sql("enroll_duration_cs", _E4, _L4), "mic": "mic"}, ["bucket", "mic"], "test_duration_cs >= 400"))
def eer_test_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    return metrics.eer_table(s.where("test_duration_cs >= 400").withColumn("bucket", binning.bucket_label(F.col("enroll_duration_cs"), _E4, _L4)), "score", "target", "bucket", b)


@query(_hist_sql({"enroll_bucket": _bucket_sql("enroll_duration_cs", _E4, _L4), "test_bucket": _bucket_sql("test_duration_cs", _E4, _L4), "mic": "mic"}, ["mic"]))
def eer_both_ge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    marked = s.withColumns({f"{x}_bucket": binning.bucket_label(F.col(f"{x}_duration_cs"), _E4, _L4) for x in ("enroll", "test")})
    return metrics.eer_matrix(marked, "score", "target", "enroll_bucket", "test_bucket", b)


@query(_hist_sql({"bucket": _bucket_sql("abs(test_duration_cs - enroll_duration_cs)", _ED, _LD), "mic": "mic"}, ["bucket", "mic"], "enroll_duration_cs >= 400 AND test_duration_cs >= 400", 1000))
def eer_both_ge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _bounded(spark, sf_dir)
    diff = durations.abs_diff_cs(F.col("enroll_duration_cs"), F.col("test_duration_cs"))
    both = s.where("enroll_duration_cs >= 400 and test_duration_cs >= 400").withColumn("bucket", binning.bucket_label(diff, _ED, _LD))
    return metrics.eer_table(both, "score", "target", "bucket", b, at_least=1000)


@query(
    with_("positives", v=_V)
    + """, q AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi, stddev_pop(x) * power(count(*), -0.2) AS h, count(*) AS n FROM v),
g AS (SELECT CAST(range AS INT) AS i, lo + (hi - lo) * range / 399 AS grid, h, n FROM q, range(400)), d AS (SELECT x, count(*) AS w FROM v GROUP BY x)
SELECT i, round(grid, 6) AS grid, round(sum(w * exp(-0.5 * ((grid - x) / h) ** 2)) / (n * h * 2.5066282746310002), 6) AS density FROM g, d GROUP BY i, grid, h, n"""
)
def kde_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kde(positives(spark, sf_dir), "diff_cs", points=400)


@query(
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem), v AS (SELECT l_extendedprice AS x, lo, hi FROM lineitem, q WHERE l_extendedprice BETWEEN lo AND hi), "
    "c AS (SELECT lo, hi, greatest(0, least(49, CAST(floor((x - lo) * 50 / (hi - lo)) AS INT))) AS index, count(*) AS n FROM v GROUP BY ALL) "
    "SELECT index, round(lo + (hi - lo) / 50 * index, 6) AS lower, round(lo + (hi - lo) / 50 * (index + 1), 6) AS upper, round(n / ((SELECT sum(n) FROM c) * (hi - lo) / 50), 6) AS density FROM c"
)
def density_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.density(table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ---- resumable work

_DONE = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'unreadable' ELSE '' END AS error, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS value FROM labels"


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DONE.replace("labels", "{labels}"), labels=table(spark, sf_dir, "labels"))


@query(f"SELECT doc_id, lang FROM documents ANTI JOIN (SELECT * FROM ({_DONE}) WHERE error = '' AND value IS NOT NULL) USING (doc_id)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.todo(table(spark, sf_dir, "documents").select("doc_id", "lang"), _done(spark, sf_dir), "doc_id", "value")


@query(f"SELECT doc_id, error FROM ({_DONE}) WHERE error <> ''")
def error_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.errors(_done(spark, sf_dir), ["doc_id"])


@query()
def length_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches depend on the ranges that tasks get, so the tests hold their rules instead of SQL."""
    return batching.plan_batches(clips(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched trials scored by cosine and their exact equal-error rate by microphone."""
    return eer_by_mic(spark, sf_dir)
