"""Registered queries that go through files: each writes what a table says in one of the formats, reads it
back with the library's reader, and returns the rows; and operators that need no pairs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning, durations, names, text, vectors
from ..operators import batching, encode, features, histograms, parity, profile, sampling, split, trials
from ..sources import files, tables
from ..storage import n_partitions, put, put_files, scratch, written
from ..streaming import incremental
from .clips import clips, positives, sides, table, with_
from .registry import query

# ---- a corpus on disk: clips as WAV files in their folders, some with transcripts

#: Rate, channels, bits and samples of a clip's file, one text for both engines: a sample is a coefficient
#: of its vector in ten thousandths. Some files are broken, some clips have a transcript only.
_AUDIO = """SELECT clip_id, path, mic_type, native_split, speaker_id, duration_cs, CASE clip_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 8000 ELSE 44100 END AS rate,
  CAST(1 + clip_id % 2 AS INT) AS channels, CASE WHEN clip_id % 5 = 0 THEN 24 WHEN clip_id % 7 = 0 THEN 8 ELSE 16 END AS bits, clip_id % 17 = 4 AS broken,
  clip_id % 11 <> 6 AS has_wav, clip_id % 3 <> 0 OR clip_id % 11 = 6 AS has_txt, concat('Word word ', CAST(clip_id AS VARCHAR(10)), ' it''s') AS said, embedding FROM clips"""
_SAMPLES = "list_transform(embedding, lambda x: CASE bits WHEN 8 THEN floor(CAST(x AS DOUBLE) * 100) / 128 WHEN 16 THEN floor(CAST(x AS DOUBLE) * 10000) / 32768 ELSE floor(CAST(x AS DOUBLE) * 10000) * 256 / 8388608 END)"
_GOOD = "has_wav AND NOT broken"


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_AUDIO.replace("FROM clips", "FROM {clips}"), clips=clips(spark, sf_dir))


def _wav(vector: list[float], rate: int, channels: int, bits: int) -> bytes:
    """A WAV file whose channels all hold the vector's samples."""
    x = np.floor(np.array(vector, np.float64) * (100 if bits == 8 else 10_000))
    raw = {8: lambda: (x + 128).astype(np.uint8).repeat(channels).tobytes(), 16: lambda: x.astype("<i2").repeat(channels).tobytes(), 24: lambda: b"".join(int(v * 256).to_bytes(3, "little", signed=True) * channels for v in x)}[bits]()
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(raw)) + raw


_corpora: dict[tuple[str, str], str] = {}


def _corpus(spark: SparkSession, sf_dir: str) -> str:
    """The folder that holds the clips' files, written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _corpora:
        root = scratch(spark, "corpus")
        held = _audio(spark, sf_dir).repartition(n_partitions(spark))
        put_files(held.mapInPandas(_corpus_files, "path string, content binary"), root)
        _corpora[at] = root
    return _corpora[at]


def _corpus_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.to_dict("records"):
            base = f"audio{r['path'].removesuffix('.wav')}"
            if r["has_wav"]:
                out.append((base + ".wav", b"RIFF" if r["broken"] else _wav(r["embedding"], r["rate"], r["channels"], r["bits"])))
            if r["has_txt"]:
                out.append((base + ".txt", r["said"].encode()))
        yield pd.DataFrame(out, columns=["path", "content"])


def _wavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_files(spark, _corpus(spark, sf_dir), "*.wav")


_SIZE = "CASE WHEN broken THEN 4 ELSE 44 + len(embedding) * channels * bits // 8 END"
_NAME = "regexp_extract(path, '([^/]+)[.]wav$', 1)"


def _name(path: str = "path"):
    return F.regexp_extract(path, "([^/]+)[.]wav$", 1)


@query(with_("clips", a=_AUDIO) + f"SELECT {_NAME} AS name, CAST({_SIZE} AS BIGINT) AS length FROM a WHERE has_wav")
def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = files.corpus_root(spark, _corpus(spark, sf_dir))
    return files.list_files(spark, root).select(_name().alias("name"), "length")


@query(
    with_("clips", a=_AUDIO)
    + f"""SELECT mic_type AS mic_config, native_split AS split, speaker_id AS speaker_folder, {_NAME} AS stem, has_wav, has_txt, CASE WHEN has_wav THEN CAST({_SIZE} AS BIGINT) END AS file_size_bytes, true AS parsed,
  true AS split_matches_folder, true AS mic_matches_folder, true AS sid_matches_folder, CASE WHEN has_txt THEN CAST(length(said) AS INT) END AS char_count, CASE WHEN has_txt THEN 3 END AS word_count, CASE WHEN has_txt THEN 2 END AS unique_words FROM a"""
)
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.manifest(spark, _corpus(spark, sf_dir), texts=True)
    return m.select(*files.PLACE, "has_wav", "has_txt", "file_size_bytes", "parsed", "split_matches_folder", "mic_matches_folder", "sid_matches_folder", "char_count", "word_count", "unique_words")


@query(with_("clips", a=_AUDIO) + f"SELECT mic_type AS mic_config, native_split AS split, speaker_id AS speaker_folder, {_NAME} AS stem FROM a ORDER BY ALL LIMIT 25")
def corpus_quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan limit of the corpus walk: the first 25 stems by place."""
    return files.manifest(spark, _corpus(spark, sf_dir), limit=25).select(*files.PLACE)


@query(with_("clips", a=_AUDIO) + "SELECT speaker_id AS speaker_folder, count(*) AS n FROM a WHERE mic_type = 'sdm' AND has_wav GROUP BY 1")
def mic_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.place_files(files.list_files(spark, f"{_corpus(spark, sf_dir)}/audio/sdm"))
    return rows.groupBy("speaker_folder").agg(F.count(F.lit(1)).alias("n"))


@query(with_("clips", a=_AUDIO, w="SELECT unnest(['ihm', 'sdm']) AS mic", x="SELECT mic, unnest(['train', 'dev', 'eval', 'none']) AS s FROM w") + "SELECT mic || '/' || s AS folder FROM x ANTI JOIN (SELECT * FROM a WHERE has_wav) b ON mic = mic_type AND s = native_split")
def empty_folder_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _corpus(spark, sf_dir)
    found = files.list_files(spark, root).select(F.regexp_extract("path", "/audio/(.*)$", 1).alias("path"))
    wanted = spark.createDataFrame([(f"{m}/{s}",) for m in ("ihm", "sdm") for s in ("train", "dev", "eval", "none")], "folder string")
    return files.empty_places(wanted, found)


@query(
    with_("clips", a=_AUDIO)
    + f"SELECT {_NAME} AS name, CASE WHEN broken THEN NULL ELSE rate END AS sample_rate, CASE WHEN broken THEN NULL ELSE channels END AS channels, CASE WHEN NOT broken THEN round(len(embedding) / rate, 9) END AS duration_s, CASE WHEN NOT broken THEN round(list_sum({_SAMPLES}), 6) END AS total, broken AS failed FROM a WHERE has_wav"
)
def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files.decode_wav(_wavs(spark, sf_dir))
    total = F.aggregate("signal", F.lit(0.0), lambda a, x: a + x)
    return d.select(_name().alias("name"), "sample_rate", "channels", F.round("duration_s", 9).alias("duration_s"), F.round(total, 6).alias("total"), F.col("error").isNotNull().alias("failed"))


@query(with_("clips", a=_AUDIO) + f"SELECT {_NAME} AS name, rate AS sample_rate, channels, bits, round(len(embedding) / rate, 9) AS duration_s FROM a WHERE {_GOOD}")
def wav_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = files.probe_wav(_wavs(spark, sf_dir)).where("error is null")
    return p.select(_name().alias("name"), "sample_rate", "channels", "bits", F.round("duration_s", 9).alias("duration_s"))


@query(with_("clips", a=_AUDIO) + f"SELECT rate AS sample_rate, channels, count(*) AS n, round(avg(abs(duration_cs / 100 - len(embedding) / rate)), 6) AS mean_abs_diff_s, round(max(abs(duration_cs / 100 - len(embedding) / rate)), 6) AS max_abs_diff_s FROM a WHERE {_GOOD} GROUP BY ALL")
def duration_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = names.parse_stem(_name()).getField("duration_from_name_s")
    out = files.audit_durations(files.probe_wav(_wavs(spark, sf_dir)), named)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_abs_diff_s", "max_abs_diff_s")})


@query(with_("clips", a=_AUDIO) + f"SELECT {_NAME} AS name, 'convert ' || rate || ' Hz, ' || channels || ' channel(s) to 16000 Hz mono' AS action FROM a WHERE {_GOOD} AND (rate <> 16000 OR channels <> 1)")
def standardise_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.standardise_plan(files.probe_wav(_wavs(spark, sf_dir))).select(_name("source").alias("name"), "action")


@query(with_("clips", a=_AUDIO) + f"SELECT {_NAME} AS name, CAST(CASE WHEN rate = 16000 THEN len(embedding) WHEN rate = 8000 THEN 2 * len(embedding) ELSE ceil(len(embedding) * 160 / 441) END AS INT) AS samples FROM a WHERE {_GOOD}")
def wav_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each signal at 16 kHz; their values are checked against tones in the tests."""
    d = files.decode_wav(_wavs(spark, sf_dir), rate=16_000).where("error is null")
    return d.select(_name().alias("name"), F.size("signal").alias("samples"))


@query(with_("clips", a=_AUDIO) + f"SELECT {_NAME} || '.wav' AS member, CAST({_SIZE} AS INT) AS size FROM a WHERE has_wav")
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tar")
    files.write_tars(_wavs(spark, sf_dir), path)
    return files.read_tar(spark, path).select("member", F.length("content").alias("size"))


# ---- annotations and segments

_LINES = "SELECT clip_id, speaker_id, duration_cs, CASE WHEN label = 9 THEN 'IS1003b' ELSE upper(meeting_id) END AS m, concat('C_', CASE WHEN label = 9 THEN 'IS1003b' ELSE upper(meeting_id) END, '_H00_', upper(speaker_id), '_', lpad(CAST(clip_id * 10 AS VARCHAR(10)), 7, '0'), '_', lpad(CAST(clip_id * 10 + duration_cs AS VARCHAR(10)), 7, '0')) AS u, CASE WHEN clip_id % 5 = 0 THEN '' ELSE concat('so it  is ', CAST(clip_id AS VARCHAR(10))) END AS said FROM clips"


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("FROM clips", "FROM {clips}"), clips=clips(spark, sf_dir))
    path = scratch(spark, "annotations")
    line = F.concat(F.col("u"), F.lit(" "), F.col("said"))
    lines.select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return tables.read_annotations(spark, path)


_UTTERANCE = "u AS utterance, said AS transcript, m AS meeting_id, 'H00' AS microphone_id, upper(speaker_id) AS speaker_id, clip_id * 10 / 100 AS begin_time, (clip_id * 10 + duration_cs) / 100 AS end_time"


@query(with_("clips", l=_LINES) + f"SELECT {_UTTERANCE} FROM l")
def annotations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir)


@query(with_("clips", l=_LINES, a=f"SELECT {_UTTERANCE} FROM l") + "SELECT replace(utterance, '_H00_', '_sdm_') AS utterance, transcript, meeting_id, 'SDM1' AS microphone_id, speaker_id, begin_time, end_time FROM a WHERE meeting_id <> 'IS1003b'")
def annotations_distant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distant_annotations(_annotations(spark, sf_dir))


@query(with_("clips") + "SELECT speaker_id AS folder, count(*) AS n, round(sum((begin_cs + duration_cs) / 100 - begin_cs / 100), 6) AS seconds, min(begin_cs / 100) AS first_start, max((begin_cs + duration_cs) / 100) AS last_end FROM (SELECT *, clip_id * 10 AS begin_cs FROM clips) GROUP BY 1")
def segments_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "segments")
    rows = clips(spark, sf_dir).select(F.concat(F.lit("clip"), "clip_id").alias("n"), "speaker_id", F.col("clip_id") * 10 / 100, (F.col("clip_id") * 10 + F.col("duration_cs")) / 100)
    rows.write.option("sep", " ").csv(path)
    return tables.segments_by_folder(tables.read_segments(spark, path)).withColumn("seconds", F.round("seconds", 6))


# ---- tables in files


@query(with_("clips") + "SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS path_id, path FROM clips")
def csv_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "dictionary")
    tables.write_csv(encode.path_dictionary((clips(spark, sf_dir), "path")), path)
    return tables.read_paths(spark, path)


@query(with_("positives") + "SELECT enroll_path, test_path, CASE WHEN test_clip_id % 9 <> 4 THEN diff_cs END AS duration_diff_cs FROM positives")
def csv_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "trials")
    known = F.when(F.col("test_clip_id") % 9 != 4, durations.to_seconds(F.col("diff_cs")))
    pairs = trials.positive_trials(*sides(spark, sf_dir), columns=("clip_id", "speaker_id", "path", "duration_cs"))
    tables.write_csv(pairs.select("enroll_path", "test_path", known.alias("duration_diff")), path)
    return tables.read_trials_csv(spark, path)


_MEASURED = "SELECT vec_id AS id, CASE WHEN vec_id % 13 <> 5 THEN (vec_id * 37) % 101 / 10.0::DOUBLE END AS energy_db, CASE WHEN vec_id % 8 <> 3 THEN (vec_id * 17) % 61 / 4.0::DOUBLE END AS wada_snr_db, CASE WHEN vec_id % 13 = 5 THEN 'empty_file' END AS error FROM embeddings"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id % 13 <> 5 THEN (vec_id * 37) % 101 / 10.0D END AS energy_db", "CASE WHEN vec_id % 8 <> 3 THEN (vec_id * 17) % 61 / 4.0D END AS wada_snr_db", "CASE WHEN vec_id % 13 = 5 THEN 'empty_file' END AS error")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "features")
    tables.write_csv(_measured(spark, sf_dir), path)
    return tables.read_features(spark, path)


@query(_MEASURED)
def csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


@query(f"SELECT * FROM ({_MEASURED}) WHERE error IS NULL AND energy_db IS NOT NULL AND wada_snr_db IS NOT NULL")
def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usable_features(_features(spark, sf_dir))


_ENCODED = "SELECT enroll_clip_id AS enroll_id, test_clip_id AS test_id, CASE WHEN test_clip_id % 9 <> 4 THEN diff_cs END AS duration_diff_cs FROM positives"


def _encoded(spark: SparkSession, sf_dir: str, codec: str) -> str:
    path = scratch(spark, "encoded")
    known = F.when(F.col("test_clip_id") % 9 != 4, F.col("diff_cs"))
    rows = positives(spark, sf_dir).select(F.col("enroll_clip_id").alias("enroll_id"), F.col("test_clip_id").alias("test_id"), durations.to_sentinel(known).cast("int").alias("duration_diff_cs"))
    tables.write_table(rows, path, codec, row_group_bytes=1 << 20)
    return path


@query(with_("positives") + _ENCODED)
def parquet_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_trials(spark, _encoded(spark, sf_dir, "zstd"))


@query(with_("positives", e=_ENCODED) + "SELECT duration_diff_cs, count(*) AS n FROM e GROUP BY 1")
def parquet_trials_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_trials(spark, _encoded(spark, sf_dir, "snappy"), ["duration_diff_cs"]).groupBy("duration_diff_cs").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def format_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents copied from Parquet to ORC and read again."""
    path = scratch(spark, "orc")
    tables.convert(spark, f"{sf_dir}/documents.parquet", "parquet", path, "orc")
    return spark.read.orc(path)


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INT) AS n FROM embeddings")
def npy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors through one .npy file, whose rows follow the ids."""
    folder = scratch(spark, "npy").removeprefix("file:")
    put(spark, f"{folder}/_", b"")
    e = table(spark, sf_dir, "embeddings")
    tables.write_npy(e, f"{folder}/v.npy", "vec_id", "embedding")
    ids = encode.dense_ids(e.select("vec_id"), "vec_id", "id")
    rows = tables.read_npy(spark, f"{folder}/v.npy", rows=200).join(ids, "id")
    return rows.select("vec_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.size("vector").alias("n"))


_BIN_ROWS = "SELECT CAST(range AS INT) AS index, range * 1000.0::DOUBLE AS lower_seconds, (range + 1) * 1000.0::DOUBLE AS upper_seconds, 1000.0::DOUBLE AS width_seconds, count(l_extendedprice) AS count FROM range(110) LEFT JOIN lineitem ON CAST(floor(l_extendedprice / 1000) AS BIGINT) = range GROUP BY range"


@query(_BIN_ROWS)
def json_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of all prices written as a JSON report, read and checked."""
    price = F.floor(F.col("l_extendedprice") / 1000).cast("int")
    counted = table(spark, sf_dir, "lineitem").groupBy(price.alias("index")).agg(F.count(F.lit(1)).alias("count"))
    rows = spark.range(110).select(F.col("id").cast("int").alias("index")).join(counted, "index", "left").na.fill(0, ["count"])
    rows = rows.select("index", (F.col("index") * 1000.0).alias("lower_seconds"), (F.col("index") * 1000.0 + 1000).alias("upper_seconds"), F.lit(1000.0).alias("width_seconds"), "count")
    bins = sorted((json.loads(r["json"]) for r in tables.json_report(rows).collect()), key=lambda b: b["index"])
    path = f"{scratch(spark, 'bins')}/bins.json"
    put(spark, path, json.dumps({"equal_width_bins": {"bins": bins}}, indent=1).encode())
    return tables.check_bins(tables.read_bins(spark, path), 110)


@query("SELECT unnest(['## Nations by region', '', '| r_name | n |', '|---|---|'] || list('| ' || r_name || ' | ' || n || ' |' ORDER BY r_name) || ['']) AS line FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n")).orderBy("r_name")
    return spark.createDataFrame([(line,) for line in tables.markdown("Nations by region", r).split("\n")], "line string")


@query(
    with_("divided", "enroll", "test")
    + """, s AS (SELECT speaker_id, string_agg(meeting_id, ', ' ORDER BY meeting_id) FILTER (side = 'enroll') AS e, string_agg(meeting_id, ', ' ORDER BY meeting_id) FILTER (side = 'test') AS t, max(n_meetings) AS n FROM divided GROUP BY 1)
SELECT speaker_id, CAST(n AS VARCHAR) AS n_meetings, e AS enroll_meetings, t AS test_meetings, CAST((SELECT count(*) FROM enroll x WHERE x.speaker_id = s.speaker_id) AS VARCHAR) AS enroll_row_count, CAST((SELECT count(*) FROM test x WHERE x.speaker_id = s.speaker_id) AS VARCHAR) AS test_row_count FROM s"""
)
def workbook_split_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split's sheet and a summary of formulas, written to a workbook and read back."""
    c = clips(spark, sf_dir)
    divided = split.meeting_split(c)
    detail = split.split_detail(c, divided).select("speaker_id", "n_meetings", "enroll_meetings", "test_meetings", "enroll_row_count", "test_row_count")
    test = split.test_rows(c, divided).select("path", "speaker_id", "mic_type")
    path = f"{scratch(spark, 'workbook')}/split.xlsx"
    summary = [*tables.summary_counts("Meeting_Split_Detail", detail.columns, "n_meetings", ["2", "3"]), *tables.summary_counts("Test", test.columns, "mic_type", ["ihm", "sdm"])]
    tables.write_workbook(spark, path, {"Meeting_Split_Detail": detail, "Test": test}, summary)
    return tables.read_sheet(spark, path, "Meeting_Split_Detail", ["speaker_id", "enroll_meetings"])


@query("SELECT doc_id, quality AS value, CASE WHEN quality IS NULL THEN 'unreadable' END AS error FROM labels")
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels done in two goes: the first fails for some, the second does what is left."""
    path = scratch(spark, "resumed")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")

    def work(df: DataFrame, fails) -> DataFrame:
        return df.select("doc_id", F.when(~fails, F.col("quality")).alias("value"), F.when(fails | F.col("quality").isNull(), "unreadable").alias("error"))

    incremental.resume(rows, path, lambda df: work(df, F.col("doc_id") % 5 == 2), "doc_id", "value")
    incremental.resume(rows, path, lambda df: work(df, F.lit(False)), "doc_id", "value")
    return incremental.latest(spark.read.parquet(path), "doc_id", "value").select("doc_id", "value", F.nullif("error", F.lit("")).alias("error"))


@query("SELECT event_id, event_type, round(value * 2, 6) AS doubled FROM events")
def followed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as files that a stream takes up in two batches and writes once."""
    base = scratch(spark, "followed")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        work = lambda df: df.select("event_id", "event_type", F.round(F.col("value") * 2, 6).alias("doubled"))
        incremental.follow(spark, f"{base}/in", "event_id long, event_type string, value double", f"{base}/out", f"{base}/checkpoint", work, "event_id").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("epoch")


# ---- functions of columns


@query(
    with_("clips")
    + """SELECT clip_id, regexp_replace(path, '_(h00|sdm)_([^_/]*)[.]wav$', '_\\2') AS whole, 'plain/a_b.wav' AS short, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '_(h00|sdm)_([^_]*)[.]wav$', '_\\2') AS bare FROM clips"""
)
def agnostic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    return c.select("clip_id", names.agnostic_key(F.col("path")).alias("whole"), names.agnostic_key(F.lit("plain/a_b.wav")).alias("short"), names.agnostic_key(F.regexp_extract("path", "([^/]+)$", 1)).alias("bare"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("n")).select("n_regionkey", text.joined(F.col("n")).alias("names"))


@query(
    """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1000000) WHEN n >= 1000 THEN printf('%.0fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS short,
  CASE WHEN d <> 0 THEN printf('%.1f%%', n * 100.0::DOUBLE / d) ELSE 'n/a' END AS share, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024) ELSE printf('%.2f B', n / 1) END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (1 + o_orderkey % 40) / (1 + o_orderkey % 1000)) AS BIGINT) * 4 + 1 AS n, (o_orderkey % 10) * 4000 AS d FROM orders)"""
)
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(floor(o_totalprice * (1 + o_orderkey % 40) / (1 + o_orderkey % 1000)) as long) * 4 + 1 as n", "(o_orderkey % 10) * 4000 as d")
    return o.select("o_orderkey", text.short_count(F.col("n")).alias("short"), text.percent(F.col("n"), F.col("d")).alias("share"), text.human_size(F.col("n")).alias("size"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN q < 1000 THEN 0 WHEN q < 2500 THEN 1 WHEN q < 4000 THEN 2 ELSE 3 END AS bucket FROM (SELECT CAST(l_quantity * 100 AS INT) AS q FROM lineitem)) GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 100).cast("int").alias("q"))
    return q.groupBy(binning.bucket_index(F.col("q"), [1000, 2500, 4000]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(with_("positives") + "SELECT mic, count(*) AS n, round(sum(diff_cs * 0.01::DOUBLE), 4) AS seconds FROM positives GROUP BY 1")
def scaled_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positives(spark, sf_dir).select("mic", features.scaled(F.col("diff_cs"), 0.01).alias("s"))
    return p.groupBy("mic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 4).alias("seconds"))


@query("SELECT c_nationkey, round(p / n, 6) AS share, CASE WHEN p > 0 THEN printf('1 : %.2f', (n - p) / p) END AS odds FROM (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0 AND c_nationkey % 6 <> 2) AS p, count(*) AS n FROM customer GROUP BY 1)")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if((F.col("c_acctbal") > 0) & (F.col("c_nationkey") % 6 != 2)).alias("p"), F.count(F.lit(1)).alias("n"))
    return n.select("c_nationkey", F.round(text.ratio(F.col("p"), F.col("n")), 6).alias("share"), text.one_to(F.col("p"), F.col("n") - F.col("p")).alias("odds"))


@query(with_("dots") + "SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x + 3 * x) / 2)), 6) AS total, CAST(len(v) + vec_id % 5 AS INT) AS padded, round(len(v) / (len(v) + vec_id % 5), 9) AS share FROM dots")
def mono_and_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", "v", vectors.mono(F.transform("v", lambda x: F.array(x, 3 * x))).alias("m"), vectors.pad(F.col("v"), F.size("v") + F.col("vec_id") % 5).alias("p"))
    return e.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("p").alias("padded"), F.round(vectors.relative_length(F.col("v"), F.size("p")), 9).alias("share"))


# ---- joins, windows, samples and batches


@query(with_("positives") + "SELECT enroll_clip_id, test_clip_id, mic FROM positives")
def test_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition of a trial looked up by its test clip."""
    p = positives(spark, sf_dir).select("enroll_clip_id", "test_clip_id")
    return features.with_test_mic(p, clips(spark, sf_dir), "clip_id", "test_clip_id")


@query("SELECT l.doc_id, quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to their documents, one without a document being an error."""
    return parity.strict_join(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


_TEN = "v AS (SELECT CAST(diff_cs AS DOUBLE) AS x, mic FROM positives), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM v), h AS (SELECT greatest(0, least(9, CAST(floor((x - lo) * 10 / (hi - lo)) AS INT))) AS index, count(*) AS count, count(*) FILTER (mic = 'ihm') AS ihm FROM v, lim GROUP BY 1)"


@query(with_("positives") + ", " + _TEN + " SELECT index, round(lo + (hi - lo) / 10 * index, 4) AS lower, round(lo + (hi - lo) / 10 * (index + 1), 4) AS upper, count, ihm FROM h, lim")
def aligned_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram joined to the one of the headset clips by bins that must have the same edges."""
    p = written(positives(spark, sf_dir).select("diff_cs", "mic"), "positives")
    bins = histograms.equal_width(p, "diff_cs", 10)
    mics = bins.select("index", "lower", "upper").join(histograms.by_bin_and_mic(p, "diff_cs", 10, F.col("mic")).select("index", F.col("ihm_ihm_count").alias("ihm")), "index")
    return histograms.aligned_bins(bins, mics).where("count > 0").drop("width")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.running_max(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


_PLOT_ORDER = "((42 * 48271 + o_orderkey * 1000003 + 1) % 2147483647 * 16807 + 12345) % 2147483647"


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_PLOT_ORDER}, o_orderkey LIMIT 500")
def plot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample for pictures: 500 orders without replacement."""
    return sampling.take(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, sampling.order_key(F.col("o_orderkey")), ["o_orderkey"])


@query(with_("positives") + ", " + _TEN + " SELECT index, count FROM h WHERE index % 5 = 0")
def every_fifth_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every(histograms.equal_width(positives(spark, sf_dir), "diff_cs", 10).where("count > 0"), "index").select("index", "count")


#: One range of clips, cut as the batches are: a clip opens a batch if the one before cannot take it.
_BATCHES = """RECURSIVE o AS (SELECT clip_id, duration_cs AS cs, row_number() OVER (ORDER BY duration_cs, clip_id) AS r FROM clips),
b(clip_id, cs, r, batch, items) AS (SELECT clip_id, cs, r, 0, 1 FROM o WHERE r = 1 UNION ALL
SELECT o.clip_id, o.cs, o.r, CASE WHEN b.items >= 16 OR (b.items + 1) * greatest(o.cs, 5) > 24000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.items >= 16 OR (b.items + 1) * greatest(o.cs, 5) > 24000 THEN 1 ELSE b.items + 1 END FROM o JOIN b ON o.r = b.r + 1)"""
_BATCHES_SQL = with_("clips").strip().replace("WITH clips", "WITH RECURSIVE clips", 1) + ", " + _BATCHES.removeprefix("RECURSIVE ")


@query(_BATCHES_SQL + " SELECT clip_id, cs AS duration_cs, batch FROM b")
def batches_of_one_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.plan_batches(clips(spark, sf_dir), partitions=1).drop("shard")


@query(_BATCHES_SQL + ", e AS (SELECT batch, max(cs) * count(*) AS padded, count(*) AS n, sum(cs) AS used FROM b GROUP BY 1) SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS clips, round(100 * (sum(padded) - sum(used)) / sum(padded), 2) AS waste_percent FROM e")
def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.padding_waste(batching.plan_batches(clips(spark, sf_dir), partitions=1))


@query("SELECT vec_id, CASE WHEN vec_id % 19 = 7 THEN NULL ELSE round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) END AS total, vec_id % 19 = 7 AS failed FROM embeddings")
def batched_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all signals by a stand-in model that fails for batches with a signal it cannot take: the
    others of such a batch still get theirs."""

    def load():
        def model(batch: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            if (batch > 1e6).any():
                raise ValueError("a sample out of range")
            return batch.sum(1, keepdims=True)

        return model

    v = F.col("embedding").cast("array<double>")
    signals = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 19 == 7, F.array(F.lit(1e9))).otherwise(v).alias("signal"))
    out = features.predict(signals, load, "vec_id", "signal", items=8)
    return out.select("vec_id", F.round(F.col("vector")[0].cast("double"), 4).alias("total"), F.col("error").isNotNull().alias("failed"))


@query(with_("candidates", "positives") + ", lim AS (SELECT CAST(min(diff_cs) AS DOUBLE) AS lo, CAST(max(diff_cs) AS DOUBLE) * 0.5 AS hi FROM positives) SELECT count(*) AS candidates, count(*) FILTER (diff_cs > hi) AS outside FROM candidates, lim")
def candidates_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates lie beyond the bins (here: of the lower half of the positives' range)."""
    from .clips import negatives

    lo, hi = histograms.limits(positives(spark, sf_dir), "diff_cs")
    bin_ = binning.width_bin(F.col("diff_cs").cast("double"), lo, hi * 0.5, 10)
    return sampling.outside(negatives(spark, sf_dir), bin_)


@query(with_("clips") + "SELECT speaker_id, count(*) AS n FROM (SELECT CASE WHEN label = 3 THEN concat('x', speaker_id) ELSE speaker_id END AS speaker_id FROM clips) WHERE left(speaker_id, 1) = 'x' GROUP BY 1")
def undecodable_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumn("speaker_id", F.when(F.col("label") == 3, F.concat(F.lit("x"), "speaker_id")).otherwise(F.col("speaker_id")))
    return profile.undecodable(c, "speaker_id")
