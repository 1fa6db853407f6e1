"""File listings and audio as DataFrames."""

from __future__ import annotations

import io
import math
import struct
import tarfile
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..storage import is_local, n_partitions, put_files


def read_files(spark: SparkSession, root: str, glob: str = "*.wav", columns: tuple[str, ...] = ("path", "length", "content")) -> DataFrame:
    """All files below root.

    Spark counts 4 MB for opening a file, so that a task gets a few files however small they are, and a
    corpus of small files many thousands of tasks. These are put together here: as many as the session
    has shuffle partitions, or as the bytes of the files need."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(*columns)
    n_bytes = int(str(files._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes()))
    return files.coalesce(max(n_partitions(spark), -(-n_bytes // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))


def list_files(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """path and length of all files below root; contents are not read."""
    return read_files(spark, root, glob, ("path", "length"))


def corpus_root(spark: SparkSession, given: str) -> str:
    """The folder with the microphone folders: the given one, its 'audio', or its parent."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for candidate in (given, f"{given}/audio", str(path(given).getParent() or given)):
        at = path(candidate)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at) and any(s.getPath().getName().lower() in ("ihm", "sdm") for s in fs.listStatus(at)):
            return candidate
    raise FileNotFoundError(f"no ihm or sdm folder at {given}, in its audio folder or beside it")


def manifest(spark: SparkSession, root: str, limit: int | None = None, texts: bool = False) -> DataFrame:
    """The corpus under root/{mic}/{split}/{speaker}/stem.{wav,txt}: one row a stem, wav and txt paired
    by one aggregation, with what folder and stem say and whether they agree.

    limit keeps that many stems, the first by place (a quick scan of a corpus); texts attaches char_count, word_count and unique_words of the transcripts, which are then read."""
    paired = pair_files(place_files(list_files(spark, root, "*.{wav,txt,WAV,TXT}")))
    if limit is not None:
        paired = paired.orderBy(*PLACE).limit(limit)
    out = decode_manifest(paired)
    if texts:
        said = place_files(read_files(spark, root, "*.{txt,TXT}")).select(*PLACE, text.text_stats(F.trim(F.col("content").cast("string"))).alias("t"))
        out = out.join(said.select(*PLACE, "t.*"), PLACE, "left")
    return out


PLACE = ["mic_config", "split", "speaker_folder", "stem"]


def place_files(files: DataFrame) -> DataFrame:
    """files (path, length ...) under {mic}/{split}/{speaker}/ with mic_config, split, speaker_folder, stem
    and kind (wav or txt) from their path; others are left out."""
    place = r"(?i)/(ihm|sdm)/([^/]+)/([^/]+)/([^/]+)\.(wav|txt)$"
    part = lambda i: F.regexp_extract("path", place, i)
    others = [c for c in files.columns if c != "path"]
    return files.where(F.col("path").rlike(place)).select(F.lower(part(1)).alias("mic_config"), F.lower(part(2)).alias("split"), part(3).alias("speaker_folder"), part(4).alias("stem"), F.lower(part(5)).alias("kind"), *others)


def pair_files(rows: DataFrame, keys: list[str] = PLACE) -> DataFrame:
    """has_wav, has_txt and file_size_bytes (of the wav) of each key of rows (keys, kind, length): a full
    outer pairing by one aggregation."""
    is_ = lambda kind: F.col("kind") == kind
    return rows.groupBy(*keys).agg(F.max(is_("wav")).alias("has_wav"), F.max(is_("txt")).alias("has_txt"), F.max(F.when(is_("wav"), F.col("length"))).alias("file_size_bytes"))


def empty_places(folders: DataFrame, files: DataFrame, folder: str = "folder") -> DataFrame:
    """Expected folders (a column) without any file below them: what a scan should warn about."""
    held = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("at")).distinct()
    below = folders.join(held, (F.col("at") == F.col(folder)) | F.col("at").startswith(F.concat(F.col(folder), F.lit("/"))), "left_anti")
    return below.select(folder)


def decode_manifest(rows: DataFrame) -> DataFrame:
    """rows (mic_config, split, speaker_folder, stem ...) with the stem's fields, parsed, and the
    agreement of split, microphone and speaker with the folders."""
    parsed = rows.withColumn("p", names.parse_stem(F.col("stem"))).withColumn("parsed", F.col("p").isNotNull())
    out = parsed.select(*rows.columns, "parsed", "p.*")
    return out.withColumns({
        "split_matches_folder": F.col("split_in_name") == F.col("split"),
        "mic_matches_folder": F.col("mic_canonical") == F.col("mic_config"),
        "sid_matches_folder": F.lower("sid") == F.lower("speaker_folder"),
    })


#: Bytes of members that an archive takes, and that are handed on together; and their number.
TAR_BYTES, HANDED_BYTES, HANDED = 32 << 20, 8 << 20, 1000


def write_tars(files: DataFrame, folder: str) -> None:
    """files (path and content) as members, named as the files are, of compressed archives in a folder:
    each task writes its own, of TAR_BYTES and one member more at most."""

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, k, held, tar = TaskContext.get().partitionId(), 0, None, None

        def done() -> pd.DataFrame:
            tar.close()
            return pd.DataFrame({"path": [f"{own:06d}-{k:06d}.tar.gz"], "content": [held.getvalue()]})

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if tar is None:
                    held = io.BytesIO()
                    tar = tarfile.open(fileobj=held, mode="w:gz")
                member = tarfile.TarInfo(path.rpartition("/")[2])
                member.size = len(content)
                tar.addfile(member, io.BytesIO(content))
                if tar.offset >= TAR_BYTES:
                    yield done()
                    k, tar = k + 1, None
        if tar is not None:
            yield done()

    put_files(files.select("path", "content").mapInPandas(archives, "path string, content binary"), folder)


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and content of the regular files in tar archives (plain or compressed; a file or
    a folder of them), one task an archive at most.

    Archives are read as a stream through Spark's file system, some members at a time, so an archive may
    be larger than memory; a member must fit in one cell."""
    local = is_local(spark, path)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, archive in enumerate(batch["path"]):
                source = open(urllib.parse.unquote(archive.removeprefix("file:")), "rb") if local else io.BytesIO(batch["content"][k])
                found, size = [], 0
                with source, tarfile.open(fileobj=source, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            found.append((archive, m.name, tar.extractfile(m).read()))
                            size += m.size
                        tar.members.clear()  # a stream never goes back, and would keep all headers
                        if size >= HANDED_BYTES or len(found) >= HANDED:
                            yield pd.DataFrame(found, columns=["archive", "member", "content"])
                            found, size = [], 0
                if found:
                    yield pd.DataFrame(found, columns=["archive", "member", "content"])

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path").repartition(n_partitions(spark), "path") if local else files.select("path", "content")
    return rows.mapInPandas(members, "archive string, member string, content binary")


# ---- WAV

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


class BadAudio(ValueError):
    """A file that is no WAV of a known encoding."""


def wav_header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """Format (1 PCM, 3 float), channels, sample rate, bits a sample, and where the samples start and
    how many bytes they are, from the chunk headers alone."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise BadAudio("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if code == _EXTENSIBLE and size >= 26:
                code = struct.unpack_from("<H", data, at + 32)[0]
            form = code, channels, rate, bits
        elif name == b"data":
            if form is None:
                break
            return *form, at + 8, min(size, len(data) - at - 8)
        at += 8 + size + size % 2
    raise BadAudio("no format or no data chunk")


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames x channels, -1 to 1) of PCM with 8, 16, 24 or 32 bits and float
    with 32 or 64."""
    code, channels, rate, bits, at, size = wav_header(data)
    width = bits // 8
    if channels < 1 or (code, bits) not in {(_PCM, 8), (_PCM, 16), (_PCM, 24), (_PCM, 32), (_FLOAT, 32), (_FLOAT, 64)}:
        raise BadAudio(f"format {code} with {bits} bits and {channels} channels")
    raw = data[at : at + size - size % (width * channels)]
    if code == _FLOAT:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (bits - 1)
    return rate, x.reshape(-1, channels)


def resample(x: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """A mono signal at another rate: band-limited interpolation with a Hann-windowed sinc of that many
    zero crossings, cut off at the lower of the two Nyquist frequencies."""
    if rate == to or not len(x):
        return x
    common = math.gcd(rate, to)
    down, up = rate // common, to // common
    cut = min(1.0, to / rate)
    reach = int(np.ceil(zeros / cut))
    n = -(-len(x) * up // down)
    out = np.empty(n)
    taps = np.arange(-reach, reach + 2)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 2)])
    for phase in range(min(up, n)):  # outputs of one phase lie at like places between inputs
        where = np.arange(phase, n, up, dtype=np.int64) * down
        whole, part = where // up, (where[0] % up) / up
        t = taps - part
        kernel = cut * np.sinc(cut * t) * np.where(np.abs(t) < reach + 1, 0.5 + 0.5 * np.cos(np.pi * t / (reach + 1)), 0)
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(taps))
        for a in range(0, len(whole), 65_536):
            out[phase + a * up : phase + (a + len(whole[a : a + 65_536]) - 1) * up + 1 : up] = windows[whole[a : a + 65_536]] @ kernel
    return out


def _each(files: DataFrame, path: str, content: str, one, columns: str, empty: tuple) -> DataFrame:
    """path and columns, the last of them error, of one(content) for each file."""
    names_ = ["path", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    out.append((name, *one(data)))
                except (BadAudio, struct.error) as why:
                    out.append((name, *empty, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(out, columns=names_, dtype=object)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, " + columns)


def probe_wav(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sample_rate, channels, bits, duration_s and error of WAV contents, from their headers: no
    sample is decoded."""

    def one(data: bytes) -> tuple:
        _, channels, rate, bits, _, size = wav_header(data)
        frames = size // max(1, channels * bits // 8)
        return rate, channels, bits, frames / rate, None if frames else "empty_file"

    return _each(files, path, content, one, "sample_rate int, channels int, bits int, duration_s double, error string", (None,) * 4)


def decode_wav(files: DataFrame, path: str = "path", content: str = "content", rate: int | None = None) -> DataFrame:
    """path, sample_rate, channels, duration_s, signal (mono, -1 to 1, at the given rate or its own) and
    error of WAV contents; sample_rate and channels are the file's.

    A file that cannot be read, or has no samples, gives an error instead of a signal."""

    def one(data: bytes) -> tuple:
        own, x = wav_samples(data)
        if not len(x):
            return own, x.shape[1], 0.0, None, "empty_file"
        signal = x.mean(1)
        return own, x.shape[1], len(x) / own, (signal if rate is None else resample(signal, own, rate)).tolist(), None

    return _each(files, path, content, one, "sample_rate int, channels int, duration_s double, signal array<double>, error string", (None,) * 4)


def audit_durations(decoded: DataFrame, named_s: Column) -> DataFrame:
    """How far durations in names are from those in the files: counts by rate and channels, mean and
    largest difference."""
    gap = F.abs(named_s - F.col("duration_s"))
    return decoded.where("error is null").groupBy("sample_rate", "channels").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_abs_diff_s"), F.max(gap).alias("max_abs_diff_s"))
