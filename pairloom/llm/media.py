"""Media columns: payloads stored as WAV, read with the wave module, short-time Fourier transforms,
and fingerprints of spectral-peak pairs kept as time-coded arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192  # payloads are padded to a multiple of this
RATE = 8000
FRAME, HOP = 192, 12
LOW = 2  # bins below are the mean and its leak
NEAR = (16, 5)  # a peak is the strongest cell within so many frames (a power of two) and bins either way
FLOOR, SHARE = 1.0, 1e-3  # and has that power and that share of its frame's strongest cell at least
FAN = 5  # each peak is paired with so many later ones
GAP = 6  # frames of a step in the gap of a code
FRAMES_AT_ONCE = 1 << 14


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes."""
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return held.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Spaces up to a positive multiple of block."""
    return payload + b" " * (-len(payload) % block if payload else block)


def _local(power: np.ndarray) -> np.ndarray:
    """Which cells of a spectrogram are local maxima within NEAR, for all frames but the NEAR[0] at
    either end. Of frames that tie the first counts, so a steady sound has a peak where it starts."""
    near, wide = NEAR
    high = power.copy()
    for k in range(1, wide + 1):
        np.maximum(high[:, k:], power[:, :-k], out=high[:, k:])
        np.maximum(high[:, :-k], power[:, k:], out=high[:, :-k])
    own = power[near:-near]
    found = (own == high[near:-near]) & (own >= np.maximum(FLOOR, SHARE * own.max(1, keepdims=True)))
    k = 1
    while k < near:  # the highest of k frames from each on
        high = np.maximum(high[:-k], high[k:])
        k *= 2
    return found & (own > high[: len(own)]) & (own >= high[near + 1 :][: len(own)])


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the spectrogram's local maxima, in order. Frames are transformed
    FRAMES_AT_ONCE at a time, with those that decide about their first and last. A payload of one frame, of which
    the window hides the first bytes, is led in by a frame of spaces."""
    if len(samples) == FRAME:
        samples = np.concatenate([np.full(FRAME, ord(" "), np.uint8), samples])
    n, near = (len(samples) - FRAME) // HOP + 1, NEAR[0]
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)  # periodic: a steady level leaks into no bin from LOW on
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    times, bins = [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        to = min(n, at + FRAMES_AT_ONCE)
        lo, hi = max(0, at - near), min(n, to + near)
        spectrum = np.fft.rfft((frames[lo:hi].astype(np.float32) - 128) * window, axis=1)[:, LOW:]
        power = np.full((to - at + 2 * near, spectrum.shape[1]), -1, np.float32)
        power[lo - at + near : hi - at + near] = spectrum.real**2 + spectrum.imag**2
        t, f = np.nonzero(_local(power))
        times.append(at + t)
        bins.append(LOW + f)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the peak pairs: the first peak's frame, and both bins with the steps of GAP
    frames between them as f1 << 20 | f2 << 12 | gap (gaps over 4095 as 4095). Peaks of one frame pair
    with each other, and a payload's only peak with itself. Without a sound, as of spaces, there are none."""
    t, f = peaks(samples)
    if len(t) == 1:
        t, f = t.repeat(2), f.repeat(2)
    times, codes = [], []
    for k in range(1, FAN + 1):
        if len(t) > k:
            gap = np.minimum((t[k:] - t[:-k]) // GAP, 4095)
            times.append(t[:-k])
            codes.append(f[:-k] << 20 | f[k:] << 12 | gap)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (a WAV file) of each row: the text's UTF-8 bytes padded with spaces.

    A null text is empty and becomes one block of spaces; no rows give no rows; other columns are not
    read; equal texts give equal files."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    kind = dict(df.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                payloads = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(p) for p in payloads], pa.int64()), pa.array([to_wav(pad(p)) for p in payloads], pa.binary())], [key, "n_bytes", "media"])

    return rows.mapInArrow(encode, f"`{key}` {kind}, n_bytes long, media binary")


def describe_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files hold, read back: payload and file sizes and digests, and the fingerprint
    as time-coded arrays (times in frames, codes). Takes key, n_bytes and media; a null file gives
    nulls; rows and equal files are treated alike one by one."""
    kind = dict(media.dtypes)[key]
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<long>"
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64()))]

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * len(fields)
        payload = from_wav(stored)
        times, codes = fingerprint(np.frombuffer(payload, np.uint8))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), times, codes

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = list(zip(*[one(x) for x in part.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, kind) for c, (_, kind) in zip(columns, fields)]], [key, "n_bytes", *[n for n, _ in fields]])

    return media.select(key, "n_bytes", "media").mapInArrow(describe, schema)
