"""Features and vectors of clips, looked up by the two sides of a trial."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binning, vectors

#: A dimension below this size may be broadcast, by its own bytes and not by a hint alone.
BROADCAST_BYTES = 64 << 20
#: Vectors of a padded batch of signals, given with their relative lengths.
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dimension(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df marked for broadcast if its rows times their size stay below BROADCAST_BYTES, else as it is."""
    most = BROADCAST_BYTES // bytes_a_row
    small = df.limit(most + 1).count() <= most
    return F.broadcast(df) if small else df


def attach(trials: DataFrame, features: DataFrame, columns: list[str], key: str, enroll: str, test: str, bytes_a_row: int = 64) -> DataFrame:
    """trials with enroll_c and test_c for each feature column c, null where a clip has none."""
    for side, on in (("enroll", enroll), ("test", test)):
        dim = dimension(features.select(F.col(key).alias(f"__{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), bytes_a_row)
        trials = trials.join(dim, trials[on] == dim[f"__{side}"], "left").drop(f"__{side}")
    return trials


def feature_diffs(trials: DataFrame, columns: list[str]) -> DataFrame:
    """trials with the absolute difference of each feature; null if either side has none."""
    return trials.withColumns({f"{c}_diff": F.abs(F.col(f"test_{c}") - F.col(f"enroll_{c}")) for c in columns})


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def with_test_mic(trials: DataFrame, clips: DataFrame, key: str, test: str) -> DataFrame:
    """The test clip's microphone, the trial's condition."""
    dim = dimension(clips.select(F.col(key).alias("__test"), F.col("mic_type").alias("mic")), 32)
    return trials.join(dim, trials[test] == dim["__test"], "left").drop("__test")


def score_cosine(trials: DataFrame, embeddings: DataFrame, key: str, vector: str, enroll: str, test: str) -> DataFrame:
    """trials with their cosine score, null where a vector is missing or has no length. Norms are
    computed once a clip, not once a trial, and dot products batch by batch. Whether the vectors may be
    broadcast is decided by their own size."""
    unit = embeddings.select(key, F.col(vector).alias("v"), vectors.norm(F.col(vector)).alias("norm"))
    longest = embeddings.agg(F.max(F.size(vector))).first()[0] or 0
    out = attach(trials, unit, ["v", "norm"], key, enroll, test, bytes_a_row=64 + 8 * longest)
    scale = F.col("enroll_norm") * F.col("test_norm")
    dots = out.withColumn("score", F.when(scale > 0, vectors.dot_batches(F.col("enroll_v"), F.col("test_v")) / scale))
    return dots.drop("enroll_v", "test_v", "enroll_norm", "test_norm")


def signal_features(clips: DataFrame, signal: str, curve: list[float], *keys: str) -> DataFrame:
    """energy_db and wada_snr_db of signals, error 'empty_file' for those without samples."""
    x = F.col(signal)
    empty = x.isNull() | (F.size(x) == 0)
    return clips.select(*keys, vectors.energy_db(x).alias("energy_db"), vectors.snr_from_g(vectors.wada_g(x), curve).alias("wada_snr_db"), F.when(empty, "empty_file").alias("error"))


def orient_confound(diff: Column) -> Column:
    """A difference as a score: smaller is more alike."""
    return -diff


def scaled(x: Column, factor: float) -> Column:
    return x * F.lit(factor)


def length_shares(clips: DataFrame, cs: str, edges: list[int], labels: list[str]) -> DataFrame:
    """Share of clips in each duration bucket and the median duration, missing ones left out."""
    known = clips.where(F.col(cs) > 0).select(binning.bucket_label(F.col(cs), edges, labels).alias("bucket"), cs)
    total = known.agg(F.count(F.lit(1)).alias("total"), (F.median(cs) / 100).alias("median_s"))
    return known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "median_s")


def predict(clips: DataFrame, load: Callable[[], Model], key: str, signal: str, items: int = 16, samples: int = 16 * 16_000 * 15) -> DataFrame:
    """key, vector and error of each clip: a model's vectors, batch by batch.

    load() makes the model once a task; model(batch, lengths) takes a matrix of signals, padded with
    zeros to the longest, and their lengths relative to it, and returns a vector each. A batch holds at
    most `items` clips of at most `samples` padded samples together (a longer clip is a batch). If a
    batch fails its clips are tried one by one, so one bad clip costs itself only: it gets an error, as
    do clips without samples. Clips should come in order of length (plan_batches) to pad little."""
    kind = dict(clips.dtypes)[key]

    def one_batch(model: Model, batch: list[np.ndarray]) -> np.ndarray:
        longest = max(map(len, batch))
        padded = np.zeros((len(batch), longest))
        for row, x in zip(padded, batch):
            row[: len(x)] = x
        return np.asarray(model(padded, np.array([len(x) / longest for x in batch])), np.float32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            found: list[tuple] = []
            keys: list = []
            batch: list[np.ndarray] = []

            def done() -> None:
                try:
                    found.extend((k, v.tolist(), None) for k, v in zip(keys, one_batch(model, batch)))
                except Exception:  # noqa: BLE001  whatever a model raises; the clips are tried one by one
                    for k, x in zip(keys, batch):
                        try:
                            found.append((k, one_batch(model, [x])[0].tolist(), None))
                        except Exception as why:  # noqa: BLE001
                            found.append((k, None, f"{type(why).__name__}: {why}"))
                keys.clear()
                batch.clear()

            for k, x in zip(frame["key"], frame["signal"]):
                if x is None or not len(x):
                    found.append((k, None, "empty_file"))
                    continue
                if batch and (len(batch) >= items or (len(batch) + 1) * max(len(x), *map(len, batch)) > samples):
                    done()
                keys.append(k)
                batch.append(np.asarray(x, np.float64))
            if batch:
                done()
            yield pd.DataFrame(found, columns=["key", "vector", "error"], dtype=object)

    out = clips.select(F.col(key).alias("key"), F.col(signal).alias("signal")).mapInPandas(run, f"key {kind}, vector array<float>, error string")
    return out.withColumnRenamed("key", key)
