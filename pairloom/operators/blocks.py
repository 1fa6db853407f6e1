"""All trials of two sides, made and scored a pair of blocks at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..storage import n_partitions, written
from . import trials

#: Clips of a block, of all genders together.
BLOCK = 2048
#: Scores that are computed at once, and pairs of blocks that a task takes.
TILE, PAIRS = 1 << 17, 64


def _packed(clips: DataFrame, unit: DataFrame, side: str, columns: list[str]) -> tuple[DataFrame, int]:
    """A row a group and block with its clips as one array, and the number of blocks of a group. Groups
    are genders; a speaker of none meets itself only."""
    kept = clips.where("speaker_id is not null")
    n = max(1, -(-kept.count() // BLOCK))
    group = F.coalesce(trials.gender_of(F.col("speaker_id")), F.concat(F.lit("="), "speaker_id"))
    known = F.col("meeting_id").isNotNull() & F.col("duration_cs").isNotNull()
    held = [F.col(c) for c in dict.fromkeys(["speaker_id", "meeting_id", *columns])]
    rows = kept.join(unit, kept["clip_id"] == unit["__key"], "left")
    rows = rows.select(group.alias("group"), F.pmod(F.xxhash64("clip_id"), F.lit(n)).cast("int").alias(side), F.struct(*held, known.alias("__known"), "__v", "__norm").alias("clip"))
    return written(rows.groupBy("group", side).agg(F.collect_list("clip").alias(f"{side}_clips")), f"{side}-blocks"), n


def scored_trials(enroll: DataFrame, test: DataFrame, embeddings: DataFrame, key: str, vector: str, columns: tuple[str, ...] = ("enroll_clip_id", "test_clip_id"), decimals: int | None = None) -> DataFrame:
    """columns (enroll_c or test_c of the clips' columns c), target and score of every positive trial and
    every negative candidate of two clip tables: the rows of positive_trials() and negative_candidates(),
    with the scores of score_cosine(), rounded half away from zero if decimals are given.

    Clips are packed into blocks, and a task computes the scores of two blocks from two matrices, so that
    vectors travel once a pair of blocks and not once a trial, and no trial is shuffled or written.
    Products are summed in the order of the elements, as SQL does it. Blocks are written once; whoever reads the
    trials again computes them again, which is cheaper than keeping them."""
    spark = enroll.sparkSession
    v = F.col(vector)
    unit = embeddings.select(F.col(key).alias("__key"), v.alias("__v"), vectors.norm(v).alias("__norm"))
    wanted = [(c, *c.split("_", 1)) for c in columns]
    own = {s: list(dict.fromkeys(c for _, side, c in wanted if side == s)) for s in ("enroll", "test")}
    e, ne = _packed(enroll, unit, "enroll", own["enroll"])
    t, nt = _packed(test, unit, "test", own["test"])
    parts = max(n_partitions(spark), ne * nt // PAIRS)
    keys = ["group", "enroll", "test"]
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = e.withColumn("test", other(nt)).repartition(parts, *keys).join(t.withColumn("enroll", other(ne)).repartition(parts, *keys), keys)
    kinds = dict(enroll.dtypes) | dict(test.dtypes)
    schema = ", ".join([*[f"{c} {kinds[name]}" for c, _, name in wanted], "target boolean", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("enroll_clips"), batch.column("test_clips")):
                for i, j, target, score, known in _scores(x.values, y.values):
                    if decimals is not None:
                        score = np.copysign(np.floor(np.abs(score) * 10.0**decimals + 0.5) / 10.0**decimals, score) + 0.0
                    at = {"enroll": (x.values, pa.array(i)), "test": (y.values, pa.array(j))}
                    out = [at[side][0].field(c).take(at[side][1]) for _, side, c in wanted]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(target), pa.array(score, mask=~known)], [*columns, "target", "score"])

    return pairs.select("enroll_clips", "test_clips").mapInArrow(run, schema)


def _codes(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values of two arrays are; nulls are -1."""
    both = pc.dictionary_encode(pa.concat_arrays([x, y])).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[: len(x)], both[len(x) :]


def _matrix(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as columns, filled up with zeros, and their lengths (-1: none)."""
    size = pc.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros((max(0, size.max(initial=0)), len(v)))
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    column = np.repeat(np.arange(len(v)), np.maximum(size, 0))
    row = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    out[row, column] = flat
    return out, size


def _scores(x: pa.StructArray, y: pa.StructArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in x and y, target, score and whether it is known, of the trials of two blocks."""
    (xs, ys), (xm, ym) = _codes(x.field("speaker_id"), y.field("speaker_id")), _codes(x.field("meeting_id"), y.field("meeting_id"))
    (xv, xn), (yv, yn) = _matrix(x.field("__v")), _matrix(y.field("__v"))
    norm = lambda z: z.field("__norm").fill_null(0.0).to_numpy(zero_copy_only=False)
    known = lambda z: z.field("__known").to_numpy(zero_copy_only=False)
    xr, yr, xk, yk = norm(x), norm(y), known(x), known(y)
    step = max(1, TILE // max(1, len(ys)))
    for a in range(0, len(xs), step):
        own = slice(a, a + step)
        same = xs[own, None] == ys
        kept = same | (xk[own, None] & yk & (xm[own, None] != ym))
        dots = np.zeros(kept.shape)
        part = np.empty(kept.shape)
        for p, q in zip(xv[:, own], yv):
            dots += np.multiply(p[:, None], q, out=part)
        i, j = np.nonzero(kept)
        scale = xr[own][i] * yr[j]
        ok = (scale > 0) & (xn[own][i] == yn[j])
        yield i + a, j, same[i, j], np.divide(dots[i, j], scale, out=np.zeros(len(i)), where=ok), ok
