"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its characters and words alone; gated
attention, learned from document labels, weights the passages; the weighted passage representation is
scored. Training runs on a bounded sample of labelled documents, scoring over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, giving_back

PASSAGE_WORDS = 64
SAMPLE = 2000
#: Vectors of a document at most when a model is trained: of more passages neighbours are averaged.
BAG = 32
_SINGLE = b"#$%&*!|.,;:'\"=@+-/()_<>?\\[]{}~^`"
_CLASSES = len(_SINGLE) + 8
#: Buckets of hashed runs of three bytes, of words and of neighbouring words.
GRAMS, WORDS, PAIRS = 96, 96, 64
_STATISTICS = 4
DIM = _CLASSES + GRAMS + WORDS + PAIRS + _STATISTICS
_BATCH_BYTES = 1 << 20


def _byte_classes() -> np.ndarray:
    """A class for each byte: these marks one each, then digits, upper case, lower case, space, other
    ASCII, first bytes of two-byte letters, of longer ones, and bytes that continue."""
    base = len(_SINGLE)
    table = np.full(256, base + 4, np.uint8)
    table[ord("0") : ord("9") + 1] = base
    table[ord("A") : ord("Z") + 1] = base + 1
    table[ord("a") : ord("z") + 1] = base + 2
    table[32] = base + 3
    table[0xC0:0xE0] = base + 5
    table[0xE0:] = base + 6
    table[0x80:0xC0] = base + 7
    for k, b in enumerate(_SINGLE):
        table[b] = k
    return table


_CLASS = _byte_classes()


def _shares(place: np.ndarray, bucket: np.ndarray, parts: int, buckets: int) -> np.ndarray:
    """Square roots of each part's shares of entries by bucket."""
    n = np.bincount(place * buckets + bucket, minlength=parts * buckets).reshape(parts, buckets)
    return np.sqrt(n / np.maximum(1, n.sum(1, keepdims=True)))


def _spread(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def encode_passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, in order, and the number of passages of each text (at
    least one: an empty text is one empty passage). A passage is PASSAGE_WORDS words; features are the
    shares of byte classes, of hashed runs of three bytes, of hashed words and neighbouring words, of
    distinct words and of words that repeat the one before, mean word length and the passage's fill."""
    counts, parts, distinct, fills, repeats, all_words = [], [], [], [], [], []
    for text in texts:
        w = (text or b"").split()
        n = max(1, -(-len(w) // PASSAGE_WORDS))
        counts.append(n)
        all_words += w
        for i in range(0, n * PASSAGE_WORDS, PASSAGE_WORDS):
            p = w[i : i + PASSAGE_WORDS]
            parts.append(b" ".join(p))
            distinct.append(len(set(p)) / max(1, len(p)))
            fills.append(len(p))
            repeats.append(sum(map(bytes.__eq__, p, p[1:])) / max(1, len(p)))
    n, fill = len(parts), np.array(fills)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    place = np.repeat(np.arange(n), sizes)
    inside = place[2:] == place[:-2]  # runs of three bytes of one passage
    wide = raw.astype(np.uint64)
    runs = (wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16))[inside]
    ids = np.fromiter(map(xxhash.xxh64_intdigest, all_words), np.uint64, len(all_words))
    of = np.repeat(np.arange(n), fill)
    beside = of[1:] == of[:-1]
    pairs = (ids[:-1] * np.uint64(31) + ids[1:])[beside]
    extra = np.stack([np.array(distinct), np.array(repeats), sizes / np.maximum(1, fill) / 10, np.log1p(fill) / np.log1p(PASSAGE_WORDS)], 1)
    found = [_shares(place, _CLASS[raw].astype(np.int64), n, _CLASSES), _shares(place[:-2][inside], _spread(runs, GRAMS), n, GRAMS), _shares(of, _spread(ids, WORDS), n, WORDS), _shares(of[:-1][beside], _spread(pairs, PAIRS), n, PAIRS), extra]
    return np.concatenate(found, 1).astype(np.float32), np.array(counts)


def bag(x: np.ndarray, most: int = BAG) -> np.ndarray:
    """A document's vectors, at most `most`: of more, like numbers of neighbours are averaged, so all of
    the text counts."""
    return x if len(x) <= most else np.stack([part.mean(0) for part in np.array_split(x, most)]).astype(x.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """score(x, counts): encoder e = tanh(x W + b), attention softmax over a bag of
    (tanh(e V) * sigmoid(e U)) w, bag z = sum a e, score = sigmoid(z c + d)."""

    def __init__(self, hidden: int = 16, attention: int = 8, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        shape = {"W": (DIM, hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "w": (attention,), "c": (hidden,), "d": ()}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 else 0.1, s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(DIM), np.ones(DIM)

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p, first = self.p, np.r_[0, np.cumsum(counts)[:-1]]
        e = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
        a = s / np.repeat(np.add.reduceat(s, first), counts)
        z = np.add.reduceat(a[:, None] * e, first)
        return first, e, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rounded, so that a bag's score does not depend on the bags beside it."""
        return np.round(self._forward((x - self.mean) / self.scale, counts)[-1], 9)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float = 0.0) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags, for each parameter, written out; x as it is."""
        p = self.p
        first, e, t, g, a, z, out = self._forward(x, counts)
        top = (out - y) / len(y)
        dz_each = np.repeat(top[:, None] * p["c"], counts, axis=0)
        da = (dz_each * e).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
        de = (a[:, None] * dz_each + dt @ p["V"].T + dg @ p["U"].T) * (1 - e**2)
        grad = {"W": x.T @ de, "b": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ top, "d": top.sum()}
        return {k: v + decay * p[k] for k, v in grad.items()}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        """Adam on the cross-entropy of all bags."""
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        x, p = ((x - self.mean) / self.scale).astype(np.float32), self.p
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, epochs + 1):
            for k, grad in self.gradients(x, counts, y, decay).items():
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(key: Column) -> Column:
    """Documents whose labels are never learned: crc32 of the id as text, modulo 3, is 1. A null id is
    never held out and has no label."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> AttentionModel | None:
    """A model from at most `sample` labelled documents that are not held out (those with the least
    hash of their id), or None if they lack one of the classes. Passages are encoded on the executors;
    the driver gets their features only, at most BAG vectors of DIM numbers a document. Of several labels of a document the least counts; null labels
    and labels without a document do not."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.min(label).alias("label"))
    known = known.orderBy(F.xxhash64(key), key).limit(sample)
    texts = docs.select(key, "text").join(F.broadcast(known), key).groupBy(key).agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                x, counts = encode_passages(binary(part.column(1)))
                cuts = np.r_[0, np.cumsum(counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([bag(x[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["key", "label", "x"])

    rows = texts.mapInArrow(encode, f"key {dict(docs.dtypes)[key]}, label int, x binary").orderBy("key").collect()
    y = np.array([r["label"] > 0 for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, DIM) for r in rows]
    return AttentionModel().fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about _BATCH_BYTES of text (column 1), each of at least one row."""
    sizes = np.array([len(x or b"") for x in binary(batch.column(1))], np.int64)
    group = np.cumsum(sizes) // _BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def score(docs: DataFrame, model: AttentionModel | None, key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1, higher: better quality) and n_passages of every row, over whole texts.

    A null text is empty and scored as one empty passage; without a model every score is 0.5; rows are
    scored one by one, so equal texts have equal scores; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                x, counts = encode_passages(binary(part.column(1)))
                scores = np.full(len(counts), 0.5) if model is None else model.scores(x, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())], [key, "score", "n_passages"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double, n_passages int")


def keep_good(docs: DataFrame, model: AttentionModel | None, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at_least or more, as score() has it: null and empty texts
    are one empty passage, very long ones are read whole, repeated rows stay or go together; without a
    model all rows stay; no rows give no rows. Columns may have any names and types."""
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(column)], ["row", "text"])
            found = []
            for part in _slices(texts):
                x, counts = encode_passages(binary(part.column(1)))
                found += [True] * len(counts) if model is None else (model.scores(x, counts) >= at_least).tolist()
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
