"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

Items are partitioned by size. Of an item with n distinct shingles, a document that holds a share t
of them lacks at most n - ceil(t n); so of the n - ceil(t n) + 1 shingles with the least hashes (the
item's bottom sketch) it has at least one. Every size class has two bit filters, of its sketches and of
all its shingles. In one pass, whatever the number of items, a document looks its shingles up there: a
class of which it has a sketch shingle, and as many shingles as the class's smallest share asks for,
gets its hits. These meet the items by an equi-join on the shingles themselves, so containment is
counted exactly: nothing is missed and nothing is estimated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import binary, fresh, giving_back, quoted
from .shingling import shingle_hashes, shingles, word_hashes, words

#: Bits of a filter for each shingle of its class, and of the largest filter (16 MB).
BITS_EACH, MOST_BITS = 16, 27


@dataclass
class Filter:
    """The bit filters of the items with shingles of k words and a size of that class."""

    k: int
    size_class: int
    least: int  # shingles that a document must share with the smallest share of the class
    bits: int
    sketch: np.ndarray
    every: np.ndarray

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of a document's shingle hashes may be an item's: none, if no item can be contained."""
        if not _has(self.sketch, hashes, self.bits).any():
            return np.zeros(0, np.int64)
        found = np.flatnonzero(_has(self.every, hashes, self.bits))
        return found if len(found) >= self.least and len(np.unique(hashes[found])) >= self.least else found[:0]


def _has(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64((1 << bits) - 1)
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def item_shingles(items: DataFrame, k: int, threshold: float, item: str, text: str) -> DataFrame:
    """A row for each distinct shingle of each item: ref (a number of the item's row), item, k (words of
    a shingle), size_class, n (the item's shingles), need (those that containment asks for), shingle, h
    (its hash) and sketch (whether it is of the bottom sketch). Items without words have none."""
    item_type = items.select(quoted(item)).limit(0).toArrow().schema.field(0).type
    names = ["ref", "item", "k", "size_class", "n", "need", "shingle", "h", "sketch"]
    kinds = [pa.int64(), item_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = TaskContext.get().partitionId() << 33
        for batch in batches:
            for value, body in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                ref += 1
                w = words(body or b"")
                if not w:
                    continue
                size = min(k, len(w))
                hashes, first = np.unique(shingle_hashes(word_hashes(w), size), return_index=True)
                text_of = list(shingles(w, size))
                n = len(hashes)
                need = max(1, int(np.ceil(threshold * n - 1e-9)))
                columns = [[ref] * n, [value] * n, [size] * n, [n.bit_length()] * n, [n] * n, [need] * n, [text_of[i] for i in first.tolist()], hashes.view(np.int64), np.arange(n) <= n - need]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = items.select(quoted(item).alias("item"), quoted(text).alias("text"))
    return rows.mapInArrow(cut, f"ref long, item {dict(rows.dtypes)['item']}, k int, size_class int, n int, need int, shingle binary, h long, sketch boolean")


def filters(table: DataFrame) -> list[Filter]:
    """Bit filters of the classes of item_shingles(), made on the executors; what comes to the driver is
    bounded by MOST_BITS a class, however many items there are."""
    classes = table.groupBy("k", "size_class").agg(F.min("need").alias("least"), F.count_distinct("h").alias("n")).collect()
    out = []
    for c in sorted(classes):
        bits = max(10, min(MOST_BITS, (BITS_EACH * c["n"]).bit_length()))
        at = F.col("h").bitwiseAND((1 << bits) - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
        rows = table.where((F.col("k") == c["k"]) & (F.col("size_class") == c["size_class"])).groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("every"), F.coalesce(F.bit_or(F.when(F.col("sketch"), bit)), F.lit(0).cast("long")).alias("sketch"))
        found = rows.toArrow()
        made = {name: np.zeros(1 << (bits - 6), np.uint64) for name in ("every", "sketch")}
        for name, words_ in made.items():
            words_[found.column("at").to_numpy()] = found.column(name).to_numpy().view(np.uint64)
        out.append(Filter(c["k"], c["size_class"], c["least"], bits, made["sketch"], made["every"]))
    return out


def _hits(docs: DataFrame, classes: list[Filter], key: str, text: str) -> DataFrame:
    """key, digest (of the text, MD5), k, size_class and shingle: the distinct shingles of each row's
    whole text that a class's filters let through."""
    key_type = docs.select(quoted(key)).limit(0).toArrow().schema.field(0).type

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            for value, body in zip(keys, binary(batch.column(1))):
                w = words(body or b"")
                hashes, by_k = word_hashes(w), {}
                for c in classes:
                    if c.k not in by_k:
                        by_k[c.k] = shingle_hashes(hashes, c.k)
                    found = c.hits(by_k[c.k])
                    if len(found):
                        digest = hashlib.md5(body).digest()
                        out += [(value, digest, c.k, c.size_class, s) for s in {b" ".join(w[i : i + c.k]) for i in found.tolist()}]
                if len(out) > 50_000:
                    yield _batch(out, key_type)
                    out = []
            yield _batch(out, key_type)

    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    return rows.mapInArrow(giving_back(find), f"key {dict(rows.dtypes)['key']}, digest binary, k int, size_class int, shingle binary")


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "digest", "k", "size_class", "shingle"])


def _contained(docs: DataFrame, items: DataFrame, k: int, threshold: float, key: str, item: str, text: str) -> DataFrame:
    """key, digest, ref, item, n_shared, n_shingles and copies (rows with that key and text)."""
    table = written(item_shingles(items, k, threshold, item, "text"), "item-shingles")
    found = _hits(docs, filters(table), key, text).join(table.drop("h", "sketch"), ["k", "size_class", "shingle"])
    # a row has each shingle once, so what comes more often is another row with the same key and text
    each = found.groupBy("key", "digest", "ref", "item", "need", "n", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    whole = each.groupBy("key", "digest", "ref", "item", "need", "n").agg(F.count(F.lit(1)).cast("int").alias("n_shared"), F.min("copies").alias("copies"))
    return whole.where("n_shared >= need").select("key", "digest", "ref", "item", "n_shared", F.col("n").alias("n_shingles"), "copies")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, item, n_shared and n_shingles of each document and item (its text in column text) with
    containment of at least threshold.

    Shingles are runs of k lower-cased words, distinct; an item of fewer words has one shingle, the
    whole of it; an item without words is contained nowhere. Null texts are empty and contain nothing.
    Repeated documents and items, null keys and ids come back as often as they are; no rows or items
    give no rows; other columns are not read. Documents are read once, whatever the number of items.
    """
    whole = _contained(docs, items, k, threshold, key, item, text)
    one = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return whole.select(F.col("key").alias(key), F.col("item").alias(item), "n_shared", "n_shingles", one.alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item as contained_items() has it. Rows with a null
    or empty text stay, repeated rows stay or go together; without items all rows stay; no rows give no
    rows. Columns may have any names and types."""
    digest = F.md5(quoted(text).cast("binary"))
    bare = docs.select(digest.alias("key"), quoted(text).alias("text"))
    dirty = written(_contained(bare, items, k, threshold, "key", item, "text").select("key").distinct(), "contaminated")
    mark = fresh(docs.columns, "digest")
    right = dirty.select(F.col("key").alias(f"{mark}_key"))
    return docs.withColumn(mark, digest).join(right, F.col(mark) == F.col(f"{mark}_key"), "left_anti").select(*map(quoted, docs.columns))
