"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import binary, fresh, giving_back, n_partitions, quoted, rounds, short
from .components import components
from .shingling import shingles, words
from .vptree import Union, links

SEED = 42
_AT_ONCE = 1 << 16
_WORD = 0x9E3779B97F4A7C15


def shingle_digests(w: list[bytes], k: int) -> np.ndarray:
    """XXH64 of all runs of k words, repeats included; of the whole sequence if it is shorter."""
    if not w:
        return np.zeros(0, np.uint64)
    k = min(k, len(w))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(w, k), repeat(SEED)), np.uint64, len(w) - k + 1)


def majority(digests: np.ndarray) -> np.uint64:
    """The number whose bits are set in over half the digests; 0 without digests."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), _AT_ONCE):
        counts += np.unpackbits(digests[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(digests), bitorder="little").view(np.uint64)[0]


def wide(digests: np.ndarray, lanes: int) -> np.ndarray:
    """A fingerprint of 64 bits a lane: the first of the digests, the others of digests mixed anew."""
    out = []
    for lane in range(lanes):
        x = digests
        if lane:
            x = (x ^ (x >> np.uint64(31))) * np.uint64(_WORD * (2 * lane + 1) % 2**64)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(x))
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """key and fp (a long) of every row's whole text: A-Z in lower case, words between ASCII white
    space, shingles of k words. A null text is empty; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_digests(words(text or b""), k)) for text in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], [key, "fp"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def linked_documents(docs: DataFrame, k: int = 5, radius: int = 2, key: str = "doc_id") -> DataFrame:
    """key, fp, component_id (the least key reachable over fingerprints within the radius, itself
    included) and links (other rows with the same or a linked component) of every row.

    Equal fingerprints are one point of the search, so copies cost nothing there; all fingerprints are
    searched, 0 like any other. Null keys are rows like any other and are the least key only of a
    component without another; repeated rows come back as often as they are; no rows give no rows.
    """
    base = written(fingerprints(docs, k, key), "fingerprints")
    points = written(base.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "points")
    roots = written(components(links(points, radius)), "roots")
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    found = placed.join(ids, "root").select("fp", "component_id", (F.col("members") - 1).alias("links"))
    return base.join(found, "fp").select(key, "fp", "component_id", "links")


# ---- near-duplicate texts: a prefix of the shingles and the tree choose whom to compare, the shingles decide


LANES = 4
#: Share of the wide fingerprints' bits that candidates agree in, for texts of SMALL distinct shingles or
#: more and for shorter ones. Pairs of Jaccard 0.8 agree in 0.85 (0.81) on average, deviation 0.02.
AGREEMENT, AGREEMENT_SMALL, SMALL = 0.7, 0.62, 32
#: Texts and shingles of a block at most, and texts that are never cut into blocks.
BLOCK, BLOCK_SHINGLES, FEW = 8192, 1 << 21, 64
#: Texts that are looked at for frequent shingles, the share that makes one, and how many there can be.
LOOKED_AT, FREQUENT_SHARE, FREQUENT = 4096, 1 / 256, 1 << 16


def frequent_shingles(docs: DataFrame, k: int = 5, text: str = "text") -> np.ndarray:
    """Sorted digests of shingles that many texts of a bounded sample have. They only say which shingles
    come last in a prefix, never which texts are compared or alike: any set gives the same result."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 0):
            for body in binary(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_digests(words(body or b""), k)).view(np.int64))], ["h"])

    some = docs.sample(min(1.0, LOOKED_AT / n), seed=SEED).select(quoted(text)).mapInArrow(giving_back(run), "h long")
    found = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(4, int(LOOKED_AT * FREQUENT_SHARE))).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64))


def prefix(digests: np.ndarray, similarity: float, last: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n distinct digests (sorted), those in `last` after all
    others. Two sets with that Jaccard similarity have one of these in common, as both follow one order."""
    n = len(digests)
    if not n:
        return digests
    if len(last):
        late = last[np.minimum(np.searchsorted(last, digests), len(last) - 1)] == digests
        digests = np.concatenate([digests[~late], digests[late]])
    return digests[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def describe(docs: DataFrame, k: int = 5, similarity: float = 0.8, last: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: key, digest of the text (MD5), number of distinct shingles of k words, a fingerprint
    of LANES x 64 bits over these, its first 64 as fp, and the prefix of the shingles."""
    last = np.zeros(0, np.uint64) if last is None else last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            tid, size, prints, fps, prefixes = [], [], [], [], []
            for body in binary(batch.column(1)):
                digests = np.unique(shingle_digests(words(body or b""), k))
                lanes = wide(digests, LANES)
                tid.append(hashlib.md5(body or b"").hexdigest())
                size.append(len(digests))
                prints.append(lanes.tobytes())
                fps.append(int(lanes.view(np.int64)[0]))
                prefixes.append(prefix(digests, similarity, last).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tid, pa.string()), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(fps, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["key", "tid", "size", "print", "fp", "prefix"])

    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    return rows.mapInArrow(giving_back(run), f"key {dict(rows.dtypes)['key']}, tid string, size long, print binary, fp long, prefix array<long>")


def _candidates(prints: np.ndarray, size: np.ndarray, similarity: float, r: int, rows: int, c: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j, i of the rows from r and j of the columns from c, whose fingerprints agree in enough
    of the bits and whose sizes allow the similarity."""
    d = np.zeros((min(rows, len(prints) - r), min(columns, len(prints) - c)), np.uint16)
    for lane in range(LANES):
        d += np.bitwise_count(prints[r : r + rows, lane, None] ^ prints[None, c : c + columns, lane])
    i, j = np.nonzero(d <= int((1 - AGREEMENT_SMALL) * 64 * LANES + 1e-9))
    d = d[i, j]
    i, j = r + i, c + j
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    fits = (i < j) & (low >= similarity * high - 1e-9) & ((d <= int((1 - AGREEMENT) * 64 * LANES + 1e-9)) | (high < SMALL))
    return i[fits], j[fits]


def _edges(ids: np.ndarray, union: Union) -> pa.RecordBatch:
    """Every text to the root of those it is joined with."""
    root = union.find(np.arange(len(ids)))
    apart = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[root[apart]])], ["a", "b"])


def _group(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows, one a text, with their ids, sizes and fingerprints."""
    whole = pa.Table.from_batches(held)
    ids, first = np.unique(whole.column("id").to_numpy(), return_index=True)
    whole = whole.take(pa.array(first))
    return whole, ids, whole.column("size").to_numpy(), np.frombuffer(b"".join(whole.column("print").to_pylist()), np.uint64).reshape(-1, LANES)


def _compare(similarity: float):
    """Edges that connect the candidates of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "group"):
            _, ids, size, prints = _group(held)
            union = Union(len(ids))
            for r in range(0, len(ids), 256):
                for c in range(r, len(ids), 4096):
                    union.join(*_candidates(prints, size, similarity, r, 256, c, 4096))
            yield _edges(ids, union)

    return run


def jaccard(held: np.ndarray, starts: np.ndarray, size: np.ndarray, mark: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Jaccard similarity of set i to each of the sets js: set i is held[starts[i] : starts[i] + size[i]],
    its members numbers below len(mark). mark is all False before and after."""
    own = held[starts[i] : starts[i] + size[i]]
    mark[own] = True
    shared = np.empty(len(js), np.int64)
    ends = np.cumsum(size[js])
    at = 0
    while at < len(js):  # so many sets at once as _AT_ONCE members, one at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * _AT_ONCE, "right")))
        n = size[js[at:to]]
        offset = np.cumsum(n) - n
        members = held[np.arange(n.sum()) + np.repeat(starts[js[at:to]] - offset, n)]
        shared[at:to] = np.add.reduceat(mark[members], offset, dtype=np.int64)
        at = to
    mark[own] = False
    return shared / (size[i] + size[js] - shared)


def _confirm(similarity: float):
    """Edges that connect the texts of each group whose sets of shingles are that similar: every
    candidate pair is compared, but for those that are connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "group"):
            whole, ids, size, prints = _group(held)
            every, members = np.unique(np.frombuffer(b"".join(whole.column("shingles").to_pylist()), np.uint64), return_inverse=True)
            starts, mark, union = np.cumsum(size) - size, np.zeros(len(every), bool), Union(len(ids))
            for r in range(0, len(ids), 256):
                i, j = _candidates(prints, size, similarity, r, 256, r, len(ids))
                cuts = np.searchsorted(i, np.arange(r, min(r + 256, len(ids)) + 1))
                for row, (a, b) in enumerate(zip(cuts, cuts[1:]), r):
                    js = j[a:b]
                    js = js[union.find(js) != union.find(np.array([row]))[0]]
                    if len(js):
                        js = js[jaccard(members, starts, size, mark, row, js) >= similarity - 1e-9]
                        union.join(np.full(len(js), row), js)
            yield _edges(ids, union)

    return run


def _in_groups(members: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """id and group of texts (id, by and, if given, weight): those of one `by` meet. Of those with up to
    FEW texts each different set is one group. Larger ones are cut into blocks by hash, more of them the
    more texts there are, and every two blocks are a group."""
    n = F.count(F.lit(1))
    least = [n / BLOCK, F.sqrt(n / FEW), *([F.sum(weight) / BLOCK_SHINGLES] if weight else [])]
    sizes = members.groupBy(by).agg(F.ceil(F.greatest(*least)).cast("int").alias("blocks"), n.alias("n")).where("n > 1").select(by, "blocks")
    members = written(members.select(by, "id").join(sizes, by), "members")
    few = members.where("blocks = 1").groupBy(by).agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    few = few.select(F.explode("ids").alias("id"), F.xxhash64("ids").alias("group"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    many = members.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    return few.unionByName(many.select("id", group.alias("group")).distinct())


def _shingles(texts: DataFrame, k: int) -> DataFrame:
    """group, id, size, print and distinct shingles of k words of texts (id, size, print, groups and
    text), repeats of a text within a partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in short(batches, "text"):
            new = [n for n, i in enumerate(batch.column("id").to_pylist()) if i not in seen and not seen.add(i)]
            batch = batch.take(pa.array(new, pa.int64()))
            found = [np.unique(shingle_digests(words(body or b""), k)).tobytes() for body in binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "size", "print", "groups")], pa.array(found, pa.binary())], ["id", "size", "print", "groups", "shingles"])

    found = texts.select("id", "size", "print", "groups", "text").mapInArrow(giving_back(run), "id long, size long, print binary, groups array<long>, shingles binary")
    return found.select(F.explode("groups").alias("group"), "id", "size", "print", "shingles")


def near_duplicate_texts(texts: DataFrame, bodies: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """node and root of the texts (by id) that are near-duplicates of another: their sets of shingles of
    k words have at least that Jaccard similarity.

    Candidates are texts whose fingerprints the vantage-point trees find within the radius, and texts
    that share a shingle of their prefixes, as any two of the similarity do: no pair is left to chance.
    Of these the pairs whose wide fingerprints agree go on, and the shingles of texts with a candidate go
    once to those they are connected with, which are compared exactly. Takes describe() with one row a
    text and an id each, written to a table, and tid, key and text of the documents. Texts without
    shingles have no near-duplicates; no rows give no rows. Groups over FEW texts or BLOCK_SHINGLES
    shingles are cut into blocks by hash of which every two meet on their own: no group is capped and
    none is whole in one task."""
    spark = texts.sparkSession
    points = written(texts.where("size > 0").select("fp").distinct(), "points")
    roots = written(components(links(points, radius)), "fingerprint-roots")
    tree = texts.where("size > 0").join(roots, F.col("fp") == F.col("node"), "left").select("id", F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("by"))
    keyed = texts.select("id", F.explode("prefix").alias("by")).unionByName(tree)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_partitions(spark), "group").sortWithinPartitions("group")

    members = _in_groups(keyed, "by").join(texts.select("id", "size", "print"), "id").select("group", "id", "size", "print")
    near = components(grouped(members).mapInArrow(giving_back(_compare(similarity)), "a long, b long"))
    near = written(near.join(texts, near["node"] == texts["id"]).select("id", "tid", "key", "size", "print", "root"), "candidates")
    groups = _in_groups(near.select("id", "size", "root"), "root", "size").groupBy("id").agg(F.collect_list("group").alias("groups"))
    near = near.join(groups, "id").withColumnsRenamed({"tid": "__tid", "key": "__key"})
    wanted = bodies.join(near, (F.col("tid") == F.col("__tid")) & F.col("key").eqNullSafe(F.col("__key")))
    return components(grouped(_shingles(wanted, k)).mapInArrow(giving_back(_confirm(similarity)), "a long, b long"))


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns: the one of least key, nulls last.

    Exact copies are one text; a null text is the empty text, and empty texts are copies of each
    other. Of several rows with the kept key and text the one whose columns, as JSON, come first stays.
    Columns may have any names and types, maps too; very long texts are read whole; no rows give no
    rows."""
    base = written(describe(docs, k, similarity, frequent_shingles(docs, k, text), key, text), "texts")
    texts = base.groupBy("tid").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", "print", "fp", "prefix")])
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    body = F.coalesce(quoted(text), F.lit(""))
    digest = F.md5(body.cast("binary"))
    roots = near_duplicate_texts(texts, docs.select(digest.alias("tid"), quoted(key).alias("key"), body.alias("text")), k, similarity)
    kept = texts.join(roots, texts["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("group")).agg(F.min(F.struct(F.col("key").isNull(), "key", "tid")).alias("kept"))
    kept = written(kept.select("kept.tid", "kept.key"), "kept")
    tid, digests = (fresh(docs.columns, c) for c in ("kept_tid", "digest"))
    names = [quoted(c) for c in docs.columns]

    def chosen(of: DataFrame) -> DataFrame:
        right = of.select(F.col("tid").alias(tid), F.col("key").alias(f"{tid}_key"))
        return docs.withColumn(digests, digest).join(right, (F.col(digests) == F.col(tid)) & quoted(key).eqNullSafe(F.col(f"{tid}_key")), "left_semi")

    same = (F.col("tid") == F.col("t")) & F.col("key").eqNullSafe(F.col("k"))
    counted = base.select("tid", "key").join(kept.select(F.col("tid").alias("t"), F.col("key").alias("k")), same, "left_semi").groupBy("tid", "key").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counted.where("n > 1").select("tid", "key"), "repeated")
    if repeated.isEmpty():
        return chosen(kept).select(*names)
    only = chosen(kept.join(repeated.select(F.col("tid").alias("t"), F.col("key").alias("k")), same, "left_anti")).select(*names)
    rows = chosen(repeated).select(F.col(digests), F.struct(*names).alias("row"))
    first = rows.groupBy(digests).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return only.unionByName(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
