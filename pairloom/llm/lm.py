"""Language-model scoring: stupid backoff over word trigrams, counted on all documents.

    S(w | u v) = c(u v w) / c(u v)   if the trigram occurs at least min_count times
               = alpha S(w | v)      otherwise, and so on down to
    S(w)       = c(w) / N

Count tables are partitioned by hash, the documents' exploded n-grams meet them there, and each
document's parts are summed. Every word of a document gives one triple: itself as the middle word v,
the word u before it and the word w after it. All triples of one v meet in one partition, and as c(u v w),
c(u v), c(v w) and c(v) all count triples of that v, one exchange serves both orders:

1. triples by their middle word: trigrams, and bigrams of all but frequent middle words;
2. what a frequent middle word leaves over, by bigram: its triples are dealt by (u, v) instead, or by
   all three words if that pair is frequent too, so c(v w) is added up here;
3. what is left, by its last word, with the table of word counts: unigrams;
4. partial sums by the documents they belong to.

N-grams travel as packed columns, one block for each slice of documents and partition, so a row of an
exchange holds thousands of them; common words, a bounded table, travel as 16-bit ranks. Frequent
words, bigrams and trigrams are no hot keys: their counts, bounded tables, are taken beforehand and go
along with the tasks, and frequent trigrams never travel. Between the exchanges tables are written, so
a lost executor costs its tasks only. Logarithms are whole millionths, so sums do not depend on their
order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import binary, n_partitions, quoted, replayable, rounds
from .shingling import words

MASK = np.uint64((1 << 48) - 1)
END, BEGIN = MASK, MASK - np.uint64(1)
ENTRIES = 1_500_000  # triples a partition, about
LEAST = 200_000  # and no fewer for the sake of parallelism
HOT = 200_000  # at most so many frequent words, and as many bigrams and trigrams
COMMON = (1 << 16) - 3  # words that travel as ranks
SLICE_BYTES = 4 << 20
UNIT = 1e6
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TRIPLES, PAIRS, PAIR_COUNTS, LAST, COUNTS, SUMS, DOCUMENT = range(7)
_NAMES = ["part", "kind", "base", "n", "packed", "key"]


def _log(n: np.ndarray | float) -> np.ndarray:
    return np.rint(np.log(n) * UNIT).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(29))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of two words, or of a pair's hash and a word."""
    return _mix(v * _M1 + w) ^ (w * _M2)


def word_ids(text: bytes | None) -> np.ndarray:
    """48 bits of each word's XXH64 (A-Z in lower case, words between ASCII white space)."""
    w = words(text or b"")
    ids = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) & MASK
    ids[ids >= BEGIN] -= np.uint64(2)
    return ids


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.view("<u8").ravel()


class Words:
    """Packs columns: words as 16-bit ranks among the common ones, or if they are none of these as the
    6 bytes of their ids; numbers below 256 ** width byte by byte; all compressed."""

    def __init__(self, common: list[int]) -> None:
        """common: ids from the most frequent on, at most COMMON."""
        ids = np.array([*common[:COMMON], int(BEGIN), int(END)], np.uint64)
        order = np.argsort(ids)
        self.ids, self.ranks, self.by_rank = ids[order], (order + 1).astype(np.uint64), np.concatenate([np.zeros(1, np.uint64), ids])

    def rank(self, w: np.ndarray) -> np.ndarray:
        """Ranks from 1, 0 for words that are not common."""
        at = np.minimum(np.searchsorted(self.ids, w), len(self.ids) - 1)
        return np.where(self.ids[at] == w, self.ranks[at], np.uint64(0))

    def pack(self, texts: tuple[np.ndarray, ...], *numbers: tuple[np.ndarray, int], ranks: tuple[np.ndarray, ...] = ()) -> bytes:
        """ranks: those of the texts, if they are known."""
        out = []
        for k, w in enumerate(texts):
            own = ranks[k] if ranks else self.rank(w)
            out += [_planes(own, 2), _planes(w[own == 0], 6)]
        out += [_planes(x, width) for x, width in numbers]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(out))

    def unpack(self, packed: bytes, n: int, texts: int, *widths: int) -> list[np.ndarray]:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        out, at = [], 0
        for _ in range(texts):
            ranks = _unplanes(raw[at:], n, 2)
            at += 2 * n
            rare = ranks == 0
            w, k = self.by_rank[ranks.astype(np.int64)], int(rare.sum())
            w[rare] = _unplanes(raw[at:], k, 6)
            at += 6 * k
            out.append(w)
        for width in widths:
            out.append(_unplanes(raw[at:], n, width))
            at += width * n
        return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """The column's texts in runs of about SLICE_BYTES, with the row each run starts at."""
    texts, start, size = binary(batch.column(column)), 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= SLICE_BYTES or i - start >= 60_000:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _triples(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words before, middle words and words after of all words of the texts (BEGIN and END at the ends
    of a text), their documents, and all documents' lengths."""
    ids = [word_ids(t) for t in texts]
    sizes = np.array([len(x) for x in ids], np.int64)
    v = np.concatenate([np.zeros(0, np.uint64), *ids])
    u, w = np.concatenate([v[:1], v[:-1]]), np.concatenate([v[1:], v[:1]])
    last = np.cumsum(sizes)[sizes > 0] - 1
    w[last] = END
    u[last - sizes[sizes > 0] + 1] = BEGIN
    return u, v, w, np.repeat(np.arange(len(texts)), sizes), sizes


class _Known:
    """A sorted table of keys and their logarithms of counts."""

    def __init__(self, rows: list[tuple[int, int]]) -> None:
        keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], _log(np.maximum(1, np.array([r[1] for r in rows], np.float64)[order]))

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are known, and the logarithm for each (0 for others)."""
        if not len(self.keys):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        known = self.keys[at] == x
        return known, np.where(known, self.logs[at], 0)


def _times(x: np.ndarray) -> np.ndarray:
    """Of each entry how often it occurs."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(x)])
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _hashes(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (u, v), (v, w) and (u, v, w)."""
    uv = _pair(u, v)
    return uv, _pair(v, w), _pair(uv, w)


def _counted(docs: DataFrame, order: int) -> DataFrame:
    """(kind, id, n): kind 1 all words and their counts, kinds 2 and 3 bigrams and trigrams that are
    frequent in some slice, with the counts of those slices. Each task sums its own slices first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, found in enumerate(held, 1):
                if found:
                    ids, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
                    found.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.view(np.int64)), pa.array(n)], ["kind", "id", "n"])

        for batch in batches:
            for _, texts in _slices(batch, 0):
                u, v, w, *_ = _triples(texts)
                ids, n = np.unique(v, return_counts=True)
                held[0].append((ids, n))
                least = max(16, len(v) // 4000)
                known = _Known(list(zip(ids[n >= least].view(np.int64).tolist(), n[n >= least].tolist())))
                inside = known.look(v)[0] & known.look(w)[0]  # only frequent words make frequent bigrams
                u, v, w = u[inside], v[inside], w[inside]
                _, vw, uvw = _hashes(u, v, w)
                for kind, x in ((1, vw), (2, uvw[known.look(u)[0]]))[: order - 1]:
                    x, n2 = np.unique(x, return_counts=True)
                    held[kind].append((x[n2 >= least], n2[n2 >= least]))
                waiting += len(ids)
                if waiting > 1_500_000:
                    yield from out()
                    waiting = 0
        yield from out()

    return docs.mapInArrow(run, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n"))


def _exact(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """How often each of these bigrams (2) and trigrams (3) (sorted hashes) occurs."""
    if not any(map(len, wanted.values())):
        return {k: [] for k in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(x), np.int64) for k, x in wanted.items()}
        for batch in batches:
            for _, texts in _slices(batch, 0):
                u, v, w, *_ = _triples(texts)
                _, vw, uvw = _hashes(u, v, w)
                inside = w != END
                for k, x in ((2, vw[inside]), (3, uvw[inside & (u != BEGIN)])):
                    if k in wanted and len(wanted[k]):
                        at = np.minimum(np.searchsorted(wanted[k], x), len(wanted[k]) - 1)
                        total[k] += np.bincount(at[wanted[k][at] == x], minlength=len(wanted[k]))
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(wanted[k].view(np.int64)), pa.array(n)], ["kind", "id", "n"])

    found: dict[int, list[tuple[int, int]]] = {k: [] for k in wanted}
    for r in docs.mapInArrow(run, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect():
        found[r["kind"]].append((r["id"], r["n"]))
    return found


def score(docs: DataFrame, order: int = 3, min_count: int = 2, alpha: float = 0.4, key: str = "doc_id", text: str = "text", entries: int = ENTRIES) -> DataFrame:
    """key, n_tokens, log_score (natural logarithms summed over the words) and perplexity of each row, by
    n-grams of up to `order` words (2 or 3).

    Counts are of all rows, repeated ones included. A null or empty text has no words: log_score 0,
    perplexity null. Very long texts are read whole. Null and repeated keys are rows like any other; no
    rows give no rows; other columns are not read. Documents that come out of an exchange are written
    first, as rows are numbered by their place.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    docs = replayable(docs.select(quoted(key).alias("key"), quoted(text).alias("text")), "texts")
    spark, kind = docs.sparkSession, dict(docs.dtypes)["key"]
    key_type = docs.select("key").limit(0).toArrow().schema.field(0).type
    table = written(_counted(docs.select("text"), order), "words")
    total = table.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    # as many partitions as their size asks for, or the cluster has, if that leaves them worth a task
    parts = max(1, -(-total // entries), min(n_partitions(spark), total // LEAST))
    often = max(min_count, total // (16 * parts))
    top = lambda k, least, most: [tuple(r) for r in table.where((F.col("kind") == k) & (F.col("n") >= least)).orderBy(F.desc("n"), "id").limit(most).select("id", "n").collect()]
    coded = Words([i for i, _ in top(1, 2, COMMON)])
    one = _Known(top(1, often, HOT))
    exact = _exact(docs.select("text"), {k: np.sort(np.array([i for i, _ in top(k, often, HOT)], np.int64).view(np.uint64)) for k in range(2, order + 1)})
    two, three = (_Known([(i, n) for i, n in exact.get(k, []) if n >= often]) for k in (2, 3))
    all_log, backoff = int(_log(float(max(1, total)))), int(_log(alpha))
    schema = f"part long, kind int, base long, n int, packed binary, key {kind}"

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), key_type]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _NAMES)

    def dealt(hashes: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(partition, places) of entries dealt by their hashes, in each partition in order of words."""
        part = (_mix(hashes) % np.uint64(parts)).astype(np.int64)
        order_ = np.argsort(part.view(np.uint64) << np.uint64(48) | by) if parts < 1 << 16 else np.lexsort((by, part))
        cuts = np.flatnonzero(np.diff(part[order_])) + 1
        for piece in np.split(order_, cuts) if len(order_) else []:
            yield int(part[piece[0]]), piece

    def sums(ids: np.ndarray, value: np.ndarray, where: np.ndarray | None = None) -> Iterator[tuple]:
        """Sums of value by document, a block for each input partition of the documents. ids are those of
        the values or, if where is given, of the places that it holds."""
        if where is None:
            ids, where = np.unique(ids, return_inverse=True)
        if not len(where):
            return
        some = np.flatnonzero(np.bincount(where, minlength=len(ids)))
        some = some[np.argsort(ids[some])]
        docs_, value = ids[some], np.bincount(where, value, len(ids)).astype(np.int64)[some]
        ranges = (docs_ >> np.uint64(32)).astype(np.int64)
        for piece in np.split(np.arange(len(docs_)), np.flatnonzero(np.diff(ranges)) + 1):
            r = int(ranges[piece[0]])
            yield (parts + r, SUMS, r, len(piece), coded.pack((), (docs_[piece] & np.uint64(0xFFFFFFFF), 4), ((-value[piece]).view(np.uint64), 8)), None)

    def last_words(w: np.ndarray, ids: np.ndarray, alphas: np.ndarray) -> Iterator[tuple]:
        """Entries that score by their last word, none of them frequent: in exchange 3."""
        for p, x in dealt(w, w):
            yield (p, LAST, 0, len(x), coded.pack((w[x],), (ids[x], 8), (alphas[x].astype(np.uint64), 1)), None)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, some in _slices(batch, 1):
                u, v, w, doc, sizes = _triples(some)
                base = (here << 32) + row + start
                out = [(parts + here, DOCUMENT, base + i, int(n), b"", keys[start + i]) for i, n in enumerate(sizes)]
                own = np.uint64(base) + np.arange(len(some), dtype=np.uint64)
                value = np.zeros(len(v), np.int64)
                (hot_v, log_v), first = one.look(v), u == BEGIN
                value[first & hot_v] += log_v[first & hot_v] - all_log
                done = first & hot_v
                first &= ~hot_v
                out += last_words(v[first], own[doc[first]], np.zeros(first.sum(), np.int64))
                rank_v = coded.rank(v)
                begins, ends = coded.rank(np.array([BEGIN, END], np.uint64))
                rank_u, rank_w = np.where(u == BEGIN, begins, np.roll(rank_v, 1)), np.where(w == END, ends, np.roll(rank_v, -1))
                if order == 2:
                    u, rank_u = np.full(len(v), BEGIN), np.full(len(v), begins)
                uv, vw, uvw = _hashes(u, v, w)
                (hot_uv, log_uv), (hot_vw, log_vw), (hot_uvw, log_uvw) = two.look(uv), two.look(vw), three.look(uvw)
                hot_uv &= hot_v & (u != BEGIN)
                hot_vw &= hot_v & (w != END)
                hot_uvw &= hot_uv & hot_vw
                whole = hot_vw & (u == BEGIN)  # bigrams that start a text
                value[hot_uvw] += log_uvw[hot_uvw] - log_uv[hot_uvw]
                value[whole] += log_vw[whole] - log_v[whole]
                done |= hot_uvw | whole
                out += sums(own, value[done], doc[done])
                ship = ~hot_uvw & ~whole & ~(hot_v & (w == END) & (hot_uv | (u == BEGIN)))
                by = np.where(hot_v, np.where(hot_uv, uvw, np.where(u == BEGIN, vw, uv)), v)[ship]
                u, v, w, doc, rank_u, rank_v, rank_w = (x[ship] for x in (u, v, w, doc, rank_u, rank_v, rank_w))
                for p, x in dealt(by, v):
                    out.append((p, TRIPLES, base, len(x), coded.pack((v[x], w[x], u[x]), (doc[x].astype(np.uint64), 2), ranks=(rank_v[x], rank_w[x], rank_u[x])), None))
                yield rows(out)
            row += batch.num_rows

    def of(held: list[pa.RecordBatch], kind_: int) -> Iterator[tuple]:
        for batch in held:
            for k, base, n, packed in zip(*[batch.column(c).to_pylist() for c in ("kind", "base", "n", "packed")]):
                if k == kind_:
                    yield base, n, packed

    def joined(parts_: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, np.uint64), *[x[i] for x in parts_]]) for i in range(n)]

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in rounds(batches, "part"):
            if part >= parts:
                for batch in held:
                    yield batch.select(_NAMES)
                continue
            for batch in held:  # words that start a text
                yield batch.filter(pa.array([k == LAST for k in batch.column("kind").to_pylist()], pa.bool_())).select(_NAMES)
            blocks = [(base, coded.unpack(packed, n, 3, 2)) for base, n, packed in of(held, TRIPLES)]
            # the documents of all blocks side by side, and each triple's place among them
            most = [int(x[3].max()) + 1 for _, x in blocks]
            first = np.cumsum([0, *most])
            ids = np.concatenate([np.zeros(0, np.uint64), *[np.uint64(base) + np.arange(m, dtype=np.uint64) for (base, _), m in zip(blocks, most)]])
            where = np.concatenate([np.zeros(0, np.int64), *[at + x[3].view(np.int64) for at, (_, x) in zip(first, blocks)]])
            v, w, u = joined([x for _, x in blocks], 3)
            del blocks, held
            if len(ids) > 4 * len(where):  # few triples of each of very many documents
                used, where = np.unique(where, return_inverse=True)
                ids = ids[used]
            uv, vw, uvw = _hashes(u, v, w)
            (hot_v, log_v), (hot_uv, log_uv), (hot_vw, log_vw) = one.look(v), two.look(uv), two.look(vw)
            n_uvw = _times(uvw)
            found = (n_uvw >= min_count) & (u != BEGIN) & (w != END)
            log_uv = np.where(hot_uv & hot_v, log_uv, _log(_times(uv)))
            value = np.zeros(len(v), np.int64)
            value[found] = _log(n_uvw[found]) - log_uv[found]
            out = []
            # what bigrams of frequent middle words count, found or not
            own = hot_v & ~hot_vw & (w != END)
            x, first, n = np.unique(vw[own], return_index=True, return_counts=True)
            vo, wo = v[own][first], w[own][first]
            for p, at in dealt(x, vo):
                out.append((p, PAIR_COUNTS, 0, len(at), coded.pack((vo[at], wo[at]), (n[at].astype(np.uint64), 5)), None))
            n_vw, n_v = _times(vw), _times(v)
            alphas = (u != BEGIN).astype(np.int64)
            rest = ~found & (w != END)
            later = rest & own
            vl, wl, idl, al = v[later], w[later], ids[where[later]], alphas[later].astype(np.uint64)
            for p, at in dealt(vw[later], vl):
                out.append((p, PAIRS, 0, len(at), coded.pack((vl[at], wl[at]), (idl[at], 8), (al[at], 1)), None))
            rest &= ~later
            here = rest & (hot_vw & hot_v | ~hot_v & (n_vw >= min_count))
            log_v = np.where(hot_v, log_v, _log(n_v))
            log_vw = np.where(hot_vw & hot_v, log_vw, _log(n_vw))
            value[here] = alphas[here] * backoff + log_vw[here] - log_v[here]
            rest &= ~here
            hot_w, log_w = one.look(w)
            hot_w &= rest
            value[hot_w] = (alphas[hot_w] + 1) * backoff + log_w[hot_w] - all_log
            done = found | here | hot_w
            out += sums(ids, value[done], where[done])
            rest &= ~hot_w
            out += last_words(w[rest], ids[where[rest]], alphas[rest] + 1)
            yield rows(out)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "part"):
            v, w, n = joined([coded.unpack(packed, n, 2, 5) for _, n, packed in of(held, PAIR_COUNTS)], 3)
            known, where = np.unique(_pair(v, w), return_inverse=True)
            count = np.bincount(where, n.astype(np.float64), len(known)).astype(np.int64)
            v, w, ids, alphas = joined([coded.unpack(packed, n, 2, 8, 1) for _, n, packed in of(held, PAIRS)], 4)
            n_vw = count[np.searchsorted(known, _pair(v, w))] if len(v) else np.zeros(0, np.int64)
            alphas = alphas.astype(np.int64)
            found = n_vw >= min_count
            hot_w, log_w = one.look(w)
            value = np.where(found, alphas * backoff + _log(np.maximum(1, n_vw)) - one.look(v)[1], (alphas + 1) * backoff + log_w - all_log)
            done = found | hot_w
            out = list(sums(ids[done], value[done]))
            out += last_words(w[~done], ids[~done], alphas[~done] + 1)
            yield rows(out)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            cold = ~one.look(w)[0]
            w, n = w[cold], n[cold]
            yield rows([(p, COUNTS, 0, len(x), coded.pack((w[x],), (n[x].view(np.uint64), 6)), None) for p, x in dealt(w, w)])

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "part"):
            w, n = joined([coded.unpack(packed, n, 1, 6) for _, n, packed in of(held, COUNTS)], 2)
            order_ = np.argsort(w)
            w, logs = w[order_], _log(n[order_].astype(np.float64))
            blocks: list[list[np.ndarray]] = []
            size = 0
            for _, n, packed in itertools.chain(of(held, LAST), [(0, 0, None)]):
                if packed is None or size > 2 * entries:  # the partition, or a part of it, at once
                    x, ids, alphas = joined(blocks, 3)
                    yield rows(list(sums(ids, alphas.astype(np.int64) * backoff + logs[np.searchsorted(w, x)] - all_log)) if len(x) else [])
                    blocks, size = [], 0
                if packed is not None:
                    blocks.append(coded.unpack(packed, n, 1, 8, 1))
                    size += n

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in rounds(batches, "part"):
            ids, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, n, packed in of(held, SUMS):
                low, value = coded.unpack(packed, n, 0, 4, 8)
                ids.append(low)
                values.append(-value.view(np.int64))
            ids, where = np.unique(np.concatenate(ids), return_inverse=True)
            value = np.bincount(where, np.concatenate(values), len(ids))
            for batch in held:
                batch = batch.filter(pa.array([k == DOCUMENT for k in batch.column("kind").to_pylist()], pa.bool_()))
                low = batch.column("base").to_numpy().astype(np.uint64) & np.uint64(0xFFFFFFFF)
                at = np.minimum(np.searchsorted(ids, low), max(0, len(ids) - 1))
                log = np.where(ids[at] == low, value[at], 0) / UNIT if len(ids) else np.zeros(len(low))
                n = batch.column("n").to_numpy()
                perplexity = np.exp(np.minimum(700, -log / np.maximum(1, n)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n.astype(np.int64)), pa.array(log), pa.array(perplexity, mask=n == 0)], [key, "n_tokens", "log_score", "perplexity"])

    def by_part(df: DataFrame, n: int = parts) -> DataFrame:
        """Each partition number's rows in a task of their own; numbers from n on share the tasks."""
        return df.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part")

    level1 = written(by_part(docs.mapInArrow(explode, schema)).mapInArrow(trigrams, schema), "trigrams")
    level2 = written(by_part(level1.where(f"kind in ({PAIRS}, {PAIR_COUNTS})")).mapInArrow(bigrams, schema), "bigrams")
    rare = table.where("kind = 1").select("id", "n").mapInArrow(tables, schema)
    waiting = level1.unionByName(level2).where(f"kind = {LAST}").unionByName(rare)
    level3 = by_part(waiting).mapInArrow(unigrams, schema)
    ends = level1.where(f"kind in ({SUMS}, {DOCUMENT})").unionByName(level2.where(f"kind = {SUMS}")).unionByName(level3)
    ranges = (level1.where(f"kind = {DOCUMENT}").agg(F.max("part")).first()[0] or parts) - parts + 1
    done = by_part(ends.withColumn("part", F.col("part") - parts), ranges).mapInArrow(totals, f"`{key}` {kind}, n_tokens long, log_score double, perplexity double")
    return done
