"""Best-fit packing with certified bounds.

Texts become token ids and pieces of at most `capacity` ids. Pieces are dealt to partitions, each is
packed by best-fit decreasing, and dual-feasible functions give a lower bound that certifies its bin
count. Partitions with a gap pass their loosest bins on, certified ones their single loosest bin;
what is passed on meets in eight times fewer partitions and is packed again, until one is left.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import rounds

FAN_IN = 8
PIECES_A_PARTITION = 100_000
CACHED_WORDS = 800_000

# What the quick way below stands for: a tokenizer file that says anything else is used as it is.
_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
# Characters for which the plain pattern below finds the same words as the tokenizer's own pattern.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-ɏ]")
_WORDS = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


class WordTokenizer:
    """Ids of texts by a tokenizer file whose words are independent of each other (lower case, split
    at white space): each word is encoded once and remembered. Texts with other characters or with
    special tokens go through the tokenizer as a whole; the ids are the same either way. A file whose
    normalizer or pre-tokenizer is another (see _PLAIN) is always used as a whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.plain = all(said.get(k) == v for k, v in _PLAIN.items()) and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain &= all("<|" in t for t in self.special)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = _Known(self.word)
        self.visible = _visible_bytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.plain or "<|" in text and any(s in text for s in self.special):
            return self.whole(text)
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        if _OTHER.search(low):
            return self.whole(text)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _WORDS.findall(low)))


def _visible_bytes() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 ones stand for
    themselves, the others for 256 onwards in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


class _Known(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.encode(word)
        return found


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of each document's pieces.

    A document is its text's ids, then end_id; a null text is empty and gives the single end id. Only
    documents of more than `capacity` ids are cut. Rows are treated one by one, so repeated rows give
    repeated pieces; other columns are not read."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path).ids
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(body or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and the bins' free room. Open bins are kept by
    room, with the rooms that occur as bits of one number, so each item costs the same."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible bounds on the bins that the lengths need: volume,
    the threshold bound (large items alone, medium ones one a bin, their gaps filled by small ones),
    and rounding to k-ths of a bin."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    half = capacity // 2
    count, volume = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(volume[-1]) // capacity)
    eps = np.arange(0, half + 1)
    large = count[-1] - count[capacity - eps]
    medium = count[capacity - eps] - count[half]
    room = medium * capacity - (volume[capacity - eps] - volume[half])
    small = volume[half] - np.where(eps > 0, volume[np.maximum(eps - 1, 0)], 0)
    best = max(best, int((large + medium + np.maximum(0, -(-(small - room) // capacity))).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        # k times the function: items of an exact multiple of 1/(k+1) keep their size
        exact = scaled % capacity == 0
        value = np.where(exact, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", a_partition: int = PIECES_A_PARTITION) -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of at most `capacity` as the rounds find,
    gapless from offset 0.

    Lengths must be 1 to capacity. Rows are dealt by position in a written table, so no key, copies or
    nulls make a partition large; a partition never holds more than about twice `a_partition` rows. No
    rows give no rows. Columns may have any names but sequence_id, offset and those with '__'.
    """
    left = written(pieces, "pieces")
    columns = left.columns
    n = left.count()
    parts = max(1, -(-n // a_partition))
    out_schema = ", ".join(f"`{c}` {t}" for c, t in left.dtypes) + ", sequence_id long, offset long, __part long, __closed boolean"
    done, step = [], 0
    left = left.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    while True:
        last = parts == 1
        packed = left.repartition(parts, "__part").sortWithinPartitions("__part").mapInArrow(_packer(columns, length, capacity, step, last), out_schema)
        if last:
            done.append(packed.drop("__part", "__closed"))
            break
        packed = written(packed, f"packed{step}")
        done.append(packed.where("__closed").drop("__part", "__closed"))
        step += 1
        parts = -(-parts // FAN_IN)
        left = packed.where("not __closed").select(*columns, F.pmod(F.col("__part"), F.lit(parts)).alias("__part"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _packer(columns: list[str], length: str, capacity: int, step: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in rounds(batches, "__part"):
            whole = pa.Table.from_batches(held).combine_chunks()
            lengths = whole.column(length).to_numpy().astype(np.int64)
            bins, offsets, free = best_fit(lengths, capacity)
            gap = len(free) - lower_bound(lengths, capacity)
            passed = np.zeros(len(free), bool)
            if not last:
                most = max(1, len(free) // FAN_IN) if gap else 1
                loosest = np.argsort(-free, kind="stable")[:most]
                passed[loosest[free[loosest] > 0]] = True
            ids = (step << 56) + (int(part) << 28) + bins
            out = whole.select(columns)
            for name, values in (("sequence_id", ids), ("offset", offsets), ("__part", np.full(len(ids), part, np.int64)), ("__closed", ~passed[bins])):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    return run
