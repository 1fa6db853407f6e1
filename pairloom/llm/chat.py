"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose turn-aligned spans. Each window holds the conversation's
system turn, then limited history (the last turns of the window before), then new turns. Repeated
turns are outside the loss mask, so every assistant text is a target exactly once.

The template of one turn is '<turn ROLE>\\nTEXT\\n</turn>\\n'. Inside ROLE and TEXT a backslash, '<'
and '>' get a backslash before them, so no text can look like a mark, and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions
from .packing import tokenizer

CLOSE = "\n</turn>\n"
WINDOWS = [("window", "int", pa.int32()), ("text", "string", pa.string()), ("n_tokens", "long", pa.int64()), ("n_repeated", "int", pa.int32()), ("loss_start", "array<int>", pa.list_(pa.int32())), ("loss_end", "array<int>", pa.list_(pa.int32()))]
DIGESTS = [("n_turns", "long", pa.int64()), ("turns_sha256", "string", pa.string()), ("loss_chars", "long", pa.int64()), ("loss_sha256", "string", pa.string()), ("formatted_chars", "long", pa.int64()), ("n_windows", "long", pa.int64())]
_SPECIAL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
_MARK_TOKENS = 4
_BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns = []
    for block in window.split(CLOSE)[:-1]:
        head = _HEAD.match(block)
        turns.append((unescape(head[1]), unescape(block[head.end() :])))
    return turns


class _Conversation:
    """Windows of one conversation, whose turns come one by one; holds one window's turns."""

    def __init__(self, conv_id: object, budget: int, history: int, targets: tuple[str, ...]) -> None:
        self.conv_id, self.budget, self.history, self.targets = conv_id, budget, history, targets
        self.system: tuple | None = None
        self.kept: list[tuple] = []  # repeated turns of the open window
        self.open: list[tuple] = []  # its new turns: (role, text, prefix sum up to here, tokens)
        self.total, self.base, self.window, self.first = 0, 0, 0, True

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        room = self.budget - (self.system[3] if self.system else 0)
        held = sum(t[3] for t in self.kept)
        if self.open and self.total + tokens - self.base + held > room:
            yield self.flush()
            held = sum(t[3] for t in self.kept)
            while self.kept and held + tokens > room:
                held -= self.kept.pop(0)[3]
        if self.first and role == "system":
            self.system = (role, text, 0, tokens)
        else:
            self.total += tokens
            self.open.append((role, text, self.total, tokens))
        self.first = False

    def flush(self) -> tuple:
        """Close the open window and choose the next one's history, by prefix sums."""
        system = [self.system] if self.system else []
        repeated = (system if self.window else []) + self.kept
        new = ([] if self.window else system) + self.open
        parts, at, starts, ends = [], 0, [], []
        for k, (role, text, _, _) in enumerate([*repeated, *new]):
            head, body = f"<turn {escape(role)}>\n", escape(text)
            if k >= len(repeated) and role in self.targets:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        out = (self.conv_id, self.window, "".join(parts), sum(t[3] for t in [*repeated, *new]), len(repeated), starts, ends)
        self.window += 1
        self.base = self.total
        self.kept = [t for t in self.open if self.total - t[2] + t[3] <= self.history]
        self.open = []
        return out


def _schema(key: str, columns: list[tuple]) -> str:
    return ", ".join([f"conv_id {key}", *[f"{name} {kind}" for name, kind, _ in columns]])


def _batch(rows: list[tuple], key: pa.DataType, columns: list[tuple]) -> pa.RecordBatch:
    """Rows with their conv_id first. Values never pass through floats, so ids come out as they came in."""
    values = list(zip(*rows)) if rows else [()] * (1 + len(columns))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [key, *[c[2] for c in columns]])], ["conv_id", *[c[0] for c in columns]])


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return df.select(column).limit(0).toArrow().schema.field(0).type


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows without it, one by one) of batches whose rows are sorted by conv_id."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for conv, run in itertools.groupby(rows, operator.itemgetter(0)):
        yield conv, (row[1:] for row in run)


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation in one partition, in order."""
    return rows.repartition(n_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def _counted(rows: DataFrame, path: str | None) -> DataFrame:
    """rows (conv_id, turn, role, text) with tokens: what each text and the marks around it take."""
    if path is None:
        words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x00-\x20]+", " ")), " "))
        return rows.withColumn("tokens", words + _MARK_TOKENS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(path).ids
        for batch in batches:
            n = [len(ids(text)) // 4 + _MARK_TOKENS for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], [*batch.schema.names, "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", tokens int")


def format_chat(turns: DataFrame, budget: int = 1024, history: int = 192, targets: tuple[str, ...] = ("assistant",), tokenizer_path: str | None = None) -> DataFrame:
    """Windows of the conversations in turns(conv_id, turn, role, text): conv_id, window, text,
    n_tokens, n_repeated (turns at its start that an earlier window had), loss_start and loss_end
    (code points of the masked-in, still escaped texts).

    A window holds at most `budget` tokens (ids of the tokenizer file, or without one runs of characters
    that are not white space; plus four a turn) unless a single turn is longer: that turn is not cut and
    gets a window without history. At most `history` tokens are repeated. A null text or role is empty; a
    null conv_id is a conversation of its own; a null turn comes first; rows with equal turn are ordered
    by role, then text, and all kept. No rows give no windows; other columns are not read. A
    conversation's rows meet in one sorted stream, of which one window is held at a time, so a huge
    conversation needs no more memory than a small one.
    """
    key, kind = dict(turns.dtypes)["conv_id"], _arrow_type(turns, "conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _together(_counted(rows, tokenizer_path), "turn", "role", "text").select("conv_id", "role", "text", "tokens")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        for conv, turns in _runs(batches):
            now = _Conversation(conv, budget, history, targets)
            for turn in turns:
                for window in now.add(*turn):
                    out.append(window)
                    chars += len(window[2])
                if chars >= _BATCH_CHARS:
                    yield _batch(out, kind, WINDOWS)
                    out, chars = [], 0
            out.append(now.flush())
            chars += len(out[-1][2])
        yield _batch(out, kind, WINDOWS)

    return rows.mapInArrow(windows, _schema(key, WINDOWS))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations, read from their windows alone: conv_id, n_turns, turns_sha256 (role,
    newline, text, newline a turn, repeated turns once), loss_chars and loss_sha256 (unescaped texts
    under the loss mask), formatted_chars and n_windows.

    Takes what format_chat returns, stored or not and in any order: the windows of a conversation meet
    by its id and are read by their number. A null conv_id is a conversation of its own; empty texts
    count as turns; no rows give no rows; other columns are not read. A digest is one stream by nature,
    so a conversation is read by one task, a window at a time."""
    key, kind = dict(windows.dtypes)["conv_id"], _arrow_type(windows, "conv_id")
    rows = _together(windows.select("conv_id", "window", "text", "n_repeated", "loss_start", "loss_end"), "window")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, held in _runs(batches):
            n, chars, formatted, count, turns, loss = 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, text, repeated, starts, ends in held:
                for role, said in parse(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    target = unescape(text[a:b])
                    chars += len(target)
                    loss.update(target.encode())
                formatted += len(text)
                count += 1
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count))
            if len(out) >= 1024:
                yield _batch(out, kind, DIGESTS)
                out = []
        yield _batch(out, kind, DIGESTS)

    return rows.mapInArrow(digests, _schema(key, DIGESTS))
