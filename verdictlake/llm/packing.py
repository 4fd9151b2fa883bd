"""Packing documents into token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document's ids go, as
one piece, to the open window that they fill best; where none has room and no
more may be opened, the piece is cut so that the fullest window becomes full
and is emitted.  The windows that stay open are merged across partitions, many
into one, round by round; the last few ids are cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common, textvec

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A row is a piece of an emitted sequence, or an open window with its pieces.
ROW = PIECE + ", open array<struct<doc_id:long,start:long,ids:binary,doc_tokens:long>>"
_OPEN = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]))
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """Online packing of one partition; emitted sequences gather in rows."""

    capacity: int
    most_open: int
    first_id: int
    fills: list[int] = field(default_factory=list)
    windows: list[list[Piece]] = field(default_factory=list)
    rows: list[list] = field(default_factory=lambda: [[] for _ in _NAMES])
    emitted: int = 0

    def emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            crc = zlib.crc32(p.ids.astype("<u4").tobytes())
            for column, value in zip(self.rows, (p.doc_id, p.start, len(p.ids), crc, p.doc_tokens, self.first_id + self.emitted, offset)):
                column.append(value)
            offset += len(p.ids)
        self.emitted += 1

    def place(self, pieces: list[Piece]) -> None:
        """Put pieces that shall stay together into one window, if they can."""
        size = sum(len(p.ids) for p in pieces)
        while size >= self.capacity:
            head, pieces = split(pieces, self.capacity)
            self.emit(head)
            size -= self.capacity
        while size:
            best, room = -1, self.capacity + 1
            fullest, fill = -1, -1
            for k, f in enumerate(self.fills):
                left = self.capacity - f
                if size <= left < room:
                    best, room = k, left
                if f > fill:
                    fullest, fill = k, f
            if best >= 0:
                self.windows[best] += pieces
                self.fills[best] += size
                if self.fills[best] == self.capacity:
                    self.close(best)
                return
            if len(self.fills) < self.most_open:
                self.windows.append(list(pieces))
                self.fills.append(size)
                return
            head, pieces = split(pieces, self.capacity - fill)
            self.windows[fullest] += head
            size -= self.capacity - fill
            self.close(fullest)

    def close(self, k: int) -> None:
        self.emit(self.windows.pop(k))
        self.fills.pop(k)

    def flush_tail(self) -> None:
        """Emit what is open, fullest first, cut to full sequences and then to
        powers of two."""
        order = sorted(range(len(self.fills)), key=lambda k: (-self.fills[k], k))
        rest = [p for k in order for p in self.windows[k]]
        size, self.windows, self.fills = sum(self.fills), [], []
        while size:
            n = self.capacity if size >= self.capacity else 1 << (size.bit_length() - 1)
            head, rest = split(rest, n)
            self.emit(head)
            size -= n

    def take(self, leftovers: bool = False) -> pa.RecordBatch:
        """The rows so far, and the open windows where asked."""
        n = len(self.rows[0])
        opened = [[{"doc_id": p.doc_id, "start": p.start, "ids": p.ids.tobytes(), "doc_tokens": p.doc_tokens} for p in w] for w in self.windows] if leftovers else []
        columns = [pa.array(c + [None] * len(opened), pa.int64()) for c in self.rows]
        columns.append(pa.array([None] * n + opened, _OPEN))
        self.rows = [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "open"])


def split(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n ids of pieces, and the rest."""
    head, rest, held = [], [], 0
    for p in pieces:
        size = len(p.ids)
        if held + size <= n:
            head.append(p)
        elif held >= n:
            rest.append(p)
        else:
            a, b = p.cut(n - held)
            head.append(a)
            rest.append(b)
        held += size
    return head, rest


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048, open_windows: int = 32, fan_in: int = 64) -> DataFrame:
    """Pack all documents (doc_id, text); one row per piece.

    A null or empty text is the end id alone; texts of any length are packed
    whole.  Rows that repeat, also with the
    same doc_id, are packed each.  An empty table gives no rows.  Other
    columns are ignored.  Every id lies in exactly one piece; sequences hold
    capacity ids but for the last few, which hold a power of two.  The ids
    must fit in 16 bits.  Rounds of merging hold at most fan_in * open_windows
    windows in a task, whatever the size of the table.
    """
    path = common.vocabulary("word_bpe_49k.json", vocabulary)

    def first_round(batches) -> Iterator[pa.RecordBatch]:
        coder = common.coder(path, keep_space=False)
        packer = Packer(capacity, open_windows, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u2")
        for batch in batches:
            for at, until in textvec.cut(batch.column(1), 1 << 22):
                for doc_id, got in zip(batch.column(0)[at:until].to_pylist(), coder.encode(batch.column(1).slice(at, until - at))):
                    ids = np.concatenate([got, end])
                    packer.place([Piece(doc_id, 0, ids, len(ids))])
                yield packer.take()
        yield packer.take(leftovers=True)

    def merge_round(batches, number: int, last: bool) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, open_windows, (number << 56) | (TaskContext.get().partitionId() << 32))
        for batch in batches:
            for window in batch.column(0).to_pylist():
                packer.place([Piece(p["doc_id"], p["start"], np.frombuffer(p["ids"], dtype="<u2"), p["doc_tokens"]) for p in window])
            yield packer.take()
        if last:
            packer.flush_tail()
        yield packer.take(leftovers=not last)

    source = docs.select("doc_id", common.text_bytes().alias("text"))
    done = common.materialize(common.mapped(source, first_round, ROW, rows_per_batch=4096), "packed", texts=True)
    parts, number, tasks = [done], 1, max(1, source.rdd.getNumPartitions())
    while True:
        left = parts[-1].where(F.col("open").isNotNull()).select("open")
        tasks = -(-tasks // fan_in)
        last = tasks == 1
        run = lambda batches, number=number, last=last: merge_round(batches, number, last)
        parts.append(common.materialize(left.coalesce(tasks).mapInArrow(run, ROW), "packed", texts=True))
        if last:
            break
        number += 1
    out = None
    for part in parts:
        rows = part.where(F.col("open").isNull()).select(*_NAMES)
        out = rows if out is None else out.union(rows)
    return out
