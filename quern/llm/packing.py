"""Harmonic packing of documents into sequences of a fixed capacity.

A document is cut into pieces whose lengths are unit fractions of the capacity C: whole sequences first, then the largest
C/k that fits what is left, until a short tail remains. A piece longer than C/(k+1) and no longer than C/k is of class k,
and a bin of class k holds exactly k pieces, whatever their order. So bins fill up one after another with no look at other
bins, and each task fills its own: nothing is shuffled and no task waits for another. At its end a task has at most one
unfinished bin of each class; their pieces are laid end to end and cut anew at C, and the last remainder is cut into
powers of two, which need no padding.

Null texts count as empty and give one piece, the end id. Texts longer than C take several sequences. Repeated rows are
packed each on their own. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text, slices, tidy
from .tokens import END_ID, WordEncoder, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"


def cut_lengths(n: int, capacity: int, shortest: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then unit fractions of the capacity, then a tail of at most shortest."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        piece = capacity // -(-capacity // rest)  # the largest C/k not above rest
        piece = rest if rest <= shortest else piece
        pieces.append(piece)
        rest -= piece
    return pieces


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Bins:
    """The bins of one task. Sequence ids are unique as each task has its own range."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next_id = capacity, task << 32
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple], kind: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, kind))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        kind = self.capacity // len(ids)
        if kind == 1:
            self.close([(doc, start, ids, total)], 1)
            return
        held = self.open.setdefault(kind, [])
        held.append((doc, start, ids.copy(), total))
        if len(held) == kind:
            self.close(self.open.pop(kind), kind)

    def finish(self) -> None:
        """Unfinished bins: end to end, cut at the capacity, the last remainder in powers of two."""
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        n = sum(len(p[2]) for p in left)
        k = at = 0
        for size in [self.capacity] * (n // self.capacity) + powers(n % self.capacity):
            pieces = []
            while size:
                doc, start, ids, total = left[k]
                take = min(size, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take], total))
                size, at = size - take, at + take
                if at == len(ids):
                    k, at = k + 1, 0
            self.close(pieces, 0)


def pack_documents(docs: DataFrame, capacity: int = 2048, shortest: int = 64, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: its document, its place there, its sequence and its place there.

    Each document's ids end with END_ID. bin_class is k for a piece of a bin of class k, 0 where bins were recut.
    """
    path = vocabulary or vocabulary_path()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.int32()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, encoder = Bins(TaskContext.get().partitionId(), capacity), WordEncoder(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, bounds = encoder.encode(part.column("text"))
                for doc, first, last in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[first:last], np.uint32(END_ID))
                    start = 0
                    for n in cut_lengths(len(own), capacity, shortest):
                        bins.add(doc, start, own[start : start + n], len(own))
                        start += n
                yield out(bins.rows)
                bins.rows = []
        bins.finish()
        yield out(bins.rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(pack), SCHEMA)
