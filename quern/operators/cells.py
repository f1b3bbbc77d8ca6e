"""Close pairs of vectors: rows in order are packed into blocks, and two blocks meet in one cell, as matrix products.

A block is one row of a table, so cells come of a join of that small table with itself on ranges: it reads the blocks again for each
part of the other side instead of shuffling a copy of every vector for every cell. A cell first compares projections. With R of m
orthonormal columns and r what a unit vector's projection lacks of length 1, u.w <= (Ru).(Rw) + r(u) r(w). Nearly all pairs
fall by that bound, which takes a quarter of the work for 256 components; the others are measured in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import arrow_rows, cut

BLOCK = 4096
#: Pairs of a slice of a cell from which a whole product is less work. A tile of bounds stays in a core's cache.
DENSE, SLICE, TILE = 100_000, 512, (256, 2048)


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of rows (scope string, at long, key string, v array<double>, t double, kept boolean) by length of v, scope and at.

    A block has rows of one length, first and last scope and at, least and greatest t, and whether it has rows that are not decided.
    Whole numbers take two bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(batch)]
            ends = [at for a, b in zip(cuts, cuts[1:]) for at in np.linspace(a, b, max(1, -(-(b - a) // block)) + 1).astype(int).tolist()[:-1]] + [len(batch)]
            for a, b in zip(ends, ends[1:]):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                v = part.column("v").flatten().to_numpy(zero_copy_only=False)
                small = v.astype(np.int16) if np.isfinite(v).all() and (np.abs(v) < 32767).all() else v
                v = small if (small == v).all() else v
                held = pa.table({**{c: part.column(c) for c in ("scope", "at", "key", "t", "kept")}, "v": pa.array([r.tobytes() for r in v.reshape(len(part), -1)] if v.size else [b""] * len(part), pa.binary())})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(held.combine_chunks())
                scope, at, t = part.column("scope"), part.column("at"), part.column("t").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{"size": int(sizes[a]), "lo_scope": scope[0].as_py(), "hi_scope": scope[-1].as_py(), "lo_at": at[0].as_py(), "hi_at": at[-1].as_py(), "lo_t": float(t.min()), "hi_t": float(t.max()), "open": part.column("kept").null_count > 0, "whole": v.dtype == np.int16, "held": sink.getvalue().to_pybytes()}], SCHEMA)

    rows = rows.select("scope", "at", "key", "v", "t", "kept", F.size("v").alias("size"))
    most = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(most, -(-rows.count() // block)))
    ordered = rows.repartitionByRange(parts, "size", "scope", "at").sortWithinPartitions("size", "scope", "at")
    return ordered.mapInArrow(run, "size int, lo_scope string, hi_scope string, lo_at long, hi_at long, lo_t double, hi_t double, open boolean, whole boolean, held binary")


SCHEMA = pa.schema([("size", pa.int32()), ("lo_scope", pa.string()), ("hi_scope", pa.string()), ("lo_at", pa.int64()), ("hi_at", pa.int64()), ("lo_t", pa.float64()), ("hi_t", pa.float64()), ("open", pa.bool_()), ("whole", pa.bool_()), ("held", pa.binary())])


@cache
def projection(size: int, m: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, m)))[0]


class Side:
    """The rows of a block with unit vectors and their projections."""

    def __init__(self, held: bytes, size: int, whole: bool, least: float):
        self.rows = pa.ipc.open_stream(held).read_all().combine_chunks()
        self.at, self.t = self.rows["at"].to_numpy(), self.rows["t"].to_numpy()
        self.open = self.rows["kept"].is_null().to_numpy() if len(self.rows) else np.zeros(0, bool)
        flat = b"".join(self.rows["v"].to_pylist())
        self.v = np.frombuffer(flat, np.int16 if whole else np.float64).reshape(len(self.at), size).astype(np.float64)
        self.norm = np.sqrt((self.v * self.v).sum(1))
        unit = np.divide(self.v, self.norm[:, None], out=np.zeros_like(self.v), where=self.norm[:, None] > 0)
        m = max(16, int(np.ceil(3 * (1 - least) * size)))
        if m < size / 2:
            near = unit @ projection(size, m)
            rest = np.where(self.norm > 0, np.sqrt(np.maximum(0.0, 1 - (near * near).sum(1))), 0.0)
            unit = np.concatenate([near, rest[:, None]], 1)
        self.short = unit.astype(np.float32)


def codes(one: pa.ChunkedArray, two: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values are; nulls are equal to none."""
    both = pa.concat_arrays([*one.chunks, *two.chunks]).dictionary_encode().indices
    found = np.where(both.is_null().to_numpy(zero_copy_only=False), -1 - np.arange(len(both)), both.fill_null(0).to_numpy())
    return found[: len(one)], found[len(one) :]


def reaching(one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) in order: rows of one and two whose product is least or more. Tiles are looked through eight pairs at a time, as few reach it."""
    found, (height, width) = [], TILE
    products, able = np.empty(height * width, np.float32), np.zeros(height * width, bool)
    for i in range(0, len(one), height):
        for j in range(0, len(two), width):
            a, b = one[i : i + height], two[j : j + width]
            n = len(a) * len(b)
            tile = products[:n].reshape(len(a), len(b))
            np.matmul(a, b.T, out=tile)
            np.greater_equal(products[:n], np.float32(least), out=able[:n])
            able[n : n + 7] = False  # the last eight
            eight = np.flatnonzero(able[: -(-n // 8) * 8].view(np.uint64))
            if len(eight):
                row, col = np.nonzero(able.reshape(-1, 8)[eight])
                at = eight[row] * 8 + col
                found.append(((at // len(b) + i) * len(two) + at % len(b) + j))
    at = np.sort(np.concatenate([np.empty(0, np.int64), *found]))
    return at // max(1, len(two)), at % max(1, len(two))


def equal_keys(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of equal keys."""
    by = np.argsort(two, kind="stable")
    first, last = (np.searchsorted(two[by], one, side) for side in ("left", "right"))
    size = last - first
    return np.repeat(np.arange(len(one)), size), by[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def united(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of both, each once, in order."""
    at = np.unique(np.concatenate([i * width + j for i, j in (one, two)]))
    return at // max(1, width), at % max(1, width)


def close_pairs(early: Side, late: Side, least: float, ttl: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of rows i of early and open rows j of late: of one scope, i before j, with a cosine of about ``least`` or more, or
    with one key if there is a ttl; then j is less than that after i."""
    scope_e, scope_l = codes(early.rows["scope"], late.rows["scope"])
    key_e, key_l = codes(early.rows["key"], late.rows["key"]) if ttl is not None else (None, None)
    wanted = np.flatnonzero(late.open)
    for at in range(0, len(wanted), SLICE):
        j = wanted[at : at + SLICE]
        b, a = reaching(late.short[j], early.short, least - 1e-4)
        if ttl is not None:
            b, a = united((b, a), equal_keys(key_l[j], key_e), len(early.at))
        if not len(b):
            continue
        b = j[b]
        fits = (scope_e[a] == scope_l[b]) & (early.at[a] < late.at[b])
        if ttl is not None:
            fits &= late.t[b] - early.t[a] < ttl
        a, b = a[fits], b[fits]
        if len(a) > DENSE:
            dot = (late.v[j] @ early.v.T)[np.searchsorted(j, b), a]
        else:
            dot = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", early.v[a[s : s + 8192]], late.v[b[s : s + 8192]]) for s in range(0, len(a), 8192))])
        norm = early.norm[a] * late.norm[b]
        cosine = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
        same = key_e[a] == key_l[b] if ttl is not None else np.zeros(len(a), bool)
        real = same | (cosine >= least - 1e-5)
        yield a[real], b[real], np.where(same, 1.0, cosine)[real]


def sides(least: float) -> Callable[[str, dict], Side]:
    """Blocks as sides by a name; the last of each name stays, as one of a cell's two does for many rows."""
    last: dict[str, tuple[bytes, Side]] = {}

    def side(name: str, row: dict) -> Side:
        if name not in last or last[name][0] != row["held"]:
            last[name] = row["held"], Side(row["held"], row["size"], row["whole"], least)
        return last[name][1]

    return side


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """packed() with an id of each block, checkpointed."""
    return cut(packed(rows, block).withColumn("id", F.monotonically_increasing_id()))


def cells(blocks: DataFrame, judge: Callable[[int, Side, int, Side], pa.RecordBatch], schema: str, least: float, ttl: float | None = None, itself: bool = True) -> DataFrame:
    """What judge says of the ids and rows of all pairs of blocks that can hold a pair, of a block with itself too if so asked; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sides(least)
        for batch in batches:
            for row in batch.to_pylist():
                yield judge(row["e"]["id"], side("e", row["e"]), row["l"]["id"], side("l", row["l"]))

    one, two = blocks.select(F.struct("*").alias("e")), blocks.filter("open").select(F.struct("*").alias("l"))
    meet = "struct(e.size, e.lo_scope, e.lo_at) < struct(l.size, l.hi_scope, l.hi_at) AND struct(l.size, l.lo_scope) <= struct(e.size, e.hi_scope)"
    if not itself:
        meet += " AND e.id <> l.id"
    if ttl is not None:
        meet += f" AND l.lo_t - e.hi_t < {float(ttl)!r}D"
    with arrow_rows(blocks.sparkSession, 2):
        return cut(one.join(two, F.expr(meet)).mapInArrow(run, schema))
