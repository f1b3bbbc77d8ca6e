"""Exact and greedy near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.cells import BLOCK, Side, blocks_of, cells, close_pairs
from quern.operators.lineage import cut


def first_of_each(rows: DataFrame, digest: Column, order: Column, *columns: str) -> DataFrame:
    """One row for each digest, the first by order; combined before the shuffle, so copies don't meet in one task."""
    return rows.groupBy(digest.alias("digest")).agg(F.min_by(F.struct(*columns), order).alias("first"), F.count("*").alias("copies")).select("digest", "first.*", "copies")


def similar_pairs(vectors: DataFrame, dims: int, least: float, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, similarity), a < b, of different vectors of dims components whose cosine is at least ``least``.

    Equal vectors count as one, under their least id; representatives() says which that is. Vectors are packed into blocks, and two blocks
    meet in one cell, once (see cells).
    """

    def judge(_: int, early: Side, __: int, late: Side) -> pa.RecordBatch:
        found = [(early.at[i], late.at[j], cosine) for i, j, cosine in close_pairs(early, late, least, None)]
        columns = [np.concatenate([np.empty(0, t), *(x[k] for x in found)]) for k, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "similarity"])

    held = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dims)))
    named = cut(digested(held, dims).drop("v"))  # ids and digests only: vectors don't meet to be told apart
    reps = named.groupBy("digest").agg(F.min("id").alias("id"))
    if named.groupBy("id").count().filter("count > 1").isEmpty():
        found = held.join(reps, "id", "left_semi")
    else:
        found = digested(held, dims).join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id"])
    rows = cut(found.filter("size(v) > 0").select(F.lit("").alias("scope"), F.col("id").alias("at"), F.lit(None).cast("string").alias("key"), "v", F.lit(0.0).alias("t"), F.lit(None).cast("boolean").alias("kept")))
    pairs = cells(blocks_of(rows, block), judge, "a long, b long, similarity double", least)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity")).filter(F.col("similarity") >= least)


def representatives(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, rep): each vector of dims components with the least id of those equal to it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dims))
    keyed = digested(rows, dims)
    return keyed.join(keyed.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "v", "rep")


def digested(rows: DataFrame, dims: int) -> DataFrame:
    """rows (id long, v array<double>, of dims components) with a digest of v; nulls are a value of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten()
            values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(-1, dims)
            empty = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims)
            digests = [blake2b(v.tobytes() + e.tobytes(), digest_size=16).digest() for v, e in zip(values, empty)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["id", "v", "digest"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, digest binary")


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ids that a pass in ascending order keeps: one is dropped only if it is similar to one kept before it.

    In each round an undecided id is kept once all its earlier neighbours are dropped, and dropped once one of them is kept.
    The least undecided id is always decided, and chains of decisions are short in practice.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct())
    state = cut(ids.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        known = edges.join(state.select(F.col("id").alias("early"), F.col("kept").alias("early_kept")), "early")
        seen = known.groupBy(F.col("late").alias("id")).agg(F.bool_or(F.coalesce("early_kept", F.lit(False))).alias("any_kept"), F.bool_and(F.coalesce(~F.col("early_kept"), F.lit(False))).alias("all_dropped"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept").isNull() | F.col("all_dropped"), True).when(F.col("any_kept"), False)
        state = cut(state.join(seen, "id", "left").select("id", decided.alias("kept")))
        if state.filter("kept IS NULL").isEmpty():
            return state.filter("kept").select("id")
