"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph holds each vector's nearest known neighbours. It starts from blocks of vectors that random hyperplanes put close
together. Then each round joins neighbours with neighbours of neighbours: around every vector its neighbours in either
direction meet, and those that are nearer to each other than what they knew replace it. A query walks the graph from its
own place: it looks at the neighbours of the nearest vectors that it has seen, until none of those is new. What it ends with
is measured again on the original vectors, in double precision.

Vectors travel as they are, in the precision of their column, and distances are taken in double precision, so near copies keep
their order. Equal vectors are one node; a node keeps as many of its least ids as a result can hold. A node always gets the vectors
of its own neighbours, and hears of the nearest that name it, so no group holds more than two widths of rows, however many
nodes name a hub: rows beyond that are cut before they are shuffled. Rounds go on until few neighbours change.

What the graph can't answer is answered exactly: queries whose walk finds fewer than k vectors, those whose walk ends because
it holds all that it may, and those with vectors of another length than most (of the longest where that is a tie) are
compared with all vectors of their length, in blocks. Vectors of different lengths are never neighbours.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Rows with the same
id and vector count once. Ties go to the lesser id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, Scratch, tidy

NODE = "id long, code binary, digest binary"


def batch_of(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound)


def usual_length(rows: DataFrame) -> int:
    """The length of most vectors."""
    return rows.groupBy(F.size("vector").alias("size")).count().agg(F.max_by("size", F.struct("count", "size"))).first()[0] or 0


def encode_nodes(rows: DataFrame, kind: str) -> DataFrame:
    """Each vector as bytes of NumPy's kind, and a digest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = (batch.column("vector").flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind)  # no negative zeros
            ends = np.cumsum(batch.column("vector").value_lengths().to_numpy(zero_copy_only=False))
            codes = [row.tobytes() for row in np.split(flat, ends[:-1])] if len(batch) else []
            yield batch_of(["id", "code", "digest"], [pa.int64(), pa.binary(), pa.binary()], [batch.column("id").to_pylist(), codes, [hashlib.md5(x).digest() for x in codes]])

    return rows.select("id", "vector").mapInArrow(tidy(run), NODE)


def decoded(codes: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes), kind).reshape(len(codes), -1).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    a, b = a - a[:1], b - a[:1]  # far from the origin near copies would lose their order
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest_of(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of the count nearest other rows, and their squared distances."""
    d = squares(points, points)
    np.fill_diagonal(d, np.inf)
    count = min(count, len(points) - 1)
    at = np.argpartition(d, count - 1, axis=1)[:, :count]
    return at, np.take_along_axis(d, at, 1)


LINK = ["key", "other", "d"], [pa.int64(), pa.int64(), pa.float32()]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with the same key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != keys[start]:
                yield held
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield held


def values(parts: list[pa.RecordBatch], column: str) -> list:
    return list(chain.from_iterable(p.column(column).to_pylist() for p in parts))


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first_edges(nodes: DataFrame, kind: str, width: int, starts: int, block: int, spread: int) -> DataFrame:
    """Links within blocks of vectors, in the orders that some sets of random hyperplanes give them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            points = decoded(batch.column("code").to_pylist(), kind)
            for turn in range(starts):
                planes = np.random.default_rng(turn).standard_normal((points.shape[1], 17))
                sides = points @ planes
                place = (turn << 16) + (sides[:, :16] > 0) @ (1 << np.arange(16, dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(place), pa.array(sides[:, 16])], names=["id", "code", "place", "along"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in chain(batches, [None]):
            held = [x for x in (left, batch) if x is not None and len(x)]
            rows, left = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None, None
            while rows is not None and len(rows) > 1:
                if batch is not None and len(rows) < 2 * block:  # keep enough for a last block that is no stump
                    left = rows
                    break
                take = len(rows) if len(rows) < 2 * block else block
                part = rows.slice(0, take)
                ids = part.column("id").to_numpy()
                at, d = nearest_of(decoded(part.column("code").to_pylist(), kind), width)
                apart = np.repeat(ids, at.shape[1]) != ids[at].ravel()  # where two orders meet a node may meet itself
                yield batch_of(*LINK, [np.repeat(ids, at.shape[1])[apart], ids[at].ravel()[apart], d.ravel()[apart]])
                rows = rows.slice(take)

    order = ["place", "along", "id"]
    return nodes.select("id", "code").mapInArrow(tidy(mark), "id long, code binary, place long, along double").repartitionByRange(spread, *order).sortWithinPartitions(*order).mapInArrow(tidy(meet), LINKS)


def sent(df: DataFrame, *columns: str) -> DataFrame:
    """Rows brought together by key, in the order of key and then columns."""
    return df.repartition(parts_of(df), "key").sortWithinPartitions("key", *columns)


def array(parts: list[pa.RecordBatch], column: str, kind=np.int64) -> np.ndarray:
    return np.concatenate([p.column(column).to_numpy(zero_copy_only=False) for p in parts]).astype(kind)


def limited(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """Like sent, with at most so many first rows of a key; rows beyond that are cut before the shuffle, too."""
    order = Window.partitionBy("key").orderBy(*columns)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def with_links(nodes: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(id, code, ids, ds, fresh): each node's nearest of what it has (ids, ds) and of links (key, other, d); how many are new."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for parts in groups(batches, "key"):
            own = parts[0]
            if own.column("code")[0].as_py() is None:
                continue
            others, ds = array(parts, "other"), array(parts, "d", np.float32)
            others, ds = others[1:], ds[1:]  # the first row is the node itself
            had = np.empty(0, np.int64)
            if own.column("ids")[0].as_py():
                had = own.column("ids")[0].values.to_numpy()
                others = np.concatenate([others, had])
                ds = np.concatenate([ds, own.column("ds")[0].values.to_numpy()])
            others, first = np.unique(others, return_index=True)
            ds = ds[first]
            order = np.lexsort((others, ds))[:width]
            out.append((own.column("key")[0].as_py(), own.column("code")[0].as_py(), others[order], ds[order], int((~np.isin(others[order], had)).sum())))
            if len(out) == 2048:
                yield batch_of(STATE_NAMES, STATE_TYPES, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch_of(STATE_NAMES, STATE_TYPES, list(zip(*out, strict=True)))

    has = "ids" in nodes.columns
    own = nodes.select(F.col("id").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("other"), F.lit(0).cast("float").alias("d"), "code", *([F.col("ids"), F.col("ds")] if has else [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<float>").alias("ds")]))
    new = links.select("key", F.lit(1).alias("kind"), "other", "d", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<float>").alias("ds"))
    return sent(own.unionByName(new), "kind").mapInArrow(tidy(merge), STATE)


STATE = "id long, code binary, ids array<long>, ds array<float>, fresh int"
STATE_NAMES = ["id", "code", "ids", "ds", "fresh"]
STATE_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.int32()]


def told(state: DataFrame, width: int) -> DataFrame:
    """(key, other, code, reach): every node is told of its own neighbours, and of the nearest that name it.

    Of a key's rows two widths are kept: all neighbours of its own first. reach is how far the other's neighbours reach, infinite
    while it has fewer than width.
    """
    reach = F.when(F.size("ids") >= width, F.array_max("ds")).otherwise(F.lit(float("inf")).cast("float"))
    near = state.select("id", "code", reach.alias("reach"), "ids", "ds")
    links = near.select(F.col("id").alias("key"), F.explode("ids").alias("other"))
    answers = links.join(near.select(F.col("id").alias("other"), "code", "reach"), "other").select("key", F.lit(0).alias("kind"), F.lit(0).cast("float").alias("d"), "other", "code", "reach")
    names = near.select(F.explode(F.arrays_zip("ids", "ds")).alias("x"), "id", "code", "reach").select(F.col("x.ids").alias("key"), F.lit(1).alias("kind"), F.col("x.ds").alias("d"), F.col("id").alias("other"), "code", "reach")
    return limited(answers.unionByName(names), 2 * width, "kind", "d", "other").select("key", "other", "code", "reach")


def met(state: DataFrame, kind: str, best: int, width: int) -> DataFrame:
    """Links (key, other, d) between nodes that have a neighbour in common and are nearer than what one of them knows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0
        for parts in groups(batches, "key"):
            ids, first = np.unique(array(parts, "other"), return_index=True)
            if len(ids) < 2:
                continue
            codes = values(parts, "code")
            at, d = nearest_of(decoded([codes[i] for i in first], kind), best)
            nearer = d < array(parts, "reach", np.float32)[first][:, None]
            found.append((np.repeat(ids, at.shape[1])[nearer.ravel()], ids[at][nearer], d[nearer]))
            held += len(found[-1][0])
            if held > 50_000:
                yield batch_of(*LINK, [np.concatenate(x) for x in zip(*found, strict=True)])
                found, held = [], 0
        if found:
            yield batch_of(*LINK, [np.concatenate(x) for x in zip(*found, strict=True)])

    return told(state, width).mapInArrow(tidy(meet), LINKS)


LINKS = "key long, other long, d float"


def build_graph(nodes: DataFrame, kind: str, width: int, rounds: int, least_change: float, starts: int, block: int, best: int, scratch: Scratch) -> DataFrame:
    """(id, code, ids, ds): the neighbour graph of nodes by NN-descent; ds are squared distances.

    It ends when a round changes less than a share least_change of all neighbours.
    """
    count = nodes.count()
    spread = max(1, min(parts_of(nodes), count * starts // (2 * block)))  # a part with few nodes would be cut off
    links = first_edges(nodes, kind, width, starts, block, spread)
    state = scratch.keep(with_links(nodes.select("id", "code"), links, width), "graph")
    for _ in range(rounds):
        state = scratch.keep(with_links(state, met(state, kind, best, width), width), "graph")
        if (state.agg(F.sum("fresh")).first()[0] or 0) < least_change * count * width:
            break
    return state


def fat_graph(state: DataFrame, width: int) -> DataFrame:
    """(node, ids, codes): each node with the vectors of its neighbours in either direction, two widths at most."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups(batches, "key"):
            ids, first = np.unique(array(parts, "other"), return_index=True)
            codes = values(parts, "code")
            yield batch_of(["node", "ids", "codes"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())], [[parts[0].column("key")[0].as_py()], [ids], [[codes[i] for i in first]]])

    return told(state, width).mapInArrow(tidy(collect), "node long, ids array<long>, codes array<binary>")


SEEN = "query long, ids array<long>, ds array<float>"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once by Arrow, in what runs meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def walk(starts: DataFrame, graph: DataFrame, kind: str, k: int, beam: int, slack: float, most: int, scratch: Scratch) -> DataFrame:
    """(query, ids, ds): the nearest nodes that each query (query, code; a node itself) finds, nearest first.

    A query holds its beam nearest, and all within 1 + slack times the distance of its k-th, up to most. In each round it
    opens all that it holds and hasn't opened; it ends when there are none. The graph should be bucketed by node: then only the
    open nodes and what they show are shuffled.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable((b.slice(at, 256) for at in range(0, len(b), 256)) for b in batches):  # a row holds two widths of vectors
            out: tuple[list, list, list] = ([], [], [])
            cols = [batch.column(c).to_pylist() for c in ("query", "code", "bound", "codes")]
            ids = batch.column("ids")
            for k, (query, code, bound, codes) in enumerate(zip(*cols, strict=True)):
                d = squares(decoded([code], kind), decoded(codes, kind))[0]
                near = d < bound
                if near.any():
                    out[0].append(query)
                    out[1].append(ids[k].values.to_numpy()[near])
                    out[2].append(d[near])
            yield batch_of(["query", "ids", "ds"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())], list(out))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups(batches, "key"):
            own = parts[0]
            query = own.column("key")[0].as_py()
            ids = np.concatenate([x.values.to_numpy() for p in parts for x in p.column("ids")])
            ds = np.concatenate([x.values.to_numpy() for p in parts for x in p.column("ds")])
            done = own.column("done")[0].values.to_numpy()
            ids, first = np.unique(ids, return_index=True)
            ds = ds[first]
            keep = ids != query
            order = np.lexsort((ids[keep], ds[keep]))[:most]
            ids, ds = ids[keep][order], ds[keep][order]
            bound = float("inf")
            if len(ds) > beam:
                bound = max(float(ds[beam - 1]), float(ds[min(k, beam) - 1]) * (1 + slack) ** 2)
                held = max(beam, int(np.searchsorted(ds, bound, side="right")))
                ids, ds = ids[:held], ds[:held]
            fresh = ids[~np.isin(ids, done)]
            yield batch_of(WALK_NAMES, WALK_TYPES, [[query], own.column("code").to_pylist()[:1], [ids], [ds], [np.concatenate([done, fresh])], [fresh], [bound]])

    state = starts.select("query", "code", F.expr("array()").cast("array<long>").alias("ids"), F.expr("array()").cast("array<float>").alias("ds"), F.array("query").alias("done"), F.array("query").alias("fresh"), F.lit(float("inf")).alias("bound"))
    while True:  # each round opens nodes that were not open before
        frontier = state.select("query", "code", "bound", F.explode("fresh").alias("node"))
        seen = frontier.join(graph, "node").select("query", "code", "bound", "ids", "codes").mapInArrow(tidy(look), SEEN)
        own = state.select(F.col("query").alias("key"), F.lit(0).alias("kind"), "code", "ids", "ds", "done")
        new = seen.select(F.col("query").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("code"), "ids", "ds", F.lit(None).cast("array<long>").alias("done"))
        state = scratch.keep(sent(own.unionByName(new), "kind").mapInArrow(tidy(merge), WALK), "walk")
        if state.filter(F.size("fresh") > 0).isEmpty():
            return state.select("query", "ids", "ds")


WALK = "query long, code binary, ids array<long>, ds array<float>, done array<long>, fresh array<long>, bound double"
WALK_NAMES = ["query", "code", "ids", "ds", "done", "fresh", "bound"]
WALK_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]


def bucketed(df: DataFrame, key: str, folder: str) -> tuple[DataFrame, str]:
    """df as a table in a shared folder, bucketed by key, and the table's name: joins by key need not shuffle it."""
    spark, n = df.sparkSession, parts_of(df)
    name = f"graph_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name), name


def scanned(asked: DataFrame, nodes: DataFrame, kind: str, k: int, block: int = 1024) -> DataFrame:
    """(query, node): the k nearest nodes (id, code) of each query (query, code; a node itself) and all as near as the last of these.

    Nodes are dealt into slices and queries into blocks; a cell holds a slice and a block of vectors of one length.
    """
    slices = parts_of(nodes)
    blocks = -(-asked.count() // block)
    one = asked.select("query", "code", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), F.lit(0).alias("kind"))
    two = nodes.select(F.col("id").alias("query"), "code", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(slices)).alias("s"), F.lit(1).alias("kind"))
    key = F.xxhash64(F.length("code"), F.col("b").cast("long"), F.col("s").cast("long")).alias("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            for part in groups(iter([batch]), "key"):
                cell, kinds = part[0].column("key")[0].as_py(), array(part, "kind")
                ids, codes = array(part, "query"), values(part, "code")
                asked_n = int((kinds == 0).sum())
                if asked_n:
                    before = held if held[0] == cell else (cell, np.empty(0, np.int64), [])
                    held = (cell, np.concatenate([before[1], ids[:asked_n]]), before[2] + codes[:asked_n])
                if held[0] != cell or asked_n == len(ids):
                    continue
                others = ids[asked_n:]
                x, y = decoded(held[2], kind), decoded(codes[asked_n:], kind)
                d = squares(x, y)
                d[held[1][:, None] == others[None]] = np.inf
                last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                noise = 1e-12 * float(d[np.isfinite(d)].max(initial=0.0))
                q, at = np.nonzero((d <= last[:, None] * (1 + 1e-9) + noise) & np.isfinite(d))
                yield batch_of(*LINK, [held[1][q], others[at], ((x[q] - y[at]) ** 2).sum(1)])

    met = one.unionByName(two).withColumn("key", key).drop("b", "s")
    found = sent(met, "kind").mapInArrow(tidy(meet), LINKS)
    last = Window.partitionBy("key").orderBy("d")
    ranked = found.withColumn("place", F.rank().over(last)).filter(F.col("place") <= k)
    return ranked.select(F.col("key").alias("query"), F.col("other").alias("node"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, width: int = 20, rounds: int = 20, least_change: float = 0.25, starts: int = 2, block: int = 256, best: int = 6, beam: int = 400, slack: float = 0.15, most: int = 5000, spare: int = 30, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of queries (its ids, among those of vectors).

    width: neighbours that a node keeps; NN-descent ends when a round changes less than a share least_change of them, or after
    so many rounds; beam: nodes that a query holds at least; slack: it holds all within 1 + slack times the distance of its
    k-th, up to most, and is answered by a scan if it comes to that; spare: how many found nodes beyond k are measured again
    at least.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = valid_vectors(vectors, id_col, vector_col)
    usual = usual_length(rows) * int(kind[-1])
    with Scratch(spark, "ann") as scratch:
        coded = scratch.keep(encode_nodes(rows, kind), "codes")
        reps = scratch.keep(coded.groupBy("digest").agg(F.min("id").alias("rep"), F.first("code").alias("code")), "nodes")
        ids = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
        asked = ids.join(coded.select(F.col("id").alias("query_id"), "digest"), "query_id").join(reps, "digest").select("query_id", F.col("rep").alias("query"), "code").distinct()
        asked = scratch.keep(asked, "asked")
        order = Window.partitionBy("digest").orderBy("id")
        least = coded.select("digest", "id").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
        members = scratch.keep(least.join(reps.select("digest", F.col("rep").alias("node")), "digest").select("node", F.col("id").alias("vec_id")), "members")
        nodes = reps.select(F.col("rep").alias("id"), "code")
        state = build_graph(nodes.filter(F.length("code") == usual), kind, width, rounds, least_change, starts, block, best, scratch)
        graph, name = bucketed(fat_graph(state, width), "node", scratch.root)
        starts_at = asked.filter(F.length("code") == usual).select("query", "code").dropDuplicates(["query"])
        with small_batches(spark, 1000):  # a row of the graph holds two widths of vectors
            found = scratch.keep(walk(starts_at, graph, kind, k, beam, slack, most, scratch), "walk")
        spark.sql(f"DROP TABLE {name}")
        # all that the k-th's rounding could hide are measured again, and some more
        close = F.filter(F.arrays_zip("ids", "ds"), lambda x, i: (i < k + spare) | (x["ds"] <= F.try_element_at("ds", F.lit(k)) * (1 + 1e-5)))
        near = found.select("query", F.explode(F.concat(F.array("query"), F.transform(close, lambda x: x["ids"]))).alias("node"))
        near = scratch.keep(near, "near")
        reached = near.join(members, "node").groupBy("query").agg(F.count("*").alias("n"))
        done = reached.filter(F.col("n") > k).join(found.filter(F.size("ids") >= most), "query", "left_anti")
        rest = scratch.keep(asked.select("query", "code").dropDuplicates(["query"]).join(done.select("query"), "query", "left_anti"), "rest")
        if not rest.isEmpty():
            near = near.unionByName(scanned(rest, nodes, kind, k)).unionByName(rest.select("query", F.col("query").alias("node"))).distinct()
        pairs = asked.select("query_id", "query").join(near, "query").join(members, "node").filter("vec_id <> query_id").select("query_id", "vec_id")
        exact = rows.select("id", "vector")
        measured = pairs.join(exact.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").join(exact.select(F.col("id").alias("vec_id"), F.col("vector").alias("v")), "vec_id")
        score = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        top = Window.partitionBy("query_id").orderBy("score", "vec_id")
        result = measured.filter(F.size("q") == F.size("v")).select("query_id", "vec_id", score.alias("score")).distinct()
        return checkpointed(result.withColumn("rank", F.row_number().over(top).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
