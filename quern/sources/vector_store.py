"""A collection of vectors that stays: created if missing, upserted by id, deleted by source, searched by cosine with a filter.

Vectors lie in files partitioned by one filter column, so a search with a filter opens only its partition. A row of these files is a segment: some
thousand vectors packed in one value, their ids and sources in another. Rows of segments that were deleted or written again are marked by
their place, so marks meet segments, not vectors, and ids are read without vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.lineage import cut
from quern.operators.search import vector_search
from quern.sources.keyword_index import opened, sealed
from quern.sources.versions import Version, VersionedTables

#: Vectors of a segment at most.
SEGMENT = 2048


class VectorStore:
    def __init__(self, spark: SparkSession, dims: int, root: str | None = None, partition: str = "tenant_id"):
        """A collection of vectors of dims components. One that is there already must have as many."""
        self.spark, self.dims, self.partition = spark, dims, partition
        self.tables = VersionedTables(spark, root, {"vectors": f"segment long, ids binary, held binary, unsound int, seq long, {partition} string", "gone": "vec_id long, seq long, segment long, place int"}, {"vectors"})
        now = self.tables.version()
        if not now.facts.get("dims"):
            self.tables.commit({}, {"dims": dims, "rows": 0}, "created", now)
        elif now.facts["dims"] != dims:
            raise ValueError(f"the collection has vectors of {now.facts['dims']} components, not {dims}")

    def _unpacked(self, segments: DataFrame, vectors: bool) -> DataFrame:
        """(vec_id, source, the partition column, and embedding or seq, segment and place) of segments, without places that are dead."""
        partition, dims = self.partition, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    found = opened(batch.column("ids")[i].as_py())
                    n = len(found["vec_id"])
                    alive = np.ones(n, bool)
                    if batch.column("dead")[i].is_valid:
                        alive[batch.column("dead")[i].values.to_numpy()] = False
                    columns = {c: found[c] for c in ("vec_id", "source")} | {partition: pa.repeat(batch.column(partition)[i], n)}
                    if vectors:
                        flat = opened(batch.column("held")[i].as_py())["v"].cast(pa.float64())
                        columns["embedding"] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims), pa.int32()), flat)
                    else:
                        columns |= {c: pa.repeat(batch.column(c)[i], n) for c in ("seq", "segment")} | {"place": pa.array(np.arange(n, dtype=np.int32))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(alive))

        names = ["ids", "dead", partition, *(["held"] if vectors else ["seq", "segment"])]
        return segments.select(*names).mapInArrow(run, f"vec_id long, source string, {partition} string, " + ("embedding array<double>" if vectors else "seq long, segment long, place int"))

    def _present(self, version: Version, vectors: bool, where: str | None = None) -> DataFrame:
        segments = self.tables.read("vectors", version)
        if where is not None:
            segments = segments.filter(F.col(self.partition) == where)
        if not version.folders.get("gone"):
            return self._unpacked(segments.withColumn("dead", F.lit(None).cast("array<int>")), vectors)
        dead = cut(self.tables.read("gone", version).groupBy("seq", "segment").agg(F.collect_list("place").alias("dead")))  # a segment's vectors at most
        return self._unpacked(segments.join(dead, ["seq", "segment"], "left"), vectors)

    def rows(self, version: Version | None = None, where: str | None = None) -> DataFrame:
        """The vectors that count: (vec_id, source, embedding, the partition column), of one partition if where names it."""
        return self._present(version or self.tables.version(), True, where).select("vec_id", "source", "embedding", self.partition)

    def delete(self, ids: DataFrame, note: str = "deleted") -> Version:
        """Removes ids (vec_id); those that aren't there make no version."""
        now = self.tables.version()
        lost = self._present(now, False).join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        folder = self.tables.write(lost.select("vec_id", "seq", "segment", "place"), "gone")
        n = self.spark.read.schema(self.tables.schemas["gone"]).parquet(folder).count()
        if not n:
            return now
        return self.tables.commit({**now.folders, "gone": [*now.folders.get("gone", []), folder]}, {**now.facts, "rows": now.facts["rows"] - n}, note, now)

    def delete_by_source(self, source: str) -> Version:
        return self.delete(self._present(self.tables.version(), False).filter(F.col("source") == source), f"deleted source {source}")

    def upsert(self, rows: DataFrame) -> Version:
        """Adds rows (vec_id, source, embedding, the partition column); ids that are there are replaced. Ids of a batch are distinct.

        Vectors that are null or have another number of components are an error, as is a repeated or null id.
        """
        seq, partition, dims = self.tables.version().number + 1, self.partition, self.dims
        kind = f"segment long, ids binary, held binary, unsound int, {partition} string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in pc.unique(batch.column(partition)).to_pylist():
                    own = batch.filter(pc.equal(batch.column(partition), value))
                    for at in range(0, len(own), SEGMENT):
                        part = own.slice(at, SEGMENT)
                        sound = pc.fill_null(pc.equal(pc.list_value_length(part.column("embedding")), dims), False)
                        flat = part.filter(sound).column("embedding").flatten()
                        v = flat.to_numpy(zero_copy_only=False)
                        if not flat.null_count and np.isfinite(v).all() and (np.abs(v) < 32767).all() and (v == v.astype(np.int16)).all() and not np.signbit(v[v == 0]).any():
                            flat = pa.array(v.astype(np.int16))  # whole numbers take two bytes
                        row = part.column("vec_id")[0].as_py() or 0, sealed(vec_id=part.column("vec_id"), source=part.column("source")), sealed(v=flat), len(part) - pc.sum(sound).as_py(), value
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string()))], names=["segment", "ids", "held", "unsound", partition])

        columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("source").cast("string").alias("source"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.col(partition).cast("string"), F.lit("default")).alias(partition)]
        folder = self.tables.write(rows.select(*columns).mapInArrow(run, kind).withColumn("seq", F.lit(seq).cast("long")), "vectors", partition)
        segments = self.spark.read.schema(self.tables.schemas["vectors"]).parquet(folder)
        added = self._unpacked(segments.withColumn("dead", F.lit(None).cast("array<int>")), False)
        n, ids = added.agg(F.count("*"), F.count_distinct("vec_id")).first()
        sound = n - (segments.agg(F.sum("unsound")).first()[0] or 0)
        if not n == ids == sound:
            raise ValueError(f"of {n} rows {ids} have an id of their own and {sound} a vector of {self.dims} components")
        now = self.delete(added, "replaced")
        return self.tables.commit({**now.folders, "vectors": [*now.folders.get("vectors", []), folder]}, {**now.facts, "rows": now.facts["rows"] + n}, "upserted", now)

    def search(self, queries: DataFrame, k: int = 5, where: str | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank) of queries (query_id, q), in one partition if where names it."""
        return vector_search(queries, self.rows(where=where), k)

    def stats(self) -> DataFrame:
        now = self.tables.version()
        return self.spark.createDataFrame([(bool(now.folders.get("vectors")), now.facts.get("rows", 0), self.dims)], "exists boolean, rows long, dims int")

    def drop(self) -> Version:
        """An empty collection; older versions can still be rolled back to."""
        return self.tables.commit({}, {"dims": self.dims, "rows": 0}, "dropped")


class DocumentStores:
    """A keyword index, a collection of vectors and the digests of their sources, kept in step."""

    def __init__(self, spark: SparkSession, index, vectors: VectorStore, chunk, embed):
        """chunk: documents (source, content) to (chunk_id, source, content, the partition column); embed: these to (id, v), better with source and the
        partition column, as vectors are shuffled else."""
        self.spark, self.index, self.vectors, self.chunk, self.embed = spark, index, vectors, chunk, embed
        self.sources = VersionedTables(spark, schemas={"sources": "source string, digest string"})

    def _add(self, docs: DataFrame) -> int:
        chunks = self.chunk(docs)
        before = self.index.tables.version().facts.get("docs", 0)
        now = self.index.append(chunks)
        found, own = self.embed(chunks).withColumnsRenamed({"id": "vec_id", "v": "embedding"}), ["source", self.vectors.partition]
        if not {*own} <= {*found.columns}:
            found = found.select("vec_id", "embedding").join(chunks.select(F.col("chunk_id").alias("vec_id"), *own), "vec_id")
        self.vectors.upsert(found)
        return now.facts["docs"] - before

    def update(self, docs: DataFrame) -> dict[str, int | str]:
        """Brings the stores to the documents (source, content), and says how: mode, counts of sources, chunks removed and added.

        none: nothing differs. incremental: chunks of changed and deleted sources go, those of changed and new ones come. full: more than half of
        the sources that are or were there differ, and the stores are written anew. Digests change last, so an update
        that fails before is done again by the next.
        """
        from quern.sources.tables import changes, update_mode

        now = self.sources.version()
        folder = self.sources.write(docs.select("source", F.substring(F.sha2("content", 256), 1, 16).alias("digest")), "sources")  # texts are read for it once
        old, new = self.sources.read("sources", now), self.spark.read.schema(self.sources.schemas["sources"]).parquet(folder)
        status = changes(old, new, "source", "digest").cache()
        counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}  # four rows at most
        total, differ = sum(counts.values()), sum(n for s, n in counts.items() if s != "same")
        mode = self.spark.range(1).select(update_mode(F.lit(differ), F.lit(total))).first()[0]
        report = {"mode": mode, **{s: counts.get(s, 0) for s in ("new", "changed", "deleted", "same")}, "removed": 0, "added": 0}
        if mode != "none":
            before = self.index.tables.version().facts.get("docs", 0)
            if mode == "full":
                self.index.drop()
                self.vectors.drop()
                report["removed"], fresh = before, docs
            else:
                stale = status.filter("status IN ('changed', 'deleted')").select("source")
                lost = cut(self.index.chunks().join(stale, "source", "left_semi").select("chunk_id"))
                self.vectors.delete(lost.withColumnRenamed("chunk_id", "vec_id"))
                report["removed"] = before - self.index.delete_ids(lost).facts.get("docs", 0)
                fresh = cut(docs.join(status.filter("status IN ('new', 'changed')").select("source"), "source", "left_semi"))  # read by both stores
            report["added"] = self._add(fresh)
            self.sources.commit({**now.folders, "sources": [folder]}, now.facts, mode, now)
        status.unpersist()
        return report
