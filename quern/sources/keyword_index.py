"""A keyword index that stays: postings in segments that are written where the texts are, appended to, deleted from and searched without the texts.

Two tables lie behind a manifest (see versions). ``segments`` has the words of some thousand chunks each: a segment's lists of (word, chunks,
counts) are packed by field and by shards of words, a row each, so a search for a few words opens only their shards' pages. One more row of a
segment has its chunks: ids, filter columns and field lengths. ``gone`` has chunks that were deleted or written again: what earlier
writes say of them doesn't count. compact() writes what counts into fresh segments.

Nothing is sorted or shuffled when chunks are added, and nothing is read of the lists when chunks go. A search takes the lists of the words asked, of
the chunks that count, together by segment; counts of documents come from these, then each segment gives its best chunks of each query.

Scores are BM25 for each field, times the field's boost; a chunk's score is that of its best field. Counts and mean lengths are those of chunks that
have the field (not null). Words are those between white space, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import search
from quern.operators.lineage import cut
from quern.operators.words import lower_line, words_of
from quern.sources.versions import Version, VersionedTables

#: The weights of the two fields.
FIELDS = {"content": 2.0, "title": 1.0}
#: Words up to which a search reads only their shards; shards of a segment.
PUSHED_WORDS, SHARDS = 2000, 16
#: A segment's bytes of text and chunks, and the bytes of its lists that compact() aims at; words asked, or terms of queries, that meet a segment at once (a copy goes with each row to Python).
SEGMENT_BYTES, SEGMENT_CHUNKS, PACKED_BYTES, TERMS = 16 << 20, 1 << 15, 4 << 20, 1 << 14
#: The shard of a segment's row of chunks.
OF_CHUNKS = -1


def sealed(**columns: pa.Array | np.ndarray) -> bytes:
    """Arrays of any lengths in one value, compressed."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(held: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(held).read_next_batch()
    return {name: batch.column(i)[0].values for i, name in enumerate(batch.schema.names)}


def shard_of(words: pa.StringArray) -> np.ndarray:
    """The shard of each word, none of them empty: by the sum of its bytes."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.int64)
    return np.add.reduceat(np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]], at[:-1], dtype=np.int64) % SHARDS


def small(numbers: np.ndarray) -> np.ndarray:
    """The same in as few bytes as they need; none is negative."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def lists_of(words: pa.StringArray, places: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(shard, lists) of words at places, each with a count, or as often as it is there."""
    coded = words.dictionary_encode()
    shard = shard_of(coded.dictionary)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    span = int(places.max(initial=0)) + 1
    key = rank[coded.indices.to_numpy()] * span + places
    if counts is None:
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, counts = key[first], np.diff(first, append=len(key))
    else:
        by = np.argsort(key)
        key, counts = key[by], counts[by]
    sizes = np.bincount(key // span, minlength=len(order))
    names, at = coded.dictionary.take(pa.array(order)), np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            own = slice(at[a], at[b])
            yield s, sealed(words=names.slice(a, b - a), sizes=small(sizes[a:b]), places=small(key[own] % span), counts=small(counts[own]))


HELD = "segment long, shard int, field string, held binary"
HELD_SCHEMA = pa.schema([("segment", pa.int64()), ("shard", pa.int32()), ("field", pa.string()), ("held", pa.binary())])


def segment_rows(segment: int, chunks: pa.RecordBatch, lists: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((segment, OF_CHUNKS, None, sealed(**{c: chunks.column(c) for c in chunks.schema.names})), HELD_SCHEMA.types)], schema=HELD_SCHEMA)
    for field, shard, held in lists:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((segment, shard, field, held), HELD_SCHEMA.types)], schema=HELD_SCHEMA)


class KeywordIndex:
    def __init__(self, spark: SparkSession, root: str | None = None, fields: Sequence[str] = ("content",), kept: Sequence[str] = ("source",)):
        """fields: text columns that are searched; kept: string columns to filter and delete by."""
        self.fields, self.kept = tuple(fields), tuple(kept)
        self.lengths = ", ".join(f"length_{f} int" for f in fields)
        self.tables = VersionedTables(spark, root, {
            "segments": f"{HELD}, seq long",
            "gone": f"chunk_id long, {self.lengths}, before long",
        })
        self.spark = spark

    def _facts(self, chunks: DataFrame) -> dict[str, int]:
        """docs, and docs and words of each field; rows counts repeated ids, too."""
        wanted = [F.count("*").alias("rows"), F.count_distinct("chunk_id").alias("docs")]
        wanted += [x for f in self.fields for x in (F.count(f"length_{f}").alias(f"docs_{f}"), F.coalesce(F.sum(f"length_{f}"), F.lit(0)).alias(f"words_{f}"))]
        return chunks.agg(*wanted).first().asDict()

    def _listed(self, segments: DataFrame) -> DataFrame:
        """The chunks of segments, with their segment, place and seq."""
        names = ["chunk_id", *self.kept, *(f"length_{f}" for f in self.fields)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    found = opened(batch.column("held")[i].as_py())
                    n = len(found["chunk_id"])
                    same = [pa.repeat(batch.column(c)[i], n) for c in ("segment", "seq")]
                    yield pa.RecordBatch.from_arrays([*(found[c] for c in names), same[0], pa.array(np.arange(n, dtype=np.int32)), same[1]], names=[*names, "segment", "place", "seq"])

        kept = "".join(f"{c} string, " for c in self.kept)
        return segments.filter(F.col("shard") == OF_CHUNKS).select("segment", "seq", "held").mapInArrow(run, f"chunk_id long, {kept}{self.lengths}, segment long, place int, seq long")

    def _present(self, version: Version) -> DataFrame:
        rows = self._listed(self.tables.read("segments", version))
        if not version.folders.get("gone"):
            return rows
        last = cut(self.tables.read("gone", version).groupBy("chunk_id").agg(F.max("before").alias("before")))  # of a known size
        return rows.join(last, "chunk_id", "left").filter("before IS NULL OR seq >= before").drop("before")

    def chunks(self, version: Version | None = None) -> DataFrame:
        """The chunks that count."""
        return self._present(version or self.tables.version()).drop("segment", "place")

    def _change(self, now: Version, added: Mapping[str, str], facts: Mapping[str, int], sign: int, note: str) -> Version:
        folders = {t: [*now.folders.get(t, []), *([added[t]] if t in added else [])] for t in self.tables.schemas}
        return self.tables.commit(folders, {k: now.facts.get(k, 0) + sign * v for k, v in facts.items() if k != "rows"}, note, now)

    def _remove(self, now: Version, ids: DataFrame, note: str) -> Version:
        """A version without the chunks of these ids: they are marked."""
        lost = self.chunks(now).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        gone = self.tables.write(lost.select("chunk_id", *(f"length_{f}" for f in self.fields), F.lit(now.number + 1).cast("long").alias("before")), "gone")
        facts = self._facts(self.spark.read.schema(self.tables.schemas["gone"]).parquet(gone))
        return self._change(now, {"gone": gone}, facts, -1, note) if facts["docs"] else now

    def append(self, chunks: DataFrame, parts: int | None = None) -> Version:
        """Adds chunks (chunk_id, the fields, the kept columns), in so many files if parts is given; those that are there already are replaced. Ids of a batch are distinct."""
        now, fields, kept, most, many = self.tables.version(), self.fields, self.kept, SEGMENT_BYTES, SEGMENT_CHUNKS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = sum(pc.fill_null(pc.binary_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
                ends = np.cumsum(size)
                at = 0
                while at < len(batch):
                    to = max(at + 1, min(at + many, int(np.searchsorted(ends, ends[at] - size[at] + most, "right"))))
                    part, at = batch.slice(at, to - at), to
                    columns, lists = {c: part.column(c) for c in ("chunk_id", *kept)}, []
                    for f in fields:
                        lines = part.column(f)
                        words, n = words_of(pc.fill_null(lines, " "))
                        columns[f"length_{f}"] = pa.array(n, pa.int32(), mask=lines.is_null().to_numpy(zero_copy_only=False))
                        lists += [(f, *x) for x in lists_of(words, np.repeat(np.arange(len(part)), n))]
                    yield from segment_rows(part.column("chunk_id")[0].as_py() or 0, pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)), lists)

        lines = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *(F.col(c).cast("string").alias(c) for c in kept), *(lower_line(F.col(f)).alias(f) for f in fields))
        held = (lines.repartition(parts) if parts else lines).mapInArrow(run, HELD)
        folder = self.tables.write(held.withColumn("seq", F.lit(now.number + 1).cast("long")), "segments")
        added = self._listed(self.spark.read.schema(self.tables.schemas["segments"]).parquet(folder))
        facts = self._facts(added)
        if facts["rows"] != facts["docs"]:
            raise ValueError("chunk_id must be distinct, and not null, within a batch")
        if now.facts.get("docs", 0):
            now = self._remove(now, added, "replaced")
        return self._change(now, {"segments": folder}, facts, 1, "appended")

    def delete(self, column: str, value: str) -> Version:
        """Removes all chunks with this value in a kept column, such as a source."""
        now = self.tables.version()
        return self._remove(now, self.chunks(now).filter(F.col(column) == value), f"deleted {column} {value}")

    def delete_ids(self, ids: DataFrame) -> Version:
        """Removes the chunks of ids (chunk_id)."""
        return self._remove(self.tables.version(), ids, "deleted ids")

    def drop(self) -> Version:
        """An empty index; older versions can still be rolled back to."""
        return self.tables.drop()

    def compact(self, parts: int | None = None) -> Version:
        """Fresh files with just the rows that count; small segments are put together."""
        now, fields, kept = self.tables.version(), self.fields, self.kept
        names = ["chunk_id", *kept, *(f"length_{f}" for f in fields)]

        def run(rows: pa.Table, chunks: pa.Table) -> pa.Table:
            chunks = chunks.combine_chunks()
            if not len(chunks):
                return HELD_SCHEMA.empty_table()
            found = alive_of(chunks)
            lists = {f: ([], [], []) for f in fields}
            for row in rows.select(["seq", "segment", "field", "held"]).to_pylist():
                if row["field"] is not None and (row["seq"], row["segment"]) in found:
                    held = opened(row["held"])
                    words, places, counts = present_lists(held, found[row["seq"], row["segment"]])
                    for x, y in zip(lists[row["field"]], (held["words"].take(pa.array(words)), places, counts)):
                        x.append(y)
            packed = [(f, *x) for f, (words, places, counts) in lists.items() if words for x in lists_of(pa.concat_arrays(words), np.concatenate(places), np.concatenate(counts))]
            return pa.Table.from_batches(segment_rows(chunks["chunk_id"][0].as_py(), pa.RecordBatch.from_arrays([chunks[c].combine_chunks() for c in names], names=names), packed), HELD_SCHEMA)

        segments, chunks = self.tables.read("segments", now), cut(self._present(now))
        groups = parts or max(1, -(-(segments.agg(F.sum(F.length("held"))).first()[0] or 0) // PACKED_BYTES))
        group = F.pmod(F.xxhash64("seq", "segment"), F.lit(groups)).alias("at")
        both = segments.filter(F.col("shard") >= 0).select(group, "seq", "segment", "field", "held").groupBy("at").cogroup(chunks.select(group, "seq", "segment", "place", *names).groupBy("at"))
        folder = self.tables.write(both.applyInArrow(run, HELD).withColumn("seq", F.lit(now.number + 1).cast("long")), "segments")
        return self.tables.commit({"segments": [folder], "gone": []}, now.facts, "compacted", now)

    def stats(self) -> DataFrame:
        """(exists, version, docs): one row."""
        now = self.tables.version()
        return self.spark.createDataFrame([(bool(now.folders.get("segments")), now.number, now.facts.get("docs", 0))], "exists boolean, version long, docs long")

    def search(self, queries: DataFrame, k: int = 10, boosts: Mapping[str, float] | None = None, where: Mapping[str, str] | None = None, digits: int = 4) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks of each row of queries (query_id, query). where: wanted values of kept columns."""
        now, kind, at_once = self.tables.version(), queries.schema["query_id"].dataType.simpleString(), search.FIRST_LOOK
        boosts = dict(boosts or {f: 1.0 for f in self.fields})
        means = {f: now.facts.get(f"words_{f}", 0) / max(1, now.facts.get(f"docs_{f}", 0)) for f in boosts}
        asked = queries.select("query_id", F.explode(T.word_set(F.col("query"))).alias("word")).distinct()
        words = cut(asked.select("word").distinct())
        segments = self.tables.read("segments", now).filter((F.col("shard") >= 0) & F.col("field").isin(list(boosts)))
        listed = [r.word for r in words.limit(PUSHED_WORDS + 1).collect()]
        if len(listed) <= PUSHED_WORDS:  # then the filter reaches the files
            segments = segments.filter(F.col("shard").isin(np.unique(shard_of(pa.array(listed, pa.string()))).tolist()))
        blocks = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, -(-words.count() // TERMS))))).agg(F.collect_list("word").alias("wanted")).select("wanted")
        chunks = self._present(now).withColumn("allowed", reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in (where or {}).items()], F.lit(True)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    held = opened(batch.column("held")[i].as_py())
                    some = np.flatnonzero(pc.is_in(held["words"], batch.column("wanted")[i].values).to_numpy(zero_copy_only=False))
                    if len(some):
                        sizes = held["sizes"].to_numpy().astype(np.int64)
                        own = ranges((np.cumsum(sizes) - sizes)[some], sizes[some])
                        lists = sealed(words=held["words"].take(pa.array(some)), sizes=small(sizes[some]), places=held["places"].to_numpy()[own], counts=held["counts"].to_numpy()[own])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("seq", "segment", "field")), pa.array([lists], pa.binary())], names=["seq", "segment", "field", "held"])

        def gather(rows: pa.Table, chunks: pa.Table) -> pa.Table:
            schema = pa.schema([("held", pa.binary()), ("field", pa.list_(pa.string())), ("word", pa.list_(pa.string())), ("df", pa.list_(pa.int32()))])
            if not len(rows) or not len(chunks):
                return schema.empty_table()
            chunks = chunks.combine_chunks()
            (alive,) = alive_of(chunks).values()
            names, of, sizes, places, counts = [], [], [], [], []
            for row in rows.select(["field", "held"]).to_pylist():
                held = opened(row["held"])
                word, place, count = present_lists(held, alive)
                n = np.bincount(word, minlength=len(held["words"]))
                some = np.flatnonzero(n)
                names.append(held["words"].take(pa.array(some)))
                of += [row["field"]] * len(some)
                sizes.append(n[some])
                places.append(place)
                counts.append(count)
            sizes, names, of = np.concatenate(sizes).astype(np.int32), pa.concat_arrays(names), pa.array(of, pa.string())
            held = sealed(chunk_id=chunks["chunk_id"].combine_chunks(), allowed=chunks["allowed"].combine_chunks(), **{f"length_{f}": chunks[f"length_{f}"].combine_chunks() for f in boosts}, field=of, word=names, sizes=sizes, places=small(np.concatenate(places)), counts=small(np.concatenate(counts)))
            return pa.table([pa.array([held], pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (of, names, pa.array(sizes)))], schema=schema)

        picked = segments.crossJoin(blocks).select("seq", "segment", "field", "held", "wanted").mapInArrow(pick, "seq long, segment long, field string, held binary")
        own = chunks.select("seq", "segment", "place", "chunk_id", "allowed", *(f"length_{f}" for f in boosts))
        met = cut(picked.groupBy("seq", "segment").cogroup(own.groupBy("seq", "segment")).applyInArrow(gather, "held binary, field array<string>, word array<string>, df array<int>"))
        df = met.select(F.explode(F.arrays_zip("field", "word", "df")).alias("x")).groupBy("x.field", "x.word").agg(F.sum("x.df").alias("df"))
        facts = self.spark.createDataFrame([(f, now.facts.get(f"docs_{f}", 0), float(b)) for f, b in boosts.items()], "field string, docs long, boost double")
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = cut(asked.join(df.join(facts, "field"), "word").select("query_id", "field", "word", (F.col("boost") * idf).alias("idf")))
        blocks = terms.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-terms.count() // TERMS))))).agg(F.collect_list(F.struct("query_id", "field", "word", "idf")).alias("terms")).select("terms")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    for found in search.best_of_segment(opened(batch.column("held")[i].as_py()), batch.column("terms")[i].values, means, k, digits, at_once):
                        yield pa.RecordBatch.from_arrays(list(found), names=["query_id", "chunk_id", "score"])

        hits = met.select("held").crossJoin(blocks).mapInArrow(score, f"query_id {kind}, chunk_id long, score double")
        return search.ranked(hits, "query_id", [F.desc("score"), F.col("chunk_id")], k)


def alive_of(chunks: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """By seq and segment the row of chunks that each place has, -1 where the chunk doesn't count."""
    seq, segment, place = (chunks[c].to_numpy() for c in ("seq", "segment", "place"))
    names, own = np.unique(np.stack([seq, segment]), axis=1, return_inverse=True)
    found = {}
    for i, name in enumerate(names.T.tolist()):
        rows = np.flatnonzero(own == i)
        found[tuple(name)] = np.full(int(place[rows].max()) + 1, -1)
        found[tuple(name)][place[rows]] = rows
    return found


def present_lists(held: Mapping[str, pa.Array], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, count) of the postings in lists whose chunk counts."""
    word = np.repeat(np.arange(len(held["words"])), held["sizes"].to_numpy())
    place, count = held["places"].to_numpy().astype(np.int64), held["counts"].to_numpy()
    row = np.where(place < len(alive), alive[np.minimum(place, len(alive) - 1)], -1)
    real = row >= 0
    return word[real], row[real], count[real]
