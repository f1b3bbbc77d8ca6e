"""Token ids in binary files of bit planes.

A file holds ids in blocks of a fixed size. A block is transposed into planes: bit b of every id makes up plane b (or byte
b, for byte planes); each plane is compressed with zstandard by itself. Planes above the highest bit in use take no space.
A footer holds the chunk index (where each block lies, how many ids, how long each plane) and the document index, and
the file ends with the footer's length and a mark. So a reader can fetch any block, or any plane of it, by its offset.

Documents are dealt out by ranges of doc_id, so files in order hold all documents in ascending order of doc_id (null ids
first). Null texts count as empty: they hold the end id alone. Documents with the same id lie next to each other. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, open_fs, shared_dir, slices
from .tokens import END_ID, WordEncoder, vocabulary_path

#: Fixed values of the format: the mark at both ends, and a footer's tail (its length, the mark).
MARK = b"BPLANE01"
TAIL = struct.Struct("<Q8s")
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
READ = "part int, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """Planes of a block, from the lowest; width 1 for bits, 8 for bytes."""
    used = int(ids.max()).bit_length() if len(ids) else 0
    if width == 8:
        return [(ids >> np.uint32(b)).astype(np.uint8).tobytes() for b in range(0, used, 8)]
    planes = []
    for b in range(used):
        if not b % 8:
            low = (ids >> np.uint32(b)).astype(np.uint8)
        planes.append(np.packbits(low & np.uint8(1 << b % 8)).tobytes())  # any bit but 0 counts as 1
    return planes


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        values = values if width == 8 else np.unpackbits(values, count=n)
        ids |= values.astype(np.uint32) << np.uint32(b * width)
    return ids


class PlaneWriter:
    """Writes one file; holds one block of ids at most, besides the document index."""

    def __init__(self, out, block: int, width: int, level: int):
        import zstandard

        self.out, self.block, self.width = out, block, width
        self.codec = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.at = len(MARK)
        self.chunks: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MARK)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, len(ids)))
        self.n_tokens += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        planes = [self.codec.compress(x) for x in to_planes(ids, self.width)]
        self.chunks.append([self.at, len(ids), [len(x) for x in planes]])
        for x in planes:
            self.out.write(x)
        self.at += sum(map(len, planes))
        self.held, self.n_held = [], 0

    def close(self) -> int:
        if self.n_held:
            self._flush()
        doc_ids = np.array([0 if d is None else d for d, _ in self.docs], np.int64)
        sizes = np.array([n for _, n in self.docs], np.int64)
        nulls = [k for k, (d, _) in enumerate(self.docs) if d is None]
        index = self.codec.compress(doc_ids.tobytes() + sizes.tobytes())
        footer = json.dumps({"width": self.width, "chunks": self.chunks, "n_docs": len(sizes), "nulls": nulls, "docs": [self.at, len(index)]}).encode()
        self.out.write(index)
        self.out.write(footer)
        self.out.write(TAIL.pack(len(footer), MARK))
        self.out.close()
        return self.at + len(index) + len(footer) + TAIL.size


class PlaneReader:
    """Reads one file by its indexes."""

    def __init__(self, file):
        import zstandard

        self.file, self.codec = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, mark = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if mark != MARK or self._at(0, len(MARK)) != MARK:
            raise ValueError("not a file of bit planes, or one that was cut short")
        self.footer = json.loads(self._at(size - TAIL.size - n, n))

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        offset, n = self.footer["docs"]
        raw = np.frombuffer(self.codec.decompress(self._at(offset, n)), np.int64)
        n = self.footer["n_docs"]
        ids: list[int | None] = raw[:n].tolist()
        for k in self.footer["nulls"]:
            ids[k] = None
        return ids, raw[n:]

    def block(self, k: int) -> np.ndarray:
        offset, n, sizes = self.footer["chunks"][k]
        data = self._at(offset, sum(sizes))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        return from_planes([self.codec.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], n, self.footer["width"])

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(len(self.footer["chunks"])):
            yield self.block(k)

    def each(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids before it in the file, how many ids, their CRC-32) of each document, a block at a time."""
        ids, sizes = self.documents()
        blocks = self.blocks()
        block, at, start = np.empty(0, np.uint32), 0, 0
        for doc, n in zip(ids, sizes.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if at == len(block):
                    block, at = next(blocks), 0
                take = min(left, len(block) - at)
                crc = zlib.crc32(block[at : at + take].astype("<u4").tobytes(), crc)
                at, left = at + take, left - take
            yield doc, start, n, crc
            start += n


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, block: int = 1 << 16, width: int = 1, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to files in folder; returns the manifest, a row per file in ascending order of doc_id.

    A task's file has a name of its own and counts only if the manifest lists it, so a task that is run again, or twice at
    once, does no harm. The manifest lies in folder/manifest.
    """
    path = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = WordEncoder(path), None, TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                if not len(rows):
                    continue
                if writer is None:
                    fs, root = open_fs(folder)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                    fs.create_dir(root, recursive=True)
                    writer = PlaneWriter(fs.open_output_stream(f"{root}/{name}"), block, width, level)
                ids, bounds = encoder.encode(rows.column("text"))
                for doc, first, last in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    writer.add(doc, np.append(ids[first:last], np.uint32(END_ID)))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": len(writer.docs), "n_tokens": writer.n_tokens, "n_bytes": size}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document, from the files alone; start counts the ids of all documents before it, in all files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int32()] + [pa.int64()] * 5
        for batch in batches:
            for part, path, before in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "before")), strict=True):
                fs, at = open_fs(path)
                rows = []
                with fs.open_input_file(at) as file:
                    for k, (doc, start, n, crc) in enumerate(PlaneReader(file).each()):
                        rows.append((part, k, doc, before + start, n, crc))
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # The manifest has a row per file, not per document: small enough for one running sum.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "path", before).repartition(n, "part").mapInArrow(read, READ).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq")


def token_file_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to a fresh shared folder and read them back."""
    return read_token_files(write_token_files(docs, shared_dir(docs.sparkSession, "tokens"), **options))
