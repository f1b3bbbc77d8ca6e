"""Media columns in archives, read by a Spark data source.

Texts become payloads (UTF-8, zero bytes up to a positive multiple of 64), payloads become grey images of 8 bits a sample
and 64 samples a row (PNG, lossless; the unpadded length in a text chunk), and images become stored members of ZIP
archives in a shared folder. The data source ``member_archive`` plans byte ranges over the archives that a manifest lists:
a partition reads its archive's directory and streams, as Arrow batches, the members that begin in its range. A member is
fetched by its own offset and checked by its CRC-32; one that fails is fetched again by itself.

Null texts count as empty (64 zero bytes). Equal texts give equal media. Repeated rows and null ids stay, each a member of
its own. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import id_and_text, open_fs, shared_dir, slices

#: Fixed values of the formats: PNG's mark, samples a row, and the part of a ZIP member's header before its name.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
ROW = 64
LOCAL_HEADER = struct.Struct("<4s5H3L2H")
MANIFEST = "archive string, n_members long, n_bytes long"
MEMBER = "doc_id long, n_bytes long, payload binary, media binary, feature string"
BATCH_BYTES = 8 << 20


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_media(text: str, level: int = 4) -> bytes:
    """The PNG of a text's payload."""
    data = text.encode("utf-8")
    padded = data + b"\0" * (-len(data) % ROW or (0 if data else ROW))
    rows = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    scan = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with its filter: none
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"".join([PNG_MARK, png_chunk(b"IHDR", head), png_chunk(b"tEXt", b"n_bytes\0" + str(len(data)).encode()), png_chunk(b"IDAT", zlib.compress(scan.tobytes(), level)), png_chunk(b"IEND", b"")])


def decode_media(media: bytes) -> tuple[int, bytes]:
    """The unpadded length and the payload of a PNG that encode_media made."""
    if media[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, width, height, n, body = 8, 0, 0, None, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n = int(data[8:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    samples = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    payload = samples[:, 1:].tobytes()
    return len(payload) if n is None else n, payload


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, a histogram of eight ranges in parts of 1,000, and an average hash of 64 bits."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 5, minlength=8)[:8] * 1000 // len(samples)
    edges = np.linspace(0, len(samples), 65).astype(int)[:-1]
    sums = np.add.reduceat(samples.astype(np.int64), edges)
    sizes = np.diff(np.append(edges, len(samples)))
    bits = np.packbits(sums * len(samples) > int(samples.sum(dtype=np.int64)) * sizes).tobytes().hex()
    return f"{samples.mean():.3f}|{samples.std():.3f}|{'-'.join(map(str, shares.tolist()))}|{bits}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts' media to archives in folder; returns the manifest, a row per archive (it lies in folder/manifest).

    Each task writes archives of about archive_bytes under names of its own; those of failed tasks are in no manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        part, archive, name, n, size = TaskContext.get().partitionId(), None, "", 0, 0

        def done() -> pa.RecordBatch:
            archive.close()
            archive.stream.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "n_members": n, "n_bytes": fs.get_file_info(f"{root}/{name}").size}], pa.schema([("archive", pa.string()), ("n_members", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for rows in slices(batch, "text"):
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    if archive is None:
                        fs.create_dir(root, recursive=True)
                        name, n, size = f"part-{part:06d}-{uuid.uuid4().hex}.zip", 0, 0
                        stream = fs.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                        archive.stream = stream
                    media = encode_media(text)
                    archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc is None else doc}.png"), media)
                    n, size = n + 1, size + len(media)
                    if size >= archive_bytes:
                        yield done()
                        archive = None
        if archive is not None:
            yield done()

    texts = id_and_text(docs, id_col, text_col)
    texts.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges of about range_bytes over the archives of the manifest."""
        fs, root = open_fs(f"{self.folder}/manifest")
        listed = ds.dataset([x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".parquet")], filesystem=fs, format="parquet").to_table(["archive", "n_bytes"])
        found = []
        for row in sorted(listed.to_pylist(), key=lambda r: r["archive"]):
            for start in range(0, row["n_bytes"], self.range_bytes):
                found.append(ByteRange(row["archive"], start, min(start + self.range_bytes, row["n_bytes"])))
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = open_fs(partition.archive)
        with fs.open_input_file(path) as file:
            directory = zipfile.ZipFile(file).infolist()
            members = sorted((m for m in directory if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
            rows, held = [], 0
            for member in members:
                doc = member.filename.split("/", 1)[1].removesuffix(".png")
                n, payload, media = self.fetch(fs, path, file, member)
                rows.append((int(doc) if doc else None, n, payload, media, feature_of(payload)))
                held += len(payload) + len(media)
                if held >= BATCH_BYTES:
                    yield member_batch(rows)
                    rows, held = [], 0
            if rows:
                yield member_batch(rows)

    def fetch(self, fs, path: str, file, member: zipfile.ZipInfo) -> tuple[int, bytes, bytes]:
        """One member by its offset; after a failure by itself again, from a file opened anew."""
        for attempt in range(1, self.tries + 1):
            try:
                if attempt > 1:
                    time.sleep(0.1 * attempt)
                    with fs.open_input_file(path) as again:
                        media = member_bytes(again, member)
                else:
                    media = member_bytes(file, member)
                return *decode_media(media), media
            except (OSError, ValueError, zlib.error):
                if attempt == self.tries:
                    raise
        raise AssertionError


def member_bytes(file, member: zipfile.ZipInfo) -> bytes:
    head = LOCAL_HEADER.unpack(file.read_at(LOCAL_HEADER.size, member.header_offset))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    data = file.read_at(member.compress_size, member.header_offset + LOCAL_HEADER.size + head[9] + head[10])
    if len(data) != member.compress_size or zlib.crc32(data) != member.CRC:
        raise ValueError("a member's checksum is wrong")
    return data


def member_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in MEMBER.split(", ")])


class MemberArchive(DataSource):
    """``spark.read.format("member_archive").option("range_bytes", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_bytes, payload, media, feature) of every member."""
    spark.dataSource.register(MemberArchive)
    return spark.read.format("member_archive").load(folder)


def media_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Store all texts in a fresh shared folder, read them back, and describe what was read."""
    folder = shared_dir(docs.sparkSession, "media")
    write_archives(docs, folder, **options)
    return read_archives(docs.sparkSession, folder).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
