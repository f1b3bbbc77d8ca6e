"""Documents into chunks by paragraphs and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def pack_lines(text: str, size: int) -> list[str]:
    """Paragraphs packed greedily up to size characters, separators not counted; one that is longer is packed by its lines.

    A line is never cut. What lines are left of a long paragraph may be joined by later paragraphs.
    """
    out: list[str] = []
    held: list[str] = []
    n = 0

    def put(piece: str, joint: str) -> None:
        nonlocal held, n
        if held and n + len(piece) > size:
            out.append(joint.join(held))
            held, n = [], 0
        held.append(piece)
        n += len(piece)

    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if len(paragraph) <= size:
            put(paragraph, "\n\n")
            continue
        if held and n + len(paragraph) > size:
            out.append("\n\n".join(held))
            held, n = [], 0
        for line in filter(None, map(str.strip, paragraph.split("\n"))):
            put(line, "\n")
    return [*out, "\n\n".join(held)] if held else out


#: About as many bytes of texts are chunked at once, whatever Arrow hands over.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about SLICE bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        held = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, held + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def chunk_documents(docs: DataFrame, size: int = 500, tenant: str = "default") -> DataFrame:
    """A row per chunk of (source, content), with its index, id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                packed = [pack_lines(text or "", size) for text in part.column("content").to_pylist()]
                counts = [len(x) for x in packed]
                index, contents = [i for n in counts for i in range(n)], [x for one in packed for x in one]
                sources = part.column("source").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([sources, pa.array(index, pa.int32()), pa.array(contents, pa.string())], names=["source", "chunk_index", "content"])

    kind = docs.schema["source"].dataType.simpleString()
    rows = docs.select("source", F.col("content").cast("string").alias("content")).mapInArrow(run, f"source {kind}, chunk_index int, content string")
    return rows.select(F.concat_ws("_", "source", "chunk_index").alias("chunk_id"), "source", "chunk_index", "content", F.lit(tenant).alias("tenant_id"), F.col("source").alias("doc_id"), T.content_hash(F.col("content")).alias("content_hash"))
