"""BPE encoding and decoding with a priority queue of merge ranks.

A word's symbols form a doubly linked list. The queue holds the merges of neighbours by rank and place; a popped entry is
stale if either symbol has changed since, and is skipped. Decoding concatenates the vocabulary's strings, with a blank
between ids, as the vocabulary file names no decoder.

Null texts count as empty: no ids, an empty decoded text. Repeated rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .tokens import plain_texts, split_words, vocabulary_path


#: So many words a task keeps what it knows of: some 70 MB.
MAX_WORDS = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one free from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Bpe:
    """The vocabulary of a tokenizers file with byte letters, word ends and lower case."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end, self.letters = model["end_of_word_suffix"], byte_letters()
        self.ids: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.strings = {i: s for s, i in (*self.ids.items(), *self.added.items())}
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): rank for rank, pair in enumerate(model["merges"])}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

    def word(self, word: str) -> list[int]:
        """Ids of one word that is in lower case already."""
        symbols: list[str | None] = [self.letters[b] for b in word.encode("utf-8")]
        if not symbols:
            return []
        symbols[-1] += self.end
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            merged = symbols[i] = left + right
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (merged, symbols[k])) in ranks:
                    heapq.heappush(queue, (ranks[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (symbols[h], merged)) in ranks:
                heapq.heappush(queue, (ranks[pair], h, *pair))
        return [self.ids[s] for s in symbols if s is not None]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def normal(self, text: str) -> str:
        """Normal form C and lower case, each character by itself."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def segment(self, text: str) -> list[list[int]]:
        """Ids of each word of a text that has no added token."""
        return [self.word(w) for w in self.words.findall(self.normal(text))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.split_added.split(text)):
            if k % 2:
                out.append(self.added[piece])
            elif piece:
                out += [i for ids in self.segment(piece) for i in ids]
        return out

    def strings_of(self, words: list[str], known: dict, max_words: int) -> list[tuple[int, str, str]]:
        """Of each word in lower case: how many ids, the ids with blanks between, the decoded ids. known keeps the first max_words."""
        out = []
        for w in words:
            found = known.get(w)
            if found is None:
                ids = self.word(w)
                found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                if len(known) < max_words:
                    known[w] = found
            out.append(found)
        return out


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


def digest(data) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_batch(model: Bpe, batch: pa.RecordBatch, known: dict, max_words: int = MAX_WORDS) -> list[tuple[int, str, str]]:
    """Of each text: how many ids, the digest of the ids with blanks between, the digest of the decoded text."""
    texts, plain = plain_texts(batch.column("text").cast(pa.large_string()))
    words, coded, counts = split_words(texts.filter(pa.array(plain)))
    found = model.strings_of(words, known, max_words)
    sizes = np.fromiter((x[0] for x in found), np.int64, len(found))[coded]
    totals = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    keep = sizes > 0  # not the empty strings of the split
    bounds = pa.array(np.concatenate([[0], np.cumsum(keep)])[ends], pa.int32())
    places = pa.array(coded[keep])
    joined = [pc.binary_join(pa.ListArray.from_arrays(bounds, pa.array([x[k] for x in found], pa.string()).take(places)), " ") for k in (1, 2)]
    own = zip(np.diff(totals[ends]).tolist(), *([digest(x.as_buffer()) for x in column] for column in joined), strict=True)
    rows = []
    for k, is_plain in enumerate(plain.tolist()):
        if is_plain:
            rows.append(next(own))
        else:
            ids = model.encode(texts[k].as_py())
            rows.append((len(ids), digest(" ".join(map(str, ids)).encode()), digest(model.decode(ids).encode())))
    return rows


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: how many ids, the digest of the ids, and the digest of the text decoded from them.

    A task keeps what it knows of its first max_words words and drops it at its end.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = bpe(path), {}
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                rows = encode_batch(model, part, known, max_words)
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


ENCODED = "doc_id long, ids array<int>"


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each document."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = pa.array([bpe(path).encode(x) for x in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): null ids give a null text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else bpe(path).decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
