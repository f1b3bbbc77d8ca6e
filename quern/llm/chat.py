"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, each turn between control strings, and encoded once with offsets. The spans of the
assistant's texts are in ascending order, and so are the tokens' spans: two binary searches a turn find its tokens. The
control strings are tokens of their own, added to the tokenizer, so no token crosses the bounds of a turn's text.

In texts and roles, ``<``, any number of ``\\`` and ``|`` get one more ``\\``, so no control string can appear there; taking it
away again restores every text. Null texts and roles count as empty. Turns are taken in the order of turn, role, text, and
turns of the same number all stay. A null conv_id is a conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary_path

#: The template's control strings, the role that is learnt from, and the byte-level vocabulary.
TURN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|close|>"
LEARNT = "assistant"
VOCABULARY = "byte_bpe_50k.json"
PARSE = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|close\|>", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the spans of the learnt texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in PARSE.findall(formatted)]


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that lie in one of the spans; both are in ascending order."""
    mask = np.zeros(len(offsets), np.int8)
    if len(offsets) and spans:
        starts, ends = np.array(spans).T
        first = np.searchsorted(offsets[:, 1], starts, side="right")
        last = np.searchsorted(offsets[:, 0], ends, side="left")
        for a, b in zip(first, last, strict=True):
            mask[a:b] = 1
    return mask


@cache
def chat_tokenizer(path: str):
    """The byte-level tokenizer with the control strings as tokens; its own special strings count as text."""
    import json

    from tokenizers import AddedToken, Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    file["added_tokens"] = []
    tokenizer = Tokenizer.from_str(json.dumps(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_tokens([AddedToken(x, normalized=False) for x in (TURN, BODY, CLOSE)])
    return tokenizer


@cache
def byte_strings(path: str) -> dict[int, bytes]:
    """The bytes that each id of the vocabulary stands for."""
    from .bpe import byte_letters

    of = {c: b for b, c in enumerate(byte_letters())}
    return {i: bytes(of[c] for c in s) for s, i in chat_tokenizer(path).get_vocab(with_added_tokens=False).items() if all(c in of for c in s)}


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations from batches that are sorted by them; one may lie across batches."""
    now, turns, any_yet = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if any_yet and conv != now:
                yield now, turns
                turns = []
            now, any_yet = conv, True
            turns.append((role, text))
    if any_yet:
        yield now, turns


FORMATTED = "conv_id long, formatted string, ids array<int>, loss_mask array<tinyint>"


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per conversation: the rendered text, its ids, and 1 for each id that is learnt."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(path)
        for conv, turns in conversations_of(batches):
            text, spans = render(turns)
            encoded = tokenizer.encode(text, add_special_tokens=False)
            mask = mask_tokens(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text], pa.string()), pa.array([encoded.ids], pa.list_(pa.int32())), pa.array([mask.tolist()], pa.list_(pa.int8()))], names=["conv_id", "formatted", "ids", "loss_mask"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_formatted(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the output says when it is read back: turns parsed from the text, learnt texts decoded from masked ids."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = byte_strings(path)
        for batch in batches:
            rows = []
            for conv, text, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "ids", "loss_mask")), strict=True):
                turns = parse(text)
                runs: list[list[bytes]] = []
                before = 0
                for i, m in zip(ids, mask, strict=True):
                    if m:
                        if not before:
                            runs.append([])
                        runs[-1].append(strings[i])
                    before = m
                loss = "".join(unescape(b"".join(x).decode("utf-8")) for x in runs)
                turns_hash = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                rows.append((conv, len(turns), turns_hash, len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(run, DIGEST)
