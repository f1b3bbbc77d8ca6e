"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits, scheme separators and
account cues. From each anchor a parser expands to the left and to the right and checks what it finds. For the four base
kinds the result is that of leftmost, non-overlapping matching by their rules.

Null texts count as empty. Repeated rows give repeated rows. An empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

#: The kinds in the order in which they are listed, and the character classes of the base rules.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LABEL | set("._%+")
PHONE = DIGITS | set(" ().-")
SCHEME = LETTERS | DIGITS | set("+.-")
STOP = frozenset(" \t\r\n\"'<>/?#")


@cache
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for cue in ("@", "+", "://", "IBAN", *sorted(DIGITS)):
        automaton.add_word(cue, cue)
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; its local part starts at floor or later."""
    start, n = at, len(text)
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels, k = at, 0, at + 1
    while True:
        first = k
        while k < n and text[k] in LABEL:
            k += 1
        if k == first:
            break
        end, labels = k, labels + 1
        if k >= n or text[k] != ".":
            break
        k += 1
    return (start, end) if labels >= 2 else None


def ip_at(text: str, at: int) -> tuple[int, list[str]]:
    """The end of up to four groups of digits with dots between, and the groups."""
    groups, k, n = [], at, len(text)
    while True:
        first = k
        while k < n and text[k] in DIGITS:
            k += 1
        groups.append(text[first:k])
        if len(groups) == 4 or k + 1 >= n or text[k] != "." or text[k + 1] not in DIGITS:
            return k, groups
        k += 1


def card_at(text: str, at: int) -> tuple[int, str]:
    """The end of a run of digits with single blanks or hyphens between, and its digits."""
    digits, k, n = [text[at]], at + 1, len(text)
    while k < n:
        if text[k] in DIGITS:
            digits.append(text[k])
            k += 1
        elif text[k] in " -" and k + 1 < n and text[k + 1] in DIGITS:
            digits.append(text[k + 1])
            k += 2
        else:
            break
    return k, "".join(digits)


def phone_at(text: str, at: int) -> int | None:
    """The end of the number that starts with the plus sign at ``at``."""
    n = len(text)
    if at + 1 >= n or text[at + 1] not in DIGITS:
        return None
    k = at + 2
    while k < n and text[k] in PHONE:
        k += 1
    while k > at + 3 and text[k - 1] not in DIGITS:
        k -= 1
    return k if k > at + 3 else None


def login_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """scheme://user:secret@host around the separator at ``at``."""
    start, n = at, len(text)
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    k = at + 3
    while k < n and text[k] not in STOP:
        k += 1
    user, sign, host = text[at + 3 : k].rpartition("@")
    name, colon, word = user.partition(":")
    return (start, k) if start < at and sign and colon and name and word and host and host[0] in LABEL else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """An account number after the cue that ends at ``at``, if its check digits are right."""
    k, n = at, len(text)
    while k < n and text[k] in " :#=" and k - at < 4:
        k += 1
    start, found, end = k, [], k
    while k < n and len(found) < 34:
        if text[k] in LETTERS or text[k] in DIGITS:
            found.append(text[k].upper())
            end = k = k + 1
        elif text[k] == " " and k + 1 < n and found:
            k += 1
        else:
            break
        number = "".join(found)
        if len(number) >= 15 and number[:2].isalpha() and number[2:4].isdigit() and (end >= n or text[end] not in LABEL):
            if int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
                return start, end
    return None


def pii_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), by start."""
    found = []
    email_end = ip_end = card_end = phone_end = login_end = 0
    for last, cue in anchors().iter(text):
        if cue in DIGITS:
            if last >= card_end:
                card_end, digits = card_at(text, last)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((last, 2, card_end))
            if last >= ip_end:
                end, groups = ip_at(text, last)
                if len(groups) == 4:
                    ip_end = end
                    if all(len(x) <= 3 and int(x) <= 255 for x in (g.lstrip("0") or "0" for g in groups)):
                        found.append((last, 1, end))
                else:
                    ip_end = last + len(groups[0])
        elif cue == "@":
            if span := email_at(text, last, email_end):
                found.append((span[0], 0, span[1]))
                email_end = span[1]
        elif cue == "+":
            if last >= phone_end and (end := phone_at(text, last)):
                phone_end = end
                if 9 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                    found.append((last, 3, end))
        elif cue == "://":
            if span := login_at(text, last - 2, login_end):
                found.append((span[0], 4, span[1]))
                login_end = span[1]
        elif span := iban_at(text, last + 1):
            found.append((span[0], 5, span[1]))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its spans ``kind:start:end``, by start and then in the order of KINDS."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = pii_spans(text)
                    base = [x for x in spans if x[1] < 4]
                    n = [sum(k == i for _, k, _ in base) for i in range(4)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, SCHEMA)
