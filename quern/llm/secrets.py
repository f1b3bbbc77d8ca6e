"""Secret scans by structural confirmation.

Three plain rules report what looks like a secret. Beyond them, runs that could be encoded are decoded from base64 or
hex, and reported only if their content has the structure of a key or a signed token: DER values whose nested lengths add
up, the length-prefixed fields of an OpenSSH key, or a JSON header that names a signing algorithm.

Null texts count as empty. Repeated rows give repeated rows. An empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, tidy

#: The base rules, and the kinds in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CUES = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

#: A header's first character is that of base64 of a brace or of white space; matches may overlap.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([eICD][A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s|\\[rn])*(?:[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*(?:\s|\\[rn])+)*)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*(?:\r|\n|\\r|\\n)+[\x20\t]*)+[A-Za-z0-9+/_-]*={0,2}")
BREAK = re.compile(r"[\x20\t]*(?:\r|\n|\\r|\\n)+[\x20\t]*")
#: Where a key may begin in a run of base64: its first character, or the next after a separator.
BEGIN = re.compile(r"(?:^|(?<=[+/_-]))(?=M|b3BlbnNzaC1rZXktdjEA)")
#: Algorithms of encrypted PKCS#8: those of PKCS#5 and of PKCS#12.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")


def decode_base64(run: str) -> bytes | None:
    """Bytes of a base64 run of either alphabet, with or without padding; None if it is none."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_values(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly; None if lengths don't add up."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that holds a version number and then the parts of a PKCS#1, PKCS#8 or SEC 1 private key."""
    outer = der_values(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_values(data, *outer[0][1:])
    if parts and [t for t, _, _ in parts] == [0x30, 0x04]:  # encrypted PKCS#8: an algorithm, then what it encrypted
        algorithm = der_values(data, *parts[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(PBE)
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [t for t, _, _ in parts]
    if tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: an algorithm, then the key
        algorithm = der_values(data, *parts[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x04:  # SEC 1: the key, then its curve
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return len(tags) >= 9 and all(t == 0x02 for t in tags[:9])  # PKCS#1: nine numbers


def is_ssh_key(data: bytes) -> bool:
    """The fields of an OpenSSH private key, or of a public key blob, each with its length before it, to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while fields < 3:  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def key_in(run: str, breaks: frozenset[int] = frozenset()) -> tuple[int, int, int] | None:
    """(start, kind, end) of the first key in a run of base64, begun at any separator; a DER key ends where its length says.

    breaks are places of the run before which a line ended.
    """
    body = run.rstrip("=")
    for at in sorted({*(m.start() for m in BEGIN.finditer(body)), *(b for b in breaks if BEGIN.match(body[b : b + 20]))}):
        if body[at] != "M":
            data = decode_base64(body[at : len(body) - (len(body) - at) % 4] if (len(body) - at) % 4 == 1 else body[at:])
            if data and is_ssh_key(data):
                return at, 6, len(run)
            continue
        head = decode_base64(body[at : at + 8])
        if not head or len(head) < 6 or head[0] != 0x30:
            continue
        wide = head[1] & 0x7F if head[1] & 0x80 else 0
        if wide > 4:
            continue
        size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
        end = at + (size * 4 + 2) // 3
        if end > len(body) or not (end == len(body) or end in breaks or body[end] in "+/_-"):
            continue
        data = decode_base64(body[at:end])
        if data and is_der_key(data):
            return at, 5, len(run) if end == len(body) else end
    return None


def wrapped_key(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """key_in of a run of base64 that goes over lines."""
    pieces, at = [], start
    for m in BREAK.finditer(text, start, end):
        pieces.append((at, text[at : m.start()]))
        at = m.end()
    pieces.append((at, text[at:end]))
    places = [i for first, piece in pieces for i in range(first, first + len(piece))]
    breaks, held = set(), 0
    for _, piece in pieces[:-1]:
        held += len(piece)
        breaks.add(held)
    found = key_in("".join(piece for _, piece in pieces), frozenset(breaks))
    if found and found[1] == 6:  # no length says where it ends: its lines are alike, and with a shorter last one make whole bytes
        ends = [0, *sorted(breaks), held + len(pieces[-1][1])]
        last = next((i for i in range(2, len(ends)) if ends[i] - ends[i - 1] != ends[i - 1] - ends[i - 2]), len(ends) - 1)
        whole = last == len(ends) - 1 or ends[last] - ends[last - 1] < ends[last - 1] - ends[last - 2]
        found = found[0], 6, ends[last] if whole and (ends[last] - found[0]) % 4 == 0 else ends[max(1, last - 1)]
        if found[2] <= found[0]:
            return None
    return found and (places[found[0]], found[1], places[found[2] - 1] + 1)


def is_jwt(run: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm, the second to a JSON object."""
    header, body, _ = run.split(".")
    try:
        head = json.loads(decode_base64(header) or b"")
        claims = json.loads(decode_base64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by the three base rules."""
    found = []
    low = text.lower()
    if any(cue in low for cue in ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded content has the structure of a key or of a signed token."""
    found = [(m.start(), 3, m.end(1)) for m in JWT.finditer(text) if is_jwt(m[1])]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            data = decode_base64(re.sub(r"\\[rn]|\s", "", m[3]))
            locked = "ENCRYPTED" in m[2] and "DEK-Info" in m[2]  # its content is a cipher's blocks
            if data and (is_der_key(data) or is_ssh_key(data) or locked and len(data) % 8 == 0):
                found.append((m.start(), 4, m.end()))
    pems = [(start, end) for start, kind, end in found if kind == 4]
    for m in BASE64.finditer(text):
        key = key_in(m[0])
        if key:
            found.append((m.start() + key[0], key[1], m.start() + key[2]))
    for m in WRAPPED.finditer(text):
        key = None if any(start <= m.start() < end for start, end in pems) else wrapped_key(text, m.start(), m.end())
        if key:
            found = [x for x in found if (x[0], x[1]) != key[:2] or x[2] > key[2]]
            found.append(key)
    for m in HEX_KEY.finditer(text):
        data = bytes.fromhex(m[0])
        if data[0] == 0x30 and is_der_key(data):
            found.append((m.start(), 5, m.end()))
        elif is_ssh_key(data):
            found.append((m.start(), 6, m.end()))
    return sorted(set(found))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its spans ``kind:start:end``, by start and then in the order of KINDS."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    n = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted({*base, *confirmed_spans(text)}))))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(scan), SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each secret in text replaced by ``[kind]``; overlapping spans are replaced together, by the first kind.

    Null texts stay null, texts without secrets stay as they are, other columns are kept.
    """

    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact_text, na_action="ignore")

    return docs.withColumn(text_col, F.pandas_udf(redact, "string")(F.col(text_col).cast("string")))


def redact_text(text: str) -> str:
    out, at = [], 0
    spans = sorted({*base_spans(text), *confirmed_spans(text)})
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """redact_secrets for the table of documents: n_chars, where there is one, follows the text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
