"""Words of lower-case texts and digests of pairs of words, for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # takes half the time of hashlib's for a few bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: White space as T.words has it: of one byte, and of several.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_BLANK = "[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"


def lower_line(c: Column) -> Column:
    """What spans takes: a text in lower case with a blank after it."""
    return F.concat(F.lower(c), F.lit(" "))


def spans(lines: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, counts): the words of lines (see lower_line; no nulls) are data[start:end], a blank follows each, and a line has counts of them.

    Words are those of T.words.
    """
    odd = pc.match_substring_regex(lines, WIDE_BLANK)
    if pc.any(odd).as_py():
        lines = pc.if_else(odd, pc.replace_substring_regex(lines, WIDE_BLANK, " "), lines)
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    blank = BLANK[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]  # a line ends with a blank, so one before it is there at each line's start
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(~before & blank)
    counts = np.diff(np.searchsorted(starts, at - at[0]))
    keep = ~blank
    keep[ends] = True
    data = data[keep]
    lengths = ends - starts
    data[(ends := np.cumsum(lengths + 1) - 1)] = 32
    return data, ends - lengths, ends, counts


def words_of(lines: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(words, counts): all words of lines in order, and how many each line has."""
    data, starts, ends, counts = spans(lines)
    letters = np.ones(len(data), bool)
    letters[ends] = False
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letters])), counts


#: The steps of MD5: constants, shifts, and which word of a block each takes.
SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
TAKES = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
INITIAL = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of texts that fit with their end mark, by how many words of a block; and texts that are digested at once.
WIDTHS, AT_ONCE = (4, 6, 8, 14), 16384


def block_heads(block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of texts of one block: block[w] has their w-th words; words that aren't there are 0."""
    a, b, c, d = (np.full(block.shape[1], x, np.uint32) for x in INITIAL)
    f, g, size = np.empty_like(a), np.empty_like(a), (lengths * 8).astype(np.uint32)
    for i in range(61):  # the others don't change the first four bytes
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, SINES[i], out=f)
        w = TAKES[i]
        if w < len(block):
            np.add(f, block[w], out=f)
        elif w == 14:
            np.add(f, size, out=f)
        np.left_shift(f, np.uint32(SHIFTS[i]), out=g), np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(INITIAL[0])


def md5_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of each data[start:end], least byte first."""
    out, lengths = np.empty(len(starts), np.uint32), ends - starts
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    least = 0
    for width in WIDTHS:
        most = min(4 * width - 1, 55)
        some = np.flatnonzero((lengths >= least) & (lengths <= most))
        least = most + 1
        inside = np.where(np.arange(4 * width) < np.arange(most + 1)[:, None], 255, 0).astype(np.uint8)
        mark = np.where(np.arange(4 * width) == np.arange(most + 1)[:, None], 128, 0).astype(np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 4 * width)
        for at in range(0, len(some), AT_ONCE):
            own = some[at : at + AT_ONCE]
            n = lengths[own]
            block = (windows[starts[own]] & inside[n]) | mark[n]
            out[own] = block_heads(np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False), n)
    for i in np.flatnonzero(lengths > 55):
        out[i] = int.from_bytes(md5(data[starts[i] : ends[i]].tobytes(), usedforsecurity=False).digest()[:4], "little")
    return out
