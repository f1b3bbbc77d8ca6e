"""Periodic runs of words, by branching tandem repeats in a suffix tree.

A run is a stretch of words with smallest period q that is at least min_length and min_exponent periods long and that no
neighbouring word extends. A text's words are numbered, and a suffix tree of them is built (a suffix array by prefix doubling,
its common prefixes, and the nodes that these stand for). At each node the leaves of all children but the largest are looked
at: a leaf i under a node of depth d begins a tandem repeat of d words if leaf i + d is under the node too, and the
repeat branches if the words that follow differ. Each run has just one branching repeat of its period, at its right end.
It is rotated to the left as long as words agree; repeats of multiples of the period then cover the same words and are merged
with it.

Before, stretches that can't hold a run are left out, which loses none: each sequence of ``gram_size`` words inside a run comes
twice in it, as a run has that many words beyond two periods. Suffix trees are built of the stretches that remain, by groups
of some words; a stretch is never cut. Texts are handled whole, in slices of some MB, without a shuffle; a task holds some
hundred bytes for each word of a slice or of the longest stretch.

A null text is empty, an empty text has no words and no runs. Repeated rows give a row each; null ids stay. Words are those
between blanks and the characters 9 to 13, equal if their bytes are. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .tokens import ragged

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
GROUP_WORDS = 1 << 17


def gram_size(min_length: int, min_exponent: int) -> int:
    """How many words a run of any period has at least beyond two periods, and one more."""
    q = min_length // min_exponent
    return min(min_length - 2 * q, (min_exponent - 2) * (q + 1)) + 1


def repeating_stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches, each within one of those given, whose sequences of size words all come twice in that one.

    Sequences are compared by a hash of 64 bits: one that is taken for another only keeps a stretch that need not stay.
    """
    starts, ends = starts[ends - starts >= size], ends[ends - starts >= size]
    if not len(starts):
        return starts, ends
    at = ragged(starts, ends - starts - size + 1)
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), ends - starts - size + 1)
    keys = owner * np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(size):
        keys = keys * np.uint64(0x5851F42D4C957F2D) + mixed[at + k]
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (keys >> np.uint64(64 - max(10, (2 * len(keys)).bit_length()))).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot)[slot] > 1)
    order = maybe[np.argsort(keys[maybe], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    kept = np.flatnonzero(twice)
    if not len(kept):
        return starts[:0], ends[:0]
    apart = (np.diff(at[kept]) != 1) | (np.diff(owner[kept]) != 0)
    first = kept[np.concatenate([[True], apart])]
    last = kept[np.concatenate([apart, [True]])]
    return at[first], at[last] + size


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, the rank of each, and how many symbols each has in common with the one before it."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, k = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for j in reversed(range(len(levels))):  # ranks of level j tell 2^j symbols
        inside = np.flatnonzero(np.maximum(a, b) + common < n)
        common[inside[levels[j][a[inside] + common[inside]] == levels[j][b[inside] + common[inside]]]] += 1 << j
    return order, rank, np.concatenate([[0], common])


def smaller_children(common: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each inner node up to some depth, all children but the largest: (first, last, depth, node's first, node's last).

    A node is the range of suffixes, in order, that have its string in common; so are its children.
    """
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [0])]  # depth, first suffix, where each child begins
    for i, depth in enumerate([*common[1:].tolist(), -1], 1):
        begins = i - 1
        while stack and depth < stack[-1][0]:
            at, begins, parts = stack.pop()
            if at <= most:
                parts.append(i)
                sizes = [parts[k + 1] - parts[k] for k in range(len(parts) - 1)]
                largest = sizes.index(max(sizes))
                found += [(parts[k], parts[k + 1] - 1, at, begins, i - 1) for k in range(len(sizes)) if k != largest]
        if depth < 0:
            break
        if stack and depth == stack[-1][0]:
            stack[-1][2].append(i)
        else:
            stack.append((depth, begins, [begins, i]))
    return tuple(np.array(found, np.int64).reshape(-1, 5).T)


def branching_repeats(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the tandem repeats that branch, up to a period, whose first half comes once more right before them.

    s must end with a symbol that it has nowhere else.
    """
    order, rank, common = suffix_order(s)
    first, last, depth, low, high = smaller_children(common, most)
    sizes = last - first + 1
    leaf = order[ragged(first, sizes)]
    d, low, high = (np.repeat(x, sizes) for x in (depth, low, high))
    starts, periods = [], []
    for start in (leaf, leaf - d):  # the leaf is the first or the second half
        ok = (d > 0) & (start - d >= 0) & (start + 2 * d < len(s))
        at, q, lo, hi = start[ok], d[ok], low[ok], high[ok]
        other = rank[np.where(start is leaf, at + q, at)]
        ok = (other >= lo) & (other <= hi) & (s[at + q] != s[at + 2 * q])
        at, q, lo, hi = at[ok], q[ok], lo[ok], hi[ok]
        before = rank[at - q]
        ok = (before >= lo) & (before <= hi)
        starts.append(at[ok])
        periods.append(q[ok])
    return np.concatenate(starts), np.concatenate(periods)


def rotated(s: np.ndarray, start: int, period: int, floor: int) -> int:
    """How far to the left of start, down to floor, a repeat of this period goes on."""
    step = 16
    while start > floor:
        low = max(floor, start - step)
        differ = np.flatnonzero(s[low:start] != s[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return start


def runs_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs in a sequence of word numbers, each within one of the stretches given."""
    size = gram_size(min_length, min_exponent)
    for _ in range(3):  # what comes twice in a text may come once in what is left
        long_enough = ends - starts >= min_length
        starts, ends = repeating_stretches(ids, starts[long_enough], ends[long_enough], size)
    long_enough = ends - starts >= min_length
    starts, ends = starts[long_enough], ends[long_enough]
    found: list[tuple[int, int, int]] = []
    sizes = ends - starts
    at = 0
    while at < len(starts):  # groups of stretches, each followed by a symbol of its own
        till = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_WORDS)) + at)
        low, n = starts[at:till], sizes[at:till]
        place = np.cumsum(n + 1) - n - 1
        s = np.empty(int((n + 1).sum()), np.int64)
        s[ragged(place, n)] = ids[ragged(low, n)]
        s[place + n] = int(ids.max()) + 1 + np.arange(len(n))
        repeats, periods = branching_repeats(s, int(n.max()) // min_exponent)
        order = np.lexsort((periods, repeats + 2 * periods))
        known: dict[int, int] = {}  # where runs of an end begin, by period
        last = -1
        for start, q in zip(repeats[order].tolist(), periods[order].tolist(), strict=True):
            end = start + 2 * q
            if end != last:
                known, last = {}, end
            if any(q % p == 0 and begin <= start - q for p, begin in known.items()):
                continue  # a multiple of that run's period: the same run
            part = int(np.searchsorted(place, start, side="right")) - 1
            known[q] = begin = rotated(s, start - q, q, int(place[part]))
            if end - begin >= max(min_length, min_exponent * q):
                shift = int(low[part] - place[part])
                found.append((begin + shift, end + shift, q))
        at = till
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, slice_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs by start and period, and its words joined by one blank, without
    those that a run repeats after its first period. min_exponent is 3 at least."""
    if min_exponent < 3 or min_length < min_exponent:
        raise ValueError("runs of less than three periods or words can't be asked for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                number: defaultdict[bytes, int] = defaultdict(count().__next__)
                split = [x.split() for x in part.column("text").cast(pa.binary()).to_pylist()]  # bytes: at those six characters
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
                ids = np.fromiter((i for x in split for i in map(number.__getitem__, x)), np.int64, int(bounds[-1]))
                del number
                runs: list[list[dict[str, int]]] = [[] for _ in split]
                drop = np.zeros(len(ids) + 1, np.int64)
                for begin, end, q in runs_of(ids, bounds[:-1], bounds[1:], min_length, min_exponent):
                    doc = int(np.searchsorted(bounds, begin, side="right")) - 1
                    runs[doc].append({"start": begin - int(bounds[doc]), "length": end - begin, "period": q})
                    drop[begin + q] += 1
                    drop[end] -= 1
                kept = np.cumsum(drop[:-1]) == 0
                texts = [b" ".join(x if not runs[k] else [w for w, keep in zip(x, kept[bounds[k] : bounds[k + 1]].tolist(), strict=True) if keep]).decode() for k, x in enumerate(split)]
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(runs, kinds), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RUNS)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of about a tenth of all ids, dealt by crc32, become periodic from some word on.

    Let h be the crc32 of the decimal id and g = h div 10. If h is divisible by 10 and the text has n > 0 words, each word
    i >= a becomes word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = id_and_text(docs).withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    marked = marked.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words").cast("long"))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return marked.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def digest_runs(found: DataFrame) -> DataFrame:
    """Of each text the number of runs, the run with the greatest length/period (ties: least start, then period), digests."""
    greater = "l.length * r.period > r.length * l.period OR (l.length * r.period = r.length * l.period AND (l.start < r.start OR (l.start = r.start AND l.period < r.period)))"
    best = F.expr(f"aggregate(runs, element_at(runs, 1), (l, r) -> CASE WHEN {greater} THEN l ELSE r END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (
        found.withColumn("best", F.when(F.size("runs") > 0, best))
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    )
