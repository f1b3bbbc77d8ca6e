"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles (words in lower case), each labelled with how often it has occurred
before. A sketch takes the few labelled shingles with the least hash values and keeps them in the order of the text, so two
documents have a sketch in common if they share these shingles in this order. Documents with a common sketch are candidates;
a pair is linked if the best alignment of the two sequences, within the band that the threshold allows, matches L shingles
with L / (n + m - L) of 0.8 or more. Classes are the connected components of links.

Equal texts form a group first, and one of each group goes on. All pairs of a small bucket are verified. In a large bucket,
members are aligned first with one leader, the member that meets most others, in up to ROUNDS rounds; that only makes classes
few. Then every large bucket that still holds several classes is compared whole: its members are dealt into blocks of a
bounded size, by length, and each pair of blocks is a task's work of its own. A pair is left out only if both are of one class
by then, if they met in another open bucket, or if their lengths or the shingles that they share rule the threshold out.
So every pair with a common sketch ends in one class or was tested or ruled out, whatever the size of the bucket, and no group
is gathered in one task. That work grows with the square of the classes that stay in a bucket.

Null texts are classes of their own. Empty texts are equal texts. Texts under five words are one shingle. Rows with the same
id belong to one class, whatever their texts. Rows without an id take the class of their text, or none. An empty table gives
no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, Scratch, slices, tidy
from .components import components

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCHES, TAKEN, SMALL = 32, 5, 16
#: Rounds of leaders; members of a large bucket in a block, and the shingles that these have together.
ROUNDS, BLOCK, WEIGHT = 2, 128, 1 << 16


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; forgets all when it is large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence(text: str, hashes: WordHashes, k: int) -> np.ndarray:
    """Hashes of the shingles of k words, in the order of the text."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        out = mixed(out * MIX + h[j : j + n])
    return out


def occurrences(h: np.ndarray) -> np.ndarray:
    """h with each value changed by how often it has occurred before; first occurrences stay."""
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])[: len(h)]
    if first.all():
        return h
    place = np.arange(len(h))
    seen = np.empty(len(h), np.uint64)
    seen[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return np.where(seen > 0, mixed(h + seen * MIX), h)


def labelled(text: str, hashes: WordHashes, k: int) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of k words, in the order of the text."""
    return occurrences(sequence(text, hashes, k))


def ordered_key(picked: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row of picked, in its order."""
    key = np.full(picked.shape[:-1], np.uint64(salt))
    for j in range(picked.shape[-1]):
        key = mixed(key * MIX + picked[..., j])
    return key


def sketches(h: np.ndarray, seeds: np.ndarray, taken: int) -> np.ndarray:
    """A key per seed: the taken least shingles by the seed's hash, in the order of the text.

    In short texts one shingle more or less changes most sketches, so theirs are joined by keys of the whole sequence and of
    the sequence without each one of its shingles.
    """
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    out = []
    if n <= 2 * taken + 2:
        out.append(ordered_key(h[None, :], 1))
        if n >= taken - 1:
            out.append(ordered_key(np.stack([np.delete(h, i) for i in range(n)]), 1))
        if n <= taken:
            return np.concatenate(out)
    step = max(1, (1 << 20) // n)
    for s in range(0, len(seeds), step):
        values = (h[None, :] ^ seeds[s : s + step, None]) * (seeds[s : s + step, None] | np.uint64(1))
        least = np.sort(np.argpartition(values, taken, axis=1)[:, :taken], axis=1)
        out.append(ordered_key(h[least], 0) + np.arange(s, s + len(least), dtype=np.uint64) * MIX)
    return np.concatenate(out)


def shingles(text: str, k: int) -> list[str]:
    words = WORD.findall(text.lower())
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def banded_matches(a: list, b: list, width: int) -> int:
    """The longest common subsequence of a and b whose matched places differ by width at most, by bit-parallel rows.

    Bit i of the row stands for place j - width + i of a; a zero bit means that one more match ends there.
    """
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    window = (1 << (2 * width + 1)) - 1
    row, top, found = window, 1 << (2 * width), 0
    for j, x in enumerate(b):
        own = places.get(x)
        if own:
            matches, low = 0, j - width
            for i in own[bisect_left(own, low) :]:
                if i > j + width:
                    break
                matches |= 1 << (i - low)
            u = row & matches
            row = ((row + u) | (row - u)) & window
        found += not row & 1
        row = row >> 1 | top
    return found + (row ^ window).bit_count()


def similarity(a, b, least: float) -> float:
    """L / (n + m - L) for the alignment of the sequences a and b; 0 if it can't reach least."""
    a, b = np.asarray(a), np.asarray(b)
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least) - 1e-9
    rest = min(n, m)
    if not rest or rest < need:
        return 0.0
    apart = np.flatnonzero(a[:rest] != b[:rest])
    k = int(apart[0]) if len(apart) else rest
    rest -= k
    apart = np.flatnonzero(a[n - rest :] != b[m - rest :])
    e = rest - 1 - int(apart[-1]) if len(apart) else rest
    left, right = a[k : n - e].tolist(), b[k : m - e].tolist()
    if k + e + (Counter(left) & Counter(right)).total() < need:
        return 0.0
    found = k + e + banded_matches(left, right, max(0, int(n + m - 2 * need)))
    return found / (n + m - found)


def sketch_documents(docs: DataFrame, k: int, count: int, taken: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the text or null, number of shingles, sketch keys)."""
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * MIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for text in part.column("text").to_pylist():
                    if text is None:
                        rows.append((None, 0, []))
                        continue
                    h = labelled(text, hashes, k)
                    rows.append((hashlib.md5(text.encode("utf-8", "replace")).digest(), len(h), sketches(h, seeds, taken).view(np.int64)))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "digest", "n", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, digest binary, n int, keys array<long>")


def sequences(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, seq): the hashes of each text's shingles, 8 bytes each, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                held = [sequence(t, hashes, k) for t in part.column("text").to_pylist()]
                columns = [part.column("id"), pa.array([len(x) for x in held], pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "seq"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, n int, seq binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sequences are similar. Many b may meet one a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("seq").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("seq").alias("sb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def small_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets whose lengths allow the similarity."""
    held = members.groupBy("key").agg(F.collect_list(F.struct("id", "n")).alias("held"))
    able = f"x.id < y.id AND least(x.n, y.n) >= greatest(x.n, y.n) * {least}D - 1e-9D"
    pairs = F.expr(f"flatten(transform(held, x -> transform(filter(held, y -> {able}), y -> struct(x.id AS a, y.id AS b))))")
    return held.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def first_stars(large: DataFrame) -> DataFrame:
    """(a, b): each member b of a large bucket with the leader a of the largest bucket that it is in.

    The leader meets most others in all its buckets: an original meets all its copies more often than these meet each other.
    """
    leaders = large.groupBy(F.col("best").alias("key")).agg(F.max_by("id", F.struct("met", "id")).alias("a"))
    return large.select(F.col("best").alias("key"), F.col("id").alias("b")).join(leaders, "key").filter("a <> b").select("a", "b")


def next_stars(large: DataFrame) -> DataFrame:
    """(a, b): each member b of an open bucket with that bucket's next leader a, if they are of different classes; one a each."""
    rows = large.select("id", "met", "label", "led", F.explode("keys").alias("key"))
    leader = F.max_by(F.struct("id", "label", "led"), F.struct(~F.col("led"), "met", "id")).alias("leader")
    held = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), leader)
    still = held.filter("low < high AND NOT leader.led").select("key", "size", F.col("leader.id").alias("a"), F.col("leader.label").alias("own"))
    meets = rows.select("key", "id", "label").join(still, "key").filter("label <> own")
    return meets.groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct("size", "key")).alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, count: int = SKETCHES, taken: int = TAKEN, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of each document; class_id is the least doc_id of its class."""
    with Scratch(docs.sparkSession, "near") as scratch:
        base = checkpointed(sketch_documents(docs, k, count, taken, id_col, text_col), "sketches")
        groups = base.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")).filter("rep IS NOT NULL")
        reps = groups.select("digest", "rep")
        buckets = groups.filter("n > 0").select(F.explode("keys").alias("key"), F.col("rep").alias("id"), "n")
        shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        members = scratch.keep(buckets.join(shared, "key"), "members")
        by_id = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("digest").alias("texts"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        repeated = scratch.keep(by_id.filter("rows > 1"), "repeated")
        ids_twice = not repeated.isEmpty()

        ids = members.select("id").distinct()
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi").filter("text IS NOT NULL")
        if ids_twice:
            texts = texts.dropDuplicates(["id", "text"])
        texts = scratch.keep(sequences(texts, k), "sequences")
        links = scratch.keep(verified(small_pairs(members.filter(F.col("size") <= small), least), texts, least), "links")

        several = F.col("low") < F.col("high")
        mixed_ids = repeated.filter(several | (F.col("texts").between(F.lit(1), F.col("rows") - 1))).select("doc_id") if ids_twice else None
        if ids_twice:  # rows of one id are of one class, whatever their texts
            own = scratch.keep(base.select("doc_id", "digest").join(mixed_ids, "doc_id").join(reps, "digest").select("doc_id", "rep").distinct(), "own")
            first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
            links = scratch.keep(links.union(own.join(first, "doc_id").select("a", F.col("rep").alias("b"))), "links")

        of_large = members.filter(F.col("size") > small).groupBy("id").agg(F.sum("size").alias("met"), F.max_by("key", F.struct("size", "key")).alias("best"), F.collect_set("key").alias("keys"))
        large = scratch.keep(of_large.withColumns({"led": F.lit(False)}), "large")
        some, labels, later = not large.isEmpty(), None, None
        for turn in range(ROUNDS if some else 0):
            stars = scratch.keep(first_stars(large) if not turn else next_stars(large), "stars")
            more = scratch.keep(verified(stars, texts, least), "links")
            if not turn:
                labels = components(links.union(more))
                large = scratch.keep(marked(large, labels, stars, None), "large")
            elif more.isEmpty():
                break
            else:
                later = scratch.keep(between(more, large, later), "later")
                large = scratch.keep(marked(large, labels, stars, components(later)), "large")
        labels = labels if some else components(links)
        if some:
            later = between(scratch.keep(block_links(large, texts, least, scratch), "links"), large, later)
        roots = components(later).select(F.col("id").alias("label"), F.col("label").alias("root")) if some else None

        def classed(reps: DataFrame) -> DataFrame:
            out = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            return out.join(roots, "label", "left").withColumn("class_id", F.coalesce("root", "label")) if some else out.withColumn("class_id", F.col("label"))

        classes = checkpointed(classed(reps).select("digest", "class_id"), "classes")
        other = checkpointed(classed(own).groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "others") if ids_twice else None

    named = base.filter("digest IS NOT NULL").select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", "class_id")
    blank = base.filter("digest IS NULL").select("doc_id")
    blank = blank.join(other, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")) if ids_twice else blank.select("doc_id", F.col("doc_id").alias("class_id"))
    return named.union(blank)


def marked(large: DataFrame, labels: DataFrame, stars: DataFrame, roots: DataFrame | None) -> DataFrame:
    """large with each member's class: base by the first links, label by those that came later; and whether it has led."""
    led = stars.select(F.col("a").alias("id"), F.lit(True).alias("now")).distinct()
    rows = large.select("id", "met", "keys", "led").join(labels, "id", "left").join(led, "id", "left")
    rows = rows.select("id", "met", "keys", (F.col("led") | F.coalesce("now", F.lit(False))).alias("led"), F.coalesce("label", "id").alias("base"))
    if roots is None:
        return rows.withColumn("label", F.col("base"))
    return rows.join(roots.select(F.col("id").alias("base"), "label"), "base", "left").withColumn("label", F.coalesce("label", "base"))


def between(links: DataFrame, large: DataFrame, others: DataFrame | None) -> DataFrame:
    """Links (a, b) of members of large as links of their first classes, together with others that are such."""
    ends = [large.select(F.col("id").alias(c), F.col("base").alias(f"base_{c}")) for c in ("a", "b")]
    found = links.join(ends[0], "a").join(ends[1], "b").select(F.col("base_a").alias("a"), F.col("base_b").alias("b"))
    return found if others is None else found.union(others)


def block_links(large: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): links that join all classes of the open large buckets (id, label, keys) that are near each other.

    A bucket's members are dealt into blocks by length, a class of many members into blocks of its own, and blocks meet in
    pairs. Lengths of two neighbouring ranges may be near, others can't, so only ranges with several classes in reach are open.
    Lengths are joined to members and keys to texts: only sequences are joined to a row for each member and bucket.
    """
    size = F.floor(F.log("n") / (np.log(1 / least) * 1.0001)).cast("int") if least < 1 else F.col("n")
    sized = large.select("id", "label", "keys").join(texts.select("id", "n"), "id").withColumn("range", size)
    rows = sized.select("id", "label", "n", "range", F.explode("keys").alias("key"))
    reach = Window.partitionBy("key").orderBy("range").rangeBetween(-1, 1)
    still = rows.groupBy("key", "range").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    still = still.select("key", "range", F.min("low").over(reach).alias("low"), F.max("high").over(reach).alias("high")).filter("low < high")
    held = scratch.keep(rows.join(still.select("key", "range"), ["key", "range"]), "open")
    if held.isEmpty():
        return held.select(F.col("id").alias("a"), F.col("id").alias("b"))
    keys = held.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    parts = held.groupBy("key", "range", "label").agg(F.count("*").alias("own"), F.sum("n").alias("own_weight"))
    sizes = parts.groupBy("key", "range").agg(F.sum("own").alias("all"), F.sum("own_weight").alias("all_weight"))

    def slot(what: str, n: str, weight: str):
        return F.pmod(F.xxhash64(what), F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(weight) / WEIGHT)))

    alone = F.col("own") >= BLOCK
    block = F.struct("range", F.when(alone, F.col("label")).alias("only"), F.when(alone, slot("id", "own", "own_weight")).otherwise(slot("id", "all", "all_weight")).alias("slot"))
    dealt = scratch.keep(held.join(parts.join(sizes, ["key", "range"]), ["key", "range", "label"]).select("key", "id", "n", "label", block.alias("block")), "dealt")
    member = F.struct("id", "label", "seq", "keys")
    blocks = scratch.keep(dealt.join(texts.join(keys, "id"), ["id", "n"]).groupBy("key", "block").agg(F.collect_list(member).alias("rows")), "blocks")
    names = blocks.select("key", "block")
    near = "left <= right AND abs(left.range - right.range) <= 1 AND NOT (left.only <=> right.only AND left.only IS NOT NULL)"
    cells = names.withColumnRenamed("block", "left").join(names.withColumnRenamed("block", "right"), "key").filter(near)
    sides = [blocks.select("key", F.col("block").alias(c), F.col("rows").alias(r)) for c, r in (("left", "one"), ("right", "two"))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("key", "same", "one", "two")]
            found = [p for i in range(len(batch)) for p in cell_links(columns[0][i].as_py(), columns[1][i].as_py(), Block(columns[2][i].values), Block(columns[3][i].values), least)]
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    met = cells.join(sides[0], ["key", "left"]).join(sides[1], ["key", "right"]).select("key", (F.col("left") == F.col("right")).alias("same"), "one", "two")
    return met.mapInArrow(tidy(compare), "a long, b long").distinct()


class Block:
    """Members of a bucket: ids, classes, sequences of shingles, open buckets of each."""

    def __init__(self, rows: pa.StructArray):
        self.ids, self.labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        self.sequences = [np.frombuffer(x, np.uint64) for x in rows.field("seq").to_pylist()]
        self.sizes = np.fromiter(map(len, self.sequences), np.int64, len(rows))
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.shingles = np.concatenate([occurrences(x) for x in self.sequences])
        held = rows.field("keys")
        self.keys = held.flatten().to_numpy(zero_copy_only=False)
        self.key_row = np.repeat(np.arange(len(rows)), np.diff(held.offsets.to_numpy()))


def overlaps(one: Block, two: Block) -> np.ndarray:
    """How many labelled shingles each member of one shares with each of two."""
    common = np.intersect1d(one.shingles, two.shingles)
    out = np.zeros((len(one.ids), len(two.ids)), np.float32)
    held = []
    for block in (one, two):
        at = np.minimum(np.searchsorted(common, block.shingles), max(len(common) - 1, 0))
        there = common[at] == block.shingles if len(common) else np.zeros(len(at), bool)
        held.append((block.row[there], at[there], len(block.ids)))
    for first in range(0, len(common), 4096):
        marks = []
        for row, at, n in held:
            inside = (at >= first) & (at < first + 4096)
            mark = np.zeros((n, min(4096, len(common) - first)), np.float32)
            mark[row[inside], at[inside] - first] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def cell_links(key: int, same: bool, one: Block, two: Block, least: float) -> list[tuple[int, int]]:
    """Links between members of two blocks, enough to join all classes that are near each other there.

    Pairs that have an open bucket before this key in common are that bucket's.
    """
    share = overlaps(one, two)
    total = one.sizes[:, None] + two.sizes[None]
    able = (share >= least * total / (1 + least) - 1e-6) & (one.labels[:, None] != two.labels[None])
    if same:
        able &= np.triu(np.ones(able.shape, bool), 1)
    for before in np.intersect1d(one.keys, two.keys).tolist():
        if before >= key:
            break
        able[np.ix_(one.key_row[one.keys == before], two.key_row[two.keys == before])] = False
    left, right = np.nonzero(able)
    best = np.argsort(-share[left, right] / total[left, right], kind="stable")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for i, j in zip(left[best].tolist(), right[best].tolist(), strict=True):
        a, b = find(one.labels[i].item()), find(two.labels[j].item())
        if a != b and similarity(one.sequences[i], two.sequences[j], least) >= least:
            parent[max(a, b)] = min(a, b)
            found.append((one.ids[i].item(), two.ids[j].item()))
    return found


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, that of the least id; columns as they were. Rows without an id stay."""
    classes = near_duplicates(docs, **options)
    kept = classes.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    id_col = options.get("id_col", "doc_id")
    stay = docs.join(kept.withColumnRenamed("doc_id", id_col), id_col, "left_semi").dropDuplicates([id_col])
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))
