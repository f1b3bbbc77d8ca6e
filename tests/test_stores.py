"""Versioned tables and the keyword index: appends, rewrites, deletes, rollbacks, and searches against a plain loop."""

import math
import random

import pytest

from quern.operators import search
from quern.sources.keyword_index import KeywordIndex
from quern.sources.versions import VersionedTables


def test_versions(spark, tmp_path):
    store = VersionedTables(spark, f"file://{tmp_path}/s", {"state": "k string, v long"})
    assert store.version().number == 0 and store.read("state").count() == 0
    rows = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    first = store.replace(rows(1), "state", "first")
    held = store.read("state", first)
    store.replace(rows(2), "state")
    assert [r.v for r in store.read("state").collect()] == [2] and [r.v for r in held.collect()] == [1]
    back = store.rollback(first.number)
    assert back.number == 3 and [r.v for r in store.read("state").collect()] == [1]
    assert store.drop().number == 4 and store.read("state").count() == 0
    assert [r.note for r in store.history().orderBy("number").collect()] == ["first", "", "rollback to 1", "dropped"]
    with pytest.raises(KeyError):
        store.version(9)
    store.write(rows(5), "state")  # a writer that fails before its manifest
    assert store.version().number == 4 and store.read("state").count() == 0


def plain_search(chunks, query, k, boosts):
    """Every chunk in turn."""
    found = {}
    for field, boost in boosts.items():
        texts = {c: (t[field] or "").lower().split() for c, t in chunks.items() if t[field] is not None}
        mean = sum(map(len, texts.values())) / max(1, len(texts))
        for word in set(query.lower().split()):
            df = sum(word in w for w in texts.values())
            for c, w in texts.items():
                if word in w:
                    tf = w.count(word)
                    s = boost * math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    found.setdefault(c, {}).setdefault(field, 0.0)
                    found[c][field] += s
    best = sorted(((round(max(f.values()), 4), c) for c, f in found.items()), key=lambda x: (-x[0], x[1]))
    return [(c, s, i) for i, (s, c) in enumerate(best[:k], 1)]


@pytest.mark.parametrize("first_look", [1, 20, 5000])
def test_index_equals_a_plain_loop(spark, monkeypatch, first_look):
    monkeypatch.setattr(search, "FIRST_LOOK", first_look)
    rnd = random.Random(first_look)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(5000)]
    text = lambda most: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, most)))
    index, state = KeywordIndex(spark, fields=("content", "title"), kept=("source",)), {}

    def add(ids):
        batch = {i: {"content": None if i % 17 == 0 else text(60), "title": text(4), "source": f"s{i % 5}"} for i in ids}
        state.update(batch)
        index.append(spark.createDataFrame([(i, t["content"], t["title"], t["source"]) for i, t in batch.items()], "chunk_id long, content string, title string, source string"), 3)

    def check(k=6):
        asked = [(q, text(8)) for q in range(12)] + [(90, ""), (91, "nowhere"), (92, None)]
        found = index.search(spark.createDataFrame(asked, "query_id long, query string"), k, {"content": 2.0, "title": 1.0}).collect()
        for q, query in asked:
            got = sorted(((r.chunk_id, r.score, r.rank) for r in found if r.query_id == q), key=lambda r: r[2])
            want = plain_search(state, query or "", k, {"content": 2.0, "title": 1.0})
            assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-4)
            if all(abs(a[1] - b[1]) > 3e-4 for a, b in zip(want, want[1:], strict=False)):
                assert [g[0] for g in got][:-1] == [w[0] for w in want][:-1]

    add(range(100))
    check()
    add(range(60, 160))  # forty again
    index.delete("source", "s2")
    state = {i: t for i, t in state.items() if t["source"] != "s2"}
    check()
    add([2, 7])  # of the deleted source
    check()
    assert index.stats().first().docs == len(state) == index.chunks().count()
    index.compact(2)
    check()
    index.tables.rollback(1)
    assert index.stats().first().docs == 100


def test_index_odd_batches(spark):
    index = KeywordIndex(spark)
    nothing = spark.createDataFrame([], "query_id long, query string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert index.search(asked).count() == 0 and not index.stats().first().exists
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id long, content string, source string")
    for bad in (rows((1, "a", "s"), (1, "b", "s")), rows((None, "a", "s"))):
        with pytest.raises(ValueError):
            index.append(bad)
    assert index.tables.version().number == 0
    index.append(rows((1, "a b", "s"), (2, None, None), (3, "", "s")))
    assert index.search(nothing).count() == 0 and [r.chunk_id for r in index.search(asked).collect()] == [1]
    index.delete("source", "other")
    assert index.tables.version().number == 1  # nothing to delete
    index.delete("source", "s")
    assert index.search(asked).count() == 0 and index.stats().first().docs == 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, source string, embedding array<double>, tenant_id string")


def test_vector_store(spark, tmp_path):
    from quern.sources.vector_store import VectorStore

    root = f"file://{tmp_path}/vectors"
    store = VectorStore(spark, 2, root)
    assert not store.stats().first().exists and store.rows().count() == 0
    store.upsert(vectors(spark, [(1, "a", [1.0, 0.0], "t"), (2, "a", [0.0, 1.0], None), (3, "b", [1.0, 1.0], "t")]))
    store.upsert(vectors(spark, [(3, "b", [-1.0, 0.0], "u"), (4, "c", [0.9, 0.1], "t")]))  # 3 moves to another tenant
    asked = spark.createDataFrame([(-1, [1.0, 0.0])], "query_id long, q array<double>")
    found = lambda where=None, s=store: [r.vec_id for r in s.search(asked, 3, where).orderBy("rank").collect()]
    assert found() == [1, 4, 2] and found("t") == [1, 4] and found("u") == [3] and found("default") == [2]
    before = store.tables.version().number
    store.delete_by_source("a")
    assert found() == [4, 3] and store.stats().first().rows == 2
    store.delete_by_source("nowhere")
    assert store.tables.version().number == before + 1
    again = VectorStore(spark, 2, root)  # opened again
    assert found(s=again) == [4, 3]
    for bad in ([(5, "a", [1.0], "t")], [(5, "a", None, "t")], [(5, "a", [1.0, 2.0], "t"), (5, "b", [1.0, 2.0], "t")]):
        with pytest.raises(ValueError):
            again.upsert(vectors(spark, bad))
    with pytest.raises(ValueError):
        VectorStore(spark, 3, root)
    again.drop()
    assert not again.stats().first().exists
    again.tables.rollback(before)
    assert found(s=again) == [1, 4, 2]


def test_updates(spark):
    from pyspark.sql import functions as F

    from quern.sources.vector_store import DocumentStores, VectorStore

    chunk = lambda docs: docs.select(F.col("source").cast("long").alias("chunk_id"), "source", "content", F.lit("t").alias("tenant_id"))
    embed = lambda chunks: chunks.select(F.col("chunk_id").alias("id"), F.array(F.length("content").cast("double"), F.lit(1.0)).alias("v"))
    stores = DocumentStores(spark, KeywordIndex(spark), VectorStore(spark, 2), chunk, embed)
    docs = lambda texts: spark.createDataFrame(list(texts.items()), "source string, content string")
    texts = {str(i): f"word{i} common" for i in range(10)}
    assert list(stores.update(docs(texts)).values()) == ["full", 10, 0, 0, 0, 0, 10]
    assert list(stores.update(docs(texts)).values()) == ["none", 0, 0, 0, 10, 0, 0]
    texts |= {"0": "fresh common", "10": "word10"}
    del texts["1"]
    assert list(stores.update(docs(texts)).values()) == ["incremental", 1, 1, 1, 8, 2, 2]
    asked = spark.createDataFrame([(1, "fresh"), (2, "word0"), (3, "word1"), (4, "word10"), (5, "word5")], "query_id long, query string")
    assert {r.query_id: r.chunk_id for r in stores.index.search(asked).collect()} == {1: 0, 4: 10, 5: 5}
    assert sorted(r.vec_id for r in stores.vectors.rows().collect()) == [0, *range(2, 11)]
    changed = {k: v + " again" for k, v in texts.items()}
    assert stores.update(docs(changed))["mode"] == "full" and stores.index.stats().first().docs == 10
    assert stores.update(docs({})) == {"mode": "full", "new": 0, "changed": 0, "deleted": 10, "same": 0, "removed": 10, "added": 0}


def test_index_of_many_segments(spark, monkeypatch):
    """Nothing is shuffled to add chunks; segments, shards, blocks of words and of queries are put together right; compaction merges segments."""
    from quern.sources import keyword_index

    rnd = random.Random(11)
    text = lambda most: " ".join(f"W{int(rnd.paretovariate(0.6))}\u2003é" if rnd.random() < 0.3 else f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, most)))
    for name, value in (("SEGMENT_BYTES", 300), ("TERMS", 20), ("PACKED_BYTES", 80_000)):
        monkeypatch.setattr(keyword_index, name, value)
    index, state, plans = KeywordIndex(spark, fields=("content", "title")), {}, []
    write = index.tables.write
    monkeypatch.setattr(index.tables, "write", lambda df, name, *by: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name, *by))
    for ids in (range(0, 80), range(60, 120)):
        batch = {i: {"content": None if i % 9 == 0 else text(40), "title": text(3)} for i in ids}
        state |= batch
        index.append(spark.createDataFrame([(i, t["content"], t["title"], f"s{i % 5}") for i, t in batch.items()], "chunk_id long, content string, title string, source string"))
    assert len(plans) == 3 and all("Exchange" not in plan for name, plan in plans if name == "segments")
    index.delete("source", "s1")
    state = {i: t for i, t in state.items() if i % 5 != 1}
    asked = [(q, text(9).replace("\u2003", " ")) for q in range(15)] + [(99, "w3")]
    for pushed in (2000, 0):
        monkeypatch.setattr(keyword_index, "PUSHED_WORDS", pushed)
        found = index.search(spark.createDataFrame(asked, "query_id long, query string"), 200, {"content": 2.0, "title": 1.0}).collect()
        for q, query in asked:
            want = {c: s for c, s, _ in plain_search(state, query, 200, {"content": 2.0, "title": 1.0})}
            got = {r.chunk_id: r.score for r in found if r.query_id == q}
            assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 2e-4 for c in want)
    before = index.tables.read("segments").filter("shard = -1").count()
    index.compact()
    assert index.tables.read("segments").filter("shard = -1").count() < before / 2 and index.chunks().count() == len(state)
    again = index.search(spark.createDataFrame(asked, "query_id long, query string"), 200, {"content": 2.0, "title": 1.0}).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in again) == sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in found)
    source = index.search(spark.createDataFrame(asked, "query_id long, query string"), 200, where={"source": "s2"}).collect()
    assert source and {r.chunk_id % 5 for r in source} == {2}


def test_words_and_digests():
    """Words as Python has them, and MD5 of all lengths around a block's end."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from quern.operators import words

    lines = ["a  b\tc ", " ", "\u3000é\u00a0漢字\x85x\n ", "\x1cz ", "w" * 70 + " v "]
    data, starts, ends, counts = words.spans(pa.array(lines))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "é", "漢字", "x", "\x1cz", "w" * 70, "v"] and counts.tolist() == [3, 0, 3, 1, 2]
    assert words.words_of(pa.array(lines).slice(2, 2))[0].to_pylist() == ["é", "漢字", "x", "\x1cz"]
    texts = [bytes((7 * i + n) % 256 for i in range(n)) for n in range(130)]
    at = np.cumsum([0, *map(len, texts)])
    heads = words.md5_heads(np.frombuffer(b"".join(texts), np.uint8), at[:-1], at[1:])
    assert heads.tolist() == [int.from_bytes(hashlib.md5(t).digest()[:4], "little") for t in texts]


def test_marks_meet_segments(spark):
    """Vectors come back as they were written, and those that are marked as gone are left out without a join of vectors."""
    from quern.sources.vector_store import VectorStore

    rows = [(i, f"s{i % 3}", [float(i), -1.0, 0.0], "t") for i in range(5000)]
    odd = [(6000, "a", [0.5, 1e300, -0.0], None), (6001, None, [None, 40000.0, float("nan")], "u"), (6002, "b", [32766.0, -32766.0, float("inf")], "u")]
    store = VectorStore(spark, 3)
    store.upsert(vectors(spark, rows + odd))
    store.upsert(vectors(spark, [(7, "z", [9.0, 9.0, 9.0], "u")]))
    store.delete_by_source("s1")
    want = {r[0]: (r[1], str(r[2]), r[3] or "default") for r in rows + odd if r[1] != "s1"} | {7: ("z", str([9.0] * 3), "u")}
    found = store.rows()
    assert {r.vec_id: (r.source, str(r.embedding), r.tenant_id) for r in found.collect()} == want and store.stats().first().rows == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")


def test_lists_of_a_segment_s_first_chunks(spark):
    """Words that only the first 256 chunks of a longer segment hold, whose places take a byte."""
    index = KeywordIndex(spark)
    index.append(spark.createDataFrame([(i, f"w{i} both" if i < 9 else "rest", "s") for i in range(700)], "chunk_id long, content string, source string").coalesce(1))
    asked = spark.createDataFrame([(1, "w3"), (2, "both")], "query_id long, query string")
    want = [(1, 3)] + [(2, i) for i in range(9)]
    assert sorted((r.query_id, r.chunk_id) for r in index.search(asked).collect()) == want
    index.compact()
    assert sorted((r.query_id, r.chunk_id) for r in index.search(asked).collect()) == want
