"""Near duplicates, components and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components, graphann, neardup


def brute_classes(rows, least=0.8):
    """Class of each id: equal texts, and pairs whose alignment is similar."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    shingled = [(i, t, neardup.shingles(t, 5) if t is not None else []) for i, t in rows]
    for k, (i, t, s) in enumerate(shingled):
        for j, u, r in shingled[:k]:
            if t is not None and u is not None and (t == u or neardup.similarity(s, r, least) >= least):
                join(i, j)
    return {i: find(i) for i, _ in rows}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new" + str(rng.random())], [words[k], "more"]])
    return " ".join(words)


def test_classes_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        original = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        rows.append((i, " ".join(original)))
        for n in (0, 1, 2, 4, 30):
            i += 1
            rows.append((i, edited(original, n, rng)))
        i += 1
        rows.append((i, " ".join([*passage, *(rng.choice(vocabulary) for _ in range(80))])))
        i += 1
    rng.shuffle(rows)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)


def test_open_buckets_join_no_ids(spark, monkeypatch):
    """A member's length and keys are not joined again to its row of each open bucket; ranges without another class in reach are left out."""
    words = {1: 100, 2: 100, 3: 110, 4: 200}
    texts = neardup.sequences(spark.createDataFrame([(i, " ".join(f"p{j}" for j in range(n))) for i, n in words.items()], "id long, text string"), 5)
    large = spark.createDataFrame([(i, 1 if i < 3 else i, [7, 8]) for i in words], "id long, label long, keys array<long>")
    keep, seen = neardup.Scratch.keep, {}

    def watched(self, df, name):
        out = keep(self, df, name)
        seen[name] = out.count(), df._jdf.queryExecution().optimizedPlan().toString()
        return out

    monkeypatch.setattr(neardup.Scratch, "keep", watched)
    with neardup.Scratch(spark, "blocks") as scratch:
        found = {tuple(r) for r in neardup.block_links(large, texts, 0.8, scratch).collect()}
    assert found <= {(1, 3), (2, 3), (3, 1), (3, 2)} and len(found) == 1
    assert seen["open"][0] == 6 and "Join Inner, (id" not in seen["dealt"][1]


def test_large_bucket(spark):
    """An original with many copies that are less like each other than like it: more than a small bucket holds."""
    rng = random.Random(6)
    original = [f"w{rng.randrange(1000)}" for _ in range(200)]
    rows = [(k, edited(original, 4, rng)) for k in range(40)] + [(40, " ".join(original))]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()}
    assert found == brute_classes(rows)


def test_families_in_one_large_bucket(spark):
    """Two pairs of near copies among many documents that share a passage; the documents that meet most others are near none."""
    rng = random.Random(15)

    def other(n):
        return [f"x{rng.randrange(10**9)}" for _ in range(n)]

    passage = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join([*passage, *other(40)])) for i in range(60)]
    for first in (100, 200):
        own = [*passage, *other(40)]
        rows += [(first, " ".join(own)), (first + 1, " ".join([*own[:-16], *other(16)]))]
    seeds = neardup.mixed(np.arange(1, 4, dtype=np.uint64) * neardup.MIX)
    keys = {i: set(neardup.sketches(neardup.labelled(t, neardup.WordHashes(), 5), seeds, neardup.TAKEN).tolist()) for i, t in rows}
    for first in (100, 200):
        common = keys[first] & keys[first + 1]
        assert common and all(sum(key in held for held in keys.values()) > 16 for key in common)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), count=3).collect()}
    assert found == brute_classes(rows)
    assert found[101] == 100 and found[201] == 200


@pytest.mark.parametrize("block", [3, 128])
def test_blocks_link_all_classes(spark, monkeypatch, block):
    """The links of open large buckets join all classes that a common bucket holds and that are near each other, and no others."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    original = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(i, edited(original, 2 + i % 9, rng)) for i in range(60)]
    texts = neardup.sequences(spark.createDataFrame(rows, "id long, text string"), 5)
    keys = {i: [key for key, own in ((1, i < 40), (2, i % 2), (3, i >= 30)) if own] for i, _ in rows}
    label = {i: i % 3 if i < 24 else i for i, _ in rows}
    large = spark.createDataFrame([(i, label[i], keys[i]) for i, _ in rows if keys[i]], "id long, label long, keys array<long>")
    with neardup.Scratch(spark, "test") as scratch:
        got = [(r.a, r.b) for r in neardup.block_links(large, texts, 0.8, scratch).collect()]
    held = {i: neardup.shingles(t, 5) for i, t in rows}
    near = [(i, j) for i in held for j in held if i < j and set(keys[i]) & set(keys[j]) and neardup.similarity(held[i], held[j], 0.8) >= 0.8]
    assert {tuple(sorted(p)) for p in got} <= set(near)
    classes = []
    for links in (near, got):
        own = dict(label)
        for a, b in links:
            old, new = own[a], own[b]
            own = {i: new if c == old else c for i, c in own.items()}
        classes.append({frozenset(i for i in own if own[i] == c) for c in own.values()})
    assert near and classes[0] == classes[1] and len(classes[0]) < len(set(label.values()))


def test_shared_passage_near_the_threshold(spark):
    """80 documents share a licence; 10 pairs are just similar enough and all others just not. Defaults."""
    rng = random.Random(21)
    licence = [f"l{i}" for i in range(354)]
    rows = []
    for i in range(70):
        rows.append((i, " ".join([*licence, *(f"x{rng.randrange(10**9)}" for _ in range(46))])))
        if i < 10:
            own = rows[-1][1].split()
            rows.append((100 + i, " ".join([*own[:-39], *(f"y{rng.randrange(10**9)}" for _ in range(39))])))
    want = brute_classes(rows)
    assert len(set(want.values())) == 70
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_one_repeated_shingle(spark):
    """A document that repeats some words still meets its copy that doesn't."""
    rng = random.Random(22)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *words[:8]]))]
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1}


def test_repeated_ids(spark):
    """Rows of one id are of one class with all that any of them is near; null texts too."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (5, None), (8, None), (9, None), (9, None), (None, a), (None, "z"), (4, "q"), (4, "q")]
    found = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(found, key=key) == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (5, 3), (8, 8), (9, 9), (9, 9), (None, 3), (None, None), (4, 4), (4, 4)], key=key)


def test_short_texts(spark):
    rows = [(0, "a b c d e f g h i"), (1, "a b c d e f g h"), (2, "a b c d e f g h i j"), (3, "q r"), (4, "q r"), (5, "Q, R!"), (6, None), (7, None), (8, ""), (9, "")]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 8}


def test_odd_documents(docs, no_docs):
    found = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    assert len(found) == docs.count()
    assert dict(found)[6] == 5 and dict(found)[0] == 0
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for d, c in found if d is not None}) and ids.count(None) == 1


def brute_matches(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("seed", range(3))
def test_alignment(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "a"]]) or (["y"] if len(b) == 1 else [])
        n = brute_matches(a, b)
        assert neardup.banded_matches(a, b, 40) == n
        true, found = n / (len(a) + len(b) - n), neardup.similarity(a, b, 0.8)
        assert (true >= 0.8) == (found >= 0.8)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    found = {r.id: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}


def brute_nearest(rows, query, k=10):
    vectors = dict(rows)
    far = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[query])) ** 2).sum())), i) for i, v in rows if i != query)
    return far[:k]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # equal vectors
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 5), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(1))
    queries = df.filter("vec_id % 25 = 7 OR vec_id >= 2000")
    found: dict = {}
    for r in graphann.nearest_neighbours(df, queries).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    asked = {i for i, _ in rows if i % 25 == 7}
    assert found.keys() == asked
    hit = 0
    for query in asked:
        got, want = sorted(found[query]), brute_nearest(rows, query)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [(s, v) for _, s, v in got] == sorted((s, v) for _, s, v in got)
        vectors = dict(rows)
        for _, score, vec in got:
            assert score == pytest.approx(float(np.linalg.norm(np.array(vectors[vec]) - np.array(vectors[query]))), abs=1e-12)
        hit += len({v for _, _, v in got} & {v for _, v in want})
    assert hit / (10 * len(asked)) >= 0.9
    assert [v for _, _, v in sorted(found[7])] == [1000 + i for i in range(10)]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in graphann.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    one = df.filter("vec_id = 0")
    assert graphann.nearest_neighbours(one, one).count() == 0
    none = df.filter("vec_id < 0")
    assert graphann.nearest_neighbours(none, none).count() == 0


def recall(spark, points, asked):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in graphann.nearest_neighbours(df, df.filter(F.col("vec_id").isin(asked))).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    far = np.linalg.norm(points[asked][:, None].astype(np.float64) - points[None].astype(np.float64), axis=2)
    far[np.arange(len(asked)), asked] = np.inf
    nearest = np.argsort(far, axis=1, kind="stable")[:, :10]
    return sum(len(found[q] & set(own.tolist())) for q, own in zip(asked, nearest, strict=True)) / (10 * len(asked))


def test_cluster_of_near_copies(spark):
    """Vectors that differ by far less than their length keep their order."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.standard_normal(32) + 1e-4 * rng.standard_normal((1000, 32)), rng.standard_normal((200, 32))]).astype(np.float32)
    assert recall(spark, points, list(range(0, 1200, 30))) >= 0.9


def test_hub(spark):
    """A vector near the centre of points on a sphere is a neighbour of all; its group stays within two widths."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((1500, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[0] = 1e-3
    points = points.astype(np.float32)
    assert recall(spark, points, list(range(0, 1500, 50))) >= 0.9
    nodes = graphann.encode_nodes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, vector array<double>"), "<f4")
    with graphann.Scratch(spark, "hub") as scratch:
        state = graphann.build_graph(nodes, "<f4", 20, 2, 0.0, 2, 256, 6, scratch)
        assert state.filter(F.array_contains("ids", 0)).count() > 700
        heard = graphann.told(state, 20).groupBy("key").count()
        assert heard.agg(F.max("count")).first()[0] <= 40


def test_core_and_shell(spark):
    """All neighbours of the points on a far shell are hubs of a tight core, or too many to tell apart; no query goes empty."""
    rng = np.random.default_rng(6)
    core, shell = 1e-2 * rng.standard_normal((300, 64)), rng.standard_normal((1700, 64))
    points = np.concatenate([core, 10 * shell / np.linalg.norm(shell, axis=1)[:, None]]).astype(np.float32)
    asked = list(range(0, 2000, 100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    assert graphann.nearest_neighbours(df, df.filter(F.col("vec_id").isin(asked))).count() == 200
    assert recall(spark, points, asked) >= 0.9


def test_exact_way(spark):
    """Queries whose walk may not hold all that it wants, and lengths that few vectors have, are scanned."""
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((25, 5)) + 1e6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0")
    found: dict = {}
    for r in graphann.nearest_neighbours(df, queries, most=10, beam=5).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found.keys() == {i for i, _ in rows if i % 20 == 0}
    for query, got in found.items():
        same = [r for r in rows if (r[0] >= 1000) == (query >= 1000)]
        assert [v for _, v in sorted(got)] == [v for _, v in brute_nearest(same, query)]
