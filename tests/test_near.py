"""What is new in a scope, against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, embed, near


def loop(rows, least, ttl):
    """scope, at, key, v, t in order; the outcome of each."""
    out, kept = {}, {}
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6) if a and b and len(a) == len(b) and any(a) and any(b) else 0.0
    for scope, at, key, v, t in sorted(rows, key=lambda r: (r[0], r[1])):
        alive = [k for k in kept.get(scope, []) if ttl is None or t - k[2] < ttl]
        out[scope, at] = "exact" if any(k[0] == key for k in alive) else "near" if any(cos(k[1], v) >= least for k in alive) else "miss"
        if out[scope, at] == "miss":
            kept.setdefault(scope, []).append((key, v, t))
    return out


def rows_of(rnd, n):
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows, texts = [], []
    for _ in range(n):  # equal keys have equal vectors
        c = rnd.choice(centres)
        texts.append(rnd.choice([None, [0.0] * 6, [1.0, 2.0]]) if rnd.random() < 0.1 else [x + rnd.gauss(0, 0.25) for x in c])
    for at in range(n):
        k = rnd.randrange(n)
        rows.append((rnd.choice(["hot", "hot", "hot", "a", ""]), at, f"k{k}", texts[k], at * 10.0))
    return rows


SCHEMA = "scope string, at long, key string, v array<double>, t double"


@pytest.mark.parametrize("block", [7, 1000])
def test_keep_new(spark, block):
    rows = rows_of(random.Random(block), 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = loop(rows, 0.92, None)
    assert {(r.scope, r.at): r.kept for r in near.keep_new(df, block=block).collect()} == {k: v == "miss" for k, v in want.items()}
    assert {"exact", "near", "miss"} == set(want.values())
    timed = loop(rows, 0.92, 400.0)
    assert {(r.scope, r.at): r.kept for r in near.keep_new(df, ttl=400.0, block=block).collect()} == {k: v == "miss" for k, v in timed.items()} != {k: v == "miss" for k, v in want.items()}


def test_cache_outcomes(spark):
    rows = rows_of(random.Random(3), 200)
    found = near.cache_outcomes(spark.createDataFrame(rows, SCHEMA), ttl=300.0).collect()
    assert {(r.scope, r.at): r.outcome for r in found} == loop(rows, 0.92, 300.0)
    assert near.cache_outcomes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors_make_no_pairs(spark):
    """A thousand equal vectors are one; no pair of them is made."""
    rows = [(i, [1.0, 0.0, 1.0]) for i in range(1000)] + [(2000, [1.0, 0.01, 1.0]), (2001, [1.0, 0.0]), (None, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.a, r.b) for r in dedup.similar_pairs(df, 3, 0.95, block=50).collect()] == [(0, 2000)]
    assert dedup.representatives(df, 3).filter("rep = 0").count() == 1000


def test_pair_vectors(spark):
    df = spark.createDataFrame([(0, "a b c a b"), (1, "A  b\nc a b"), (2, "x"), (3, None), (4, "p q r s t")], "id long, text string")
    found = {r.id: r.v for r in embed.pair_vectors(df, "id", "text").collect()}
    assert found.keys() == {0, 1, 4} and found[0] == found[1] and len(found[4]) == 256 and sum(map(abs, found[0])) <= 4
    assert embed.pair_vectors(df.filter(F.col("id") > 9), "id", "text").count() == 0


def test_vectors_of_several_lengths(spark):
    """Odd vectors neither stop a search nor are hits."""
    from quern.operators import search

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [2.0]), (-3, [1.0, 2.0, 3.0]), (-4, None)], "query_id long, q array<double>")
    found = [(r.query_id, r.vec_id, r.score) for r in search.vector_search(asked, df, 3).orderBy("query_id", "rank").collect()]
    assert found == [(-2, 4, 1.0), (-1, 0, 1.0), (-1, 1, round(1 / 1.01**0.5, 6)), (-1, 2, 0.0)]


def test_chains_and_small_blocks(spark, monkeypatch):
    """A chain as long as the table is decided in a look for each block, not one for each link; no vector is copied for a cell."""
    rows = [("a", i, f"k{i}", [float(np.cos(i * 0.3)), float(np.sin(i * 0.3))], i * 10.0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    looks = []
    real = near.blocks_of
    monkeypatch.setattr(near, "blocks_of", lambda r, b: looks.append(1) or real(r, b))
    want = loop(rows, 0.92, None)
    assert {(r.scope, r.at): r.kept for r in near.keep_new(df, block=40).collect()} == {k: v == "miss" for k, v in want.items()}
    assert len(looks) <= 6
    timed = loop(rows, 0.92, 35.0)
    assert {(r.scope, r.at): r.kept for r in near.keep_new(df, ttl=35.0, block=40).collect()} == {k: v == "miss" for k, v in timed.items()} != {k: v == "miss" for k, v in want.items()}


def test_null_keys_are_equal_to_none(spark):
    df = spark.createDataFrame([("a", i, None, None, 0.0) for i in range(3)], SCHEMA)
    assert {r.kept for r in near.keep_new(df).collect()} == {r.kept for r in near.keep_new(df, ttl=9.0).collect()} == {True}


def test_projections_lose_no_pair(spark):
    """Long vectors, dense and with a few large components, against brute force."""
    rnd = np.random.default_rng(5)
    base = [rnd.integers(-1, 2, 256).astype(float) for _ in range(20)] + [np.eye(256)[k] * 40 for k in range(3)]
    rows = [(i, (base[i % 23] * (1 + i % 2) + rnd.integers(-1, 2, 256) * (rnd.random(256) < 0.06)).tolist()) for i in range(230)]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cos = np.round(unit @ unit.T, 6)
    want = {(a, b) for a in range(230) for b in range(a + 1, 230) if cos[a, b] >= 0.92}
    found = dedup.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 256, 0.92, block=50).collect()
    assert {(r.a, r.b) for r in found} == want and len(want) > 100


def test_pair_vectors_shuffle_nothing(spark):
    """Rows are counted where they are, and columns that are kept come along, so no join brings them back."""
    df = spark.createDataFrame([(1, "a b c", "s1"), (2, "p Q\n p  q ", None), (3, " x ", "s3")], "id long, text string, source string")
    found = embed.pair_vectors(df, "id", "text", keep=("source",))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.id: r for r in found.collect()}
    assert rows.keys() == {1, 2} and rows[1].source == "s1" and rows[2].source is None
    assert sorted(set(rows[2].v)) in ([-2.0, 0.0, 1.0], [-1.0, 0.0, 2.0], [0.0, 1.0, 2.0], [-2.0, -1.0, 0.0], [-3.0, 0.0], [0.0, 3.0], [-1.0, 0.0], [0.0, 1.0])


def test_tiles_lose_no_pair(monkeypatch):
    """Pairs of tiles of odd sizes are those of the whole product, in order; keys are met as in a loop."""
    from quern.operators import cells

    monkeypatch.setattr(cells, "TILE", (8, 24))
    rnd = np.random.default_rng(3)
    for n, m in ((1, 1), (7, 25), (33, 50), (0, 5), (5, 0)):
        one, two = rnd.standard_normal((n, 4)).astype(np.float32), rnd.standard_normal((m, 4)).astype(np.float32)
        want = [(i, j) for i in range(n) for j in range(m) if np.float32(one[i] @ two[j]) >= 1.5]
        i, j = cells.reaching(one, two, 1.5)
        assert list(zip(i.tolist(), j.tolist())) == want
        a, b = rnd.integers(-3, 9, n), rnd.integers(-3, 9, m)
        keys = {(i, j) for i in range(n) for j in range(m) if a[i] == b[j]}
        i, j = cells.united(cells.reaching(one, two, 1.5), cells.equal_keys(a, b), m)
        assert list(zip(i.tolist(), j.tolist())) == sorted(keys | set(want))


def test_repeated_ids_and_digests(spark):
    """Of an id that is there twice the vector counts that it stands for; nulls are no zeros; no vector meets another before its block."""
    rows = [(3, [1.0, 0.0, 1.0]), (5, [1.0, 0.0, 1.0]), (5, [1.0, 0.1, 1.0]), (7, [0.0, 2.0, 0.0]), (8, [0.0, 2.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.id, r.rep) for r in dedup.representatives(df, 3).collect()} == {(3, 3), (5, 3), (5, 5), (7, 7), (8, 8)}
    assert [(r.a, r.b) for r in dedup.similar_pairs(df.filter("vec_id < 8"), 3, 0.95).collect()] == [(3, 5)]
