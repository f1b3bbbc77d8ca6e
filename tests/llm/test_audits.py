"""Periodic runs, the filter audit and the URL filter: brute force, SQL, odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import filteraudit, queries, runs, urlfilter


def brute_runs(words, min_length=24, min_exponent=3):
    """Every stretch of equal words q apart, for each q, and the least q of those with the same bounds."""
    best = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e, q) for (b, e), q in best.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(words):
    found = brute_runs(words)
    best = min(found, key=lambda r: (Fraction(r[0] - r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for b, e, q in found for i in range(b + q, e)}
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_of_random_words():
    rnd, total = random.Random(1), 0
    for _ in range(600):
        alphabet, docs = rnd.choice([1, 2, 3, 5, 50]), []
        for _ in range(rnd.randint(1, 4)):
            words = []
            while len(words) < rnd.randint(0, 150):
                if rnd.random() < 0.5:
                    words += [rnd.randrange(alphabet) for _ in range(rnd.randint(1, 30))]
                else:
                    more = [rnd.randrange(alphabet) for _ in range(rnd.randint(1, 12))] * rnd.randint(2, 9)
                    words += more[: rnd.randint(len(more) // 2, len(more))]
            docs.append(words)
        bounds = np.cumsum([0] + [len(x) for x in docs])
        ids = np.array([x for d in docs for x in d], np.int64)
        least = rnd.choice([(24, 3), (24, 3), (9, 3), (12, 4), (10, 3), (7, 5)])
        want = [(int(bounds[k]) + b, int(bounds[k]) + e, q) for k, d in enumerate(docs) for b, e, q in brute_runs(d, *least)]
        assert runs.runs_of(ids, bounds[:-1], bounds[1:], *least) == want
        total += len(want)
    assert total > 1000


def test_runs_over_group_bounds(monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", 100)
    docs = [list(range(k, k + 9)) * 5 + [999] for k in range(40)]
    bounds = np.cumsum([0] + [len(x) for x in docs])
    found = runs.runs_of(np.array(sum(docs, [])), bounds[:-1], bounds[1:], 24, 3)
    assert found == [(46 * k, 46 * k + 45, 9) for k in range(40)]


def test_long_periodic_texts_take_little_time():
    assert runs.runs_of(np.zeros(300_000, np.int64), np.array([0]), np.array([300_000]), 24, 3) == [(0, 300_000, 1)]
    ids = np.arange(300_000) % 70_001
    assert runs.runs_of(ids, np.array([0]), np.array([300_000]), 24, 3) == [(0, 300_000, 70_001)]


def test_runs_ask_for_three_periods(docs):
    with pytest.raises(ValueError):
        runs.find_runs(docs, 24, 2)


def test_op11_equals_brute_force(spark, sf_dir):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(rows)
    short = [r for r in rows if len(r.text or "") < 8000]
    assert sum(found[r.doc_id][0] > 0 for r in short) > 5
    for r in short:
        assert found[r.doc_id] == digest(planted(r.doc_id, words_of(r.text)))


def test_runs_of_odd_documents(docs, no_docs):
    want = sorted((str(r.doc_id), *digest(planted(r.doc_id, words_of(r.text)))) for r in docs.filter("length(text) < 10000 OR text IS NULL").collect())
    found = runs.digest_runs(runs.find_runs(runs.with_planted_runs(docs))).collect()
    assert len(found) == docs.count()
    got = [(str(r.doc_id), *tuple(r)[1:]) for r in found]
    assert all(w in got for w in want)
    long = next(r for r in found if r.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30_000, 1)
    assert runs.digest_runs(runs.find_runs(runs.with_planted_runs(no_docs))).count() == 0


def brute_audit(rows, names):
    """Walks through every order, document by document."""
    out, k = [], len(names)
    for part in sorted({r[0] for r in rows}):
        own, total = [r for r in rows if r[0] == part], {}
        steps = []
        for order in permutations(range(k)):
            left = own
            for step, i in enumerate(order, 1):
                gone = [r for r in left if r[1] >> i & 1]
                left = [r for r in left if not r[1] >> i & 1]
                total[i] = total.get(i, 0) + len(gone)
                fails = sum(r[1] >> i & 1 for r in own)
                steps.append((part, "".join(names[x] for x in order), step, len(left), len(gone), fails - len(gone), sum(r[1] == 1 << i for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), i))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return out


def test_audit_equals_a_walk_through_all_orders(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["", "x", "y"]), rnd.choice([0, rnd.randrange(32)]), rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(200)] + [("clean", 0, 1, 0)]
    found = filteraudit.audit_filters(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), "ABCDE")
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_audit(rows, "ABCDE"))
    three = [(p, m & 7, g, t) for p, m, g, t in rows]
    found = filteraudit.audit_filters(spark.createDataFrame(three, "part string, mask int, good int, toxic int"), "abc")
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_audit(three, "abc"))


def test_polynomial_is_exact_for_large_counts():
    counts = [3 * 10**17 + m for m in range(32)]
    polynomial = filteraudit.RemovalPolynomial(counts, 5)
    assert polynomial.corner(31) == sum(counts[1:]) and polynomial.corner(0) == 0
    assert sum(polynomial.shapley(i) for i in range(5)) == sum(counts[1:])
    assert polynomial.shapley(0) == sum(Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m & 1)


def test_failures_of_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = docs.filter("doc_id IS NULL OR doc_id IN (0, 1, 5, 6, 7)")
    found = filteraudit.document_failures(rows, labels).collect()
    # null text and '' are copies of each other; the row with id 5 comes twice and is no copy; 6 is one of it; 7 has one word
    want = [("", 1, 0, 0), ("s", 1, 0, 0), ("s", 1 + 16, 0, 0), ("s", 1, 1, 1), ("s", 1, 1, 1), ("s", 1 + 16, 0, 0), ("s", 2, 0, 0)]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert filteraudit.audit_documents(docs, labels).count() == 2 * 600
    assert filteraudit.audit_documents(no_docs, labels).count() == 0


def compare(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = queries.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) > 0 and sorted(map(repr, got)) == sorted(map(repr, want))
    return found


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_url_filter"])
def test_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name)


URLS = {
    "http://a.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
    "https://x.com/fr/?q": ("x.com", "/fr/", "com/fr/", "allow"),
    "https://x.com/de/a#b": ("x.com", "/de/a", "com/de/", "block"),
    "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
    "x://y.org?a/b": ("y.org", "", None, None),
    "a://b://c.org/d": ("b:", "//c.org/d", None, None),
    "no scheme.org/": ("", "", None, None),
    "://ÀB.org/Ü\n/x": ("Àb.org", "/Ü\n/x", "org/", "allow"),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "rule", "row", "gram", "score", "a", "v1")})


def test_rules(spark):
    found = {r.url: r for r in urlfilter.with_rules(pages_of(spark, URLS).select("page_id", "url")).collect()}
    for url, want in URLS.items():
        assert (found[url].host, found[url].path, found[url].rule, found[url].ruled) == want


def test_longest_rule_wins(spark):
    rules = (("org", "/", "block"), ("a.org", "/", "allow"), ("org", "/x/y/z", "allow"))
    found = urlfilter.with_rules(pages_of(spark, ["h://a.org/x/y/z", "h://b.org/x/y/z", "h://b.org/x"]).select("page_id", "url"), rules)
    assert [(r.rule, r.ruled) for r in found.orderBy("page_id").collect()] == [("org/x/y/z", "allow"), ("org/x/y/z", "allow"), ("org/", "block")]


def test_models_tell_classes_apart(spark):
    """Ruled URLs of two kinds of words; URLs that no rule fits are judged by their characters."""
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    good, bad = "abcdefg", "pqrstuvw"
    urls = [f"http://{word(good)}.org/{word(good)}" for _ in range(300)] + [f"http://{word(bad)}.com/de/{word(bad)}" for _ in range(300)]
    new = [f"http://{word(kind)}.net/{word(kind)}" for kind in (good, bad) for _ in range(100)]
    found = urlfilter.judge_urls(pages_of(spark, urls + new)).orderBy("page_id").collect()
    assert len(found) == 800 and all(r.verdict == "allow" for r in found[:300]) and all(r.verdict == "block" for r in found[300:600])
    assert sum(r.verdict == "allow" for r in found[600:700]) >= 95 and sum(r.verdict == "block" for r in found[700:]) >= 95


def test_odd_urls(spark, tmp_path):
    """Odd, repeated and very long URLs, in Spark and in SQL; without ruled URLs, and without any."""
    odd = [*URLS, "http://x.net/" + "ab/" * 3000, "http://x.com/fr/" + "🙂é" * 50] * 2 + [f"http://{k % 7}.{t}/{k}" for k in range(60) for t in ("org", "com/de", "net/en")]
    for name, urls in (("some", odd), ("plain", ["http://x.net/a", None, ""]), ("none", [])):
        at = str(tmp_path / name)
        pages_of(spark, urls).select("page_id", "url", "html").coalesce(1).write.parquet(f"{at}/pages.parquet")
        found = urlfilter.judge_urls(pages_of(spark, urls)).select("page_id", "host", "path", "rule", "verdict", "score", "limit")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet/*.parquet')")
        want = duck.sql(f'SELECT page_id, host, path, rule, verdict, score, "limit" FROM ({queries.oracle_sql()["op13_url_filter"]})').fetchall()
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want)) and len(want) == len(urls)
