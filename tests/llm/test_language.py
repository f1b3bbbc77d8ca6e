"""Language identification: held-out accuracy and odd documents."""

import zlib

from quern.llm import langid
from quern.llm.queries import op2_language_id


def test_held_out_accuracy(spark, sf_dir):
    rows = op2_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert held and sum(held) / len(held) >= 0.95


def test_odd_documents(spark, docs, no_docs):
    profiles = langid.fit_profiles(docs, fit_rows=5)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(docs, profiles).collect()}
    assert found[0] == found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[5][0] == "en" and 0 < found[5][1] <= 1
    assert langid.predict_language(docs, profiles).count() == docs.count()
    assert langid.predict_language(no_docs, profiles).count() == 0
    nothing = langid.fit_profiles(no_docs)
    assert {r.lang_pred for r in langid.predict_language(docs, nothing).collect()} == {"und"}


def test_grams_by_brute_force():
    text = "Ab, cab!"
    points = " ab cab "
    want: dict = {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            gram = points[i : i + n]
            if gram != " " and not (n == 3 and gram[1] == " "):
                want[gram] = want.get(gram, 0) + 1
    codes, counts = langid.grams(text)
    text_of = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    assert {text_of(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == want


def test_distance_by_brute_force():
    profiles = langid.Profiles({"x": [1, 2, 3], "y": [3, 9, 8]}, 3)
    codes, counts = langid.grams("ab ab abc")
    own = langid.ranked(codes, counts, 3).tolist()
    by = {"x": own, "y": own[::-1]}
    assert langid.Profiles(by, 3).predict("ab ab abc") == ("x", 1.0)
    assert profiles.predict("!!")[0] == "und"


def test_filter_keeps_clean_documents(spark, docs, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = langid.fit_profiles(table)
    kept = langid.keep_identified(table, profiles, 0.15)
    assert kept.columns == table.columns and kept.count() == table.count()
    assert {0, 1, 2, 3}.isdisjoint({r.doc_id for r in langid.keep_identified(docs, profiles, 0.15).collect()})
