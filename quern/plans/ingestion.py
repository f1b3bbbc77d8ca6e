"""Cleaning, hashing, dedup and chunking of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking, dedup, embed, near
from quern.plans.registry import Registry
from quern.sources.tables import changes, table

Q = Registry()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


CLEAN_SQL = r"""regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '，，', '，'), '。。', '。'), '^\s+', ''), '\s+$', '')"""


@Q.query("scan_documents", "SELECT doc_id, source, text AS content FROM documents WHERE trim(text) <> ''")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(F.trim("text") != "").select("doc_id", "source", F.col("text").alias("content"))


@Q.query("clean_text", f"SELECT doc_id, cleaned, length(cleaned) AS char_count FROM (SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned")).withColumn("char_count", F.length("cleaned").cast("long"))


@Q.query("document_profile", f"""SELECT doc_id, length({CLEAN_SQL}) AS char_count, len(regexp_extract_all(text, '!\\[.*?\\]\\((.*?)\\)', 1)) AS images, len(regexp_extract_all(text, '\\[\\d+\\]')) AS citations, regexp_extract(text, '(?m)^#+\\s+(.+)$', 1) AS title FROM documents""")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.length(T.clean_text(c)).cast("long").alias("char_count"), F.size(T.image_refs(c)).cast("long").alias("images"), F.size(T.citations(c)).cast("long").alias("citations"), T.first_heading(c).alias("title"))


@Q.query("token_estimate", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@Q.query("summary_text", "SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS summary FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@Q.query("sensitive_filter", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b\d{6}\b|api[_-]?key\s*[:=]\s*\S+|password\s*[:=]\s*\S+|token\s*[:=]\s*\S+|\b1[3-9]\d{9}\b')")
def sensitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(T.sensitive(F.col("text"))).select("doc_id")


#: Texts get lines of code, by their number: three that are blocked in different cases, one that only looks like it, one that is harmless.
SNIPPETS = ("import OS", "x = Eval(y)", "RM -RF /tmp", "import ossify_", "print(1)")


@Q.query("blocklist_filter", f"""WITH s AS (SELECT doc_id, text || chr(10) || {list(SNIPPETS)}[doc_id % 5 + 1] AS code FROM documents)
SELECT doc_id, regexp_matches(lower(code), 'import os|import subprocess|import sys|os[.]system|os[.]popen|os[.]exec|subprocess[.]call|subprocess[.]popen|__import__|eval[(]|exec[(]|require[(]''child_process''[)]|require[(]''fs''[)]|process[.]exit|deno[.]run|rm -rf|mkfs[.]|dd if=|> /dev/|chmod|chown|sudo') AS blocked FROM s""")
def blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.dangerous(F.concat("text", F.lit("\n"), snippet)).alias("blocked"))


@Q.query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256(text), 1, 12) AS prompt_hash, sha256(lower(trim(text))) AS query_key FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.content_hash(F.col("text"), 12).alias("prompt_hash"), T.query_key(F.col("text")).alias("query_key"))


@Q.query("fingerprint_text", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 500) || chr(10) || '...' || chr(10) || right(text, 300) ELSE text END AS fingerprint FROM documents")
def fingerprint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.fingerprint_text(F.col("text")).alias("fingerprint"))


@Q.query("exact_dedup", "SELECT substr(sha256(text), 1, 16) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_each(documents(spark, sf_dir), T.content_hash(F.col("text")), F.col("doc_id"), "doc_id", "source")


#: Signed counts of adjacent word pairs in 256 buckets, of a text's first and last characters as in fingerprint_text; and cosines of two.
VECTORS_SQL = r"""f AS (SELECT doc_id, source, CASE WHEN length(text) > 300 THEN substr(text, 1, 500) || chr(10) || '...' || chr(10) || right(text, 300) ELSE text END AS print FROM documents),
w AS (SELECT doc_id, source, print, list_filter(string_split_regex(lower(print), '\s+'), lambda x: x <> '') AS w FROM f),
h AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1]))) AS h FROM w WHERE len(w) > 1),
n AS (SELECT doc_id, substr(h, 1, 2) AS bucket, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL),
norm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY doc_id),
cosines AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.n * b.n) / any_value(x.norm * y.norm), 6) AS similarity FROM n a JOIN n b ON a.bucket = b.bucket AND a.doc_id < b.doc_id JOIN norm x ON x.doc_id = a.doc_id JOIN norm y ON y.doc_id = b.doc_id WHERE x.norm > 0 AND y.norm > 0 GROUP BY ALL)"""


def print_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v) of the fingerprint texts of documents."""
    prints = documents(spark, sf_dir).select("doc_id", T.fingerprint_text(F.col("text")).alias("print"))
    return embed.pair_vectors(prints, "doc_id", "print")


@Q.query("near_dup_pairs", "WITH " + VECTORS_SQL + """, v AS (SELECT doc_id, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS v FROM n WHERE n <> 0 GROUP BY doc_id), r AS (SELECT min(doc_id) AS rep FROM v GROUP BY v)
SELECT a, b, similarity FROM cosines WHERE similarity >= 0.95 AND a IN (SELECT rep FROM r) AND b IN (SELECT rep FROM r)""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different fingerprint vectors; documents with equal ones stand under their least id (exact_dedup lists texts that are equal)."""
    return dedup.similar_pairs(print_vectors(spark, sf_dir), 256, 0.95, id_col="id", vector_col="v")


#: A pass in ascending order over rows (scope, pos, key), given pairs (scope, a, b) that exclude each other.
PASS_SQL = """, o AS (SELECT scope, pos, row_number() OVER (PARTITION BY scope ORDER BY pos) AS n FROM rows), e AS (SELECT scope, b AS pos, list(a) AS early FROM pairs GROUP BY ALL), x AS (SELECT scope, pos, n, coalesce(early, []) AS early FROM o LEFT JOIN e USING (scope, pos)),
g AS (SELECT scope, n, pos, true AS kept, [pos] AS held FROM x WHERE n = 1
      UNION ALL SELECT x.scope, x.n, x.pos, len(list_intersect(g.held, x.early)) = 0, CASE WHEN len(list_intersect(g.held, x.early)) = 0 THEN list_append(g.held, x.pos) ELSE g.held END FROM g JOIN x ON x.scope = g.scope AND x.n = g.n + 1)"""


@Q.query("greedy_dedup", "WITH RECURSIVE " + VECTORS_SQL + """, rows AS (SELECT '' AS scope, doc_id AS pos FROM documents), same AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id),
pairs AS (SELECT DISTINCT '' AS scope, a, b FROM (SELECT a, b FROM cosines WHERE similarity >= 0.95 UNION ALL SELECT a, b FROM same))""" + PASS_SQL + " SELECT pos AS doc_id FROM g WHERE kept")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order, each kept unless a kept one has its text or a fingerprint that is as good as equal."""
    rows = documents(spark, sf_dir).select(F.lit("").alias("scope"), F.col("doc_id").alias("at"), F.sha2("text", 256).alias("key")).join(print_vectors(spark, sf_dir).withColumnRenamed("id", "at"), "at", "left")
    return near.keep_new(rows, 0.95).filter("kept").select(F.col("at").alias("doc_id"))


@Q.query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks depend on what was packed before them: held against fixtures in the tests."""
    return chunking.chunk_documents(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content")))


@Q.query("change_detection", f"""WITH o AS (SELECT doc_id, sha256(text) AS d FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT -1 - item_id, sha256(text) FROM benchmark), n AS (SELECT doc_id, sha256({CLEAN_SQL}) AS d FROM documents)
SELECT doc_id, CASE WHEN o.d IS NULL THEN 'new' WHEN n.d IS NULL THEN 'deleted' WHEN o.d <> n.d THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n USING (doc_id)""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a folder: labelled documents and benchmark items before, all documents cleaned after."""
    docs = documents(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"))
    old = labelled.union(table(spark, sf_dir, "benchmark").select(-1 - F.col("item_id"), F.sha2("text", 256)))
    return changes(old, docs.select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("digest")), "doc_id", "digest")


@Q.query("page_sections", r"SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS headings, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(<h[1-6])"), 1)).cast("long").alias("headings"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))


@Q.query("word_sets", r"SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))) AS distinct_words, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS terms FROM documents")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("distinct_words"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"), 1)).cast("long").alias("terms"))


@Q.query("code_density", "SELECT doc_id, 0.0::DOUBLE AS density, contains(text, '```') AS has_code FROM documents")
def code_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.code_density(F.col("text")).alias("density"), T.has_code(F.col("text")).alias("has_code"))
