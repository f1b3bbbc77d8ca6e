"""Stores that stay: a keyword index, a collection of vectors, and updates of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import embed
from quern.plans.registry import Registry
from quern.plans.retrieval import WORDS
from quern.sources.keyword_index import FIELDS, KeywordIndex
from quern.sources.tables import spread, table
from quern.sources.vector_store import DocumentStores, VectorStore

Q = Registry()


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("title"), "source", "lang")


def updated_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """All documents in two batches; then every seventh again with a longer text; then one source is deleted."""
    docs = documents_as_chunks(spark, sf_dir)
    index = KeywordIndex(spark, fields=("content", "title"), kept=("source", "lang"))
    index.append(docs.filter("chunk_id % 2 = 0"))
    index.append(docs.filter("chunk_id % 2 = 1"))
    index.append(docs.filter("chunk_id % 7 = 0").withColumn("content", F.concat_ws(" ", "content", "source", "content")))
    index.delete("source", "src3")
    return index


#: The same state of the index: its chunks, and their words by field.
STATE = f"""
WITH q AS (SELECT item_id AS query_id, text || ' src' || (item_id % 20) AS query FROM benchmark),
c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', text, source, text) ELSE text END AS content, concat_ws(' ', source, lang) AS title, source, lang FROM documents WHERE source <> 'src3' OR source IS NULL),
f AS (SELECT 'content' AS field, 2.0 AS boost, chunk_id, {WORDS.format('content')} AS w FROM c UNION ALL SELECT 'title', 1.0, chunk_id, {WORDS.format('title')} FROM c),
size AS (SELECT field, any_value(boost) AS boost, count(w) AS docs, avg(len(w)) AS mean FROM f GROUP BY field),
tf AS (SELECT field, chunk_id, word, count(*) AS tf, any_value(n) AS length FROM (SELECT field, chunk_id, len(w) AS n, unnest(w) AS word FROM f) GROUP BY ALL),
df AS (SELECT field, word, count(*) AS df FROM tf GROUP BY ALL),
qw AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS word FROM q),
s AS (SELECT query_id, chunk_id, field, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (field, word) JOIN size USING (field) JOIN qw USING (word) GROUP BY ALL)"""


@Q.query("stored_index_topk", STATE + """, b AS (SELECT query_id, chunk_id, round(max(score), 4) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10""")
def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of two fields, content counting twice; one word of each query is a source's name, which titles hold."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" src"), (F.col("item_id") % 20).cast("string")).alias("query"))
    return updated_index(spark, sf_dir).search(asked, 10, FIELDS)


@Q.query("stored_index_filtered", STATE + """, b AS (SELECT query_id, chunk_id, round(max(score), 4) AS score FROM s JOIN c USING (chunk_id) WHERE lang = 'en' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5""")
def stored_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a compaction, among chunks of one language."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" src"), (F.col("item_id") % 20).cast("string")).alias("query"))
    index = updated_index(spark, sf_dir)
    index.compact()
    return index.search(asked, 5, FIELDS, {"lang": "en"})


@Q.query("stored_index_stats", "SELECT true AS \"exists\", count(*) AS docs FROM documents WHERE source <> 'src3' OR source IS NULL")
def stored_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated_index(spark, sf_dir).stats().drop("version")


def halves(docs: DataFrame) -> DataFrame:
    """Two chunks of each document, the two halves of its text."""
    parts = F.posexplode(F.array(F.expr("substring(content, 1, length(content) div 2)"), F.expr("substring(content, length(content) div 2 + 1)")))
    return docs.select("source", parts.alias("half", "content")).select((F.col("source").cast("long") * 2 + F.col("half")).alias("chunk_id"), "source", "content", F.concat(F.lit("t"), (F.col("source").cast("long") % 3).cast("string")).alias("tenant_id"))


def folder_states(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four states of a folder of documents: nine tenths; all but some deleted and some changed; the same; most of them changed."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"), "doc_id")
    second = docs.filter("doc_id % 13 <> 5").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" it was updated once"))).otherwise(F.col("content")))
    third = second.withColumn("content", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("changed again "), "content")).otherwise(F.col("content")))
    return [x.drop("doc_id") for x in (docs.filter("doc_id % 10 <> 0"), second, second, third)]


def stores_of(spark: SparkSession) -> DocumentStores:
    return DocumentStores(spark, KeywordIndex(spark, kept=("source", "tenant_id")), VectorStore(spark, 256), halves, lambda c: embed.pair_vectors(c, "chunk_id", "content", keep=("source", "tenant_id")))


@Q.query("incremental_updates", """WITH d AS (SELECT doc_id, doc_id % 10 <> 0 AS first, doc_id % 13 <> 5 AS second, doc_id % 7 = 0 AS changed, doc_id % 5 <> 0 AS again FROM documents),
c AS (SELECT 1 AS step, count(*) FILTER (first) AS new, 0 AS changed, 0 AS deleted, 0 AS same FROM d UNION ALL
 SELECT 2, count(*) FILTER (NOT first AND second), count(*) FILTER (first AND second AND changed), count(*) FILTER (first AND NOT second), count(*) FILTER (first AND second AND NOT changed) FROM d UNION ALL
 SELECT 3, 0, 0, 0, count(*) FILTER (second) FROM d UNION ALL SELECT 4, 0, count(*) FILTER (second AND again), 0, count(*) FILTER (second AND NOT again) FROM d)
SELECT step, CASE step WHEN 2 THEN 'incremental' WHEN 3 THEN 'none' ELSE 'full' END AS mode, new, changed, deleted, same, CASE step WHEN 2 THEN 2 * (changed + deleted) WHEN 4 THEN 2 * (changed + same) ELSE 0 END AS removed, CASE step WHEN 1 THEN 2 * new WHEN 2 THEN 2 * (new + changed) WHEN 4 THEN 2 * (changed + same) ELSE 0 END AS added FROM c""")
def incremental_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of four updates of the stores did."""
    stores = stores_of(spark)
    reports = [(k, *stores.update(state).values()) for k, state in enumerate(folder_states(spark, sf_dir), 1)]
    return spark.createDataFrame(reports, "step int, mode string, new long, changed long, deleted long, same long, removed long, added long")


@Q.query("vector_store_topk", rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' it was updated once' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 5),
c AS (SELECT doc_id * 2 AS id, left(text, length(text) // 2) AS text, doc_id % 3 AS tenant FROM d UNION ALL SELECT doc_id * 2 + 1, substr(text, length(text) // 2 + 1), doc_id % 3 FROM d),
t AS (SELECT id, {WORDS.format('text')} AS w FROM c UNION ALL SELECT -1 - item_id, {WORDS.format('text')} FROM benchmark),
h AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1]))) AS h FROM t WHERE len(w) > 1),
n AS (SELECT id, substr(h, 1, 2) AS bucket, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL),
norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM n GROUP BY id),
cs AS (SELECT x.id AS query_id, y.id AS vec_id, round(coalesce(sum(x.n * y.n) / nullif(any_value(nx.norm * ny.norm), 0), 0), 6) AS score FROM n x JOIN n y ON x.bucket = y.bucket AND x.id < 0 AND y.id >= 0 JOIN norm nx ON nx.id = x.id JOIN norm ny ON ny.id = y.id JOIN c ON c.id = y.id WHERE tenant = 1 GROUP BY ALL)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs WHERE score > 0 QUALIFY rank <= 5""")
def vector_store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After an incremental update, in one tenant's partition."""
    stores, states = stores_of(spark), folder_states(spark, sf_dir)
    stores.update(states[0])
    stores.update(states[1])
    asked = embed.pair_vectors(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text"), "id", "text")
    return stores.vectors.search(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5, "t1").filter("score > 0")
