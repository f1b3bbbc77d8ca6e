"""Search, fusion, reranking and evidence, with benchmark items as queries and documents as chunks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import fusion, rank, search
from quern.operators.lineage import cut
from quern.plans.registry import Registry
from quern.sources.tables import spread, table

Q = Registry()

TWO_WAY = {"vector": 0.6, "keyword": 0.4}
THREE_WAY = {"keyword": 0.3, "vector": 0.5, "graph": 0.2}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def overlap(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.overlap_search(asked(spark, sf_dir), chunks(spark, sf_dir), k)


def bm25(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.bm25_search(asked(spark, sf_dir), chunks(spark, sf_dir), k)


def shortest_of(spark: SparkSession, sf_dir: str, hits: DataFrame, k: int = 10) -> DataFrame:
    """The shortest of hits: a third list."""
    hits = hits.select("query_id", "chunk_id", "score").join(chunks(spark, sf_dir), "chunk_id").withColumn("n", F.length("content"))
    return search.ranked(hits, "query_id", [F.col("n"), F.col("chunk_id")], k).select("query_id", "chunk_id", "score", "rank")


#: Tables that the SQL below shares.
WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
BASE = f"""
WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
c AS (SELECT doc_id AS chunk_id, text AS content, source, lang FROM documents),
qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM (SELECT query_id, list_distinct({WORDS.format('query')}) AS w FROM q)),
cw AS (SELECT chunk_id, unnest(list_distinct({WORDS.format('content')})) AS word FROM c),
ov0 AS (SELECT query_id, chunk_id, count(*) / any_value(n) AS score, count(*) AS hits FROM cw JOIN qw USING (word) GROUP BY ALL),
ov AS (SELECT query_id, chunk_id, score, hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ov0),
tf AS (SELECT chunk_id, word, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS word FROM (SELECT chunk_id, {WORDS.format('content')} AS w FROM c)) GROUP BY ALL),
size AS (SELECT count(*) AS docs, avg(len({WORDS.format('content')})) AS mean FROM c),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm0 AS (SELECT query_id, chunk_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 4) AS score
        FROM tf JOIN df USING (word) JOIN qw USING (word), size GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm0),
sh AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY length(content), chunk_id) AS rank FROM ov JOIN c USING (chunk_id) WHERE rank <= 50),
lists AS (SELECT query_id, chunk_id, rank, 'keyword' AS list, 0 AS place FROM ov WHERE rank <= 10
          UNION ALL SELECT query_id, chunk_id, rank, 'vector', 1 FROM bm WHERE rank <= 10
          UNION ALL SELECT query_id, chunk_id, rank, 'graph', 2 FROM sh WHERE rank <= 10),
top AS (SELECT ov.*, query, content, source FROM ov JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE rank <= 20)
"""


@Q.query("kw_overlap_topk", BASE + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ov WHERE rank <= 5")
def kw_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@Q.query("bm25_topk", BASE + "SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir)


@Q.query("bm25_one_per_source", BASE + """, f AS (SELECT query_id, chunk_id, source, bm.score, rank AS found, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM bm JOIN c USING (chunk_id) WHERE rank <= 10)
SELECT query_id, chunk_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY found) AS rank FROM f WHERE own = 1""")
def bm25_one_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25(spark, sf_dir).withColumnRenamed("rank", "found").join(chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id")
    return fusion.first_per(hits, "source", [F.col("found")], 10).select("query_id", "chunk_id", "source", "score", "rank")


VECTOR = """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def vector_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.vector_search(queries, vectors, k)


@Q.query("vector_topk", VECTOR + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir, 10)


@Q.query("vector_argmax", VECTOR + "SELECT query_id, vec_id AS best_id, score AS best_score, score >= 0.3 AS is_match FROM r WHERE rank = 1")
def vector_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector_hits(spark, sf_dir, 1)
    return hits.select("query_id", F.col("vec_id").alias("best_id"), F.col("score").alias("best_score"), (F.col("score") >= 0.3).alias("is_match"))


@Q.query("vector_filtered_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id AND label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.vector_search(queries, vectors.filter("label = 3"), 5)


@Q.query("search_confidence", BASE + "SELECT query_id, coalesce(round(avg(score) * least(1.0, count(score) / 10), 4), 0.0) AS confidence FROM q LEFT JOIN (SELECT query_id, score FROM ov WHERE rank <= 7) USING (query_id) GROUP BY query_id")
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.confidence(asked(spark, sf_dir), overlap(spark, sf_dir, 7))


@Q.query("minimum_score", BASE + """, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ov WHERE rank <= 10)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM m WHERE score >= 0.8 OR (best < 0.8 AND rank <= 3)""")
def minimum_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.at_least(overlap(spark, sf_dir), 0.8, 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@Q.query("search_cascade", BASE + """, a AS (SELECT query_id, chunk_id, score, rank, 1 AS level FROM ov WHERE rank <= 5 AND score >= 0.9 UNION ALL SELECT query_id, chunk_id, score, rank, 2 FROM bm WHERE rank <= 5),
f AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS first FROM a) SELECT query_id, chunk_id, round(score, 4) AS score, rank, level FROM f WHERE level = first""")
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols, queries = ["query_id", "chunk_id", "score", "rank"], asked(spark, sf_dir)
    used = search.counted_words(queries, chunks(spark, sf_dir))
    most = search.overlap_of(queries, used.filter("word <> ''").select("chunk_id", "word").repartition("chunk_id"), 5)
    return search.cascade(most.filter("score >= 0.9").select(*cols), search.bm25_of(queries, used, 5).select(*cols)).withColumn("score", F.round("score", 4))


def rrf_sql(weights: dict[str, float]) -> str:
    case = " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items())
    return f""", fused AS (SELECT query_id, chunk_id, round(sum(CASE list {case} END / (60 + rank)), 8) AS score, string_agg(list, ',' ORDER BY place) AS matched
FROM lists WHERE list IN ({', '.join(f"'{s}'" for s in weights)}) GROUP BY ALL),
src AS (SELECT f.*, source, content FROM fused f JOIN c USING (chunk_id))"""


def three_lists(spark: SparkSession, sf_dir: str, names: Collection[str] = tuple(THREE_WAY)) -> dict[str, DataFrame]:
    """The lists of these names. All come from one scan of the texts; the third is of the 50 that share most words, of which the first ten are the first."""
    queries, docs = asked(spark, sf_dir), chunks(spark, sf_dir)
    most = 50 if "graph" in names else 10
    used = search.counted_words(queries, docs) if "vector" in names else None
    hits = search.overlap_search(queries, docs, most) if used is None else search.overlap_of(queries, used.filter("word <> ''").select("chunk_id", "word").repartition("chunk_id"), most)
    hits = cut(hits)
    make = {"keyword": lambda: hits.filter("rank <= 10"), "vector": lambda: search.bm25_of(queries, used, 10), "graph": lambda: shortest_of(spark, sf_dir, hits)}
    return {name: make[name]() for name in names}


@Q.query("rrf_two_way", BASE + rrf_sql(TWO_WAY) + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS own FROM src),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o WHERE own = 1)
SELECT query_id, chunk_id, source, round(score, 4) AS score, rank FROM r WHERE rank <= 5""")
def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(three_lists(spark, sf_dir, ("keyword", "vector")), TWO_WAY).join(chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id")
    return fusion.first_per(fused, "source", [F.desc("score"), F.col("chunk_id")], 5).select("query_id", "chunk_id", "source", F.round("score", 4).alias("score"), "rank")


@Q.query("rrf_three_way", BASE + rrf_sql(THREE_WAY) + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM src)
SELECT query_id, chunk_id, score, matched, rank, score AS pre_boost_score, 0.0::DOUBLE AS code_density FROM r WHERE rank <= 10""")
def rrf_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(three_lists(spark, sf_dir), THREE_WAY)
    top = search.ranked(fused, "query_id", [F.desc("score"), F.col("chunk_id")], 10).join(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return fusion.code_boost(top, T.code_density(F.col("content")), 0.5).drop("content")


@Q.query("rrf_degraded", BASE + rrf_sql({"keyword": 0.6, "graph": 0.4}) + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM src)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10""")
def rrf_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the vector list the other weights are scaled to a sum of 1."""
    weights = {s: round(w, 12) for s, w in fusion.renormalised(THREE_WAY, {"keyword", "graph"}).items()}
    return search.ranked(fusion.rrf(three_lists(spark, sf_dir, tuple(s for s in THREE_WAY if s in weights)), weights), "query_id", [F.desc("score"), F.col("chunk_id")], 10).select("query_id", "chunk_id", "score", "rank")


#: How the driver's tables stand for document types: by source number.
DOC_TYPE_SQL = "CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'official_doc' WHEN 1 THEN 'api_reference' WHEN 2 THEN 'sample_code' WHEN 3 THEN 'faq' ELSE '' END"


def doc_type() -> F.Column:
    return F.expr(DOC_TYPE_SQL)


MERGED = {"keyword": 0.35, "vector": 0.25, "graph": 0.15}


@Q.query("rrf_merged_boost", BASE + rrf_sql(MERGED) + f""", t AS (SELECT *, {DOC_TYPE_SQL} AS doc_type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first FROM src),
b AS (SELECT query_id, chunk_id, doc_type, round(score * (1.0 + CASE WHEN doc_type IN ('official_doc', 'api_reference') THEN 0.2 * 0.2 ELSE 0 END + CASE WHEN doc_type = 'api_reference' THEN 0.35 * 0.15 ELSE 0 END
 + CASE WHEN doc_type = 'sample_code' OR contains(lower(source), 'code') THEN 0.3 * 0.15 ELSE 0 END + CASE WHEN doc_type IN ('error_knowledge', 'faq', 'ticket') THEN 0.15 * 0.1 ELSE 0 END), 6) AS score FROM t WHERE first <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) SELECT query_id, chunk_id, doc_type, score, rank FROM r WHERE rank <= 15""")
def rrf_merged_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = search.ranked(fusion.rrf(three_lists(spark, sf_dir), MERGED), "query_id", [F.desc("score"), F.col("chunk_id")], 30).drop("rank")
    typed = fused.join(chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id").withColumn("doc_type", doc_type())
    weights = dict(fusion.DEFAULT_WEIGHTS, **fusion.INTENT_WEIGHTS["api_usage"])
    boosted = typed.withColumn("score", F.round(F.col("score") * fusion.quality_boost(F.col("doc_type"), F.col("source"), weights), 6))
    return search.ranked(boosted, "query_id", [F.desc("score"), F.col("chunk_id")], 15).select("query_id", "chunk_id", "doc_type", "score", "rank")


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by overlap with their query and content; a chunk's index in its source is its id's remainder."""
    return overlap(spark, sf_dir, 20).join(asked(spark, sf_dir), "query_id").join(chunks(spark, sf_dir).drop("lang"), "chunk_id").withColumn("chunk_index", F.col("chunk_id") % 7).withColumn("doc_type", doc_type())


@Q.query("rerank_rule", BASE + """, s AS (SELECT query_id, chunk_id, source, hits + greatest(0, 3 - chunk_id % 7) * 0.5 AS rerank_score FROM top),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rerank_score DESC, chunk_id) AS own FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM o WHERE own = 1)
SELECT query_id, chunk_id, source, CAST(rerank_score AS DOUBLE) AS rerank_score, rank FROM r WHERE rank <= 5""")
def rerank_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rule_rerank(top(spark, sf_dir).drop("rank"), 5).select("query_id", "chunk_id", "source", "rerank_score", "rank")


@Q.query("rerank_simple", BASE + "SELECT query_id, chunk_id, round(score * 0.5 + hits * 0.5, 6) AS rerank_score FROM top")
def rerank_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).select("query_id", "chunk_id", F.round(rank.simple_score(F.col("score"), F.col("query"), F.col("content")), 6).alias("rerank_score"))


@Q.query("rerank_diverse", BASE + """, o AS (SELECT query_id, chunk_id, source, rank AS found, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM top),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own > 1, found) AS rank FROM o) SELECT query_id, chunk_id, source, rank FROM r WHERE rank <= 10""")
def rerank_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.diverse(top(spark, sf_dir).withColumnRenamed("rank", "found"), 10, [F.col("found")]).select("query_id", "chunk_id", "source", "rank")


@Q.query("intent_boost", BASE + f"""SELECT query_id, chunk_id, round(score * CASE query_id % 3 WHEN 0 THEN CASE WHEN contains({DOC_TYPE_SQL}, 'api') THEN 1.2 ELSE 1.0 END
 WHEN 1 THEN CASE WHEN contains({DOC_TYPE_SQL}, 'doc') THEN 1.15 ELSE 1.0 END ELSE CASE WHEN contains(lower(content), 'error') OR contains(lower(content), 'failed') OR contains(lower(content), 'exception') THEN 1.25 ELSE 1.0 END END, 6) AS score FROM top""")
def intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.expr("CASE query_id % 3 WHEN 0 THEN 'api_usage' WHEN 1 THEN 'concept_qa' ELSE 'error_diagnosis' END")
    factor = rank.intent_boost(intent, F.col("content"), F.col("source"), F.col("doc_type"))
    return top(spark, sf_dir).select("query_id", "chunk_id", F.round(F.col("score") * factor, 6).alias("score"))


EVIDENCE = BASE + f""", e AS (SELECT query_id, chunk_id, source, 't' || (chunk_id % 3) AS title, {DOC_TYPE_SQL} AS doc_type, round(least(0.5, score * 0.5)
 + CASE WHEN length(content) > 100 AND (contains(content, '```') OR contains(content, '@ohos') OR contains(content, 'API') OR contains(lower(content), 'error')) THEN 0.15 ELSE 0 END + CASE WHEN length(content) > 500 THEN 0.05 ELSE 0 END
 + CASE {DOC_TYPE_SQL} WHEN 'official_doc' THEN 0.2 WHEN 'api_reference' THEN 0.15 WHEN 'sample_code' THEN 0.12 ELSE 0 END
 + CASE WHEN length(content) > 200 THEN 0.05 ELSE 0 END + CASE WHEN length(content) > 500 THEN 0.05 ELSE 0 END, 6) AS evidence_score FROM top)
"""


@Q.query("evidence_score", EVIDENCE + "SELECT query_id, chunk_id, evidence_score FROM e")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).select("query_id", "chunk_id", rank.evidence_score(F.col("score"), F.col("content"), F.col("source"), F.col("doc_type"), 6).alias("evidence_score"))


@Q.query("evidence_select")
def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over kept rows is held against a plain loop in the tests."""
    rows = top(spark, sf_dir).withColumn("title", F.concat(F.lit("t"), (F.col("chunk_id") % 3).cast("string")))
    scored = rows.withColumn("evidence_score", rank.evidence_score(F.col("score"), F.col("content"), F.col("source"), F.col("doc_type"))).withColumn("bucket", rank.evidence_bucket(F.lit("concept_qa"), F.col("source"), F.col("doc_type")))
    return rank.select_evidence(scored)


@Q.query("hybrid_workflow", BASE + rrf_sql(TWO_WAY) + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first FROM src),
m AS (SELECT a.*, coalesce(hits, 0) AS hits FROM a LEFT JOIN (SELECT query_id, chunk_id, hits FROM ov) USING (query_id, chunk_id) WHERE first <= 20),
s AS (SELECT query_id, chunk_id, source, round(score * 0.5 + hits * 0.5, 6) AS rerank_score FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rerank_score DESC, chunk_id) AS own FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own > 1, rerank_score DESC, chunk_id) AS rank FROM o) SELECT query_id, chunk_id, source, rerank_score, rank FROM r WHERE rank <= 10""")
def hybrid_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search twice, fuse to 20, rerank, and keep 10 with diverse sources."""
    fused = search.ranked(fusion.rrf(three_lists(spark, sf_dir, ("keyword", "vector")), TWO_WAY), "query_id", [F.desc("score"), F.col("chunk_id")], 20).drop("rank")
    rows = fused.join(asked(spark, sf_dir), "query_id").join(chunks(spark, sf_dir), "chunk_id").withColumn("rerank_score", F.round(rank.simple_score(F.col("score"), F.col("query"), F.col("content")), 6))
    return rank.diverse(rows, 10, [F.desc("rerank_score"), F.col("chunk_id")]).select("query_id", "chunk_id", "source", "rerank_score", "rank")


@Q.query("retrieval_eval", BASE + """, rel AS (SELECT query_id, rank, CAST(contains(content, query) AS INT) AS hit FROM ov JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE rank <= 10),
total AS (SELECT query_id, count(*) AS n FROM q JOIN c ON contains(content, query) GROUP BY query_id),
per AS (SELECT query_id, max(CASE WHEN rank <= 3 THEN hit ELSE 0 END) AS hit3, max(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS hit5, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / coalesce(any_value(n), 1) AS recall5, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / rank END), 0) AS mrr FROM q LEFT JOIN rel USING (query_id) LEFT JOIN total USING (query_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(hit3), 4) AS hit_at_3, round(avg(hit5), 4) AS hit_at_5, round(avg(recall5), 4) AS recall_at_5, round(avg(mrr), 4) AS mrr FROM per""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant if it holds the whole item. Those that do share all its words, so overlap hits are enough to look at."""
    everything = overlap(spark, sf_dir, None).select("query_id", "chunk_id", "rank", "score")
    rows = everything.filter("score = 1 OR rank <= 10").join(asked(spark, sf_dir), "query_id").join(chunks(spark, sf_dir), "chunk_id").select("query_id", "rank", F.contains("content", "query").cast("int").alias("hit"))
    within = lambda k: F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)
    per = asked(spark, sf_dir).select("query_id").join(rows, "query_id", "left").groupBy("query_id").agg(F.max(within(3)).alias("hit3"), F.max(within(5)).alias("hit5"), (F.sum(within(5)) / F.greatest(F.sum("hit"), F.lit(1))).alias("recall5"), F.coalesce(F.max(F.when((F.col("hit") == 1) & (F.col("rank") <= 10), 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return per.agg(F.count("*").alias("queries"), mean("hit3", "hit_at_3"), mean("hit5", "hit_at_5"), mean("recall5", "recall_at_5"), mean("mrr", "mrr"))


@Q.query("external_trigger", BASE + "SELECT query_id, count(score) < 5 OR max(score) < 0.3 AS external FROM q LEFT JOIN (SELECT query_id, score FROM ov WHERE rank <= 10) USING (query_id) GROUP BY query_id")
def external_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.needs_external(asked(spark, sf_dir), overlap(spark, sf_dir))


@Q.query("citations", BASE + """SELECT query_id, rank AS citation, chunk_id, source, substr(content, 1, 120) AS excerpt FROM top WHERE rank <= 5""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).filter("rank <= 5").select("query_id", F.col("rank").alias("citation"), "chunk_id", "source", F.substring("content", 1, 120).alias("excerpt"))


@Q.query("docs_budget", BASE + """, t AS (SELECT query_id, chunk_id, rank, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 2) END AS tokens FROM top),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM t),
f AS (SELECT *, min(CASE WHEN used > 3000 THEN rank END) OVER (PARTITION BY query_id) AS over_at FROM u)
SELECT query_id, chunk_id, rank, CAST(CASE WHEN rank = over_at THEN 3000 - (used - tokens) ELSE tokens END AS BIGINT) AS tokens, coalesce(rank = over_at, false) AS truncated FROM f WHERE over_at IS NULL OR rank < over_at OR (rank = over_at AND 3000 - (used - tokens) > 20)""")
def docs_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of a ranking that fits in 3,000 tokens; the first that doesn't is cut if over 20 tokens are left."""
    per = Window.partitionBy("query_id")
    rows = top(spark, sf_dir).select("query_id", "chunk_id", "rank", T.estimate_tokens(F.col("content")).alias("tokens")).withColumn("used", F.sum("tokens").over(per.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("over_at", F.min(F.when(F.col("used") > 3000, F.col("rank"))).over(per)).withColumn("room", 3000 - (F.col("used") - F.col("tokens")))
    is_over = F.coalesce(F.col("rank") == F.col("over_at"), F.lit(False))
    return rows.filter(F.col("over_at").isNull() | (F.col("rank") < F.col("over_at")) | (is_over & (F.col("room") > 20))).select("query_id", "chunk_id", "rank", F.when(is_over, F.col("room")).otherwise(F.col("tokens")).alias("tokens"), is_over.alias("truncated"))
