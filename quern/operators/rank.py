"""Reranking, diversity and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def overlap_size(query: Column, content: Column) -> Column:
    return F.size(F.array_intersect(T.word_set(query), T.word_set(content)))


def rule_rerank(rows: DataFrame, n: int) -> DataFrame:
    """Overlap, and a bonus for the first chunks of a source; one row a source, so it may return fewer than n."""
    score = overlap_size(F.col("query"), F.col("content")) + F.greatest(F.lit(0), 3 - F.col("chunk_index")) * 0.5
    order = [F.desc("rerank_score"), F.col("chunk_id")]
    one = rows.withColumn("rerank_score", score).withColumn("own", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))).filter("own = 1").drop("own")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)


def simple_score(score: Column, query: Column, content: Column) -> Column:
    return score * 0.5 + overlap_size(query, content) * 0.5


def intent_boost(intent: Column, content: Column, source: Column, doc_type: Column) -> Column:
    """The factor by which an intent raises a row."""
    text, low, kind = F.lower(content), F.lower(source), F.lower(F.coalesce(doc_type, F.lit("")))
    has = lambda c, *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))
    return (
        F.when((intent == "api_usage") & (has(kind, "api") | has(text, "@ohos")), 1.2)
        .when((intent == "code_generation") & (has(low, "code") | has(text, "```")), 1.3)
        .when((intent == "error_diagnosis") & has(text, "error", "报错", "错误", "failed", "exception"), 1.25)
        .when((intent == "migration") & has(text, "migration", "迁移", "升级", "废弃"), 1.3)
        .when((intent == "concept_qa") & (has(low, "official") | has(kind, "doc")), 1.15)
        .otherwise(1.0)
    )


def diverse(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first row of each source, then the others, n of each query."""
    own = F.when(F.col("source") == "", F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order)))
    back = F.when((own > 1) | (F.col("source") == ""), 1).otherwise(0)
    first = rows.withColumn("back", back)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("back"), *order))).filter(F.col("rank") <= n).drop("back")


def evidence_score(score: Column, content: Column, source: Column, doc_type: Column, digits: int = 4) -> Column:
    """Relevance, density, authority and completeness."""
    n, low, kind = F.length(content), F.lower(source), F.coalesce(doc_type, F.lit(""))
    marks = F.contains(content, F.lit("```")) | F.contains(content, F.lit("@ohos")) | F.contains(content, F.lit("API")) | F.contains(F.lower(content), F.lit("error")) | F.contains(content, F.lit("错误"))
    dense = F.when((n > 100) & marks, 0.15).otherwise(0.0) + F.when(n > 500, 0.05).otherwise(0.0)
    authority = (
        F.when(F.contains(low, F.lit("official")) | (kind == "official_doc"), 0.2)
        .when(F.contains(low, F.lit("api")) | (kind == "api_reference"), 0.15)
        .when(F.contains(low, F.lit("error")) | (kind == "error_knowledge"), 0.1)
        .when(kind == "sample_code", 0.12)
        .otherwise(0.0)
    )
    complete = F.when(n > 200, 0.05).otherwise(0.0) + F.when(n > 500, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(0.5), score * 0.5) + dense + authority + complete, digits)


def evidence_bucket(intent: Column, source: Column, doc_type: Column) -> Column:
    """0 for what the intent wants first, 1 for sample code, 2 for the rest."""
    low, kind = F.lower(source), F.coalesce(doc_type, F.lit(""))
    wanted = lambda word, mark: F.contains(low, F.lit(word)) | F.contains(kind, F.lit(mark))
    first = ((intent == "code_generation") & wanted("code", "sample")) | ((intent == "error_diagnosis") & wanted("error", "faq")) | ((intent == "migration") & wanted("migration", "migration")) | kind.isin("official_doc", "api_reference")
    return F.when(first, 0).when(kind == "sample_code", 1).otherwise(2)


def select_evidence(rows: DataFrame, most: int = 5) -> DataFrame:
    """Rows by bucket and score, skipping one whose source and title were both seen before, most of each query.

    Whether a row is skipped depends on the rows kept before it, so an array of the candidates, which retrieval bounds, is
    folded in order.
    """
    item = F.struct(F.col("bucket"), (-F.col("evidence_score")).alias("low"), F.col("chunk_id"), F.col("source"), F.col("title"), F.col("evidence_score"))
    start = F.expr("named_struct('kept', cast(array() AS array<struct<bucket:int,low:double,chunk_id:bigint,source:string,title:string,evidence_score:double>>), 'sources', cast(array() AS array<string>), 'titles', cast(array() AS array<string>))")

    def step(acc: Column, x: Column) -> Column:
        skip = (F.size(acc["kept"]) >= most) | (F.array_contains(acc["sources"], x["source"]) & F.array_contains(acc["titles"], x["title"]))
        return F.when(skip, acc).otherwise(F.struct(F.array_append(acc["kept"], x).alias("kept"), F.array_append(acc["sources"], x["source"]).alias("sources"), F.array_append(acc["titles"], x["title"]).alias("titles")))

    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = listed.select("query_id", F.posexplode(F.aggregate("items", start, step)["kept"]).alias("pos", "x"))
    return kept.select("query_id", F.col("x.chunk_id").alias("chunk_id"), F.col("x.evidence_score").alias("evidence_score"), (F.col("pos") + 1).alias("evidence_index"))
