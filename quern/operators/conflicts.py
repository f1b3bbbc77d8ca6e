"""Documents of one answer that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What denies, what affirms, what is deprecated, what is recommended.
DENIED = r"(?i)not\s+(supported|available|recommended|possible|allowed)|不支持|不可用|不推荐|不允许|已废弃|已移除"
AFFIRMED = r"(?i)支持|可用|推荐|supported|available|recommended"
DEPRECATED = r"(?i)(deprecated|废弃|removed\s+in|已移除)\s*(?:in\s*)?(?:API\s*)?(\d+)"
RECOMMENDED = r"(?i)(?:recommend|建议|推荐|最佳实践|best\s+practice)\s+(?:is\s+)?(?:to\s+)?(\w[\w\s]{5,50})"


def every(c: Column, rule: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rule), group))


def topics(content: Column, title: Column) -> Column:
    """APIs, versions, error codes, components and phrases of three title words, of the first 1,000 characters."""
    text = F.concat_ws(" ", title, F.substring(content, 1, 1000))
    tag = lambda name, found: F.transform(found, lambda x: F.concat(F.lit(f"{name}:"), F.trim(x)))
    words = F.filter(F.split(title, r"\s+"), lambda w: F.length(w) > 2)
    places = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    phrases = F.filter(F.transform(places, lambda i: F.array_join(F.slice(words, i, 3), " ")), lambda p: F.length(p) > 10)
    return F.array_distinct(F.concat(
        tag("api", every(text, r"(@ohos\.[\w.]+)")), tag("version", every(text, r"(API\s*\d{1,2}|HarmonyOS\s*(?:NEXT\s*)?\d+\.\d+)")), tag("error", F.slice(F.regexp_extract_all(text, F.lit(r"\b(\d{8,})\b"), 1), 1, 5)),
        tag("component", F.slice(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), 1), 1, 5)), tag("topic", phrases),
    ))


def pairs_on_topics(docs: DataFrame) -> DataFrame:
    """(query_id, a, b, topics): pairs of one query's documents (query_id, chunk_id, content, title) that share topics.

    Retrieval bounds how many documents a query has, so a topic meets only those.
    """
    tagged = docs.select("query_id", "chunk_id", F.explode(topics(F.col("content"), F.col("title"))).alias("topic"))
    other = tagged.select("query_id", F.col("chunk_id").alias("b"), "topic")
    met = tagged.withColumnRenamed("chunk_id", "a").join(other, ["query_id", "topic"]).filter("a < b")
    return met.groupBy("query_id", "a", "b").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def contradictions(docs: DataFrame) -> DataFrame:
    """(query_id, a, b, kind, severity) of documents on the same topic. Letter case and order of the two don't matter."""
    side = lambda name, text: docs.select("query_id", F.col("chunk_id").alias(name), F.col("content").alias(text))
    rows = pairs_on_topics(docs).join(side("a", "ta"), ["query_id", "a"]).join(side("b", "tb"), ["query_id", "b"])
    ta, tb = F.col("ta"), F.col("tb")
    version = lambda t: F.array_sort(every(t, r"(?i)API\s*(\d{1,2})"))
    denies = lambda x, y: x.rlike(DENIED) & ~y.rlike(DENIED) & y.rlike(AFFIRMED)
    old = lambda x, y: x.rlike(DEPRECATED) & y.rlike(r"@ohos\.[\w.]+")
    advice = lambda t: F.transform(every(t, RECOMMENDED), lambda x: F.lower(F.trim(x)))
    found = F.array(
        F.when((F.size(version(ta)) > 0) & (F.size(version(tb)) > 0) & (version(ta) != version(tb)), F.struct(F.lit("version").alias("kind"), F.lit("high").alias("severity"))),
        F.when(denies(ta, tb) | denies(tb, ta), F.struct(F.lit("negation").alias("kind"), F.lit("high").alias("severity"))),
        F.when(old(ta, tb) | old(tb, ta), F.struct(F.lit("deprecation").alias("kind"), F.lit("critical").alias("severity"))),
        F.when((F.size(advice(ta)) > 0) & (F.size(advice(tb)) > 0) & ~F.arrays_overlap(advice(ta), advice(tb)), F.struct(F.lit("recommendation").alias("kind"), F.lit("medium").alias("severity"))),
    )
    return rows.select("query_id", "a", "b", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("query_id", "a", "b", "x.kind", "x.severity")


def annotate(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with ``conflicts``, an array of struct(kind, severity) of the contradictions that name their source; empty for others.

    docs (query_id, chunk_id, source, ...), found as ``contradictions`` gives it. Documents of one source share its conflicts.
    """
    sides = found.select("query_id", F.explode(F.array("a", "b")).alias("chunk_id"), "kind", "severity")
    named = sides.join(docs.select("query_id", "chunk_id", "source"), ["query_id", "chunk_id"]).groupBy("query_id", "source").agg(F.array_sort(F.collect_set(F.struct("kind", "severity"))).alias("conflicts"))
    none = F.array().cast("array<struct<kind:string,severity:string>>")
    return docs.join(named, ["query_id", "source"], "left").withColumn("conflicts", F.coalesce("conflicts", none))


def conflict_stats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, total_docs, conflicting_docs, consistent_docs, has_conflicts), also for queries without any conflict."""
    held = F.count_if(F.size("conflicts") > 0)
    return annotate(docs, found).groupBy("query_id").agg(F.count("*").alias("total_docs"), held.alias("conflicting_docs"), (F.count("*") - held).alias("consistent_docs"), (held > 0).alias("has_conflicts"))


def warnings(found: DataFrame) -> DataFrame:
    """(query_id, warning): the numbered lines that a prompt carries for each contradiction of its documents."""
    rows = F.array_sort(F.collect_list(F.struct("a", "b", "kind", "severity")))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"), x["kind"], F.lit("** (严重程度: "), x["severity"], F.lit(")"))
    return found.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.concat(F.lit("证据冲突警告\n"), F.array_join(F.transform("rows", line), "\n")).alias("warning"))
