"""Conflicts, judged answers, gates, budgets, embeddings without a model, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import conflicts, documents, embed, evaluate, graph, master
from quern.plans import retrieval
from quern.plans.registry import Registry
from quern.sources.tables import table

Q = Registry()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@Q.query("conflict_pairs", retrieval.BASE + r""", t AS (SELECT query_id, chunk_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(substr(source || ' ' || substr(content, 1, 1000), 1), '\b\d{8,}\b')[1:5], lambda x: 'error:' || x),
 list_transform(regexp_extract_all(source || ' ' || substr(content, 1, 1000), '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')[1:5], lambda x: 'component:' || x), list_transform(list_distinct(regexp_extract_all(source || ' ' || substr(content, 1, 1000), 'API\s*\d{1,2}')), lambda x: 'version:' || x)))) AS topic FROM top)
SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, string_agg(DISTINCT x.topic, ',' ORDER BY x.topic) AS topics FROM t x JOIN t y ON x.query_id = y.query_id AND x.topic = y.topic AND x.chunk_id < y.chunk_id GROUP BY ALL""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = retrieval.top(spark, sf_dir).withColumn("title", F.col("source"))
    return conflicts.pairs_on_topics(docs).select("query_id", "a", "b", F.array_join("topics", ",").alias("topics"))


@Q.query("contradictions")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's texts hold none of the marks: fixtures in the tests do."""
    return conflicts.contradictions(retrieval.top(spark, sf_dir).withColumn("title", F.col("source")))


@Q.query("rule_judge", r"""WITH a AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT *, list_filter(string_split_regex(q, '\s+'), lambda x: x <> '') AS words FROM a WHERE role = 'assistant' AND q IS NOT NULL),
m AS (SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 20 THEN 0.8 ELSE 0.3 END::DOUBLE AS p, least(n / 5, 1.0)::DOUBLE AS r, CASE WHEN contains(text, '[1]') OR contains(text, '[2]') THEN 0.8 ELSE 0.3 END::DOUBLE AS f, least(len(list_filter(words, lambda x: contains(text, x))) / greatest(len(words), 1) + 0.3::DOUBLE, 1.0::DOUBLE) AS v FROM w)
SELECT conv_id, turn, round(v, 4) AS relevance, (p + r + 2 + f + v) / 6 >= 0.6 AS passing FROM m""")
def rule_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").withColumn("q", F.lag("text").over(own.orderBy("turn"))).withColumn("n", F.count("*").over(own)).filter("role = 'assistant' AND q IS NOT NULL")
    judged = rows.select("conv_id", "turn", evaluate.rule_judge(F.col("q"), F.col("text"), F.col("n")).alias("j"))
    return judged.select("conv_id", "turn", F.col("j.relevance").alias("relevance"), F.col("j.passing").alias("passing"))


@Q.query("eval_gate", """WITH c AS (SELECT quality::DOUBLE AS f, (length(text) > 500)::INT::DOUBLE AS r, 1.0 - toxic AS a, lang = 'en' AS i FROM documents JOIN labels USING (doc_id))
SELECT round(avg(f) * 0.4 + avg(r) * 0.3 + avg(a) * 0.2 + avg(i::INT) * 0.1, 4) AS overall, round(avg(f), 4) AS faithfulness, round(avg(r), 4) AS context_recall, round(avg(a), 4) AS answer_relevancy, round(avg(i::INT), 4) AS intent_accuracy, avg(f) * 0.4 + avg(r) * 0.3 + avg(a) * 0.2 + avg(i::INT) * 0.1 >= 0.7 AS passed FROM c""")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = rows.select(F.col("quality").cast("double").alias("faithfulness"), (F.length("text") > 500).cast("double").alias("context_recall"), (1.0 - F.col("toxic")).alias("answer_relevancy"), (F.col("lang") == "en").alias("intent_correct"))
    return evaluate.gate(cases)


@Q.query("regression_summary", r"""WITH c AS (SELECT lang = 'en' AS intent_ok, contains(lower(text), 'the')::INT + contains(lower(text), 'ing')::INT AS found, toxic = 0 AS verified FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS cases, count(*) FILTER (intent_ok AND found > 0 AND verified) AS passed, round(count(*) FILTER (intent_ok) / greatest(count(*), 1), 4) AS intent_accuracy, round(sum(found) / greatest(sum(2), 1), 4) AS keyword_rate FROM c""")
def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = F.contains(F.lower("text"), F.lit("the")).cast("int") + F.contains(F.lower("text"), F.lit("ing")).cast("int")
    return evaluate.regression(rows.select((F.col("lang") == "en").alias("intent_ok"), found.alias("found"), F.lit(2).alias("expected"), (F.col("toxic") == 0).alias("verified")))


#: Nine rates of each event type, from the share of its values over some bounds.
RATES = {"hit_at_k": 5, "recall_at_k": 8, "avg_retrieval_score": 20, "citation_present_rate": 1, "groundedness_rate": 4, "refusal_correctness_rate": 2, "verification_pass_rate": 3, "fallback_rate": 30, "tool_success_rate": 2}


@Q.query("gate_thresholds", "WITH m AS (SELECT user_id, " + ", ".join(f"avg((value > {b})::INT) AS {n}" for n, b in RATES.items()) + """ FROM events GROUP BY user_id), f AS (SELECT *, concat_ws(',', CASE WHEN hit_at_k < 0.8 THEN 'hit_at_k' END, CASE WHEN recall_at_k < 0.75 THEN 'recall_at_k' END, CASE WHEN avg_retrieval_score < 0.6 THEN 'avg_retrieval_score' END,
 CASE WHEN citation_present_rate < 0.95 THEN 'citation_present_rate' END, CASE WHEN groundedness_rate < 0.85 THEN 'groundedness_rate' END, CASE WHEN refusal_correctness_rate < 0.9 THEN 'refusal_correctness_rate' END,
 CASE WHEN verification_pass_rate < 0.85 THEN 'verification_pass_rate' END, CASE WHEN fallback_rate > 0.25 THEN 'fallback_rate' END, CASE WHEN tool_success_rate < 0.9 THEN 'tool_success_rate' END) AS failed FROM m)
SELECT user_id, failed, hit_at_k >= 0.8 AND recall_at_k >= 0.75 AND avg_retrieval_score >= 0.6 AS rag, citation_present_rate >= 0.95 AND groundedness_rate >= 0.85 AND refusal_correctness_rate >= 0.9 AS answer, verification_pass_rate >= 0.85 AND fallback_rate <= 0.25 AND tool_success_rate >= 0.9 AS agent, failed = '' AS passes FROM f""")
def gate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.avg((F.col("value") > b).cast("int")).alias(n) for n, b in RATES.items()))
    gated = measured.select("user_id", master.gate({n: F.col(n) for n in RATES}).alias("g"))
    return gated.select("user_id", F.array_join("g.failed", ",").alias("failed"), "g.rag", "g.answer", "g.agent", "g.passes")


@Q.query("priority_budget", """WITH c AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN greatest(1, length(text) // 2) ELSE 0 END) AS q, sum(CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 2) ELSE 0 END) AS d, sum(CASE WHEN role = 'system' THEN greatest(1, length(text) // 2) ELSE 0 END) AS t FROM conversations GROUP BY conv_id),
x AS (SELECT *, least(q, 1000) AS q1 FROM c), y AS (SELECT *, least(d, 1000 - q1) AS d1 FROM x), z AS (SELECT *, least(t, 1000 - q1 - d1) AS t1 FROM y)
SELECT conv_id, q1::BIGINT AS query, d1::BIGINT AS docs, t1::BIGINT AS tools, (1000 - q1 - d1 - t1)::BIGINT AS remaining FROM z""")
def priority_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda role, name: F.sum(F.when(F.col("role") == role, T.estimate_tokens(F.col("text"))).otherwise(0)).alias(name)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tokens("user", "q"), tokens("assistant", "d"), tokens("system", "t"))
    return rows.select("conv_id", evaluate.allocate({"query": F.col("q"), "docs": F.col("d"), "tools": F.col("t")}, 1000).alias("a")).select("conv_id", "a.*")


@Q.query("mock_embedding")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of digests: held against hashlib in the tests."""
    return chunks(spark, sf_dir).select("chunk_id", embed.mock_embedding(F.col("content"), 64).alias("embedding"))


@Q.query("ab_split")
def ab_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws: held against Python's generator in the tests."""
    return table(spark, sf_dir, "customer").select("c_custkey", evaluate.split_version(F.col("c_name"), {"v1": 0.5, "v2": 0.3, "v3": 0.2}).alias("version"))


@Q.query("page_outline")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and Markdown headings with offsets: held against fixtures in the tests."""
    return documents.sections(chunks(spark, sf_dir))


@Q.query("entity_mentions")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with offsets: held against fixtures in the tests."""
    return graph.extract_entities(chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")))


@Q.query("event_tail", "SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(1000).select("event_id", "ts", "event_type")


@Q.query("prompt_history", "SELECT c_nationkey AS prompt, arg_max(c_name, c_custkey) AS active, count(*) AS versions, arg_max(c_acctbal, c_custkey) AS metric FROM customer GROUP BY c_nationkey")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("prompt")).agg(F.max_by("c_name", "c_custkey").alias("active"), F.count("*").alias("versions"), F.max_by("c_acctbal", "c_custkey").alias("metric"))


@Q.query("template_answer", retrieval.BASE + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM top) SELECT query_id, string_agg('[' || rank || '] ' || source, '; ' ORDER BY rank) AS answer FROM f WHERE own = 1 GROUP BY query_id""")
def template_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("query_id", "source").orderBy("rank")
    rows = retrieval.top(spark, sf_dir).withColumn("own", F.row_number().over(first)).filter("own = 1")
    line = F.struct("rank", F.concat(F.lit("["), "rank", F.lit("] "), "source").alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["x"]), "; ").alias("answer"))


@Q.query("incremental_reports", "SELECT n_regionkey AS run, sum(c_acctbal > 0)::BIGINT AS added, count(*) AS total, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS notes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def incremental_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("run"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").groupBy("run").agg(F.count_if(F.col("c_acctbal") > 0).alias("added"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("notes"))
