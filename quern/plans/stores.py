"""Repository reads and writes on orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import Registry
from quern.sources.tables import delete_keys, latest, table, upsert

Q = Registry()


@Q.query("repo_topn", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def repo_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", "o_custkey", "o_totalprice")


@Q.query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey = 42").select("c_custkey", "c_name")


@Q.query("conjunction_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def conjunction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select("c_custkey")


@Q.query("keyed_upsert", """WITH n AS (SELECT c_custkey + 500 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE '' END AS c_name, c_mktsegment FROM customer)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_name IS NOT NULL AND n.c_name <> '' THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN n.c_mktsegment IS NOT NULL AND n.c_mktsegment <> '' THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.select((F.col("c_custkey") + 500).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise("").alias("c_name"), "c_mktsegment")
    return upsert(old, new, "c_custkey")


@Q.query("delete_by_key", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return delete_keys(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@Q.query("checkpoint_latest", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), "o_orderstatus", "o_orderkey")


@Q.query("index_stats", "SELECT count(*) AS docs, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS chars FROM documents")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


@Q.query("unified_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, substr(text, 1, 200) AS content, 'keyword' AS source, lang AS doc_type, 0.0::DOUBLE AS score FROM documents")
def unified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("content"), F.lit("keyword").alias("source"), F.col("lang").alias("doc_type"), F.lit(0.0).alias("score"))


@Q.query("permission_gate", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 1000 AS allowed, CASE WHEN c_acctbal > 5000 THEN 'admin' WHEN c_acctbal > 0 THEN 'user' ELSE 'guest' END AS tier FROM customer")
def permission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.filter(F.array(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "read"), F.when(F.col("c_acctbal") > 1000, "spend")), lambda x: x.isNotNull())
    allowed = F.size(F.array_except(F.array(F.lit("read"), F.lit("spend")), have)) == 0
    return table(spark, sf_dir, "customer").select("c_custkey", allowed.alias("allowed"), F.when(F.col("c_acctbal") > 5000, "admin").when(F.col("c_acctbal") > 0, "user").otherwise("guest").alias("tier"))


@Q.query("tenant_rollup", "SELECT n_name AS tenant, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def tenant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tenant"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").groupBy("tenant").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
