"""The graph of parts and suppliers: an edge for each pair in lineitem, weighted by mean quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph
from quern.plans.registry import Registry
from quern.sources.tables import table

Q = Registry()

EDGES_SQL = """edges AS (SELECT l_partkey * 100000 + l_suppkey AS edge_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN any_value(l_partkey) % 3 = 0 THEN 'DEPENDS_ON' ELSE 'SUPPLIED_BY' END AS rel, avg(l_quantity) / 50 AS weight
 FROM lineitem GROUP BY l_partkey, l_suppkey),
both_ways AS (SELECT edge_id, src, dst, rel, weight FROM edges UNION ALL SELECT edge_id, dst, src, rel, weight FROM edges), seeds AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0)"""
ONE_SQL = """one AS (SELECT seed, edge_id, dst AS node, rel, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, dst, edge_id) AS rank FROM seeds JOIN both_ways ON seed = src WHERE dst <> seed)"""
TWO_SQL = """two AS (SELECT seed, a.dst AS mid, b.dst AS node, a.rel || ',' || b.rel AS rels, round(a.weight * b.weight, 6) AS weight, row_number() OVER (PARTITION BY seed ORDER BY round(a.weight * b.weight, 6) DESC, b.dst, a.dst, a.edge_id, b.edge_id) AS rank
 FROM seeds JOIN both_ways a ON seed = a.src JOIN both_ways b ON a.dst = b.src WHERE b.dst <> seed AND a.dst <> seed AND b.dst <> a.dst AND a.edge_id <> b.edge_id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.avg("l_quantity") / 50).alias("weight"))
    rel = F.when(F.col("l_partkey") % 3 == 0, "DEPENDS_ON").otherwise("SUPPLIED_BY")
    return rows.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("edge_id"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), rel.alias("rel"), "weight")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries: parts whose key is divisible by 20."""
    return table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("seed"))


@Q.query("graph_1hop", f"WITH {EDGES_SQL}, {ONE_SQL} SELECT seed, edge_id, node, rel, round(weight, 6) AS weight, rank FROM one WHERE rank <= 20")
def graph_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_hop(seeds(spark, sf_dir), edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@Q.query("graph_2hop", f"WITH {EDGES_SQL}, {TWO_SQL} SELECT * FROM two WHERE rank <= 15")
def graph_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(seeds(spark, sf_dir), edges(spark, sf_dir), digits=6)


@Q.query("path_score", f"""WITH {EDGES_SQL}, {ONE_SQL}, {TWO_SQL}, p AS (SELECT node AS chunk_id, seed, weight, 1 AS hops FROM one WHERE rank <= 20 UNION ALL SELECT node, seed, weight, 2 FROM two WHERE rank <= 15),
g AS (SELECT chunk_id, count(DISTINCT seed) AS seeds, avg(weight) AS weight, avg(hops) AS hops FROM p GROUP BY chunk_id)
SELECT chunk_id, round(0.4::DOUBLE * least(1.0, seeds / 100) + 0.3::DOUBLE * least(1.0, weight) + 0.2::DOUBLE * (chunk_id LIKE 'p%')::INT + 0.1::DOUBLE / greatest(hops, 1.0), 6) AS score FROM g""")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = graph_1hop(spark, sf_dir).select(F.col("node").alias("chunk_id"), "seed", "weight", F.lit(1).alias("hops"))
    two = graph_2hop(spark, sf_dir).select(F.col("node").alias("chunk_id"), "seed", "weight", F.lit(2).alias("hops"))
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.col("p_name").alias("content"))
    return graph.path_scores(one.unionByName(two), names, 100, 6)


@Q.query("path_relations", f"WITH {EDGES_SQL}, {TWO_SQL} SELECT DISTINCT rels FROM two WHERE rank <= 15")
def path_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_2hop(spark, sf_dir).select("rels").distinct()


@Q.query("path_summary", f"WITH {EDGES_SQL}, {TWO_SQL} SELECT seed, string_agg(seed || ' -> ' || mid || ' -> ' || node, '; ' ORDER BY rank) AS summary FROM two WHERE rank <= 10 GROUP BY seed")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct("rank", F.concat_ws(" -> ", "seed", "mid", "node").alias("x"))
    return graph_2hop(spark, sf_dir).filter("rank <= 10").groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["x"]), "; ").alias("summary"))


@Q.query("evidence_lookup", f"WITH {EDGES_SQL}, {ONE_SQL} SELECT seed, node, p_name FROM one JOIN part ON 'p' || p_partkey = seed WHERE rank <= 20")
def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("seed"), "p_name")
    return graph_1hop(spark, sf_dir).join(parts, "seed").select("seed", "node", "p_name")


@Q.query("entity_match", """WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part), e AS (SELECT DISTINCT p_name AS name FROM part),
h AS (SELECT term, name, CASE WHEN lower(name) = term THEN 1.0 WHEN starts_with(lower(name), term) THEN 0.8 ELSE 0.6 END::DOUBLE AS score FROM t JOIN e ON contains(lower(name), term)),
b AS (SELECT *, max(score) OVER (PARTITION BY term) AS best FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY name) AS rank FROM b WHERE score = best) SELECT term, name, score FROM r WHERE rank <= 30""")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    terms = parts.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).distinct()
    return graph.match_entities(terms, parts.select(F.col("p_name").alias("name")).distinct())


@Q.query("cooccurrence_edges", """WITH w(name, kind) AS (VALUES ('the', 'A'), ('ing', 'B'), ('tion', 'C'), ('que', 'D')), m AS (SELECT doc_id AS chunk_id, name, kind, instr(lower(text), name) - 1 AS pos FROM documents, w WHERE contains(lower(text), name))
SELECT a.chunk_id, a.name AS "left", b.name AS "right", round(greatest(0.1, 1 - (b.pos - a.pos) / 300), 2) AS weight FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.kind <> b.kind AND (a.pos < b.pos OR (a.pos = b.pos AND a.name < b.name)) AND b.pos - a.pos <= 300""")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in (("the", "A"), ("ing", "B"), ("tion", "C"), ("que", "D"))]))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("low"), names.alias("w"))
    mentions = docs.select("chunk_id", "w.name", "w.kind", (F.expr("instr(low, w.name)") - 1).alias("pos")).filter("pos >= 0")
    return graph.cooccurrence(mentions)


@Q.query("mentions_merge", "SELECT DISTINCT 'p' || l_partkey AS chunk, 's' || l_suppkey AS entity FROM lineitem")
def mentions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("chunk"), F.concat(F.lit("s"), "l_suppkey").alias("entity")), "chunk", "entity")


@Q.query("relation_first", "SELECT l_partkey, l_suppkey, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS rel, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_partkey, l_suppkey")
def relation_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min_by("l_returnflag", seq).alias("rel"), F.min(seq).alias("seq"))
