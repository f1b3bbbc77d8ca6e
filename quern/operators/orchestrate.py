"""Retrieval of a table of queries of different modes in one plan, and an agent with a cache before it.

Each source is asked once, for just the queries that need it; a query whose graph search fails or finds nothing falls to the
next level, and a trace says which way it went.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.lineage import cut
from quern.operators.route import PLANS, recovery_rewrite
from quern.operators.search import ranked

#: A source takes (query_id, query) and gives (query_id, chunk_id, rank), the best first.
Source = Callable[[DataFrame], DataFrame]

#: Keywords of relations on a path, what counts as a term of a text, and the rank constant of the fusion.
RELATION_WORDS = {
    "RELATED_TO": ("相关", "关联"), "DEPENDS_ON": ("依赖", "需要"), "CALLS": ("调用", "执行"), "BELONGS_TO": ("属于", "模块"), "CAUSES": ("导致", "原因", "引发"),
    "FIXES": ("修复", "解决"), "PART_OF": ("包含", "组成"), "HAS_LIFECYCLE": ("生命周期",), "AFFECTS": ("影响", "波及"),
}
KEY_TERMS = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[A-Z_]{4,}\b", r"@ohos\.\w+(?:\.\w+)*"
MODE_PLANS = {"hybrid_only": "hybrid_only", "graph_first": "graph_first", "parallel": "default", "keyword_first": "deep_keyword", "vector_first": "deep_vector"}
GRAPH_MODES = tuple(m for m in MODE_PLANS if m != "hybrid_only")
RRF_K = 60


def key_terms(c: Column, most: int = 5) -> Column:
    """The first identifiers of a text, kind by kind, each once whatever its case."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit(f"({p})"), 1) for p in KEY_TERMS))
    return F.slice(T.ordered_distinct(found), 1, most)


def expand_queries(queries: DataFrame, paths: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """(query_id, query, terms): queries with up to ``most`` terms of their graph paths added, the longest first, ties by the term.

    paths (query_id, chunk_id, entities, relations: arrays of names). Terms are the names on a query's paths, keywords of
    the relations, and five terms of each chunk (chunk_id, content) that a path ends in; not the query's own words, nor single characters.
    """
    words = F.create_map(*(x for rel, names in RELATION_WORDS.items() for x in (F.lit(rel), F.array(*map(F.lit, names)))))
    none = F.array().cast("array<string>")
    named = F.concat("entities", F.flatten(F.transform("relations", lambda r: F.coalesce(F.try_element_at(words, r), none))))
    held = chunks.select("chunk_id", "content").join(paths.select("chunk_id").distinct(), "chunk_id", "left_semi")  # so only these are looked through for terms; explode would filter all by them
    ends = paths.select("query_id", "chunk_id").distinct().join(held.select("chunk_id", key_terms(F.col("content")).alias("found")), "chunk_id")
    terms = paths.select("query_id", F.explode(named).alias("term")).unionByName(ends.select("query_id", F.explode_outer("found").alias("term"))).distinct()
    new = terms.join(queries.select("query_id", T.words(F.col("query")).alias("own")), "query_id").filter((F.length("term") >= 2) & ~F.array_contains("own", F.lower("term")))
    best = ranked(new, "query_id", [F.desc(F.length("term")), F.col("term")], most)
    listed = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    joined = queries.join(listed, "query_id", "left").withColumn("terms", F.coalesce("terms", none))
    return joined.withColumn("query", F.when(F.size("terms") > 0, F.concat("query", F.lit(" "), F.array_join("terms", " "))).otherwise(F.col("query")))


def retrieve(queries: DataFrame, chunks: DataFrame, keyword: Source, vector: Source, graph: Callable[[DataFrame], DataFrame], last: Source, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, chunk_id, rerank_score, rank) and a trace of queries (query_id, query, mode, graph_state).

    graph gives paths (query_id, chunk_id, rank, entities, relations). Its state is on, off or failed. By mode:
    hybrid_only asks keyword and vector search. graph_first asks the graph and then these two with the expanded query; without any
    paths it is hybrid_only. The other three ask all at once and go without the graph if it has nothing. Where the graph is off or a mode is unknown it is
    hybrid_only. What the lists hold is fused by the ranks and weights of the mode's plan, twice k rows are ranked again by the words they share with
    the query, and queries without any hit ask the last source.
    trace: method, degraded_from, degraded_to ('' if not), hits of each source, terms added, level (fused, last or none).
    """
    state, mode = F.col("graph_state"), F.col("mode")
    wants = mode.isin(*GRAPH_MODES) & (state != "off")
    asked = queries.select("query_id", "query", "mode", "graph_state", (wants & (state == "on")).alias("asks"))
    paths = cut(graph(asked.filter("asks").select("query_id", "query")))
    counts = lambda hits, name: hits.groupBy("query_id").agg(F.countDistinct("chunk_id").alias(name))
    asked = asked.join(counts(paths, "graph_hits"), "query_id", "left").fillna(0, ["graph_hits"])
    has = F.col("graph_hits") > 0
    method = F.when(~wants | ((mode == "graph_first") & ~has), "rrf_two_way").when(mode == "graph_first", "rrf_three_way_graph_first").when(has, "rrf_three_way").otherwise("rrf_two_way_renormalised")
    down = F.when((state == "off") & (mode == "hybrid_only"), "graph_unavailable").when((state == "off") | ~mode.isin("hybrid_only", *GRAPH_MODES), mode).when((mode == "graph_first") & ~has, "graph_first").when(wants & (state == "failed"), mode).otherwise("")
    to = F.when(down == "", "").when(wants & (state == "failed") & (mode != "graph_first"), "parallel_keyword_vector_only").otherwise("hybrid_only")
    asked = asked.withColumns({"method": method, "degraded_from": down, "degraded_to": to})
    first = asked.filter("method = 'rrf_three_way_graph_first'")
    expanded = expand_queries(first.select("query_id", "query"), paths.join(first.select("query_id"), "query_id", "left_semi"), chunks)
    searched = cut(asked.filter("method <> 'rrf_three_way_graph_first'").select("query_id", "query", F.array().cast("array<string>").alias("terms")).unionByName(expanded))
    lists = {"keyword": keyword(searched.select("query_id", "query")), "vector": vector(searched.select("query_id", "query"))}
    lists["graph"] = paths.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    plan = F.when(F.col("method") == "rrf_two_way", "hybrid_only").otherwise(F.col("mode")).alias("plan")
    weights = queries.sparkSession.createDataFrame(weight_rows(), "plan string, method string, list string, w double, most int")
    counted = _union(lists).join(asked.select("query_id", "method", plan), "query_id").join(F.broadcast(weights), ["plan", "method", "list"])  # a row for each mode and list
    hits = cut(counted.filter("rank <= most").select("query_id", "chunk_id", "rank", "list", "w"))
    fused = hits.filter("w > 0").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 8).alias("score"))
    fused = ranked(fused, "query_id", [F.desc("score"), F.col("chunk_id")], 2 * k).select("query_id", "chunk_id", "score")
    missed = asked.select("query_id", "query").join(fused.select("query_id").distinct(), "query_id", "left_anti")
    rescue = last(missed).filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    found = cut(fused.withColumn("level", F.lit("fused")).unionByName(rescue.withColumn("level", F.lit("last"))))
    words = chunks.select("chunk_id", "content").join(found, "chunk_id").join(asked.select("query_id", "query"), "query_id")  # few hits first, so texts need no shuffle
    shared = F.size(F.array_intersect(T.word_set(F.col("query")), T.word_set(F.col("content"))))
    scored = words.select("query_id", "chunk_id", F.round(F.col("score") * 0.5 + shared * 0.5, 6).alias("rerank_score"))
    tally = lambda name: counts(hits.filter(F.col("list") == name), f"{name}_hits")
    trace = asked.join(tally("keyword"), "query_id", "left").join(tally("vector"), "query_id", "left").join(searched.select("query_id", F.size("terms").alias("terms")), "query_id")
    trace = trace.join(found.groupBy("query_id").agg(F.first("level").alias("level")), "query_id", "left").fillna(0, ["keyword_hits", "vector_hits"]).fillna("none", ["level"])
    columns = ["query_id", "mode", "method", "degraded_from", "degraded_to", "keyword_hits", "vector_hits", "graph_hits", "terms", "level"]
    return ranked(scored, "query_id", [F.desc("rerank_score"), F.col("chunk_id")], k), trace.select(*columns)


def _union(lists: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("query_id", "chunk_id", "rank", F.lit(name).alias("list")) for name, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def weight_rows() -> list[tuple[str, str, str, float, int]]:
    """(plan, method, list, w, most): what a list's ranks count, and how many of them; without the graph the other two are scaled to a sum of 1."""
    rows = []
    for mode, name in MODE_PLANS.items():
        plan, lists = PLANS[name], ("keyword", "vector", "graph")
        rest = plan["keyword"] + plan["vector"]
        for method in ("rrf_two_way",) if mode == "hybrid_only" else ("rrf_three_way", "rrf_three_way_graph_first", "rrf_two_way_renormalised"):
            scale = 1 / rest if method.startswith("rrf_two") else 1.0
            rows += [(mode, method, x, plan[x] * scale, plan[f"{x}_k"]) for x in lists if x != "graph" or scale == 1.0 and method != "rrf_two_way"]
    return rows


def answer_requests(requests: DataFrame, cache: DataFrame, workflow: Callable[[DataFrame], DataFrame], weak: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Results (request_id, path, attempts, hits) of requests (request_id, scope, query), and what the cache gains.

    hits is an array of structs (rank, chunk_id, score), best first. The cache (scope, key, hits) is asked first, by scope and the query's key. Only
    misses run the workflow, which takes (query_id, query) and gives (query_id, chunk_id, score, rank), and each different query of a scope
    once. Those with no hits, or with none of a score of ``weak`` or more, run it again with the recovery rewrite; if that finds
    nothing either, what the first run found stays. path: cache_hit, workflow or fail. Results with hits are gained, one a scope and key.
    """
    keyed = requests.withColumn("key", T.query_key(F.col("query")))
    known = keyed.join(cache.select("scope", "key", F.col("hits").alias("cached")), ["scope", "key"], "left")
    open_ = cut(known.filter("cached IS NULL").groupBy("scope", "key").agg(F.min("request_id").alias("query_id"), F.min_by("query", "request_id").alias("query")))
    listed = lambda hits: hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    first = cut(open_.join(listed(workflow(open_.select("query_id", "query"))), "query_id", "left"))
    poor = F.coalesce(F.forall("hits", lambda h: h["score"] < weak), F.lit(True))
    again = first.filter(poor).select("query_id", recovery_rewrite(F.col("query")).alias("query"))
    second = listed(workflow(again)).withColumnRenamed("hits", "more")
    tried = cut(first.withColumn("poor", poor).join(second, "query_id", "left").select("scope", "key", F.coalesce("more", "hits").alias("hits"), F.when(F.col("poor"), 2).otherwise(1).alias("attempts")))
    joined = known.join(tried.withColumnRenamed("hits", "own"), ["scope", "key"], "left")
    hits = F.coalesce("cached", "own", F.expr("cast(array() as array<struct<rank: int, chunk_id: bigint, score: double>>)"))
    path = F.when(F.col("cached").isNotNull(), "cache_hit").when(F.col("own").isNotNull(), "workflow").otherwise("fail")
    return joined.select("request_id", path.alias("path"), F.coalesce("attempts", F.lit(0)).alias("attempts"), hits.alias("hits")), tried.filter("hits IS NOT NULL").select("scope", "key", "hits")
