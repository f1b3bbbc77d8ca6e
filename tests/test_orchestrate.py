"""Modes, degradation, expansion and the agent's cache, on small tables."""

from quern.operators import orchestrate

Q = "query_id long, query string, mode string, graph_state string"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")


def test_modes_and_levels(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta MyClass")], "chunk_id long, content string")
    asked_of = {"keyword": [], "vector": [], "graph": [], "last": []}

    def source(name, found):
        def run(queries):
            rows = {r.query_id: r.query for r in queries.collect()}
            asked_of[name].append(rows)
            return hits(spark, [(q, c, r) for q in rows for c, r in found.get(q, [])])

        return run

    def graph(queries):
        ids = [r.query_id for r in queries.collect()]
        asked_of["graph"].append(ids)
        rows = [(q, 3, 1, ["Alpha", "omega"], ["CALLS"]) for q in ids if q in (1, 3)]
        return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, entities array<string>, relations array<string>")

    queries = [(1, "alpha", "graph_first", "on"), (2, "beta", "graph_first", "on"), (3, "gamma", "parallel", "on"), (4, "gamma", "parallel", "failed"), (5, "x", "hybrid_only", "off"), (6, "y", "odd", "on"), (7, "z", "keyword_first", "off")]
    keyword, vector = source("keyword", {1: [(1, 1)], 2: [(1, 1)], 3: [(2, 1)], 4: [(2, 1)]}), source("vector", {3: [(1, 6)], 6: [(2, 1)]})
    found, trace = orchestrate.retrieve(spark.createDataFrame(queries, Q), chunks, keyword, vector, graph, source("last", {5: [(2, 1)]}), 2)
    rows = {r.query_id: r for r in trace.collect()}
    got = {q: (r.method, r.degraded_from, r.degraded_to, r.level) for q, r in rows.items()}
    assert got == {
        1: ("rrf_three_way_graph_first", "", "", "fused"), 2: ("rrf_two_way", "graph_first", "hybrid_only", "fused"), 3: ("rrf_three_way", "", "", "fused"), 4: ("rrf_two_way_renormalised", "parallel", "parallel_keyword_vector_only", "fused"),
        5: ("rrf_two_way", "graph_unavailable", "hybrid_only", "last"), 6: ("rrf_two_way", "odd", "hybrid_only", "fused"), 7: ("rrf_two_way", "keyword_first", "hybrid_only", "none"),
    }
    assert sorted(asked_of["graph"][0]) == [1, 2, 3]  # only queries that want it
    assert set(asked_of["last"][0]) == {5, 7}
    # paths' names, keywords of CALLS and an identifier of the chunk, longest first; not the query's own word
    assert asked_of["keyword"][0][1] == "alpha MyClass omega 执行 调用" and asked_of["keyword"][0][2] == "beta" and rows[1].terms == 4
    assert rows[3].vector_hits == 0  # its rank is beyond what the plan takes
    assert {(r.query_id, r.chunk_id, r.rerank_score) for r in found.collect() if r.query_id == 1} == {(1, 1, round(0.5 + 0.5 * round(0.2 / 61, 8), 6)), (1, 3, round(0.5 * round(0.5 / 61, 8), 6))}


def test_weights_sum_to_one():
    totals = {}
    for plan, method, _, w, _ in orchestrate.weight_rows():
        totals[plan, method] = totals.get((plan, method), 0) + w
    assert len(totals) == 13 and all(abs(t - 1) < 1e-9 for t in totals.values())


def test_agent(spark):
    schema = "scope string, key string, hits array<struct<rank: int, chunk_id: bigint, score: double>>"
    seen = []

    def workflow(queries):
        rows = [(r.query_id, r.query) for r in queries.collect()]
        seen.append(sorted(q for _, q in rows))
        known = {"good": 0.9, "的 poor": 0.05, "poor": 0.5, "weak": 0.01}
        return spark.createDataFrame([(i, 7, known[q], 1) for i, q in rows if q in known], "query_id long, chunk_id long, score double, rank int")

    requests = spark.createDataFrame([(1, "a", "good"), (2, "a", " GOOD "), (3, "b", "good"), (4, "a", "的 poor"), (5, "a", "nothing"), (6, "a", "weak")], "request_id long, scope string, query string")
    answers, gained = orchestrate.answer_requests(requests, spark.createDataFrame([], schema), workflow)
    got = {r.request_id: (r.path, r.attempts, [h.score for h in r.hits]) for r in answers.collect()}
    # 1 and 2 are one key; the rewrite helps 4, finds nothing for 5, and for 6 the weak hit stays
    assert got == {1: ("workflow", 1, [0.9]), 2: ("workflow", 1, [0.9]), 3: ("workflow", 1, [0.9]), 4: ("workflow", 2, [0.5]), 5: ("fail", 2, []), 6: ("workflow", 2, [0.01])}
    assert len(seen[0]) == 5 and gained.count() == 4
    again, more = orchestrate.answer_requests(requests.filter("scope = 'a'"), gained, workflow)
    assert {r.request_id: r.path for r in again.collect()} == {1: "cache_hit", 2: "cache_hit", 4: "cache_hit", 5: "fail", 6: "cache_hit"} and more.count() == 0
    assert seen[2] == ["nothing"]


def test_terms_of_path_ends_only(spark, sf_dir):
    """Texts and words are looked through for chunks of paths, not to filter all chunks first."""
    from quern.operators.lineage import cut
    from quern.plans import orchestration, retrieval

    docs, queries = retrieval.chunks(spark, sf_dir).select("chunk_id", "content"), retrieval.asked(spark, sf_dir)
    paths = cut(spark.createDataFrame([(1, 5, ["Alpha"], ["PART_OF"])], "query_id long, chunk_id long, entities array<string>, relations array<string>"))
    expanded = orchestrate.expand_queries(queries, paths, docs)
    for df in (expanded, orchestration.long_words(docs, "chunk_id", "content")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" in plan and not any("Filter" in line and "regexp_extract_all" in line for line in plan.splitlines())
    assert {"Alpha", "包含", "组成"} <= set(next(r.terms for r in expanded.collect() if r.query_id == 1))
