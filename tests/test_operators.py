"""Operators that SQL can't express, and those that the driver's tables don't reach, on fixtures and plain loops."""

import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, chunking, conflicts, dedup, documents, embed, evaluate, fusion, graph, memory, monitor, rank, route, search
from quern.plans import retrieval
from quern.sources import tables
from quern.streaming import replay


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, "  a\x00b\t\tc\r\nd\re\n\n\n\nf，，g。。h \x7f ", T.clean_text(F.col("x"))) == "ab c\nd\ne\n\nf，g。h"


def test_tokens_of_other_scripts(spark):
    assert one(spark, "A b　C  a", T.word_set(F.col("x"))) == ["a", "b", "c"]
    assert one(spark, "配置 ArkTS的router x 错误码", T.query_keywords(F.col("x"))) == ["配置", "ArkTS的router", "错误码"]
    assert one(spark, "用API和路由 x1", T.memory_terms(F.col("x"))) == ["api", "x1", "和路由"]


def test_summary_and_estimate(spark):
    assert one(spark, "a\nb", T.summary(F.col("x"))) == "a b"
    assert one(spark, "x" * 121, T.summary(F.col("x"))) == "x" * 117 + "..."
    assert [one(spark, x, T.estimate_tokens(F.col("x"))) for x in ("", "a", "abc", None)] == [0, 1, 1, 0]


def test_code(spark):
    text = "ab\n```py\nx\n```\ncd"
    assert one(spark, text, T.code_density(F.col("x"))) == pytest.approx(13 / 19, abs=0.06)
    assert one(spark, text, T.has_code(F.col("x"))) and not one(spark, "``` open", T.has_code(F.col("x")))
    assert one(spark, "![a](b.png) [1] （见2020年）", F.concat(T.image_refs(F.col("x")), T.citations(F.col("x")))) == ["b.png", "[1]", "（见2020年）"]


def test_claims(spark):
    assert one(spark, "One is here. 二是这样。 No! ok", T.split_claims(F.col("x"))) == ["One is here.", "二是这样。"]


def test_longest_first_is_stable(spark):
    assert one(spark, "bb a cc ddd", T.longest_first(F.split("x", " "))) == ["ddd", "bb", "cc", "a"]
    assert one(spark, "B a b A", T.ordered_distinct(F.split("x", " "))) == ["B", "a"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        ("", 10, []), ("a\n\nb\n\nc", 10, ["a\n\nb\n\nc"]), ("aaaa\n\nbbbb\n\ncccc", 8, ["aaaa\n\nbbbb", "cccc"]),
        ("aaaa\nbbbb\ncccc", 8, ["aaaa\nbbbb", "cccc"]), ("x" * 20, 8, ["x" * 20]), ("ab\n\n" + "c" * 6 + "\n" + "d" * 6, 8, ["ab", "c" * 6, "d" * 6]),
        ("aaaa\nbbbb\ncc\n\ndd", 8, ["aaaa\nbbbb", "cc\n\ndd"]), (" a \n\n \n\n b ", 10, ["a\n\nb"]),
    ],
)
def test_chunks(text, size, want):
    assert chunking.pack_lines(text, size) == want


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("s", "aaaa\n\nbbbb\n\ncccc"), ("t", None), ("u", "")], "source string, content string")
    rows = chunking.chunk_documents(docs, 8).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.content, r.tenant_id, len(r.content_hash)) for r in rows] == [("s_0", "aaaa\n\nbbbb", "default", 16), ("s_1", "cccc", "default", 16)]


def test_similar_pairs_without_a_band_in_common(spark):
    """Pairs just above the threshold, among them those on different sides of planes in each of 12 bands of 6."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 60_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = np.random.default_rng(11).choice([-1.0, 1.0], size=(12 * 6, 64))
    apart = ~((x @ planes.T > 0) == (y @ planes.T > 0)).reshape(-1, 12, 6).all(2).any(1)
    assert apart.any()
    held = np.concatenate([x[apart], y[apart], x[:20], y[:20]])
    cosines = np.round(held @ held.T, 6)
    want = {(i, j) for i in range(len(held)) for j in range(i + 1, len(held)) if cosines[i, j] >= 0.95}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id long, embedding array<double>")
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 64, 0.95).collect()} == want


def test_greedy_keep(spark):
    rng = random.Random(0)
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), *{tuple(sorted(rng.sample(range(10, 80), 2))) for _ in range(120)}]
    ids = list(range(85))
    near = {frozenset(p) for p in pairs}
    kept: list = []
    for i in ids:
        if not any(frozenset((i, j)) in near for j in kept):
            kept.append(i)
    found = dedup.greedy_keep(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.id for r in found.collect()) == kept


def test_similar_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, [x + rng.gauss(0, 0.05) for x in rows[i][1]]) for i in range(20)]
    found = {(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 8, 0.97).collect()}
    assert {(i, 100 + i) for i in range(20)} <= found


def test_rrf(spark):
    lists = {"keyword": [(1, 10, 1), (1, 11, 2)], "vector": [(1, 11, 1), (1, 12, 2)], "graph": [(1, 99, 1)]}
    frames = {s: spark.createDataFrame(r, "query_id long, chunk_id long, rank int") for s, r in lists.items()}
    weights = {"keyword": 0.4, "vector": 0.6, "graph": 0.0}
    got = {r.chunk_id: (r.score, r.matched) for r in fusion.rrf(frames, weights).collect()}
    assert got == {10: (round(0.4 / 61, 8), "keyword"), 11: (round(0.4 / 62 + 0.6 / 61, 8), "keyword,vector"), 12: (round(0.6 / 62, 8), "vector")}
    back = {r.chunk_id: r.score for r in fusion.rrf(dict(reversed(frames.items())), weights).collect()}
    assert back == {c: s for c, (s, _) in got.items()}


def test_weights():
    assert sum(fusion.renormalised({"a": 0.3, "b": 0.5, "c": 0.2}, {"a", "c"}).values()) == pytest.approx(1)
    assert fusion.renormalised({"a": 0.0, "b": 0.0}, {"a", "b"}) == {"a": 0.5, "b": 0.5}
    assert len(fusion.intent_weights()) == 72


def test_select_evidence(spark):
    rng = random.Random(2)
    rows = [(q, c, rng.choice("ab"), rng.choice("xyz"), rng.randrange(3), round(rng.random(), 3)) for q in range(6) for c in range(12)]
    found = rank.select_evidence(spark.createDataFrame(rows, "query_id long, chunk_id long, source string, title string, bucket int, evidence_score double"), 4)
    got: dict = {}
    for r in found.orderBy("query_id", "evidence_index").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(6):
        sources, titles, kept = set(), set(), []
        for _, c, s, t, _, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (r[4], -r[5], r[1])):
            if len(kept) < 4 and not (s in sources and t in titles):
                sources.add(s)
                titles.add(t)
                kept.append(c)
        assert got[q] == kept


def test_search_cascade_and_minimum(spark):
    a = spark.createDataFrame([(1, 5, 0.9, 1)], "query_id long, chunk_id long, score double, rank int")
    b = spark.createDataFrame([(1, 6, 0.5, 1), (2, 7, 0.2, 1)], "query_id long, chunk_id long, score double, rank int")
    assert {(r.query_id, r.chunk_id, r.level) for r in search.cascade(a, b).collect()} == {(1, 5, 1), (2, 7, 2)}
    assert {(r.query_id, r.chunk_id) for r in search.at_least(b, 0.4, 1).collect()} == {(1, 6), (2, 7)}


def test_intents_and_plans(spark):
    q = ["ArkTS 报错 16000001 怎么办", "API 10 升级到 API 12 的迁移", "什么是 Stage 模型", "给我一个 router 示例代码", "hello"]
    rows = spark.createDataFrame([(x,) for x in q], "x string")
    got = [r[0] for r in rows.select(route.intents(F.col("x"))).collect()]
    assert got[0][0] == "error_diagnosis" and got[1][0] == "migration" and got[2] == ["concept_qa"] and "code_generation" in got[3] and got[4] == ["concept_qa"]
    plans = [r[0] for r in rows.select(route.plan_name(F.col("x"), F.lit(True))).collect()]
    assert plans == ["exact", "exact", "semantic", "default", "default"]
    assert {r[0] for r in rows.select(route.plan_name(F.col("x"), F.lit(False))).collect()} == {"hybrid_only"}
    assert one(spark, "A 依赖 B 吗", route.plan_name(F.col("x"), F.lit(True))) == "graph_first"
    assert one(spark, "A 依赖 B 吗", route.plan_name(F.col("x"), F.lit(True), F.lit("concept_qa"))) == "deep_vector"
    assert got[0] == ["error_diagnosis"] or got[0][0] == "error_diagnosis"
    assert one(spark, "项目白屏 demo", route.intents(F.col("x"))) == ["code_generation", "project_debug", "error_diagnosis"]
    assert one(spark, "编译失败 permission denied", route.scenarios(F.col("x"))) == ["permission_error", "build_error"]
    assert one(spark, "", route.tools(F.lit("error_diagnosis"), F.array(F.lit("permission_error"), F.lit("build_error")))) == ["keyword_search", "vector_search", "error_diagnosis_search", "official_doc_search", "version_compatibility_check", "ticket_search"]
    assert one(spark, "", route.tools(F.lit("project_debug"), F.array(F.lit("build_error")))) == ["keyword_search", "vector_search"]
    assert [one(spark, x, route.query_type(F.col("x"))) for x in ("为什么", "工单 版本", "如何 配置")] == ["semantic", "keyword", "mixed"]


def test_intents_by_plain_strings(spark):
    """Every alternative in either case, alone, inside and cut short, and letters that Java folds, give what the whole patterns give; none of these is run over a text."""
    texts = [None, "", "x" * 3000, "ANR 和 API 区别", "H\u0130", "de\u017fcription DEBUG", "HV\u0130GOR f\u0131ll", "Desig\u017fn bui\u212ad IDE \u0130DE oom", "install\nfail", "启动\r了卡住", "GET\u3000请求 @ohos.é"]
    for p in route.INTENT_PATTERNS.values():
        for x in p.split("|"):
            said = [re.sub(r"\.\*|\\s\*|\\w\+", y, x) for y in ("", " a ", "\n")]
            texts += [*said, *(y.upper() for y in said), *(f"é{y.title()}e" for y in said), said[0][1:], said[0][:-1], said[0].replace("i", "\u0131").replace("s", "\u017f").replace("k", "\u212a"), said[1].replace("I", "\u0130")]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    x = F.col("x")
    got = rows.select("x", *[route.names_any(x, route.any_case(x), p).eqNullSafe(x.rlike(route.ANY_CASE + p)).alias(n) for n, p in route.INTENT_PATTERNS.items()])
    assert [r for r in got.collect() if not all(r[1:])] == []
    plan = rows.select(route.intents(x))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan and not any("|" in p for p in re.findall(r"RLIKE (.*?)\)", plan))


def test_entities_by_strings_first(spark, monkeypatch):
    """Patterns are tried only where their strings are, and no mention is lost: of all strings in either case, with letters that patterns fold."""
    around = ("{}", "a {} b", "{}X", "x = {}", "import {{ a }} from '{}'", "REST API {} API x", "f() {} {{", "class {} extends b", "npm i {}", "Error Code: 12345 {}", "def f({}", "配置a: {} 错误码 7", "struct {} a.b()", "AB_1234 @ohos.a.b {}")
    names = sorted({y for strings in graph.ENTITY_STRINGS.values() for x in strings for y in x} | {"٣٤٥٦٧", "AUTH_a", "myAPI", "查询接口", "onWindowStageDestroy", "函数"})
    texts = [t.format(n) for n in names for t in around]
    texts += [x for t in texts for x in (t.upper(), t.replace("i", "\u0131").replace("s", "\u017f").replace("k", "\u212a"), t.upper().replace("I", "\u0130"))] + [None, ""]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string").coalesce(1)
    found = lambda: sorted(tuple(r) for r in graph.extract_entities(chunks).collect())
    got = found()
    monkeypatch.setattr(graph, "ENTITY_STRINGS", {kind: [("",)] * len(x) for kind, x in graph.ENTITY_PATTERNS.items()})
    assert got == found() and {r[3] for r in got} == set(graph.ENTITY_PATTERNS)


def test_entities_of_plain_prose_in_time(spark, monkeypatch):
    """Prose without any of the strings isn't read once for each of 55 patterns."""
    chunks = spark.createDataFrame([("a", "the ofof tiontion and blebleea inging. " * 40000)], "chunk_id string, content string").coalesce(1)
    took = []
    for strings in (graph.ENTITY_STRINGS, graph.ENTITY_STRINGS, {kind: [("",)] * len(x) for kind, x in graph.ENTITY_PATTERNS.items()}):  # workers start in the first
        monkeypatch.setattr(graph, "ENTITY_STRINGS", strings)
        start = time.perf_counter()
        assert graph.extract_entities(chunks).count() == 0
        took.append(time.perf_counter() - start)
    assert took[1] < took[2] / 2


def test_rewrite(spark):
    r = one(spark, "如何登录？怎么部署", route.rewrite(F.col("x")))
    assert (r.strategy, r.rewritten, r.variants) == ("decomposition", "如何登录 怎么部署", ["如何登录？怎么部署", "如何登录", "怎么部署"])
    r = one(spark, "API 认证错误 API", route.rewrite(F.col("x")))
    assert (r.strategy, r.rewritten) == ("expansion", "API 接口 应用程序接口 认证 鉴权 登录错误 异常 报错 故障 API")
    assert one(spark, "plain?", route.rewrite(F.col("x"))).strategy == "none"
    assert one(spark, "如何 fix 的 Broken 我们 pipe", route.recovery_rewrite(F.col("x"))) == "Broken pipe fix"
    assert one(spark, "如何 的", route.recovery_rewrite(F.col("x"))) == "如何 的"


def test_fallbacks(spark):
    kind = lambda x, n: tuple(one(spark, x, route.fallback(F.col("x"), F.lit(n))))
    assert kind("no_relevant_docs", 0) == ("no_relevant_docs", "rewrite_query", False, True)
    assert kind("no_relevant_docs", 1) == ("no_relevant_docs", "human_fallback", True, True)
    assert kind("permission_denied", 9) == ("permission_denied", "final_refusal", False, False)
    assert kind("odd", 9) == ("unknown_intent", "human_fallback", False, True)


def test_memory_routes(spark):
    rows = [(1, "以后请用中文回答"), (2, "我在做一个 RAG 平台"), (3, "今天我在做一个 RAG 平台"), (4, "password: x 以后用中文"), (5, " "), (6, "我主要写 Python，我负责 Agent 项目")]
    got = {r.turn: (r.score, r.field, r.targets) for r in memory.routes(spark.createDataFrame(rows, "turn int, text string"), F.lit(False)).collect()}
    assert got == {
        1: (3, "preferred_language", ["short_term", "user_profile", "semantic"]), 2: (4, None, ["short_term", "episodic"]), 3: (1, None, ["short_term"]),
        4: (-2, "preferred_language", ["short_term", "skip"]), 6: (7, "primary_stack", ["short_term", "user_profile", "semantic", "episodic"]),
    }


def test_importance_ages(spark):
    score = lambda hours: memory.importance(F.lit("x" * 101), F.lit("user"), F.lit(0), F.lit(2), F.lit(1.0), F.lit(hours))
    got = [round(one(spark, "", score(h)), 2) for h in (167, 169, 721)]
    assert got == [0.6, 0.5, 0.4]


def test_window_statistics(spark):
    for n in (1, 49, 50, 100, 101):
        rows = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "k int, i int, v double")
        r = monitor.window_stats(rows, "k", "v", ["i"]).first()
        kept = [float(i) for i in range(n)][-100:]
        e = kept[0]
        for x in kept[1:]:
            e = 0.3 * x + 0.7 * e
        assert r.n == len(kept) and r.ewma == pytest.approx(e) and r["mean"] == pytest.approx(sum(kept) / len(kept))
        assert r["std"] == 0 if n == 1 else r["std"] > 0
    rows = spark.createDataFrame([(1, float(i)) for i in range(1, 21)], "k int, v double")
    assert monitor.p95(rows, "k", "v").first().p95 == 20.0


def test_thresholds(spark):
    stats = spark.createDataFrame([(1, 50, 2.0, 0.1, 2.0), (2, 49, 100.0, 1.0, 100.0)], "k int, n long, mean double, std double, ewma double")
    rows = {r.k: r for r in monitor.rate_thresholds(monitor.latency_thresholds(stats)).collect()}
    assert (rows[1].latency_warning, rows[1].latency_critical) == (5.0, 15.0) and rows[2].latency_warning == 5.0
    assert rows[1].error_warning == 0.5 and rows[1].pass_min == 0.95


def test_firing(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1])], "k int, t int, v int")
    got = sorted((r.started, r.ended, r.periods) for r in monitor.firing(rows, "k", "t", F.col("v") == 1, 3).collect())
    assert got == [(0, 2, 3), (7, 10, 4)]


def events(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randrange(3), start + dt.timedelta(seconds=rng.randrange(600)), i, rng.random() < 0.6) for i in range(n)]


def test_rate_limit(spark):
    rows = events(300, 0)
    found = {r.event_id: r.admitted for r in replay.rate_limit(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, ok boolean"), 5, 60.0).collect()}
    admitted: dict = {}
    for user, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        recent = [t for t in admitted.get(user, []) if (ts - t).total_seconds() < 60]
        assert found[i] == (len(recent) < 5)
        if found[i]:
            admitted.setdefault(user, []).append(ts)


def test_breaker(spark):
    rows = events(300, 1)
    found = {r.event_id: r.passed for r in replay.circuit_breaker(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, ok boolean"), 2, 30.0).collect()}
    state: dict = {}
    for user, ts, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        failed, until = state.get(user, (0, dt.datetime.min))
        passes = ts >= until
        assert found[i] == passes
        if passes:
            failed = 0 if ok else failed + 1
            if failed == 2:
                failed, until = 0, ts + dt.timedelta(seconds=30)
            state[user] = (failed, until)


def test_rate_limit_on_a_stream(spark, tmp_path):
    rows = events(60, 2)
    schema = "user_id long, ts timestamp, event_id long, ok boolean"
    for k in range(3):  # three files, in order of time
        part = sorted(rows, key=lambda r: r[1])[20 * k : 20 * k + 20]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = replay.rate_limit_stream(stream, 5, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {r.event_id: r.admitted for r in spark.table("limited").collect()}
    want = {r.event_id: r.admitted for r in replay.rate_limit(spark.createDataFrame(rows, schema), 5, 60.0).collect()}
    assert got == want


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (0, 1, 7, 30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = replay.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 1, 2]


def test_new_suffix(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "abc"), (1, 2, "x")], "session int, at int, text string")
    got = replay.new_suffix(rows, Window.partitionBy("session").orderBy("at")).orderBy("at").collect()
    assert [r.delta for r in got] == ["a", "bc", "x"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext", encoding="utf-8")
    (tmp_path / "b.md").write_text("  \n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    assert [(r.filename, r.content) for r in tables.markdown_folder(spark, str(tmp_path)).collect()] == [("a.md", "# A\ntext")]
    (tmp_path / "x.jsonl").write_text('\n{"query": "a", "n": 1}\nnot json\n{"query": "b", "n": 2}\n', encoding="utf-8")
    assert sorted(r.query for r in tables.json_lines(spark, str(tmp_path / "x.jsonl"), "query string, n int").collect()) == ["a", "b"]
    assert tables.uploaded_texts(spark, str(tmp_path / "a.md")).first().content == "# A\ntext"


def test_graph_rules(spark):
    edges = spark.createDataFrame([(1, "a", "b", "R", 0.5), (2, "a", "b", "S", 0.5), (3, "b", "c", "R", 0.5), (4, "b", "a", "T", 0.1)], "edge_id long, src string, dst string, rel string, weight double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert [(r.edge_id, r.node) for r in graph.one_hop(seeds, edges, 2).orderBy("rank").collect()] == [(1, "b"), (2, "b")]
    assert {(r.mid, r.node, r.rels) for r in graph.two_hop(seeds, edges).collect()} == {("b", "c", "R,R"), ("b", "c", "S,R"), ("b", "c", "T,R")}


def test_cooccurrence_bounds(spark):
    rows = [("c", "x", "A", 0), ("c", "y", "B", 300), ("c", "z", "C", 301), ("c", "w", "B", 0), ("d", "q", "B", 1)]
    got = {(r.left, r.right): r.weight for r in graph.cooccurrence(spark.createDataFrame(rows, "chunk_id string, name string, kind string, pos int")).collect()}
    assert got == {("x", "y"): 0.1, ("y", "z"): 1.0, ("w", "x"): 1.0, ("w", "z"): None} or got == {("x", "y"): 0.1, ("y", "z"): 1.0, ("w", "x"): 1.0}


def test_extraction(spark):
    text = "class RouterOptions depends on @ohos.router since API 10, see error 16000001, Error Code: 401 and\npage.onCreate() { in module.json5 with ArkTS; struct Index, Button, X_TOKEN = 1"
    chunks = spark.createDataFrame([("c1", text), ("c2", None), ("c3", ""), ("c4", text)], "chunk_id string, content string")
    found = graph.extract_entities(chunks)
    rows = found.collect()
    want = {
        ("RouterOptions", "CLASS"), ("@ohos.router", "API"), ("API 10", "API"), ("page.onCreate", "API"), ("16000001", "ERROR_CODE"), ("error", "ERROR_CODE"), ("Error Code: 401", "ERROR_CODE"),
        ("onCreate", "FUNCTION"), ("onCreate()", "FUNCTION"), ("onCreate", "LIFECYCLE"), ("ohos.router", "MODULE"), ("module.json5", "CONFIG"), ("X_TOKEN =", "CONFIG"),
        ("Index", "COMPONENT"), ("Button", "COMPONENT"), ("ArkTS", "CONCEPT"),
    }
    assert {(r.name, r.kind) for r in rows} == want
    assert len(rows) == 2 * len(want) and {r.chunk_id for r in rows} == {"c1", "c4"}
    assert all(text[r.pos :].startswith(r.name) for r in rows)


def test_relations_and_graph(spark):
    lines = {
        "CAUSES": "Alpha causes Beta", "FIXES": "Alpha 修复 Beta", "DEPENDS_ON": "Alpha depends on Beta", "CALLS": "Alpha.Beta()", "BELONGS_TO": "Alpha belongs to Beta", "PART_OF": "Alpha 包含 Beta",
        "HAS_LIFECYCLE": "Alpha onCreate", "AFFECTS": "Alpha affects Beta", "RELATED_TO": "Alpha -> Beta", "IMPORTS": "from Alpha import Beta", "EXTENDS": "Alpha extends Beta", "IMPLEMENTS": "Alpha implements Beta",
    }
    chunks = spark.createDataFrame([("d", rel, text) for rel, text in lines.items()] + [("d", "none", None), ("e", "alone", "Alpha causes Gamma and Alpha"), ("d", "CAUSES", "Alpha causes Beta")], "doc_id string, chunk_id string, content string")
    names = [(c, n.lower(), k) for c in (*lines, "none", "alone") for n, k in (("Alpha", "CLASS"), ("Beta", "CLASS"), ("onCreate", "FUNCTION"))]
    mentions = spark.createDataFrame(names, "chunk_id string, normalized string, kind string")
    found = graph.pattern_relations(mentions, chunks.filter("NOT (chunk_id = 'none')").dropDuplicates(["chunk_id"]))
    rows = {(r.chunk_id, r.source, r.target) for r in found.filter("chunk_id = rel").collect()}
    assert rows == {(rel, "alpha", "oncreate" if rel == "HAS_LIFECYCLE" else "beta") for rel in lines}
    assert found.filter("chunk_id = 'alone'").count() == 0
    assert found.groupBy("chunk_id", "source", "target", "rel").count().filter("count > 1").count() == 0
    nodes, edges = graph.build_graph(chunks, mentions, found, 5)
    assert {r.node_id: (r.label, r.content) for r in nodes.collect() if r.label != "Chunk"} == {"document:d": ("Document", None), "document:e": ("Document", None), "entity:alpha": ("Entity", "CLASS"), "entity:beta": ("Entity", "CLASS"), "entity:oncreate": ("Entity", "FUNCTION")}
    assert {r.content for r in nodes.filter("label = 'Chunk'").collect()} == {t[:5] for t in lines.values()} | {None, "Alpha"}
    assert nodes.count() == nodes.select("node_id").distinct().count()
    assert edges.filter("rel = 'HAS_CHUNK'").count() == len(lines) + 2 and edges.filter("rel = 'MENTIONS'").count() == len(names)


def test_conflict_report(spark):
    docs = spark.createDataFrame([(1, 10, "s"), (1, 11, "t"), (1, 12, "s"), (1, 13, "u"), (2, 10, "s"), (2, 11, None)], "query_id int, chunk_id int, source string")
    found = spark.createDataFrame([(1, 10, 11, "version", "high"), (1, 10, 11, "negation", "high")], "query_id int, a int, b int, kind string, severity string")
    marked = {(r.query_id, r.chunk_id): [c.kind for c in r.conflicts] for r in conflicts.annotate(docs, found).collect()}
    both = ["negation", "version"]
    assert marked == {(1, 10): both, (1, 11): both, (1, 12): both, (1, 13): [], (2, 10): [], (2, 11): []}
    stats = {r.query_id: (r.total_docs, r.conflicting_docs, r.consistent_docs, r.has_conflicts) for r in conflicts.conflict_stats(docs, found).collect()}
    assert stats == {1: (4, 3, 1, True), 2: (2, 0, 2, False)}
    assert conflicts.warnings(found).first().warning == "证据冲突警告\n1. **negation** (严重程度: high)\n2. **version** (严重程度: high)"


def test_alert_rules(spark):
    names = ["requests", "errors", "tool_calls", "tool_errors", "retrievals", "no_docs", "fallbacks", "passes", "checks", "cache_hits", "cache_requests"]
    quiet = dict.fromkeys(names, 0) | {"requests": 10, "checks": 10, "passes": 10, "b0": 10, "b1": 0, "b2": 0, "top_score": 0.5, "hallucination_rate": 0.0, "up": 1.0, "memory_gb": 1.0}
    rows = [quiet | {"service": s, "minute": m} for s in ("calm", "bad") for m in range(20)]
    for r in rows:
        if r["service"] == "bad":
            r |= {"b2": 10, "b0": 0} if 3 <= r["minute"] else {}
            r |= {"up": 0.0} if r["minute"] in (4, 5, 8) else {}
            r |= {"memory_gb": None} if r["minute"] == 7 else {"memory_gb": 21.0}
            r |= {"errors": 3} if r["minute"] == 19 else {}
    found = monitor.alert_rules(spark.createDataFrame(rows), "service", "minute", (1.0, 20.0)).collect()
    got = {(r.service, r.alert): (r.started, r.ended) for r in found if r.alert != "HighMemoryUsage"}
    assert got == {("bad", "ServiceDown"): (4, 5), ("bad", "HighP95Latency"): (3, 19)}
    assert sorted((r.started, r.ended) for r in found if r.alert == "HighMemoryUsage") == [(0, 6), (8, 19)]


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, text string")
    tables.append_once(spark, rows, log, "id")
    tables.append_once(spark, rows.union(spark.createDataFrame([(3, "c")], rows.schema)), log, "id")
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == [1, 2, 3]
    out = str(tmp_path / "out")
    tables.export_newest(spark.read.parquet(log), out, [F.desc("id")], 2)
    sources = {"cases": (out, "id long, text string", "id")}
    root = str(tmp_path / "root")
    assert [(r.name, r.rows) for r in tables.migrate(spark, sources, root, dry_run=True).collect()] == [("cases", 2)]
    assert not (tmp_path / "root").exists()
    for _ in range(2):
        assert tables.migrate(spark, sources, root).first().rows == 2
    assert sorted(r.id for r in spark.read.parquet(f"{root}/cases").collect()) == [2, 3]


def test_query_entities_nothing(spark):
    empty = one(spark, "", route.query_entities(F.col("x")))
    assert not any(empty) and one(spark, "", route.search_terms(F.lit(None).cast("array<string>"), F.array(), F.col("x"))) == []
    found = one(spark, "用 ohos.router 和 @ohos.router 替换，api 9 OOM oom，SDK12", route.query_entities(F.col("x")))
    assert found.apis == ["@ohos.router"] and found.components == ["Router"] and found.errors == ["OOM"] and found.api_levels == ["API 9"] and found.versions == ["SDK 12"]
    assert one(spark, "从 FA 模型迁移到 Stage", route.query_entities(F.col("x"))).migration_to == "Stage模型"


def test_queries_without_hits(spark):
    queries = spark.createDataFrame([(1, "a b"), (2, "zz"), (3, None), (4, "")], "query_id long, query string")
    chunks = spark.createDataFrame([(i, "a b") for i in range(6)], "chunk_id long, content string")
    hits = search.overlap_search(queries, chunks, 10)
    assert {r.query_id: r.confidence for r in search.confidence(queries, hits).collect()} == {1: 0.6, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.query_id: r.external for r in search.needs_external(queries, hits).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_search_shuffles_no_row_for_each_query_and_chunk(spark, sf_dir):
    """Sums over a chunk's words are whole where they are made; the lists of a fusion read the texts once."""
    queries, docs = retrieval.asked(spark, sf_dir), retrieval.chunks(spark, sf_dir)
    for hits in (search.overlap_search(queries, docs, 5), search.bm25_search(queries, docs, 5)):
        assert not re.search(r"hashpartitioning\(query_id[^)]*chunk_id", hits._jdf.queryExecution().executedPlan().toString())


def test_overlap_of_blocks_by_brute_force(spark, monkeypatch):
    """Small blocks of queries and chunks give what a plain loop gives; texts are not shuffled."""
    draw = random.Random(3)
    texts = [None, "", " \u3000\n", "É é  É", *(" ".join(draw.choices("a b c d e f gg É the".split(), k=draw.randint(1, 12))) for _ in range(300))]
    asked = [None, "", "zz", "a b", "é", "The  the\tgg a", *(" ".join(draw.choices("a b c d e f gg É x y".split(), k=5)) for _ in range(20))]
    queries, chunks = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), spark.createDataFrame([(7 * i % 311, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    words = lambda t: set((t or "").lower().split())
    want = {}
    for q, text in enumerate(asked):
        scores = [(-len(words(text) & words(t)) / len(words(text)), 7 * i % 311) for i, t in enumerate(texts) if words(text) & words(t)]
        want |= {(q, c): (-s, rank) for rank, (s, c) in enumerate(sorted(scores), 1)}
    monkeypatch.setattr(search, "CHUNK_BYTES", 700)
    monkeypatch.setattr(search, "QUERY_BYTES", 50)
    for k in (None, 4):
        hits = search.overlap_search(queries, chunks, k)
        assert not re.search(r"(hashpartitioning|RoundRobin)[^)]*(chunk_id|content)", hits._jdf.queryExecution().executedPlan().toString())
        assert {(r.query_id, r.chunk_id): (r.score, r.rank) for r in hits.collect()} == {x: y for x, y in want.items() if k is None or y[1] <= k}


def test_shared_words_of_small_matrices(monkeypatch):
    """A block that is scored in parts gives the best of all its parts, ties to the smaller id."""
    import pyarrow as pa

    ids, texts = pa.array([9, 3, 5, 1, 4]), pa.array(["a", "a b", "b a a", "c", "b"])
    for cells in (1, 6, 1 << 22):
        monkeypatch.setattr(search, "CELLS", cells)
        found = search.shared_words(ids, texts, pa.array([1, 2]), pa.array(["a b b", "c"]), 2)
        assert [x.to_pylist() for x in found] == [[1, 1, 2], [3, 5, 1], [1.0, 1.0, 1.0]]


def test_chunks_of_many_texts_in_slices(spark):
    """Texts are chunked a few MB at a time; null and empty ones give no rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"content": [None, "a" * (3 << 20), "b", "", *(["c" * (1 << 19)] * 9)]})
    parts = list(chunking.slices(batch, "content"))
    assert [len(x) for x in parts] == [1, 1, 5, 4, 2] and pa.Table.from_batches(parts).column("content").to_pylist() == batch.column("content").to_pylist()
    docs = spark.createDataFrame([(2, None), (1, "x\n\n" + "y" * 9), (3, "")], "source long, content string")
    found = chunking.chunk_documents(docs, 5).select("chunk_id", "source", "chunk_index", "content").collect()
    assert sorted(map(tuple, found)) == [("1_0", 1, 0, "x"), ("1_1", 1, 1, "y" * 9)]


def test_nearest_is_bounded_in_memory():
    """Scores of two blocks are not held all at once."""
    import tracemalloc

    rng = np.random.default_rng(1)
    v, ids = rng.standard_normal((4096, 8)), np.arange(4096)
    tracemalloc.start()
    found = np.concatenate([np.stack([a, b]) for a, b, _ in search.nearest(ids, v, ids, v, 1, 6)], axis=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(v @ v.T, 6)
    np.fill_diagonal(scores, -np.inf)
    assert peak < 40 << 20 and (found[0] == ids).all() and (found[1] == scores.argmax(axis=1)).all()


def test_markdown_structure():
    text = "# A  \n二、B\n3) C\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\ntext\n```py\nimport os\nclass K:\n  def f(self): g()\n```\n```ts\nexport class Foo extends Bar {}\nnew Baz()\n```\n"
    assert documents.find_sections(text) == [(1, "A", 0), (2, "二、B", 6), (2, "3. C", 10)]
    assert documents.find_tables(text) == [(4, 2)]
    assert [(lang, a, b) for lang, a, b, _ in documents.find_code(text)] == [("py", 10, 14), ("ts", 15, 18)]
    assert {("os", "IMPORT", 1.0), ("K", "CLASS", 1.0), ("f", "FUNCTION", 1.0), ("g", "METHOD_CALL", 0.9), ("Foo", "CLASS", 0.7), ("Baz", "METHOD_CALL", 0.7)} <= set(documents.find_symbols(text))
    assert documents.find_symbols("```py\ndef (\n```") == []


def test_markdown_rows(spark):
    docs = spark.createDataFrame([(1, "# T\n```js\nfunction go() {}\n```"), (2, None)], "chunk_id long, content string")
    assert [tuple(r) for r in documents.sections(docs).collect()] == [(1, 1, "T", 0)]
    assert documents.code_blocks(docs).first().language == "js" and documents.pipe_tables(docs).count() == 0
    assert ("go", "FUNCTION") in {(r.name, r.kind) for r in documents.code_symbols(docs).collect()}


def test_mock_embedding(spark):
    import hashlib

    digest = hashlib.sha256("héllo".encode()).digest()
    want = [b / 127.5 - 1 for b in digest + hashlib.sha256(digest).digest()][:40]
    assert one(spark, "héllo", embed.mock_embedding(F.col("x"), 40)) == pytest.approx(want)


def test_contradictions(spark):
    rows = [
        (1, 1, "@ohos.router works on API 9 and is not supported here"), (1, 2, "@ohos.router is supported since api 12"), (1, 3, "nothing shared"),
        (2, 1, "@ohos.a deprecated in API 11. We recommend using the old way"), (2, 2, "@ohos.a call; best practice to write tests first"),
    ]
    docs = spark.createDataFrame([(q, c, t, "s") for q, c, t in rows], "query_id long, chunk_id long, content string, title string")
    got = {(r.query_id, r.a, r.b, r.kind) for r in conflicts.contradictions(docs).collect()}
    assert got == {(1, 1, 2, "version"), (1, 1, 2, "negation"), (2, 1, 2, "deprecation"), (2, 1, 2, "recommendation")}


def test_split_version(spark):
    import hashlib

    users = [f"u{i}" for i in range(50)]
    rows = spark.createDataFrame([(u,) for u in users], "x string").select("x", evaluate.split_version(F.col("x"), {"b": 1.0, "a": 3.0}).alias("v")).collect()
    for r in rows:
        roll = random.Random(int(hashlib.md5(r.x.encode()).hexdigest()[:8], 16)).random()
        assert r.v == ("a" if roll <= 0.75 else "b")


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("", None), ('x {"a": 1} y', '{"a": 1}'), ('```json\n{"a": {"b": "}"}}\n```', '{"a": {"b": "}"}}'), ("{broken", None), ("[1]", None), ('```\n{"k": "é"}```', '{"k": "é"}')],
)
def test_json_in_answers(spark, text, want):
    assert answers.json_in(text) == want
    assert one(spark, text, answers.extract_json(F.col("x"))) == want


def test_validation(spark):
    r = one(spark, '{"primary_intent": " Migration ", "secondary_intents": ["API_USAGE", "migration", "odd"], "difficulty": "huge", "retrieval_plan": {"mode": "parallel"}}', answers.validated(F.col("x")))
    assert (r.primary_intent, r.secondary_intents, r.difficulty, r.risk_level, r["mode"], r.needs_clarification) == ("migration", ["api_usage"], "low", "low", "parallel", False)
    r = one(spark, "not json", answers.validated(F.col("x")))
    assert (r.primary_intent, r.secondary_intents, r["mode"]) == ("concept_qa", [], "hybrid_only")


def test_cache(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(2), start + dt.timedelta(seconds=rng.randrange(2000)), i, f"k{rng.randrange(12)}") for i in range(400)]
    found = {r.event_id: r.hit for r in replay.cache_hits(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, key string"), 300.0, 5).collect()}
    held: dict = {0: {}, 1: {}}
    for user, ts, i, key in sorted(rows, key=lambda r: (r[1], r[2])):
        own = held[user]
        hit = key in own and (ts - own[key][0]).total_seconds() < 300
        assert found[i] == hit
        if hit:
            own[key][1] = ts
        else:
            own.pop(key, None)
            if len(own) >= 5:
                del own[min(own, key=lambda k: (own[k][1], k))]
            own[key] = [ts, ts]


def test_session_and_batches_on_a_stream(spark, tmp_path):
    schema = "session_id string, ts timestamp, text string"
    rows = [(f"s{i % 2}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"t{i}") for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = replay.session_stream(stream, last=3).writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.session_id, tuple(r.texts)) for r in spark.table("sessions").collect()} == {("s0", ("t4", "t6", "t8")), ("s1", ("t5", "t7", "t9"))}
    query = replay.append_batches(stream, str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 10 and replay.newest(written, "session_id").count() == 2


def test_patterns_take_linear_time(spark):
    """A hundred thousand characters without a blank, and matches that follow each other in one run."""
    patterns = [p for kinds in (graph.ENTITY_PATTERNS, graph.RELATION_PATTERNS) for rules in kinds.values() for p in rules]
    for text in ("x" * 100_000, "中文字符" * 25_000, "a" * 50_000 + " causes " + "b" * 50_000, "import " * 15_000):
        began = time.perf_counter()
        found = [m[0] for p in patterns for m in graph.word_led(p)(text)]
        assert time.perf_counter() - began < 3 and ("causes" not in text or len(found) >= 1)
    tokens = ["导致", "causes", " ", "\n", "崩溃", "abc", "X", "的生命周期", "和", "相关", "Ability", "onCreate", "是", "的", "一部分", ".f(", "->", " extends ", "A, B", "修复", "问题", "import", " from 'x'", "调用", "方法", "→", "_", "9"]
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(tokens) for _ in range(20))
        for p in patterns:
            assert [(m.span(), m.groups()) for m in graph.word_led(p)(text)] == [(m.span(), m.groups()) for m in re.compile(p, re.IGNORECASE | re.MULTILINE).finditer(text)]


@pytest.mark.parametrize("digits", [2, 6])
def test_two_hops_of_hubs(spark, digits):
    """Pruned edges give the paths of a plain loop: many ties, parallel edges, self loops, a hub."""
    rnd = random.Random(digits)
    edges = [(i, f"n{rnd.choice([0, 0, 0, rnd.randrange(40)])}", f"n{rnd.randrange(40)}", f"r{i % 3}", rnd.choice([0.05, 0.5, 0.51, rnd.random() + 0.01])) for i in range(500)]
    both = [(i, a, b, r, w) for i, a, b, r, w in edges] + [(i, b, a, r, w) for i, a, b, r, w in edges]
    seeds = [f"n{k}" for k in range(0, 40, 4)]
    found = graph.two_hop(spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(edges, "edge_id long, src string, dst string, rel string, weight double"), 5, digits).collect()
    for seed in seeds:
        paths = []
        for e1, a, mid, r1, w1 in both:
            if a == seed and mid != seed:
                paths += [(-round(w1 * w2, digits), node, mid, e1, e2, f"{r1},{r2}") for e2, m, node, r2, w2 in both if m == mid and node not in (seed, mid) and e1 != e2]
        want = [(p[1], p[2], p[5]) for p in sorted(paths)[:5]]
        assert [(r.node, r.mid, r.rels) for r in sorted((r for r in found if r.seed == seed), key=lambda r: r.rank)] == want
