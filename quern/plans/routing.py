"""Query rewriting, intents, plans and failures, with benchmark items, conversations, parts and events as their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import master, evaluate, fusion, route
from quern.plans.registry import Registry
from quern.sources.tables import table

Q = Registry()

STOPS = ", ".join(f"'{w}'" for w in route.STOP_WORDS)

#: Questions that are put before the texts of conversations, as the tables' own texts hold none of the words that rules ask for;
#: with the intent, the plan and the mode that a person expects.
QUESTIONS = (
    ("登录页面报错 401，怎么解决？", "project_debug", "exact", "hybrid_only"),
    ("从 FA 模型迁移到 Stage 模型有哪些步骤", "migration", "semantic", "graph_first"),
    ("什么是 Stage 模型；和 FA 有什么区别", "concept_qa", "semantic", "hybrid_only"),
    ("写一个 Router 跳转 Navigation 的 demo", "code_generation", "default", "parallel"),
    ("@ohos.net.http 怎么调用 GET 请求", "api_usage", "exact", "parallel"),
    ("UserService 依赖 AuthService 吗，之间有什么关系", "concept_qa", "graph_first", "hybrid_only"),
    ("编译失败 hvigor ERROR AUTH_1001", "error_diagnosis", "exact", "hybrid_only"),
    ("部署配置 权限 API 密码", "project_debug", "default", "hybrid_only"),
    ("python 脚本 permission denied 闪退", "error_diagnosis", "default", "hybrid_only"),
    ("工单 TKT-1 版本 配置", "concept_qa", "default", "hybrid_only"),
    ("hello", "concept_qa", "default", "hybrid_only"),
)
ASKED = "q AS (SELECT conv_id, turn, 1 + (conv_id + turn) % " + str(len(QUESTIONS)) + " AS slot, [" + ", ".join(f"'{x[0]}'" for x in QUESTIONS) + "][1 + (conv_id + turn) % " + str(len(QUESTIONS)) + "] || ' ' || text AS query FROM conversations)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, expected_intent, expected_plan, expected_mode): each turn's whole text after one of the questions."""
    slot = ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int")
    at = [F.element_at(F.array(*[F.lit(x[i]) for x in QUESTIONS]), slot) for i in range(4)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(at[0], F.lit(" "), "text").alias("query"), *[c.alias(n) for c, n in zip(at[1:], ("expected_intent", "expected_plan", "expected_mode"), strict=True)])


def sql_has(pattern: str, any_case: bool = False) -> str:
    return f"regexp_matches(query, '(?-s){pattern}'" + (", 'i')" if any_case else ")")


def sql_count(marks: tuple[str, ...]) -> str:
    return " + ".join(f"contains(query, '{m}')::INT" for m in marks)


def sql_first(pairs: list[tuple[str, str]]) -> str:
    """The names whose conditions hold, with commas between."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {held} THEN '{name}' END" for held, name in pairs) + ")"


NAMED = ASKED + ", h AS (SELECT *, " + ", ".join(f"{sql_has(p, True)} AS {name}" for name, p in route.INTENT_PATTERNS.items()) + " FROM q), i AS (SELECT *, coalesce(nullif(" + sql_first([("code_generation AND project_debug", "code_generation"), ("project_debug", "project_debug"), ("error_diagnosis", "error_diagnosis"), ("code_generation AND NOT project_debug", "code_generation"), *((x, x) for x in ("migration", "api_usage", "concept_qa"))]) + ", ''), 'concept_qa') AS intents FROM h), l AS (SELECT *, split_part(intents, ',', 1) AS intent FROM i)"
SQL_MODE = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{m}'" for i, m in route.INTENT_MODES.items()) + " ELSE 'hybrid_only' END"
SCENARIOS = sql_first([(sql_has(p, True), name) for name, p in route.SCENARIO_PATTERNS.items()])
TOOLS = "'keyword_search,vector_search' || CASE intent " + " ".join(f"WHEN '{i}' THEN ',{','.join(t)}'" for i, t in route.INTENT_TOOLS.items()) + " ELSE '' END || " + " || ".join(f"CASE WHEN intent = 'error_diagnosis' AND regexp_matches(scenarios, '{'|'.join(names)}') THEN ',{tool}' ELSE '' END" for tool, names in route.SCENARIO_TOOLS.items())
#: DuckDB's word boundary knows ASCII letters only; these texts hold accents. So boundaries of two named things are spelled out.
SEVERAL = r"(?:^|[^\pL\pN_])[A-Z][a-zA-Z]+(?:[^\pL\pN_\n].*(?:和|与|、|,|and).*[^\pL\pN_\n]|[^\pL\pN_\n].*[、,]|[、,].*[^\pL\pN_\n]|[、,])[A-Z][a-zA-Z]+(?:[^\pL\pN_]|$)"
FLAGS = "f AS (SELECT *, " + ", ".join(f"{sql_has(SEVERAL if name == 'several_entities' else p)} AS {name}" for name, p in route.FEATURES.items()) + " FROM "
RULED = """CASE WHEN relation THEN 'graph_first' WHEN error_code OR (api_name AND NOT semantic) OR class_name OR function_name OR config_name {exact} THEN 'exact'
WHEN (semantic AND NOT error_code) OR (length(query) > 20 AND NOT error_code AND NOT api_name AND regexp_matches(query, '什么是|如何|为什么')) THEN 'semantic' ELSE 'default' END"""


@Q.query("query_rewrite", rf"""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark), k AS (SELECT item_id, w, list_filter(w, lambda x: lower(x) NOT IN ({STOPS})) AS kept FROM w),
p AS (SELECT item_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE w END) AS x, generate_subscripts(CASE WHEN len(kept) > 0 THEN kept ELSE w END, 1) AS i FROM k) SELECT item_id, string_agg(x, ' ' ORDER BY length(x) DESC, i) AS rewritten FROM p GROUP BY item_id""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", route.recovery_rewrite(F.col("text")).alias("rewritten"))


SQL_EXPANDED = "query"
for _word, _put in route.SYNONYMS.items():
    SQL_EXPANDED = f"regexp_replace({SQL_EXPANDED}, '{_word}', '{_put}')"


@Q.query("query_variants", rf"""WITH {ASKED}, p AS (SELECT *, list_filter(list_transform(string_split_regex(query, '{"|".join(("\\" + x) if x == "?" else x for x in route.SEPARATORS)}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts, {SQL_EXPANDED} AS expanded FROM q)
SELECT conv_id, turn, CASE WHEN len(parts) > 1 THEN array_to_string(parts, ' ') ELSE expanded END AS rewritten, CASE WHEN len(parts) > 1 THEN query || '|' || array_to_string(parts, '|') WHEN expanded <> query THEN query || '|' || expanded ELSE query END AS variants,
CASE WHEN len(parts) > 1 THEN 'decomposition' WHEN expanded <> query THEN 'expansion' ELSE 'none' END AS strategy FROM p""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions(spark, sf_dir).select("conv_id", "turn", route.rewrite(F.col("query")).alias("r"))
    return found.select("conv_id", "turn", "r.rewritten", F.array_join("r.variants", "|").alias("variants"), "r.strategy")


@Q.query("query_types", f"""WITH {ASKED}, c AS (SELECT *, {sql_count(route.SEMANTIC_MARKERS)} AS s, {sql_count(route.KEYWORD_MARKERS)} AS k FROM q)
SELECT conv_id, turn, CASE WHEN s > k THEN 'semantic' WHEN k > s THEN 'keyword' ELSE 'mixed' END AS query_type, {sql_has(route.CODE_QUERY)} AS code_query,
CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + f" THEN '{name}'" for name, words in route.LANGUAGES.items())} ELSE 'typescript' END AS language FROM c""")
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.col("query")
    return questions(spark, sf_dir).select("conv_id", "turn", route.query_type(query).alias("query_type"), route.is_code_query(query).alias("code_query"), route.target_language(query).alias("language"))


@Q.query("query_intents", f"""WITH {NAMED}, s AS (SELECT *, {SCENARIOS} AS scenarios FROM l)
SELECT conv_id, turn, intents, scenarios, {TOOLS} AS tools, {SQL_MODE} AS mode, CAST({" + ".join(f"len(list_distinct(regexp_extract_all(query, '(?-s){p}', 0, 'i')))" for p in route.INTENT_PATTERNS.values())} AS INT) AS signals FROM s""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.col("query")
    rows = questions(spark, sf_dir).select("conv_id", "turn", route.intents(query).alias("i"), route.scenarios(query).alias("s"), route.signals(query).alias("g"))
    primary, total = F.col("i")[0], F.lit(0)
    for name in route.INTENT_PATTERNS:
        total = total + F.size(F.col("g")[name])
    return rows.select("conv_id", "turn", F.array_join("i", ",").alias("intents"), F.array_join("s", ",").alias("scenarios"), F.array_join(route.tools(primary, F.col("s")), ",").alias("tools"), route.mode(primary).alias("mode"), total.cast("int").alias("signals"))


@Q.query("query_features", f"WITH {ASKED}, {FLAGS} q) SELECT conv_id, turn, {', '.join(route.FEATURES)} FROM f")
def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", route.features(F.col("query")).alias("f")).select("conv_id", "turn", "f.*")


KNOWN = "CASE conv_id % 5 WHEN 0 THEN 'migration' WHEN 1 THEN 'api_usage' WHEN 2 THEN 'concept_qa' WHEN 3 THEN 'exact' END"


@Q.query("plan_choice", f"""WITH {ASKED}, {FLAGS} q), k AS (SELECT *, {KNOWN} AS known FROM f)
SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'hybrid_only' WHEN known = 'migration' THEN 'graph_first' WHEN known = 'api_usage' THEN 'deep_keyword' WHEN known = 'concept_qa' THEN 'deep_vector' ELSE {RULED.format(exact="OR coalesce(known, '') = 'exact'")} END AS plan FROM k""")
def plan_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", route.plan_name(F.col("query"), F.col("conv_id") % 7 != 0, F.expr(KNOWN)).alias("plan"))


@Q.query("decision_eval", f"""WITH {NAMED}, {FLAGS} l), d AS (SELECT intent, {SQL_MODE} AS mode, {RULED.format(exact="")} AS plan, slot FROM f), x AS (SELECT *, {", ".join(f"[{', '.join(repr(x[i]) for x in QUESTIONS)}][slot] AS expected_{n}" for i, n in ((1, "intent"), (2, "plan"), (3, "mode")))} FROM d)
SELECT count(*) AS cases, avg((intent = expected_intent)::INT::DOUBLE) AS intent_accuracy, avg((plan = expected_plan)::INT::DOUBLE) AS plan_accuracy, avg((mode = expected_mode)::INT::DOUBLE) AS mode_accuracy FROM x""")
def decision_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.col("query")
    rows = questions(spark, sf_dir).withColumn("intent", route.intents(query)[0])
    return evaluate.decision_accuracy(rows.withColumns({"mode": route.mode(F.col("intent")), "plan": route.plan_name(query, F.lit(True))}))


@Q.query("proxy_scores", rf"""WITH {NAMED}, w AS (SELECT *, list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '') AS words FROM l)
SELECT conv_id, turn, CASE intent {" ".join(f"WHEN '{i}' THEN least(1.0, greatest(0.3, ({' + '.join(f"list_contains(words, '{w}')::INT" for w in x)}) / {float(len(x))}::DOUBLE * 0.9::DOUBLE))" for i, x in evaluate.EXPECTED_WORDS.items())} ELSE 0.7::DOUBLE END::DOUBLE AS faithfulness,
least(1.0, 0.5::DOUBLE + ((length(query) > 10)::INT + regexp_matches(query, '[?？]')::INT + (len(words) > 3)::INT + regexp_matches(query, '如何|怎么|什么|为什么')::INT + (intent <> 'unknown')::INT) / 10::DOUBLE)::DOUBLE AS relevancy FROM w""")
def proxy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    query, intent = F.col("query"), F.col("intent")
    return questions(spark, sf_dir).withColumn("intent", route.intents(query)[0]).select("conv_id", "turn", evaluate.proxy_faithfulness(query, intent).alias("faithfulness"), evaluate.proxy_relevancy(query, intent).alias("relevancy"))


@Q.query("intent_weights", "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', {w}::DOUBLE)" for i, s, w in fusion.intent_weights()) + ") t(intent, source, weight)")
def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(fusion.intent_weights(), "intent string, source string, weight double")


@Q.query("plan_templates", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p['mode']}', " + ", ".join(f"{p[k]}::DOUBLE" for k in ("keyword", "vector", "graph")) + ", " + ", ".join(f"{p[k]}::INT" for k in ("keyword_k", "vector_k", "graph_k", "graph_depth")) + ")" for n, p in route.PLANS.items()) + ") t(plan, mode, keyword, vector, graph, keyword_k, vector_k, graph_k, graph_depth)")
def plan_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in route.PLANS], "plan string")
    return names.select("plan", route.plan(F.col("plan")).alias("p")).select("plan", "p.*")


KINDS = {"error": "tool_failure", "view": "no_relevant_docs", "click": "low_retrieval_score", "purchase": "permission_denied", "signup": "unheard_of"}


@Q.query("fallback_decisions", f"""WITH k AS (SELECT event_id, event_id % 4 AS tries, CASE event_type {" ".join(f"WHEN '{e}' THEN '{k if k in route.FALLBACKS else 'unknown_intent'}'" for e, k in KINDS.items())} ELSE 'unknown_intent' END AS kind FROM events),
x AS (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN tries >= {n}" for k, (_, n) in route.FALLBACKS.items() if n is not None)} ELSE false END AS exhausted FROM k),
a AS (SELECT *, CASE WHEN exhausted THEN 'human_fallback' ELSE CASE kind {" ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, _) in route.FALLBACKS.items())} END END AS action FROM x) SELECT event_id, kind, action, exhausted, action <> 'final_refusal' AS recoverable FROM a""")
def fallback_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in KINDS.items()], F.lit("other"))
    return table(spark, sf_dir, "events").select("event_id", route.fallback(kind, F.col("event_id") % 4).alias("f")).select("event_id", "f.*")


@Q.query("failure_kinds", """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'permission_denied' WHEN event_type = 'signup' THEN 'unknown_intent' WHEN event_id % 6 = 0 THEN 'no_relevant_docs' WHEN value / 500 < 0.1 THEN 'low_retrieval_score' WHEN event_type = 'error' THEN 'tool_failure' WHEN event_id % 4 = 1 THEN 'answer_not_grounded' ELSE 'unknown_intent' END AS kind FROM events""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    granted = F.when(F.col("user_id") % 9 == 0, F.array(F.lit("chat"))).otherwise(F.array(F.lit("chat"), F.lit("knowledge_search")))
    intent = F.when(F.col("event_type") == "signup", "unknown").otherwise("concept_qa")
    kind = route.failure_kind(granted, intent, F.col("event_id") % 6, F.col("value") / 500, (F.col("event_type") == "error").cast("int"), F.col("event_id") % 4 != 1)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


def cases(key: str, *values: str) -> str:
    """SQL that Spark and DuckDB share: one of the values by the remainder of key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: States of the master by the numbers of events, for Spark and DuckDB alike. k is a tenth of the number.
STATE_SQL = {
    "last_step": cases("event_id", "'recognize_intent'", "'call_tools'", "'retrieve'", "'rewrite_query'", "'build_context'", "'generate_code'", "'execute_code'", "'generate_answer'", "'verify_answer'", "'check_permission'"),
    "intent": cases("k", "'concept_qa'", "'error_diagnosis'", "'code_generation'", "'api_usage'"), "query": cases("k", "'Ticket TKT-001'", "'查询系统状态'", "'how to'", "'why'", "'an Error Code'", "''", "'x'"),
    "needs_clarification": "k % 3 = 0", "confidence": "(k % 10) * 0.05", "tool_errors": "k % 2", "tool_retries": "(k % 8 - k % 2) / 2", "retrieve_retries": "(k % 4 - k % 2) / 2", "verify_retries": cases("k", "0", "0", "0", "1", "1"),
    "code_retries": cases("k", "0", "0", "1", "1", "1"), "best_score": cases("k", "NULL", "0.0", "value", "value", "value"), "fallback_reason": cases("k", "'low_retrieval_score'", "''", "''", "'other'"), "has_code": "k % 8 < 4",
    "code_verified": "k % 3 = 1", "verified": "k % 10 < 5", "steps": "k % 20", "may": "k % 7 <> 3",
}
STATES = "WITH e AS (SELECT event_id, value, (event_id - event_id % 10) // 10 AS k FROM events), s AS (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in STATE_SQL.items()) + " FROM e)"


def master_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.expr("event_id div 10"))
    return rows.select("event_id", F.struct(*(F.expr(v).alias(k) for k, v in STATE_SQL.items())).alias("s"))


@Q.query("next_steps", STATES + """, d AS (SELECT event_id, CASE
 WHEN steps >= 18 THEN 'human_fallback|graph step budget exceeded'
 WHEN last_step = 'recognize_intent' THEN CASE WHEN needs_clarification AND confidence < 0.2 THEN 'human_fallback|deep intent needs clarification' WHEN intent = 'error_diagnosis' OR regexp_matches(lower(query), '工单|ticket|tkt-|系统状态|服务状态|健康检查|运行状态|错误码|error code|用户信息|用户档案|我的信息|个人信息') THEN 'call_tools|master selected tool agent from intent/query signals' ELSE 'retrieve_knowledge|intent routes to knowledge retrieval' END
 WHEN last_step = 'call_tools' THEN CASE WHEN tool_errors = 0 THEN 'retrieve_knowledge|tools completed; retrieve supporting knowledge' WHEN tool_retries < 2 THEN 'call_tools|tool failed and retry budget remains' ELSE 'retrieve_knowledge|tool retry exhausted; continue with knowledge retrieval' END
 WHEN last_step = 'retrieve' THEN CASE WHEN fallback_reason = 'low_retrieval_score' AND retrieve_retries >= 1 THEN CASE WHEN intent = 'code_generation' THEN 'build_context|code request can continue with template context' ELSE 'human_fallback|retrieval quality is too low' END
   WHEN coalesce(best_score, 0) > 0 THEN 'build_context|retrieval found usable evidence' WHEN retrieve_retries < 1 THEN 'rewrite_query|no usable docs; rewrite and retry retrieval' WHEN intent = 'code_generation' THEN 'build_context|code request can continue without retrieved docs' ELSE 'human_fallback|no usable docs and retrieval retry exhausted' END
 WHEN last_step = 'rewrite_query' THEN 'retrieve_knowledge|query rewritten; retry retrieval'
 WHEN last_step = 'build_context' THEN CASE WHEN intent = 'code_generation' AND NOT has_code THEN 'generate_code|code generation requested' ELSE 'generate_answer|context ready for answer generation' END
 WHEN last_step = 'generate_code' THEN 'execute_code|code generated; execute in sandbox'
 WHEN last_step = 'execute_code' THEN CASE WHEN code_verified THEN 'generate_answer|code verified; generate final explanation' WHEN code_retries = 0 THEN 'generate_code|code execution failed; retry code generation' ELSE 'finalize_answer|code execution failed after retry; finalize with disclaimer' END
 WHEN last_step = 'generate_answer' THEN 'verify_answer|draft answer ready; verify grounding'
 WHEN last_step = 'verify_answer' THEN CASE WHEN verified THEN 'finalize_answer|answer verified' WHEN verify_retries < 1 THEN 'build_context|answer not grounded; regenerate with same context' ELSE 'human_fallback|answer verification failed and retry exhausted' END
 ELSE 'retrieve_knowledge|default to retrieval' END AS d FROM s) SELECT event_id, split_part(d, '|', 1) AS next_node, split_part(d, '|', 2) AS reason FROM d""")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_states(spark, sf_dir).select("event_id", master.master_step(F.col("s")).alias("d")).select("event_id", "d.next_node", "d.reason")


@Q.query("graph_steps", STATES + """ SELECT event_id, CASE last_step WHEN 'check_permission' THEN CASE WHEN may THEN 'deep_intent_recognition' ELSE 'final_refusal' END
 WHEN 'recognize_intent' THEN CASE WHEN (needs_clarification AND confidence < 0.2) OR intent = 'error_diagnosis' THEN 'master_agent' ELSE 'retrieve_knowledge' END
 WHEN 'retrieve' THEN CASE WHEN coalesce(best_score, 0) <= 0 AND fallback_reason = 'low_retrieval_score' THEN 'master_agent' ELSE 'build_context' END
 WHEN 'build_context' THEN CASE WHEN intent = 'code_generation' AND NOT has_code THEN 'generate_code' ELSE 'generate_answer' END
 WHEN 'generate_answer' THEN 'verify_answer' WHEN 'verify_answer' THEN CASE WHEN verified THEN 'finalize_answer' ELSE 'human_fallback' END ELSE 'master_agent' END AS node FROM s""")
def graph_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    permissions = F.when(F.col("s.may"), F.array(F.lit("chat"), F.lit("knowledge_search"))).otherwise(F.array(F.lit("chat")))
    return master_states(spark, sf_dir).select("event_id", master.graph_step(F.col("s"), permissions).alias("node"))


@Q.query("intent_confidences", """WITH i AS (SELECT event_id, event_id % 7 AS own, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 + event_id % 3 END AS total, event_id % 5 AS n_candidates, event_id % 4 AS kind, event_id % 8 AS kinds, event_id % 6 AS scene, event_id % 9 < 4 AS unclear, event_id % 5 AS questions, event_id % 4 AS tools, event_id % 3 * 60 AS chars FROM events),
p AS (SELECT *, CASE WHEN total IS NULL THEN 0.1 WHEN total = 0 THEN 0.05 ELSE CASE WHEN own >= 5 THEN 0.3 WHEN own >= 3 THEN 0.25 WHEN own = 2 THEN 0.2 WHEN own = 1 THEN 0.15 ELSE 0 END END - CASE WHEN total IS NOT NULL AND n_candidates > 3 THEN 0.05 ELSE 0 END AS rules,
 0.2 * least(1.0, CASE WHEN kinds = 7 THEN 7 ELSE kinds END / 6) AS entities, CASE WHEN scene = 0 THEN 0.15 WHEN scene = 1 THEN 0.1 ELSE 0 END AS scenario, CASE WHEN kind < n_candidates THEN 0.15 WHEN n_candidates > 0 AND kind = 3 THEN 0.08 ELSE 0 END AS agrees, CASE WHEN unclear THEN greatest(0, 0.1 - 0.03 * questions) ELSE 0.1 END AS clear,
 CASE WHEN tools >= 3 THEN 0.1 WHEN tools >= 1 THEN 0.05 ELSE 0 END AS helped, CASE WHEN chars > 100 THEN 0.05 WHEN chars > 50 THEN 0.03 ELSE 0 END AS answered FROM i)
SELECT event_id, round((rules + entities + scenario + agrees + clear + helped + answered)::DOUBLE, 3) AS confidence FROM p""")
def intent_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised intents by the numbers of events: up to four candidates i0 to i3 of the rules, and i0 as second choice."""
    e = F.col("event_id")
    names = F.array(*(F.lit(f"i{k}") for k in range(5)))
    candidates = F.slice(names, F.lit(1), (e % 5).cast("int"))
    some = lambda k: F.when(e % 8 > k, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    entities = F.struct(*(some(k).alias(name) for k, name in enumerate(("apis", "components", "errors", "api_levels", "versions", "files"))), F.lit("a").alias("migration_from"), F.when(e % 8 > 6, "b").otherwise("").alias("migration_to"))
    second = F.when(e % 4 == 3, F.array(F.lit("i0"))).otherwise(F.array().cast("array<string>"))
    score = master.intent_confidence(e % 7, F.when(e % 11 != 0, e % 7 + e % 3), candidates, F.concat(F.lit("i"), (e % 4).cast("string")), second, master.entity_coverage(entities), F.when(e % 6 == 0, "s").otherwise(""), F.when(e % 6 == 1, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")), e % 9 < 4, e % 5, e % 4, e % 3 * 60)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 3).alias("confidence"))


@Q.query("expansion_terms", r"""WITH w AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark), p AS (SELECT DISTINCT query_id, lower(p_name) AS term FROM w JOIN part ON p_partkey % 40 = query_id % 40),
r AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS rank FROM p JOIN w USING (query_id) WHERE length(term) >= 2 AND NOT list_contains(w, term)) SELECT query_id, term, rank FROM r WHERE rank <= 15""")
def expansion_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), (F.col("p_partkey") % 40).alias("slot"))
    paths = queries.select("query_id", (F.col("query_id") % 40).alias("slot")).join(parts, "slot")
    return route.expansion_terms(paths, queries)


@Q.query("cache_scope", "SELECT c_custkey, 'r' || c_nationkey % 3 || '|' || CASE WHEN c_acctbal > 0 THEN 'read,write' ELSE 'read' END AS scope FROM customer")
def cache_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    granted = F.when(F.col("c_acctbal") > 0, F.array(F.lit("write"), F.lit("read"))).otherwise(F.array(F.lit("read")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", F.concat(F.lit("r"), F.col("c_nationkey") % 3), F.array_join(F.array_sort(granted), ",")).alias("scope"))
