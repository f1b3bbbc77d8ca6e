"""Entities, tools and terms of queries, alert rules, updates, tenants, and a graph that is built from texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, monitor, route
from quern.plans import routing
from quern.plans.registry import Registry
from quern.sources import tables
from quern.sources.tables import table

Q = Registry()

#: What is put before each turn, besides the questions of quern.plans.routing.
PREFIXES = ("", "AUTH_401 TKT-123 HarmonyOS NEXT SDK 12 ", "API 9 build-profile.json5 OpenHarmony 4.1 ", "class MainPage extends UIAbility，把 MainPage 替换为 TabsPage，Swiper ")
INTENTS = ("troubleshooting", "ticket_query", "technical_question")
TURN = "conv_id + turn * 3"
PLACE = f"CAST(1 + ({TURN}) % {{n}} AS INT)"
ASKED = routing.ASKED + f", a AS (SELECT conv_id, turn, [{', '.join(repr(p) for p in PREFIXES)}][1 + ({TURN}) % {len(PREFIXES)}] || query AS query, [{', '.join(repr(i) for i in INTENTS)}][1 + ({TURN}) % {len(INTENTS)}] AS intent FROM q)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, intent): each turn after a question and one of the prefixes."""
    pick = lambda found: F.element_at(F.array(*[F.lit(x) for x in found]), F.expr(PLACE.format(n=len(found))))
    return routing.questions(spark, sf_dir).select("conv_id", "turn", F.concat(pick(PREFIXES), "query").alias("query"), pick(INTENTS).alias("intent"))


def sql_calls() -> str:
    words = {tool: " OR ".join(f"contains(lower(query), '{w.lower()}')" for w in found) for tool, found in route.TOOL_TRIGGERS.items()}
    rules = (
        ("intent = 'troubleshooting'", "'get_system_status:'"), ("intent = 'troubleshooting' AND error <> ''", "'get_error_code_detail:' || error"), ("intent = 'ticket_query'", "'query_ticket:' || ticket"),
        (f"intent <> 'troubleshooting' AND ({words['get_system_status']})", "'get_system_status:'"),
        (f"intent <> 'troubleshooting' AND error <> '' AND ({words['get_error_code_detail']})", "'get_error_code_detail:' || error"),
        (f"intent <> 'ticket_query' AND ticket <> '' AND ({words['query_ticket']})", "'query_ticket:' || ticket"), (words["get_user_profile"], "'get_user_profile:'"), (words["execute_code"], "'execute_code:'"),
    )
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {held} THEN {call} END" for held, call in rules) + ")"


@Q.query("tool_calls", f"WITH {ASKED}, n AS (SELECT *, upper(regexp_extract(query, '{route.TICKET}', 0, 'i')) AS ticket, upper(regexp_extract(query, '{route.ERROR_CODE}', 0, 'i')) AS error FROM a) SELECT conv_id, turn, {sql_calls()} AS calls FROM n")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = route.tool_calls(F.col("query"), F.col("intent"))
    return asked(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(calls, lambda x: F.concat_ws(":", x["tool"], x["param"])), ",").alias("calls"))


def sql_every(rule: str, group: int = 0) -> str:
    return f"regexp_extract_all(query, '{rule}', {group}, 'i')"


def sql_holds(names: tuple[str, ...]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(query), '{x.lower()}') THEN '{x}' END" for x in names) + ")"


def sql_known(api: str) -> str:
    parts = [(p, f"contains(lower(query), '{p.lower()}')") for p in api.split(".")]
    return "(" + " + ".join(f"{c}::INT" for _, c in parts) + " >= 2 AND (" + " OR ".join(c for p, c in parts if len(p) > 3) + "))"


def sql_moved(i: int) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN regexp_matches(query, '{m[2]}') THEN '{m[i]}'" for m in route.MIGRATIONS) + f" END, nullif(trim(regexp_extract(query, '{route.MIGRATION}', {i + 1})), ''))"


ENTITIES = f"""e AS (SELECT *, list_concat({", ".join(sql_every(p) for p in route.QUERY_APIS)}, list_filter([{", ".join(f"CASE WHEN {sql_known(a)} THEN '{a}' END" for a in route.KNOWN_APIS)}], lambda x: x IS NOT NULL)) AS api,
list_concat({", ".join(sql_every(p) for p in route.QUERY_ERRORS)}) AS err, list_concat(CASE WHEN contains(lower(query), 'harmonyos next') THEN ['HarmonyOS NEXT'] ELSE [] END, {", ".join(f"list_transform({sql_every(p, 1)}, lambda x: '{n} ' || x)" for n, p in route.VERSIONS.items())}) AS version FROM a)"""
ONCE = "array_to_string(list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: {f}), {g}) = i), ',')"


@Q.query("query_entities", rf"""WITH {ASKED}, {ENTITIES}, t AS (SELECT *, list_transform(err, lambda x: trim(x)) AS er FROM e) SELECT conv_id, turn, {ONCE.format(c="api", f="ltrim(lower(y), '@')", g="ltrim(lower(x), '@')")} AS apis, {sql_holds(route.COMPONENTS)} AS components, {ONCE.format(c="er", f="lower(y)", g="lower(x)")} AS errors,
array_to_string(list_transform({sql_every(route.API_LEVEL, 1)}, lambda x: 'API ' || x), ',') AS api_levels, array_to_string(version, ',') AS versions, {sql_holds(route.FILES)} AS files, {sql_moved(0)} AS migration_from, {sql_moved(1)} AS migration_to FROM t""")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir).select("conv_id", "turn", route.query_entities(F.col("query")).alias("e"))
    return rows.select("conv_id", "turn", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("apis", "components", "errors", "api_levels", "versions", "files")], "e.migration_from", "e.migration_to")


BARE = f"[{', '.join(repr(x[0]) for x in routing.QUESTIONS)}][slot]"
NAMED = f"list_concat({', '.join(f"regexp_extract_all(query, '{p}')" for p in route.TERM_PATTERNS)})"


@Q.query("search_terms", f"""WITH {routing.ASKED}, b AS (SELECT conv_id, turn, {BARE} AS query, CASE WHEN conv_id % 5 = 0 THEN ['Router', ' router ', 'Stage'] ELSE [] END AS entities, CASE WHEN turn % 3 = 0 THEN ['', 'http'] ELSE [] END AS keywords FROM q),
c AS (SELECT *, CASE WHEN len(entities) > 0 THEN list_transform(entities, lambda x: trim(x)) WHEN len(keywords) > 0 THEN ['http'] ELSE {NAMED} END AS terms FROM b) SELECT conv_id, turn, {ONCE.format(c="terms", f="lower(y)", g="lower(x)")} AS terms FROM c""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = ((F.col("conv_id") + F.col("turn")) % len(routing.QUESTIONS) + 1).cast("int")
    query = F.element_at(F.array(*[F.lit(x[0]) for x in routing.QUESTIONS]), slot)
    entities = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("Router"), F.lit(" router "), F.lit("Stage")))
    keywords = F.when(F.col("turn") % 3 == 0, F.array(F.lit(""), F.lit("http")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(route.search_terms(entities, keywords, query), ",").alias("terms"))


#: Bounds of latency in seconds, one more than the dashboard's, so that the critical bound can be passed.
BOUNDS = (*monitor.LATENCY_BOUNDS, 60.0)
COUNTERS = {
    "requests": "true", "errors": "event_type = 'error'", "tool_calls": "event_type IN ('click', 'purchase')", "tool_errors": "event_type = 'purchase'", "retrievals": "event_type = 'view'",
    "no_docs": "event_type = 'view' AND value < 10", "fallbacks": "event_type = 'signup'", "passes": "value > 20", "checks": "true", "cache_hits": "user_id % 5 = 0", "cache_requests": "true",
} | {f"b{i}": " AND ".join([f"value / 10 > {BOUNDS[i - 1]}D"] * (i > 0) + [f"value / 10 <= {x}D"] * (i < len(BOUNDS))) for i, x in enumerate((*BOUNDS, 0.0))}
GAUGES = {"top_score": "max(value) / 1000", "hallucination_rate": "max(CASE WHEN event_type = 'error' THEN 0.2D ELSE 0.0D END)", "up": "max(CASE WHEN value > 30 THEN 1.0D ELSE 0.0D END)", "memory_gb": "max(value) / 5"}


def sql_samples() -> str:
    counts = ", ".join(f"count(*) FILTER ({held}) AS {name}" for name, held in COUNTERS.items())
    gauges = ", ".join(f"{c} AS {name}" for name, c in GAUGES.items())
    sql = f"m AS (SELECT user_id % 2 AS service, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 6 + hour(ts) // 4 AS minute, {counts}, {gauges} FROM events GROUP BY 1, 2)"
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", sql)


def sql_rules() -> str:
    rolled = {f"{c}_{n}": f"sum({c}) OVER (PARTITION BY service ORDER BY minute RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)::DOUBLE" for listed in monitor.ALERTS.values() for _, _, what, n, _, _, _ in listed if "/" in what for c in what.split("/")}
    rolled |= {f"c{i}": " + ".join(f"sum(b{j}) OVER (PARTITION BY service ORDER BY minute RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE" for j in range(i + 1)) for i in range(len(BOUNDS) + 1)}
    last = f"c{len(BOUNDS)}"
    steps = " ".join(f"WHEN c{i} >= {last} * 0.95 THEN {BOUNDS[i - 1] if i else 0.0} + {BOUNDS[i] - (BOUNDS[i - 1] if i else 0.0)}::DOUBLE * ({last} * 0.95::DOUBLE - {f'c{i - 1}' if i else 0}) / nullif(c{i} - {f'c{i - 1}' if i else 0}, 0)" for i in range(len(BOUNDS)))
    flags = []
    for group, listed in monitor.ALERTS.items():
        for name, level, what, n, side, bound, lasts in listed:
            value = "p95" if what == "p95_latency" else f"{what.split('/')[0]}_{n} / nullif({what.split('/')[1]}_{n}, 0)" if "/" in what else what
            flags.append(f"SELECT service, minute, '{group}' AS \"group\", '{name}' AS alert, '{level}' AS severity, {lasts} AS lasts FROM p WHERE {value} {side} {bound}::DOUBLE")
    return f"""w AS (SELECT *, {", ".join(f"{c} AS {name}" for name, c in rolled.items())} FROM m), p AS (SELECT *, CASE WHEN {last} = 0 THEN NULL {steps} ELSE {BOUNDS[-1]} END AS p95 FROM w), f AS ({" UNION ALL ".join(flags)}),
r AS (SELECT *, minute - row_number() OVER (PARTITION BY service, alert ORDER BY minute) AS run FROM f) SELECT service, "group", alert, severity, min(minute) AS started, max(minute) AS ended FROM r GROUP BY service, "group", alert, severity, lasts, run HAVING max(minute) - min(minute) >= lasts"""


@Q.query("alert_rules", f"WITH {sql_samples()}, {sql_rules()}")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two services of events; four hours stand for a minute, event types and values for what a service counts."""
    rows = table(spark, sf_dir, "events").withColumn("service", F.col("user_id") % 2).withColumn("minute", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 6 + F.floor(F.hour("ts") / 4).cast("int"))
    samples = rows.groupBy("service", "minute").agg(*[F.count_if(F.expr(held)).alias(name) for name, held in COUNTERS.items()], *[F.expr(c).alias(name) for name, c in GAUGES.items()])
    return monitor.alert_rules(samples, "service", "minute", BOUNDS)


@Q.query("update_mode", "WITH s AS (SELECT source, count(*) AS total, count(*) FILTER (n_chars > 1500 AND source LIKE '%1%' OR doc_id % 97 = 0) AS changed FROM documents GROUP BY source) SELECT source, changed, total, CASE WHEN changed = 0 THEN 'none' WHEN changed > total * 0.5 THEN 'full' ELSE 'incremental' END AS mode FROM s")
def update_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = (F.col("n_chars") > 1500) & F.col("source").like("%1%") | (F.col("doc_id") % 97 == 0)
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(changed).alias("changed"), F.count("*").alias("total"))
    return counts.withColumn("mode", tables.update_mode(F.col("changed"), F.col("total")))


@Q.query("optional_filter", "SELECT 'given' AS asked, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'all', count(*) FROM events")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    count = lambda name, kind: tables.given(events, event_type=kind).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
    return count("given", "error").unionByName(count("all", None))


@Q.query("tenant_context", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_nationkey WHEN c_custkey % 5 = 0 THEN 'h' || c_nationkey ELSE 'default' END AS tenant_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'anonymous' END AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'admin' ELSE 'basic' END AS role FROM customer""")
def tenant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    token = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("tenant_id"), F.concat(F.lit("t"), nation), F.lit("sub"), F.col("c_name")))
    headers = F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("x-tenant-id"), F.concat(F.lit("h"), nation), F.lit("x-role"), F.lit("admin")))
    return table(spark, sf_dir, "customer").select("c_custkey", tables.tenant_context(token, headers).alias("t")).select("c_custkey", "t.*")


@Q.query("entity_candidates", """WITH e AS (SELECT p_partkey % 40 AS query_id, p_partkey AS entity_id, 0.5 + (p_partkey % 4) / 8 AS score, p_name AS name FROM part WHERE p_partkey % 40 NOT IN (SELECT ps FROM (SELECT DISTINCT p_size % 40 AS ps FROM part WHERE p_size < 20))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM e) SELECT query_id, 'entity:' || entity_id AS chunk_id, 'graph' AS doc_id, '[PART] ' || name || ': 知识图谱实体' AS content, score::DOUBLE AS score FROM r WHERE rank <= 10""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entities = part.select((F.col("p_partkey") % 40).alias("query_id"), F.col("p_partkey").alias("entity_id"), F.lit("PART").alias("kind"), F.col("p_name").alias("name"), (F.lit(0.5) + F.col("p_partkey") % 4 / 8).alias("score"))
    return graph.entity_candidates(entities, part.filter("p_size < 20").select((F.col("p_size") % 40).alias("query_id")))


@Q.query("graph_edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph of all conversations: patterns of one engine have no like in the other, so fixtures hold them."""
    turns = asked(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("query").alias("content"))
    mentions = graph.extract_entities(turns)
    return graph.build_graph(turns, mentions, graph.pattern_relations(mentions, turns))[1]
