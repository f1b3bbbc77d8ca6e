"""Windows over conversations, memory scores, claims and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import memory, near
from quern.plans.ingestion import PASS_SQL, VECTORS_SQL, print_vectors
from quern.plans.registry import Registry
from quern.sources.tables import table

Q = Registry()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@Q.query("last_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.last_turns(turns(spark, sf_dir), 3).select("conv_id", "turn", "role")


BUDGET_SQL = """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END AS tokens FROM conversations),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM t) SELECT conv_id, turn, CAST(tokens AS BIGINT) AS tokens FROM u WHERE used <= 800"""


@Q.query("history_budget", BUDGET_SQL)
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history_budget(turns(spark, sf_dir), 800)


@Q.query("turn_position", "SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) < count(*) OVER (PARTITION BY conv_id) / 2 AS first_half FROM conversations")
def turn_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.positions(turns(spark, sf_dir)).select("conv_id", "turn", (F.col("place") == 0).alias("is_first"), (F.col("place") < F.col("total") / 2).alias("first_half"))


@Q.query("session_summary", """SELECT conv_id, count(*) AS turns, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id HAVING count(*) >= 4""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.summaries(turns(spark, sf_dir), 4)


@Q.query("memory_importance", r"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, round(greatest(0.0, least(1.0, CASE WHEN contains(text, '```') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\b(error|exception|traceback|stack\s?trace)\b|nullpointer|500|502|503|404|401|403|timeout') THEN 0.2 ELSE 0 END
 + CASE WHEN place = 0 THEN 0.15 ELSE 0 END + CASE WHEN length(text) > 100 THEN 0.15 ELSE 0 END + CASE WHEN role = 'user' THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '?') THEN 0.1 ELSE 0 END
 + CASE WHEN len(regexp_extract_all(text, '@ohos\.[\w.]+|API\s*\d{1,2}|https?://\S+|[A-Z][a-z]+(?:[A-Z][a-z]+)+')) >= 2 THEN 0.1 ELSE 0 END + CASE WHEN place < total / 2 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS importance FROM p""")
def memory_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.positions(turns(spark, sf_dir)).select("conv_id", "turn", F.round(memory.importance(F.col("text"), F.col("role"), F.col("place"), F.col("total")), 6).alias("importance"))


@Q.query("memory_rank", """WITH m AS (SELECT user_id, event_id, (event_id % 10) / 10.0 AS relevance, (event_id % 7) / 7.0 AS importance, greatest(0, epoch(TIMESTAMP '2024-03-01' - ts)) / 86400.0 AS age FROM events),
s AS (SELECT user_id, event_id, round(0.5 * relevance + 0.3 * importance + 0.2 * pow(2.718281828, -age / 30), 6) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s) SELECT user_id, event_id, score, rank FROM r WHERE rank <= 3""")
def memory_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", (F.col("event_id") % 10 / 10.0).alias("relevance"), (F.col("event_id") % 7 / 7.0).alias("importance"), "ts")
    scored = rows.withColumn("score", F.round(memory.recall_score(F.col("relevance"), F.col("importance"), F.col("ts"), F.lit("2024-03-01").cast("timestamp")), 6))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("user_id", "event_id", "score", "rank")


@Q.query("memory_cap", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def memory_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).filter("r <= 100").select("user_id", "event_id")


#: Phrases that are put before turns, as the tables' own texts hold none of the words that routing asks for.
TOLD = ("", "以后请用中文回答", "我在做一个 RAG 平台", "我主要写 Python 后端", "这次先不用管", "纠正一下 不是 A 是 B", "我负责部署系统", "token = abc123")


def sql_told(pattern: str) -> str:
    return f"regexp_matches(text, '(?-s){pattern}', 'i')"


@Q.query("memory_route", rf"""WITH t AS (SELECT conv_id, turn, role, [{", ".join(f"'{x}'" for x in TOLD)}][1 + (conv_id + turn) % {len(TOLD)}] || ' ' || text AS text FROM conversations),
m AS (SELECT *, CASE {" ".join(f"WHEN {sql_told(p)} THEN '{n}'" for n, p in memory.PROFILE.items())} END AS field, {sql_told(memory.ONE_OFF)} AS once, regexp_matches(text, '(?i)\b\d{{6}}\b|api[_-]?key\s*[:=]\s*\S+|password\s*[:=]\s*\S+|token\s*[:=]\s*\S+|\b1[3-9]\d{{9}}\b') AS secret FROM t),
s AS (SELECT *, CASE WHEN field IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN {sql_told(memory.LONG_TERM)} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{memory.PROJECT}') THEN 2 ELSE 0 END + (role = 'user')::INT + {sql_told(memory.CORRECTION)}::INT - CASE WHEN once THEN 3 ELSE 0 END - CASE WHEN secret THEN 5 ELSE 0 END - CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS score FROM m)
SELECT conv_id, turn, CAST(score AS INT) AS score, field, concat_ws(',', 'short_term', CASE WHEN role = 'system' THEN 'checkpoint' END, CASE WHEN role <> 'system' THEN nullif(concat_ws(',', CASE WHEN turn * 4 >= 20 THEN 'summary' END, CASE WHEN secret THEN 'skip' END, CASE WHEN NOT secret AND field IS NOT NULL AND score >= 3 THEN 'user_profile,semantic' END, CASE WHEN NOT secret AND score >= 4 AND NOT once THEN 'episodic' END), '') END) AS targets FROM s""")
def memory_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns count as told before, assistants' as inferred, system turns as states of execution."""
    slot = ((F.col("conv_id") + F.col("turn")) % len(TOLD) + 1).cast("int")
    told = turns(spark, sf_dir).withColumn("text", F.concat(F.element_at(F.array(*map(F.lit, TOLD)), slot), F.lit(" "), "text"))
    routed = memory.routes(told, F.col("role") == "user", F.col("role") == "assistant", F.col("role") == "system", F.col("turn") * 4)
    return routed.select("conv_id", "turn", "score", "field", F.array_join("targets", ",").alias("targets"))


@Q.query("claim_evidence", r"""WITH c AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\n+')) AS claim FROM conversations WHERE role = 'assistant'), d AS (SELECT conv_id, turn AS doc, text FROM conversations WHERE role <> 'assistant'),
w AS (SELECT DISTINCT conv_id, turn, doc, claim, list_distinct(list_filter(string_split_regex(lower(claim), '\s+'), lambda x: x <> '')) AS own, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS words FROM c JOIN d USING (conv_id))
SELECT conv_id, turn, claim, doc FROM w WHERE len(own) > 0 AND len(words) > 0 AND len(list_intersect(own, words)) / greatest(len(own), len(words))::DOUBLE > 0.02""")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of answers and the other turns of their conversations that share words with them; these texts share few."""
    said = turns(spark, sf_dir)
    lines = said.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("text", r"\n+")).alias("claim")).distinct()
    return memory.claim_evidence(lines, said.filter("role <> 'assistant'").select("conv_id", F.col("turn").alias("doc"), "text"), 0.02)


@Q.query("rule_verdict", r"""WITH a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' [1]' ELSE text END AS answer, conv_id % 4 AS docs, 0.001 * (1 + turn) AS best, 0.00095 * (1 + turn) AS mean, conv_id % 3 AS citations, (conv_id % 5 = 0)::INT AS conflicts FROM conversations WHERE role <> 'system'),
f AS (SELECT *, trim(answer) = '' AS blank, regexp_matches(answer, '参考来源|引用|\[1\]|citation') AS cites FROM a),
i AS (SELECT *, CASE WHEN blank THEN 'empty' WHEN docs = 0 THEN 'no_docs' ELSE concat_ws(',', CASE WHEN docs >= 2 AND mean > 0 AND best / mean < 1.1 AND best < 0.02 THEN 'noise' END, CASE WHEN NOT cites AND citations > 0 THEN 'no_marks' END, CASE WHEN NOT cites AND citations = 0 THEN 'no_citations' END, CASE WHEN length(trim(answer)) < 10 THEN 'short' END, CASE WHEN conflicts > 0 THEN 'conflicts' END) END AS issues FROM f)
SELECT conv_id, turn, issues, NOT blank AND docs > 0 AND (issues = '' OR NOT contains(issues, ',')) AS verified FROM i""")
def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("turn") % 5 == 0, "").when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" [1]"))).otherwise(F.col("text"))
    verdict = memory.rule_verdict(answer, F.col("conv_id") % 4, 0.001 * (1 + F.col("turn")), 0.00095 * (1 + F.col("turn")), F.col("conv_id") % 3, (F.col("conv_id") % 5 == 0).cast("int"))
    found = turns(spark, sf_dir).filter("role <> 'system'").select("conv_id", "turn", verdict.alias("v"))
    return found.select("conv_id", "turn", F.array_join("v.issues", ",").alias("issues"), "v.verified")


@Q.query("memory_dedup", "SELECT conv_id, min(turn) AS turn, count(*) AS copies FROM conversations GROUP BY conv_id, sha256(lower(trim(text)))")
def memory_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id", T.query_key(F.col("text")).alias("key")).agg(F.min("turn").alias("turn"), F.count("*").alias("copies")).drop("key")


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as what is told in a scope (their language) in the order of ids, one each five minutes."""
    vectors = print_vectors(spark, sf_dir).withColumnRenamed("id", "at")
    rows = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("scope"), F.col("doc_id").alias("at"), T.query_key(F.col("text")).alias("key"), (F.col("doc_id") * 300.0).alias("t"))
    return rows.join(vectors, "at", "left")


TOLD_SQL = "WITH RECURSIVE " + VECTORS_SQL + """, rows AS (SELECT coalesce(lang, '') AS scope, doc_id AS pos, sha256(lower(trim(text))) AS key, doc_id * 300.0 AS t FROM documents),
same AS (SELECT a.scope, a.pos AS a, b.pos AS b, b.t - a.t AS age FROM rows a JOIN rows b ON a.scope = b.scope AND a.key = b.key AND a.pos < b.pos),
close AS (SELECT x.scope, a, b, y.t - x.t AS age FROM cosines JOIN rows x ON x.pos = a JOIN rows y ON y.pos = b AND y.scope = x.scope WHERE similarity >= 0.92),
pairs AS (SELECT DISTINCT scope, a, b FROM (SELECT * FROM same UNION ALL SELECT * FROM close) {where})""" + PASS_SQL


@Q.query("memory_near_dedup", TOLD_SQL.format(where="") + " SELECT scope AS user_id, pos AS doc_id, kept FROM g")
def memory_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of a user that are new: no kept one has the same text, or a cosine of 0.92 or more."""
    return near.keep_new(remembered(spark, sf_dir)).select(F.col("scope").alias("user_id"), F.col("at").alias("doc_id"), "kept")


@Q.query("cache_near_lookup", TOLD_SQL.format(where="WHERE age < 150000") + """, hit AS (SELECT DISTINCT g.scope, g.pos FROM g JOIN same ON same.scope = g.scope AND same.b = g.pos AND age < 150000 JOIN g k ON k.scope = g.scope AND k.pos = same.a AND k.kept WHERE NOT g.kept)
SELECT g.scope, g.pos AS doc_id, CASE WHEN kept THEN 'miss' WHEN hit.pos IS NOT NULL THEN 'exact' ELSE 'near' END AS outcome FROM g LEFT JOIN hit ON hit.scope = g.scope AND hit.pos = g.pos""")
def cache_near_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a scope that a cached one answers: the same text first, else one that is close; both for 150,000 seconds."""
    return near.cache_outcomes(remembered(spark, sf_dir), ttl=150_000.0).select("scope", F.col("at").alias("doc_id"), "outcome")


@Q.query("cache_lookup", """WITH k AS (SELECT conv_id, turn, sha256(lower(trim(text))) AS key FROM conversations WHERE role = 'user'), f AS (SELECT key, min(conv_id * 1000 + turn) AS first FROM k GROUP BY key)
SELECT conv_id, turn, first < conv_id * 1000 + turn AS hit FROM k JOIN f USING (key)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's text was asked before, in the order of conversations and turns."""
    keyed = turns(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", T.query_key(F.col("text")).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    first = keyed.groupBy("key").agg(F.min("at").alias("first"))
    return keyed.join(first, "key").select("conv_id", "turn", (F.col("first") < F.col("at")).alias("hit"))


@Q.query("cache_stats", """WITH k AS (SELECT conv_id * 1000 + turn AS pos, sha256(lower(trim(text))) AS key FROM conversations WHERE role = 'user'), f AS (SELECT key, min(pos) AS first FROM k GROUP BY key)
SELECT count(*) AS lookups, count(*) FILTER (first < pos) AS hits, round(count(*) FILTER (first < pos) / greatest(count(*), 1), 4) AS hit_rate FROM k JOIN f USING (key)""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.count_if("hit")
    return cache_lookup(spark, sf_dir).agg(F.count("*").alias("lookups"), hits.alias("hits"), F.round(hits / F.greatest(F.count("*"), F.lit(1)), 4).alias("hit_rate"))


CLAIMS_SQL = r"""s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([。！？.!?\n])', '\1' || chr(1), 'g'), chr(1))) AS raw FROM conversations WHERE role = 'assistant'),
cl AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '')) AS claim FROM s),
cw AS (SELECT conv_id, turn, claim, list_filter(list_distinct(string_split_regex(lower(claim), '\s+')), lambda x: length(x) > 2) AS words FROM cl WHERE length(claim) > 3),
u AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS context FROM conversations WHERE role = 'user' GROUP BY conv_id),
g AS (SELECT conv_id, turn, claim, CASE WHEN len(words) = 0 THEN 0.3 ELSE CASE WHEN r >= 0.5 THEN least(1.0, 0.5 + 0.5 * r) WHEN r >= 0.3 THEN 0.4 ELSE 0.2 END END AS confidence, len(words) > 0 AND r >= 0.5 AS grounded
 FROM (SELECT cw.*, len(list_filter(words, lambda w: list_contains(string_split_regex(coalesce(context, ''), '\s+'), w))) / greatest(len(words), 1) AS r FROM cw LEFT JOIN u USING (conv_id)))"""


@Q.query("claim_grounding", "WITH " + CLAIMS_SQL + " SELECT conv_id, turn, claim, round(confidence, 6)::DOUBLE AS confidence, grounded FROM g")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    answers = rows.filter("role = 'assistant'").select("conv_id", "turn", "text")
    context = memory.joined_texts(rows.filter("role = 'user'"))
    return memory.claims(answers, context).withColumn("confidence", F.round("confidence", 6))


@Q.query("claim_rollup", "WITH " + CLAIMS_SQL + """ SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (grounded) AS grounded, count(*) FILTER (NOT grounded AND confidence < 0.3) AS hallucinated, count(*) FILTER (NOT grounded AND confidence >= 0.3) AS uncertain,
 count(*) FILTER (NOT grounded AND confidence < 0.3) = 0 AND count(*) FILTER (NOT grounded AND confidence >= 0.3) <= greatest(1, 0.2 * count(*)) AS verified FROM g GROUP BY conv_id, turn""")
def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.claim_rollup(claim_grounding(spark, sf_dir), "conv_id", "turn")


@Q.query("answer_eval", """WITH a AS (SELECT conv_id, turn, text, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations), f AS (SELECT *, contains(text, '[') AS cites, length(text) > 20 AS long_enough, regexp_matches(lower(text), 'cannot|sorry|nicht') AS refuses FROM a WHERE role = 'assistant')
SELECT count(*) AS answers, round(avg(cites::INT), 4) AS citation_rate, round(avg(long_enough::INT), 4) AS length_rate, round(avg(refuses::INT), 4) AS refusal_rate, round(avg((question IS NOT NULL)::INT), 4) AS answered_rate FROM f""")
def answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, sf_dir).withColumn("question", F.lag("text").over(order)).filter("role = 'assistant'")
    rate = lambda flag, name: F.round(F.avg(flag.cast("int")), 4).alias(name)
    return rows.agg(F.count("*").alias("answers"), rate(F.contains("text", F.lit("[")), "citation_rate"), rate(F.length("text") > 20, "length_rate"), rate(F.lower("text").rlike("cannot|sorry|nicht"), "refusal_rate"), rate(F.col("question").isNotNull(), "answered_rate"))


@Q.query("feedback_capture", """WITH j AS (SELECT d.doc_id, l.quality, l.toxic, length(text) AS n FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, quality = 0 AS thumbs_down, concat_ws('; ', CASE WHEN n < 100 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'no feedback' END) AS reason FROM j""")
def feedback_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.concat_ws("; ", F.when(F.length("text") < 100, "short"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality").isNull(), "no feedback"))
    return rows.select("doc_id", (F.col("quality") == 0).alias("thumbs_down"), reason.alias("reason"))
