"""Conversation windows, memory scores, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: What raises a turn's importance.
ERRORS = r"(?i)\b(error|exception|traceback|stack\s?trace)\b|nullpointer|失败|错误|异常|报错|堆栈|500|502|503|404|401|403|timeout|超时"
TECHNICAL = r"(@ohos\.[\w.]+|import\s+\{.*?\}\s+from|API\s*\d{1,2}|HarmonyOS\s*(?:NEXT\s*)?\d+\.\d+|https?://[^\s]+|[A-Z][a-z]+(?:[A-Z][a-z]+)+)"
#: What makes a turn worth keeping or not; letters in either case. Project words may stand anywhere.
PROJECT = r"rag|agent|langgraph|milvus|elasticsearch|neo4j|redis|postgresql|评测|部署"
PROFILE = {
    "preferred_language": r"以后.*(中文|英文).*回答|以后.*用(中文|英文)|回答.*用(中文|英文)",
    "answer_style": r"以后.*(简洁|详细|分步骤|直接).*回答|回答.*(简洁|详细|分步骤|直接)",
    "primary_stack": r"我主要(写|做|负责).*(Python|Java|Go|前端|后端|RAG|Agent)|我的技术栈.*(Python|Java|Go|React|FastAPI|LangGraph)",
}
LONG_TERM = r"我在做.*(项目|系统|平台)|我负责.*(项目|模块|系统|平台)|我们项目.*(使用|采用|基于)|长期.*(目标|计划|需求)|之后.*都要.*"
ONE_OFF = r"这次先|临时|今天|明天|刚才|等会"
CORRECTION = r"不是.*是.*|我刚才说错了|纠正一下"


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def history_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The latest turns whose tokens fit together."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))
    return rows.withColumn("used", F.sum("tokens").over(order)).filter(F.col("used") <= budget).drop("used")


def positions(turns: DataFrame) -> DataFrame:
    """turns with their place from 0 and how many there are."""
    own = Window.partitionBy("conv_id")
    return turns.withColumn("place", F.row_number().over(own.orderBy("turn")) - 1).withColumn("total", F.count("*").over(own))


def summaries(turns: DataFrame, least: int) -> DataFrame:
    """First question and last answer of conversations of at least so many turns."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    last = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), first.alias("first_user"), last.alias("last_assistant")).filter(F.col("turns") >= least)


def importance(text: Column, role: Column, place: Column, total: Column, feedback: Column | None = None, age_hours: Column | None = None) -> Column:
    """Importance of a turn, between 0 and 1."""
    signals = [
        (F.contains(text, F.lit("```")), 0.25), (text.rlike(ERRORS), 0.2), (place == 0, 0.15), (F.length(text) > 100, 0.15), (role == "user", 0.1),
        (F.contains(text, F.lit("?")) | F.contains(text, F.lit("？")), 0.1), (F.size(F.regexp_extract_all(text, F.lit(TECHNICAL), 1)) >= 2, 0.1),
        (F.size(F.regexp_extract_all(text, F.lit(r"(@ohos\.[\w.]+)"), 1)) >= 3, 0.1), (place < total / 2, 0.05),
    ]
    score = reduce(lambda s, x: s + F.when(x[0], x[1]).otherwise(0.0), signals, F.lit(0.0))
    if feedback is not None:
        score = score + F.when(feedback > 0, F.least(F.lit(0.15), feedback * 0.15)).otherwise(0.0)
    if age_hours is not None:  # the longer age is tested first
        score = score - F.when(age_hours > 720, 0.2).when(age_hours > 168, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def recall_score(relevance: Column, weight: Column, created: Column, as_of: Column) -> Column:
    """Half relevance, three tenths importance, two tenths freshness with a month's decay."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1e6 / 86400)
    return 0.5 * relevance + 0.3 * weight + 0.2 * F.pow(F.lit(2.718281828), -days / 30)


def routes(turns: DataFrame, repeated: Column, inferred: Column | None = None, workflow: Column | None = None, session_turns: Column | None = None, session_tokens: Column | None = None) -> DataFrame:
    """Score, profile field, target layers and importance of each turn that isn't blank.

    repeated: told before; inferred: by a model, not by the user; workflow: a state of execution; then how long the session is.
    """
    no, none = F.lit(False), F.lit(0)
    inferred, workflow = (no if x is None else x for x in (inferred, workflow))
    session_turns, session_tokens = (none if x is None else x for x in (session_turns, session_tokens))
    text = F.col("text")
    has = lambda p: text.rlike("(?diuU)" + p)
    points = lambda held, n: F.when(held, n).otherwise(0)
    secret, once = T.sensitive(text), has(ONE_OFF)
    field = F.coalesce(*[F.when(has(p), F.lit(name)) for name, p in PROFILE.items()], F.lit(None).cast("string"))
    score = points(field.isNotNull(), 3) + points(has(LONG_TERM), 2) + points(F.lower(text).rlike(PROJECT), 2) + points(repeated, 1) + points(has(CORRECTION), 1) - points(once, 3) - points(secret, 5) - points(inferred, 2)
    profile = F.col("field").isNotNull() & (F.col("score") >= 3)
    kept = [F.when(secret, "skip"), F.when(~secret & profile, "user_profile"), F.when(~secret & profile, "semantic"), F.when(~secret & (F.col("score") >= 4) & ~once, "episodic")]
    layers = F.array(F.lit("short_term"), F.when(workflow, "checkpoint"), *[F.when(~workflow, x) for x in (F.when((session_turns >= 20) | (session_tokens >= 6000), "summary"), *kept)])
    rows = turns.filter(F.regexp_replace("text", r"(?U)\s", "") != "").withColumns({"field": field, "score": score})
    return rows.withColumn("targets", F.filter(layers, lambda x: x.isNotNull())).withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 6)))


def joined_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, context): all texts of a conversation in order, in lower case."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.lower(F.array_join(F.transform(listed, lambda x: x["text"]), " ")).alias("context"))


def claims(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Claims of answers, how far their longer words occur in the context, and whether half of them do."""
    split = answers.select("conv_id", "turn", F.explode(T.split_claims(F.col("text"))).alias("claim"))
    words = F.filter(F.array_distinct(F.split(F.lower("claim"), r"\s+")), lambda x: F.length(x) > 2)
    rows = split.withColumn("words", words).join(context, "conv_id", "left")
    held = F.size(F.array_intersect("words", F.split(F.coalesce("context", F.lit("")), r"\s+")))
    share = held / F.greatest(F.size("words"), F.lit(1))
    some = F.size("words") > 0
    confidence = F.when(~some, 0.3).when(share >= 0.5, F.least(F.lit(1.0), 0.5 + 0.5 * share)).when(share >= 0.3, 0.4).otherwise(0.2)
    return rows.select("conv_id", "turn", "claim", confidence.alias("confidence"), (some & (share >= 0.5)).alias("grounded"))


def claim_rollup(rows: DataFrame, *key: str) -> DataFrame:
    """Counts for each answer; verified if nothing is made up and little is uncertain."""
    wrong, unsure = F.count_if(~F.col("grounded") & (F.col("confidence") < 0.3)), F.count_if(~F.col("grounded") & (F.col("confidence") >= 0.3))
    counted = rows.groupBy(*key).agg(F.count("*").alias("claims"), F.count_if("grounded").alias("grounded"), wrong.alias("hallucinated"), unsure.alias("uncertain"))
    return counted.withColumn("verified", (F.col("hallucinated") == 0) & (F.col("uncertain") <= F.greatest(F.lit(1.0), 0.2 * F.col("claims"))))


def claim_evidence(claims: DataFrame, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(conv_id, turn, claim, doc): documents (conv_id, doc, text) of the same conversation that share most words with a claim.

    The share is of the larger of both sets of words. Both sides are keyed by conversation, so none meets all documents.
    """
    left = claims.select("conv_id", "turn", "claim", T.word_set(F.col("claim")).alias("own"))
    right = docs.select("conv_id", "doc", T.word_set(F.col("text")).alias("words"))
    share = F.size(F.array_intersect("own", "words")) / F.greatest(F.size("own"), F.size("words"))
    return left.join(right, "conv_id").filter((F.size("own") > 0) & (F.size("words") > 0) & (share > least)).select("conv_id", "turn", "claim", "doc")


def rule_verdict(answer: Column, docs: Column, best_score: Column, mean_score: Column, citations: Column, conflicts: Column) -> Column:
    """struct(issues, verified): an answer may have one issue at most; a blank one, or one without documents, is never verified."""
    cites = answer.rlike(r"参考来源|引用|\[1\]|citation")
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    noise = (docs >= 2) & (mean_score > 0) & (best_score / mean_score < 1.1) & (best_score < 0.02)
    found = [F.when(noise, "noise"), F.when(~cites & (citations > 0), "no_marks"), F.when(~cites & (citations == 0), "no_citations"), F.when(F.length(text) < 10, "short"), F.when(conflicts > 0, "conflicts")]
    issues = F.when(text == "", F.array(F.lit("empty"))).when(docs == 0, F.array(F.lit("no_docs"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.struct(issues.alias("issues"), ((text != "") & (docs > 0) & (F.size(issues) <= 1)).alias("verified"))
