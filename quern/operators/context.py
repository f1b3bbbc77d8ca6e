"""The context of an answer: five parts share a token budget by priority, then citations and texts are built of what fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Marks of the parts of a context window and of the list of references.
USER, SUMMARY, HISTORY, DOCS, DOCS_UNIT, REFERENCES = "[用户信息]", "[会话摘要]", "[历史对话]", "[参考文档]", "篇", "\n---\n## 📚 参考来源\n"
SHOWN_TURNS, TURN_CHARS, EXCERPT_CHARS = 6, 150, 120


def running(rows: DataFrame, order: list[Column], text: str, most: int) -> DataFrame:
    """rows with their tokens and the sum of tokens up to them, without those beyond what any budget could hold."""
    upto = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("tokens", T.estimate_tokens(F.col(text)))
    return counted.withColumn("used", F.sum("tokens").over(upto)).filter(F.col("used") <= most)


def listed(rows: DataFrame, name: str, place: str, *columns: str) -> DataFrame:
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place, "tokens", "used", *columns))).alias(name))


def build_contexts(queries: DataFrame, docs: DataFrame, tools: DataFrame, history: DataFrame, most: int = 4096) -> DataFrame:
    """A row for each query (id, query, summary, user_context): tokens of its parts and what is left, documents and turns that fit,
    references and the context window.

    docs (id, rank, source, chunk_id, score, content), tools (id, place, output), history (id, turn, role, content). The query comes first, then the
    documents by rank, the tools' outputs in order, the summary, and the turns from the newest back; each list is cut before the first
    that doesn't fit in what the parts before it left over, and query and summary count as far as there is room.
    """
    none = lambda name, like: F.coalesce(F.col(name), F.expr(f"cast(array() as {like})"))
    docs_list = listed(running(docs, [F.col("rank")], "content", most), "docs", "rank", "source", "chunk_id", "score", "content")
    tool_list = listed(running(tools, [F.col("place")], "output", most), "tools", "place")
    turn_list = listed(running(history, [F.desc("turn")], "content", most), "turns", "turn", "role", "content")
    rows = queries
    for part in (docs_list, tool_list, turn_list):
        kind = part.schema[1].dataType.simpleString()
        rows = rows.join(part, "id", "left").withColumn(part.columns[1], none(part.columns[1], kind))
    fit = lambda name, left: F.filter(name, lambda x: x["used"] <= left)
    total = lambda name: F.coalesce(F.array_max(F.transform(name, lambda x: x["used"])), F.lit(0)).cast("long")
    rows = rows.withColumn("query_tokens", F.least(T.estimate_tokens(F.col("query")), F.lit(most).cast("long")))
    left = F.lit(most).cast("long") - F.col("query_tokens")
    rows = rows.withColumn("docs", fit("docs", left)).withColumn("docs_tokens", total("docs"))
    left = left - F.col("docs_tokens")
    rows = rows.withColumn("tools", fit("tools", left)).withColumn("tools_tokens", total("tools"))
    left = left - F.col("tools_tokens")
    rows = rows.withColumn("summary_tokens", F.least(T.estimate_tokens(F.col("summary")), left))
    left = left - F.col("summary_tokens")
    rows = rows.withColumn("turns", fit("turns", left)).withColumn("history_tokens", total("turns"))
    rows = rows.withColumn("remaining", left - F.col("history_tokens"))
    return rows.withColumns({"references": references(F.col("docs")), "window": context_window(F.col("user_context"), F.col("summary"), F.col("turns"), F.col("docs"))})


def references(docs: Column) -> Column:
    """A Markdown list of documents by number, source and excerpt; empty without any."""
    line = lambda d, i: F.concat(F.lit("- **["), (i + 1).cast("string"), F.lit("]** `"), F.coalesce(d["source"], F.lit("")), F.lit("` — "), F.translate(F.substring(F.coalesce(d["content"], F.lit("")), 1, EXCERPT_CHARS), "\n", " "))
    return F.when(F.size(docs) > 0, F.concat_ws("\n", F.lit(REFERENCES), F.array_join(F.transform(docs, line), "\n"))).otherwise("")


def context_window(user: Column, summary: Column, turns: Column, docs: Column) -> Column:
    """The parts that there are, apart by a blank line; of the turns the last six."""
    said = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark + "\n"), c))
    shown = F.slice(turns, F.greatest(F.size(turns) - SHOWN_TURNS + 1, F.lit(1)), SHOWN_TURNS)
    lines = F.transform(shown, lambda t: F.concat(F.lit("  "), F.coalesce(t["role"], F.lit("?")), F.lit(": "), F.substring(F.coalesce(t["content"], F.lit("")), 1, TURN_CHARS)))
    parts = [said(USER, user), said(SUMMARY, summary), F.when(F.size(turns) > 0, F.concat(F.lit(HISTORY + "\n"), F.array_join(lines, "\n"))), F.when(F.size(docs) > 0, F.concat(F.lit(f"{DOCS} ("), F.size(docs).cast("string"), F.lit(f" {DOCS_UNIT})")))]
    return F.concat_ws("\n\n", *parts)
