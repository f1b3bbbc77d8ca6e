"""Judging answers and gates, prompt versions and splits."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def rule_judge(query: Column, answer: Column, n_docs: Column) -> Column:
    """struct of six marks, their mean and whether that is 0.6 or more."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    named = F.size(F.filter(words, lambda w: F.contains(answer, w))) / F.greatest(F.size(words), F.lit(1))
    has_docs, cites = n_docs > 0, F.exists(F.array(*map(F.lit, ("[1]", "[2]", "参考来源", "引用"))), lambda m: F.contains(answer, m))
    marks = [
        F.when((F.length(F.trim(answer)) >= 20) & has_docs, 0.8).otherwise(0.3), F.when(has_docs, F.least(n_docs / 5, F.lit(1.0))).otherwise(0.0), F.when(has_docs, 1.0).otherwise(0.0),
        F.when(has_docs, 1.0).otherwise(0.0), F.when(cites, 0.8).otherwise(0.3), F.least(named + 0.3, F.lit(1.0)),
    ]
    overall = F.round(sum(marks[1:], marks[0]) / 6, 4)
    names = ("precision", "recall", "mrr", "hit_rate", "faithfulness", "relevance")
    return F.struct(*[F.round(m, 4).alias(n) for m, n in zip(marks, names, strict=True)], overall.alias("overall"), (overall >= 0.6).alias("passing"))


def gate(cases: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Weighted means of cases (faithfulness, context_recall, answer_relevancy, intent_correct), and whether they pass."""
    f, r, a, i = F.avg("faithfulness"), F.avg("context_recall"), F.avg("answer_relevancy"), F.avg(F.col("intent_correct").cast("int"))
    overall = F.round(f * 0.4 + r * 0.3 + a * 0.2 + i * 0.1, 4)
    return cases.agg(overall.alias("overall"), F.round(f, 4).alias("faithfulness"), F.round(r, 4).alias("context_recall"), F.round(a, 4).alias("answer_relevancy"), F.round(i, 4).alias("intent_accuracy"), (overall >= threshold).alias("passed"))


def regression(cases: DataFrame) -> DataFrame:
    """Summary of cases (intent_ok, found, expected, verified): how many pass, intent accuracy, share of keywords found."""
    passed = F.col("intent_ok") & (F.col("found") > 0) & F.col("verified")
    n = F.greatest(F.count("*"), F.lit(1))
    return cases.agg(F.count("*").alias("cases"), F.count_if(passed).alias("passed"), F.round(F.count_if("intent_ok") / n, 4).alias("intent_accuracy"), F.round(F.sum("found") / F.greatest(F.sum("expected"), F.lit(1)), 4).alias("keyword_rate"))


def allocate(row_tokens: dict[str, Column], budget: int) -> Column:
    """struct of what each part gets, in the order given: each takes from what is left."""
    left: Column = F.lit(budget).cast("long")
    out = []
    for name, tokens in row_tokens.items():
        taken = F.least(tokens, left)
        out.append(taken.alias(name))
        left = left - taken
    return F.struct(*out, left.alias("remaining"))


def split_version(user: Column, split: dict[str, float]) -> Column:
    """The version that a user is given: a draw seeded by the user, against the cumulated shares in the order of names."""
    total = sum(split.values())
    shares = [(v, w / total) for v, w in sorted(split.items())]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for users, seeds in batches:
            out = []
            for user, seed in zip(users, seeds, strict=True):
                roll, at, pick = random.Random(int(seed)).random(), 0.0, shares[-1][0]
                for version, share in shares:
                    at += share
                    if roll <= at:
                        pick = version
                        break
                out.append(pick if user is not None else None)
            yield pd.Series(out, dtype="object")

    return F.pandas_udf(run, "string")(user, F.conv(F.substring(F.md5(user), 1, 8), 16, 10).cast("long"))


#: Words that a question of an intent is expected to have.
EXPECTED_WORDS = {
    "api_usage": ("权限", "申请", "permission"),
    "migration": ("迁移", "变化", "api 12"),
    "best_practice": ("最佳实践", "导航", "arkui"),
    "error_diagnosis": ("错误码", "15500000"),
    "code_generation": ("typescript", "网络", "请求"),
    "concept_qa": ("stage", "fa", "区别", "模型"),
    "compatibility": ("兼容", "api 12"),
    "project_debug": ("崩溃", "调试", "api 12"),
}


def proxy_faithfulness(query: Column, intent: Column) -> Column:
    """Nine tenths of the share of an intent's expected words that the query has as words, 0.3 at least; 0.7 for other intents."""
    words = T.words(query)
    share = lambda expected: F.size(F.array_intersect(words, F.array(*map(F.lit, expected)))) / float(len(expected))
    scores = [F.when(intent == i, F.least(F.lit(1.0), F.greatest(F.lit(0.3), share(x) * 0.9))) for i, x in EXPECTED_WORDS.items()]
    return F.coalesce(*scores, F.lit(0.7))


def proxy_relevancy(query: Column, intent: Column) -> Column:
    """Half, and a tenth for each sign of a question that can be answered; 1 at most."""
    words = F.array_remove(F.split(query, r"(?U)\s+"), "")
    signs = [F.length(query) > 10, query.rlike(r"[?？]"), F.size(words) > 3, query.rlike("如何|怎么|什么|为什么"), intent != "unknown"]
    total = F.lit(0)
    for sign in signs:
        total = total + F.when(sign, 1).otherwise(0)
    return F.least(F.lit(1.0), 0.5 + total / 10)


def decision_accuracy(cases: DataFrame) -> DataFrame:
    """(cases, intent_accuracy, plan_accuracy, mode_accuracy) of rows with what was decided and what was expected."""
    share = lambda a, b: F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0))
    return cases.agg(F.count("*").alias("cases"), share("intent", "expected_intent").alias("intent_accuracy"), share("plan", "expected_plan").alias("plan_accuracy"), share("mode", "expected_mode").alias("mode_accuracy"))
