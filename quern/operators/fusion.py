"""Reciprocal rank fusion with weights, dedup keys and boosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of each intent, where they differ from the default.
DEFAULT_WEIGHTS = {
    "keyword": 0.30, "vector": 0.35, "graph": 0.25, "source_quality": 0.10, "official_doc": 0.25, "api_reference": 0.20, "sample_code": 0.20,
    "error_knowledge": 0.15, "faq": 0.10, "ticket": 0.10, "migration_guide": 0.15, "version_meta": 0.10,
}
INTENT_WEIGHTS = {
    "api_usage": {"keyword": 0.35, "vector": 0.25, "graph": 0.15, "source_quality": 0.15, "api_reference": 0.35, "sample_code": 0.30, "official_doc": 0.20},
    "error_diagnosis": {"keyword": 0.45, "vector": 0.25, "graph": 0.20, "source_quality": 0.10, "error_knowledge": 0.40, "faq": 0.25, "ticket": 0.20, "official_doc": 0.15},
    "migration": {"keyword": 0.20, "vector": 0.25, "graph": 0.45, "source_quality": 0.10, "migration_guide": 0.45, "official_doc": 0.25, "api_reference": 0.15},
    "code_generation": {"keyword": 0.25, "vector": 0.25, "graph": 0.15, "source_quality": 0.15, "sample_code": 0.40, "official_doc": 0.25, "api_reference": 0.20},
    "concept_qa": {"keyword": 0.20, "vector": 0.45, "graph": 0.20, "source_quality": 0.15, "official_doc": 0.45, "api_reference": 0.20},
}


def intent_weights() -> list[tuple[str, str, float]]:
    """(intent, source, weight) of all intents."""
    named = {"default": {}, **INTENT_WEIGHTS}
    return [(intent, source, own.get(source, weight)) for intent, own in named.items() for source, weight in DEFAULT_WEIGHTS.items()]


def renormalised(weights: dict[str, float], available: set[str]) -> dict[str, float]:
    """Weights of the sources that are there, with a sum of 1; equal ones if all of these are 0."""
    kept = {s: w for s, w in weights.items() if s in available}
    total = sum(kept.values())
    return {s: w / total if total > 0 else 1 / len(kept) for s, w in kept.items()}


def rrf(lists: dict[str, DataFrame], weights: dict[str, float], k: int = 60, digits: int = 8) -> DataFrame:
    """(query_id, chunk_id, score, matched): weighted sum of 1 / (k + rank) over the lists (query_id, chunk_id, rank).

    A weight of 0 leaves a list out; matched names the lists in their order.
    """
    used = [(i, s, df) for i, (s, df) in enumerate(lists.items()) if weights.get(s, 0) > 0]
    tagged = [df.select("query_id", "chunk_id", F.lit(i).alias("place"), F.lit(s).alias("list"), (F.lit(weights[s]) / (k + F.col("rank"))).alias("part")) for i, s, df in used]
    rows = reduce(DataFrame.unionByName, tagged)
    matched = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "list"))), lambda x: x["list"]), ",")
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), digits).alias("score"), matched.alias("matched"))


def first_per(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The best row of each query and key, then the best keep of each query, with their rank."""
    one = rows.withColumn("own", F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))).filter("own = 1").drop("own")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= keep)


def code_boost(rows: DataFrame, density: Column, factor: float, digits: int = 8) -> DataFrame:
    """Scores raised by the share of code; the order stays, the score before is kept."""
    return rows.withColumn("pre_boost_score", F.col("score")).withColumn("code_density", F.round(density, 3)).withColumn("score", F.round(F.col("score") * (1 + F.lit(factor) * density), digits))


def quality_boost(doc_type: Column, source: Column, weights: dict[str, float]) -> Column:
    """1 and a term for each quality that type or source name."""
    low, kind = F.lower(source), F.coalesce(doc_type, F.lit(""))
    terms = [
        (kind.isin("official_doc", "api_reference"), weights["official_doc"] * 0.2),
        (kind == "api_reference", weights["api_reference"] * 0.15),
        ((kind == "sample_code") | F.contains(low, F.lit("code")), weights["sample_code"] * 0.15),
        (kind.isin("error_knowledge", "faq", "ticket"), weights["error_knowledge"] * 0.1),
        ((kind == "migration_guide") | F.contains(low, F.lit("migration")), weights["migration_guide"] * 0.2),
        ((kind == "version_meta") | F.contains(low, F.lit("version")), weights["version_meta"] * 0.15),
    ]
    return reduce(lambda total, t: total + F.when(t[0], t[1]).otherwise(0.0), terms, F.lit(1.0))
