"""Answers of models as rows: JSON found in their text, and its values brought into range."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each field may be, and what stands for anything else.
INTENTS = ("concept_qa", "api_usage", "code_generation", "error_diagnosis", "migration")
MODES = ("hybrid_only", "parallel", "graph_first")
LEVELS = ("low", "medium", "high")
FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)

SCHEMA = "primary_intent string, secondary_intents array<string>, scenario string, difficulty string, risk_level string, needs_clarification boolean, suggested_tools array<string>, retrieval_plan struct<mode:string>"


def json_in(text: str | None) -> str | None:
    """The first JSON object in a text: fenced, the whole text, or between braces."""
    if not text or not text.strip():
        return None
    fenced = FENCED.search(text)
    text = fenced[1] if fenced else text
    start = text.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[start:])
    except (ValueError, RecursionError):
        return None
    return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None


def extract_json(c: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(json_in)

    return F.pandas_udf(run, "string")(c)


def validated(c: Column) -> Column:
    """A JSON string as a struct of allowed values; what is missing, malformed or unknown becomes the default."""
    raw = F.from_json(c, SCHEMA)
    one_of = lambda value, allowed: F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(allowed[0])
    intent = one_of(raw["primary_intent"], INTENTS)
    others = F.filter(F.transform(F.coalesce(raw["secondary_intents"], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isin(*INTENTS) & (x != intent))
    return F.struct(
        intent.alias("primary_intent"),
        others.alias("secondary_intents"),
        F.trim(F.coalesce(raw["scenario"], F.lit(""))).alias("scenario"),
        one_of(raw["difficulty"], LEVELS).alias("difficulty"),
        one_of(raw["risk_level"], LEVELS).alias("risk_level"),
        F.coalesce(raw["needs_clarification"], F.lit(False)).alias("needs_clarification"),
        one_of(raw["retrieval_plan"]["mode"], MODES).alias("mode"),
    )
