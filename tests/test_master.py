"""The master's rules, the graph's guards, confidence, the gate and the blocklist against literal values."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import master

STATE = {
    "last_step": ("string", ""), "steps": ("int", 0), "query": ("string", "how"), "intent": ("string", "concept_qa"), "needs_clarification": ("boolean", False), "confidence": ("double", 0.5), "tool_errors": ("int", 0),
    "tool_retries": ("int", 0), "retrieve_retries": ("int", 0), "verify_retries": ("int", 0), "code_retries": ("int", 0), "best_score": ("double", None), "fallback_reason": ("string", ""), "has_code": ("boolean", False),
    "code_verified": ("boolean", False), "verified": ("boolean", False),
}

MASTER = [
    ({}, "retrieve_knowledge", "default to retrieval"),
    ({"last_step": "recognize_intent"}, "retrieve_knowledge", "intent routes to knowledge retrieval"),
    ({"last_step": "recognize_intent", "needs_clarification": True, "confidence": 0.1}, "human_fallback", "deep intent needs clarification"),
    ({"last_step": "recognize_intent", "needs_clarification": True, "confidence": 0.2}, "retrieve_knowledge", "intent routes to knowledge retrieval"),
    ({"last_step": "recognize_intent", "query": "my TICKET"}, "call_tools", "master selected tool agent from intent/query signals"),
    ({"last_step": "recognize_intent", "intent": "error_diagnosis"}, "call_tools", "master selected tool agent from intent/query signals"),
    ({"last_step": "call_tools"}, "retrieve_knowledge", "tools completed; retrieve supporting knowledge"),
    ({"last_step": "call_tools", "tool_errors": 1, "tool_retries": 1}, "call_tools", "tool failed and retry budget remains"),
    ({"last_step": "call_tools", "tool_errors": 1, "tool_retries": 2}, "retrieve_knowledge", "tool retry exhausted; continue with knowledge retrieval"),
    ({"last_step": "retrieve", "best_score": 0.3}, "build_context", "retrieval found usable evidence"),
    ({"last_step": "retrieve"}, "rewrite_query", "no usable docs; rewrite and retry retrieval"),
    ({"last_step": "retrieve", "best_score": 0.0, "retrieve_retries": 1}, "human_fallback", "no usable docs and retrieval retry exhausted"),
    ({"last_step": "retrieve", "retrieve_retries": 1, "intent": "code_generation"}, "build_context", "code request can continue without retrieved docs"),
    ({"last_step": "retrieve", "best_score": 0.9, "fallback_reason": "low_retrieval_score", "retrieve_retries": 1}, "human_fallback", "retrieval quality is too low"),
    ({"last_step": "retrieve", "fallback_reason": "low_retrieval_score", "retrieve_retries": 1, "intent": "code_generation"}, "build_context", "code request can continue with template context"),
    ({"last_step": "rewrite_query"}, "retrieve_knowledge", "query rewritten; retry retrieval"),
    ({"last_step": "build_context"}, "generate_answer", "context ready for answer generation"),
    ({"last_step": "build_context", "intent": "code_generation"}, "generate_code", "code generation requested"),
    ({"last_step": "build_context", "intent": "code_generation", "has_code": True}, "generate_answer", "context ready for answer generation"),
    ({"last_step": "generate_code"}, "execute_code", "code generated; execute in sandbox"),
    ({"last_step": "execute_code", "code_verified": True}, "generate_answer", "code verified; generate final explanation"),
    ({"last_step": "execute_code"}, "generate_code", "code execution failed; retry code generation"),
    ({"last_step": "execute_code", "code_retries": 1}, "finalize_answer", "code execution failed after retry; finalize with disclaimer"),
    ({"last_step": "generate_answer"}, "verify_answer", "draft answer ready; verify grounding"),
    ({"last_step": "verify_answer", "verified": True}, "finalize_answer", "answer verified"),
    ({"last_step": "verify_answer"}, "build_context", "answer not grounded; regenerate with same context"),
    ({"last_step": "verify_answer", "verify_retries": 1}, "human_fallback", "answer verification failed and retry exhausted"),
    ({"last_step": "generate_answer", "steps": 17}, "verify_answer", "draft answer ready; verify grounding"),
    ({"last_step": "generate_answer", "steps": 18}, "human_fallback", "graph step budget exceeded"),
]


def states(spark, cases):
    schema = "n int, " + ", ".join(f"{k} {t}" for k, (t, _) in STATE.items())
    rows = [(n, *(case.get(k, d) for k, (_, d) in STATE.items())) for n, case in enumerate(cases)]
    return spark.createDataFrame(rows, schema).select("n", F.struct(*STATE).alias("s"))


def test_master(spark):
    found = states(spark, [c[0] for c in MASTER]).select("n", master.master_step(F.col("s")).alias("d")).orderBy("n").collect()
    assert [(r.d.next_node, r.d.reason) for r in found] == [c[1:] for c in MASTER]


def test_graph(spark):
    cases = [
        ({"last_step": "check_permission"}, ["chat"], "final_refusal"), ({"last_step": "check_permission"}, ["knowledge_search"], "deep_intent_recognition"), ({"last_step": "recognize_intent"}, [], "retrieve_knowledge"),
        ({"last_step": "recognize_intent", "intent": "error_diagnosis"}, [], "master_agent"), ({"last_step": "recognize_intent", "needs_clarification": True, "confidence": 0.1}, [], "master_agent"),
        ({"last_step": "retrieve"}, [], "build_context"), ({"last_step": "retrieve", "fallback_reason": "low_retrieval_score"}, [], "master_agent"), ({"last_step": "retrieve", "fallback_reason": "low_retrieval_score", "best_score": 0.1}, [], "build_context"),
        ({"last_step": "build_context", "intent": "code_generation"}, [], "generate_code"), ({"last_step": "build_context"}, [], "generate_answer"), ({"last_step": "generate_answer"}, [], "verify_answer"),
        ({"last_step": "verify_answer"}, [], "human_fallback"), ({"last_step": "verify_answer", "verified": True}, [], "finalize_answer"), ({"last_step": "call_tools"}, [], "master_agent"),
    ]
    permissions = spark.createDataFrame([(n, c[1]) for n, c in enumerate(cases)], "n int, p array<string>")
    found = states(spark, [c[0] for c in cases]).join(permissions, "n").select("n", master.graph_step(F.col("s"), F.col("p")).alias("node")).orderBy("n").collect()
    assert [r.node for r in found] == [c[2] for c in cases]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ((0, None, ["a"], "b", [], 0.0, "", [], False, 0, 0, 0), 0.2),  # no rules: 0.1, and it is clear: 0.1
        ((5, 6, ["a"], "a", [], 1.0, "s", [], False, 0, 3, 200), 1.0),  # .3 + .2 + .15 + .15 + .1 + .1 + .05, at most 1
        ((3, 6, ["a", "b", "c", "d"], "z", ["d"], 0.5, "", ["h"], True, 2, 1, 60), 0.25 - 0.05 + 0.1 + 0.1 + 0.08 + 0.04 + 0.05 + 0.03),
        ((0, 0, [], "a", [], 0.0, "", [], True, 5, 0, 50), 0.05),
        ((2, 2, ["x"], "a", ["b"], 0.0, "", [], False, 0, 2, 51), 0.2 + 0.1 + 0.05 + 0.03),
    ],
)
def test_confidence(spark, values, want):
    schema = "own int, total int, c array<string>, p string, s array<string>, cov double, sc string, h array<string>, u boolean, q int, t int, n int"
    got = spark.createDataFrame([values], schema).select(master.intent_confidence(*(F.col(c.split()[0]) for c in schema.split(", "))).alias("x")).first().x
    assert got == pytest.approx(want, abs=1e-9)


def test_coverage(spark):
    schema = "e struct<apis: array<string>, components: array<string>, errors: array<string>, api_levels: array<string>, versions: array<string>, files: array<string>, migration_from: string, migration_to: string>"
    rows = [((["a"], [], None, ["1"], [], [], "x", "y"),), (([], [], [], [], [], [], "x", ""),), ((["a"],) * 6 + ("x", "y"),)]
    assert [round(r.c, 6) for r in spark.createDataFrame(rows, schema).select(master.entity_coverage(F.col("e")).alias("c")).collect()] == [0.5, 0.0, 1.0]


def test_gate(spark):
    good = {"hit_at_k": 0.8, "recall_at_k": 0.75, "avg_retrieval_score": 0.6, "citation_present_rate": 0.95, "groundedness_rate": 0.85, "refusal_correctness_rate": 0.9, "verification_pass_rate": 0.85, "fallback_rate": 0.25, "tool_success_rate": 0.9}
    rows = [good, good | {"fallback_rate": 0.26}, good | {"recall_at_k": None, "groundedness_rate": 0.1}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in good))
    found = [r.g for r in df.select(master.gate({k: F.col(k) for k in good}).alias("g")).collect()]
    assert [(g.failed, g.rag, g.answer, g.agent, g.passes) for g in found] == [([], True, True, True, True), (["fallback_rate"], True, True, False, False), (["recall_at_k", "groundedness_rate"], False, False, True, False)]


def test_blocklist(spark):
    codes = ["IMPORT OS", "a = eval (x)", "a = eval(x)", "Subprocess.Popen", "require('fs')", "dd  if=", "dd if=/x", "SUDO ls", "print(1)", ""]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.b for r in df.select(T.dangerous(F.col("c")).alias("b")).collect()] == [True, False, True, True, True, False, True, True, False, False]
