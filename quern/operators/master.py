"""Which node comes next: the guards before the master, its rules after each step, its budget of steps, and how sure an intent is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retries of each kind, steps of the master, the permission without which nothing is answered, words that ask for a tool.
RETRIES = {"tool_call": 2, "retrieve": 1, "verify": 1}
MOST_STEPS, PERMISSION, UNSURE = 18, "knowledge_search", 0.2
TOOL_WORDS = ("工单", "ticket", "tkt-", "系统状态", "服务状态", "健康检查", "运行状态", "错误码", "error code", "用户信息", "用户档案", "我的信息", "个人信息")
#: Reasons that the master gives.
REASONS = {
    "budget": "graph step budget exceeded", "clarify": "deep intent needs clarification", "tools": "master selected tool agent from intent/query signals", "knowledge": "intent routes to knowledge retrieval",
    "tools_done": "tools completed; retrieve supporting knowledge", "tools_again": "tool failed and retry budget remains", "tools_over": "tool retry exhausted; continue with knowledge retrieval",
    "template": "code request can continue with template context", "too_low": "retrieval quality is too low", "usable": "retrieval found usable evidence", "rewrite": "no usable docs; rewrite and retry retrieval",
    "code_bare": "code request can continue without retrieved docs", "no_docs": "no usable docs and retrieval retry exhausted", "again": "query rewritten; retry retrieval", "code": "code generation requested",
    "ready": "context ready for answer generation", "run": "code generated; execute in sandbox", "code_ok": "code verified; generate final explanation", "code_again": "code execution failed; retry code generation",
    "code_over": "code execution failed after retry; finalize with disclaimer", "verify": "draft answer ready; verify grounding", "verified": "answer verified", "regenerate": "answer not grounded; regenerate with same context",
    "unverified": "answer verification failed and retry exhausted", "default": "default to retrieval",
}


def _choose(cases: list[tuple[Column, str, str]], rest: tuple[str, str]) -> Column:
    to = lambda node, why: F.struct(F.lit(node).alias("next_node"), F.lit(REASONS[why]).alias("reason"))
    return reduce(lambda other, c: F.when(c[0], to(c[1], c[2])).otherwise(other), reversed(cases), to(*rest))


def requires_tools(intent: Column, query: Column) -> Column:
    """An error to diagnose, or a query that names a ticket, a state of the system, an error code or a user's data."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return (intent == "error_diagnosis") | reduce(lambda a, w: a | F.contains(low, F.lit(w)), TOOL_WORDS, F.lit(False))


def master_step(s: Column) -> Column:
    """struct(next_node, reason) for a state s.

    Its fields: last_step, steps (of the master before this one), query, intent, needs_clarification, confidence, tool_errors, tool_retries,
    retrieve_retries, verify_retries, code_retries (counts), best_score (null without documents), fallback_reason, has_code, code_verified, verified.
    """
    last = s["last_step"]
    code, usable = s["intent"] == "code_generation", F.coalesce(s["best_score"] > 0, F.lit(False))
    again = {kind: s[name] < RETRIES[kind] for kind, name in (("tool_call", "tool_retries"), ("retrieve", "retrieve_retries"), ("verify", "verify_retries"))}
    intent, tools, found, context, ran, checked = (last == x for x in ("recognize_intent", "call_tools", "retrieve", "build_context", "execute_code", "verify_answer"))
    low = found & (s["fallback_reason"] == "low_retrieval_score") & ~again["retrieve"]
    return _choose(
        [
            (s["steps"] + 1 > MOST_STEPS, "human_fallback", "budget"),
            (intent & s["needs_clarification"] & (s["confidence"] < UNSURE), "human_fallback", "clarify"),
            (intent & requires_tools(s["intent"], s["query"]), "call_tools", "tools"),
            (intent, "retrieve_knowledge", "knowledge"),
            (tools & (s["tool_errors"] == 0), "retrieve_knowledge", "tools_done"),
            (tools & again["tool_call"], "call_tools", "tools_again"),
            (tools, "retrieve_knowledge", "tools_over"),
            (low & code, "build_context", "template"),
            (low, "human_fallback", "too_low"),
            (found & usable, "build_context", "usable"),
            (found & again["retrieve"], "rewrite_query", "rewrite"),
            (found & code, "build_context", "code_bare"),
            (found, "human_fallback", "no_docs"),
            (last == "rewrite_query", "retrieve_knowledge", "again"),
            (context & code & ~s["has_code"], "generate_code", "code"),
            (context, "generate_answer", "ready"),
            (last == "generate_code", "execute_code", "run"),
            (ran & s["code_verified"], "generate_answer", "code_ok"),
            (ran & (s["code_retries"] == 0), "generate_code", "code_again"),
            (ran, "finalize_answer", "code_over"),
            (last == "generate_answer", "verify_answer", "verify"),
            (checked & s["verified"], "finalize_answer", "verified"),
            (checked & again["verify"], "build_context", "regenerate"),
            (checked, "human_fallback", "unverified"),
        ],
        ("retrieve_knowledge", "default"),
    )


def graph_step(s: Column, permissions: Column) -> Column:
    """The node that the graph itself goes to after a step of a state s, without the master where the way is plain.

    Without the permission to search knowledge a request ends in a refusal. Unclear intents, errors to diagnose and low scores go to the master.
    """
    last, usable = s["last_step"], F.coalesce(s["best_score"] > 0, F.lit(False))
    asks = (s["needs_clarification"] & (s["confidence"] < UNSURE)) | (s["intent"] == "error_diagnosis")
    return (
        F.when(last == "check_permission", F.when(F.array_contains(permissions, PERMISSION), "deep_intent_recognition").otherwise("final_refusal"))
        .when(last == "recognize_intent", F.when(asks, "master_agent").otherwise("retrieve_knowledge"))
        .when(last == "retrieve", F.when(~usable & (s["fallback_reason"] == "low_retrieval_score"), "master_agent").otherwise("build_context"))
        .when(last == "build_context", F.when((s["intent"] == "code_generation") & ~s["has_code"], "generate_code").otherwise("generate_answer"))
        .when(last == "generate_answer", "verify_answer")
        .when(last == "verify_answer", F.when(s["verified"], "finalize_answer").otherwise("human_fallback"))
        .otherwise("master_agent")
    )


def entity_coverage(entities: Column) -> Column:
    """The share of six kinds of entities that a query names, a migration from one to another counting as one more; 1 at most.

    entities: a struct with the arrays apis, components, errors, api_levels, versions, files and the strings migration_from, migration_to.
    """
    kinds = [F.coalesce(F.size(entities[k]) > 0, F.lit(False)) for k in ("apis", "components", "errors", "api_levels", "versions", "files")]
    moves = (F.coalesce(entities["migration_from"], F.lit("")) != "") & (F.coalesce(entities["migration_to"], F.lit("")) != "")
    return F.least(F.lit(1.0), reduce(lambda a, k: a + k.cast("int"), [*kinds, moves], F.lit(0)) / 6)


def intent_confidence(own: Column, total: Column, candidates: Column, primary: Column, secondary: Column, coverage: Column, scenario: Column, hints: Column, unclear: Column, questions: Column, tools: Column, answer_chars: Column) -> Column:
    """How sure a recognised intent is, from 0 to 1, of seven parts.

    own, total: signals of the leading intent and of all (total is null without rules); candidates, hints: arrays of the rules' intents and
    scenarios; primary, secondary (array), scenario, unclear, questions, tools: of the recognised intent; coverage: entity_coverage;
    answer_chars: of a model's raw answer.
    """
    strength = F.when(own >= 5, 0.3).when(own >= 3, 0.25).when(own >= 2, 0.2).when(own >= 1, 0.15).otherwise(0.0)
    rules = F.when(total.isNull(), 0.1).otherwise(F.when(total > 0, strength).otherwise(0.05) - F.when(F.size(candidates) > 3, 0.05).otherwise(0.0))
    scene = F.when(F.coalesce(scenario, F.lit("")) != "", 0.15).when(F.size(hints) > 0, 0.1).otherwise(0.0)
    agrees = F.when(F.array_contains(candidates, primary), 0.15).when(F.arrays_overlap(candidates, secondary), 0.08).otherwise(0.0)
    clear = F.when(~unclear, 0.1).otherwise(F.greatest(F.lit(0.0), 0.1 - questions * 0.03))
    helped = F.when(tools >= 3, 0.1).when(tools >= 1, 0.05).otherwise(0.0)
    answered = F.when(answer_chars > 100, 0.05).when(answer_chars > 50, 0.03).otherwise(0.0)
    parts = rules + coverage * 0.2 + scene + agrees + clear + helped + answered
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(parts, 4)))


#: Bounds of the gate, three stages that must all pass; fallbacks count against it.
GATE = {
    "rag": {"hit_at_k": 0.80, "recall_at_k": 0.75, "avg_retrieval_score": 0.60},
    "answer": {"citation_present_rate": 0.95, "groundedness_rate": 0.85, "refusal_correctness_rate": 0.90},
    "agent": {"verification_pass_rate": 0.85, "fallback_rate": 0.25, "tool_success_rate": 0.90},
}
AT_MOST = ("fallback_rate",)


def gate(measured: dict[str, Column]) -> Column:
    """struct(failed, rag, answer, agent, passes) of measured rates: names of those out of bounds, in order, and whether each stage and all pass.

    A rate that wasn't measured (null) fails.
    """
    within = {name: F.coalesce((measured[name] <= bound) if name in AT_MOST else (measured[name] >= bound), F.lit(False)) for stage in GATE.values() for name, bound in stage.items()}
    failed = F.filter(F.array(*(F.when(~ok, name) for name, ok in within.items())), lambda x: x.isNotNull())
    stages = [reduce(lambda a, n: a & within[n], names, F.lit(True)).alias(stage) for stage, names in GATE.items()]
    return F.struct(failed.alias("failed"), *stages, (F.size(failed) == 0).alias("passes"))
