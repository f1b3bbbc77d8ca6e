"""The context of an answer against a plain loop over its parts."""

import random

from quern.operators import context


def tokens(text):
    return max(1, len(text) // 2) if text else 0


def plain(query, docs, tools, summary, history, most):
    left, out = most, {}
    out["query_tokens"] = min(tokens(query), left)
    left -= out["query_tokens"]
    kept = {}
    for name, parts in (("docs", docs), ("tools", tools)):
        used, kept[name] = 0, []
        for p in parts:
            if used + tokens(p) > left:
                break
            used += tokens(p)
            kept[name].append(p)
        out[f"{name}_tokens"] = used
        left -= used
    out["summary_tokens"] = min(tokens(summary), left)
    left -= out["summary_tokens"]
    used, turns = 0, []
    for text in reversed(history):
        if used + tokens(text) > left:
            break
        used += tokens(text)
        turns.insert(0, text)
    out["history_tokens"], out["remaining"] = used, left - used
    return out, kept["docs"], turns


def test_contexts(spark):
    rnd = random.Random(5)
    text = lambda most: "x" * rnd.choice([0, 1, 2, 3, rnd.randint(0, most)])
    cases = [(text(60), [text(80) for _ in range(rnd.randint(0, 6))], [text(30) for _ in range(rnd.randint(0, 3))], text(50), [text(40) for _ in range(rnd.randint(0, 12))]) for _ in range(60)]
    cases += [("q" * 500, ["d"], ["t"], "s", ["h"]), ("", [], [], "", [])]
    queries = spark.createDataFrame([(i, c[0], c[3] or None, "name" if i % 2 else "") for i, c in enumerate(cases)], "id long, query string, summary string, user_context string")
    docs = spark.createDataFrame([(i, r, f"s{r}", r, 0.5, d) for i, c in enumerate(cases) for r, d in enumerate(c[1], 1)], "id long, rank int, source string, chunk_id long, score double, content string")
    tools = spark.createDataFrame([(i, r, t) for i, c in enumerate(cases) for r, t in enumerate(c[2])], "id long, place int, output string")
    history = spark.createDataFrame([(i, r, "user", h) for i, c in enumerate(cases) for r, h in enumerate(c[4])], "id long, turn int, role string, content string")
    found = {r.id: r for r in context.build_contexts(queries, docs, tools, history, 100).collect()}
    assert len(found) == len(cases)
    for i, c in enumerate(cases):
        want, kept, turns = plain(c[0], c[1], c[2], c[3], c[4], 100)
        r = found[i]
        assert {k: r[k] for k in want} == want
        assert [d.content for d in r.docs] == kept and [t.content for t in r.turns] == turns
        assert r.references == ("\n---\n## 📚 参考来源\n\n" + "\n".join(f"- **[{n}]** `s{n}` — {d}" for n, d in enumerate(kept, 1)) if kept else "")
        parts = ["[用户信息]\nname"] * (i % 2) + [f"[会话摘要]\n{c[3]}"] * bool(c[3]) + ["[历史对话]\n" + "\n".join(f"  user: {t}" for t in turns[-6:])] * bool(turns) + [f"[参考文档] ({len(kept)} 篇)"] * bool(kept)
        assert r.window == "\n\n".join(parts)
