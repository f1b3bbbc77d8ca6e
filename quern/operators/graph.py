"""A property graph as node and edge tables: matching terms, hops, paths, scores, and its extraction from text."""

from __future__ import annotations

import re

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut

#: Kinds of entities and the patterns that find them, in the order in which they are tried; letters in either case.
ENTITY_PATTERNS = {
    "ERROR_CODE": [
        r"\b\d{5,10}\b",
        r"\bERR[A-Z_]+\b",
        r"\bAUTH_\w+\b",
        r"\b[A-Z]{2,6}_\d{3,8}\b",
        r"\b错误码\s*[:：]?\s*\d+\b",
        r"\bError\s*Code\s*[:：]?\s*\d+\b",
    ],
    "API": [
        r"@ohos\.\w+(?:\.\w+)*",
        r"\b[A-Z]\w*API\b",
        r"\b\w+接口\b",
        r"\bAPI\s+\w+\b",
        r"\bREST\w*\s+API\b",
        r"\b\w+\.\w+\(\)",
        r"\bimport\s+\{[^}]+\}\s+from\s+['\"][^'\"]+['\"]",
    ],
    "FUNCTION": [
        r"\b(onCreate|onDestroy|onStart|onStop|onResume|onPause)\b",
        r"\b(onWindowStageCreate|onWindowStageDestroy)\b",
        r"\b(onForeground|onBackground)\b",
        r"\b(onPageShow|onPageHide|onBackPress)\b",
        r"\b\w+\(.*?\)\s*\{",
        r"\b(function|async function)\s+(\w+)",
        r"\b(def\s+\w+\()",
    ],
    "CLASS": [
        r"\bclass\s+(\w+)",
        r"\b(Ability|EntryAbility|UIAbility|ServiceAbility|DataAbility)\b",
        r"\bextends\s+(\w+)",
        r"\bimplements\s+(\w+)",
        r"\b@Component\b",
        r"\b@Entry\b",
        r"\b@Component\s*\n\s*struct\s+(\w+)",
    ],
    "CONFIG": [
        r"\b[A-Z_]{3,30}\s*=\s*",
        r"\b(config|Config|CONFIG)\w*\b",
        r"\b(\.env|\.json|\.yaml|\.xml)\b",
        r"\b配置\w*\s*[:：]",
        r"\bmodule\.json5?\b",
        r"\bapp\.json5?\b",
    ],
    "MODULE": [
        r"\b@ohos\.\w+\b",
        r"\bimport\s+.*\s+from\s+['\"]@ohos\.\w+['\"]",
        r"\b(ohos\.\w+(?:\.\w+)*)\b",
        r"\bnpm\s+(install|i)\s+\S+",
    ],
    "LIFECYCLE": [
        r"\b生命周期\b",
        r"\blifecycle\b",
        r"\bLifeCycle\b",
        r"\b(onCreate|onDestroy|onStart|onStop|onWindowStageCreate)\b",
        r"\b(AbilityLifecycleCallback)\b",
        r"\b(UIAbility onCreate onDestroy)\b",
    ],
    "COMPONENT": [
        r"\b@Component\b",
        r"\b@Entry\b",
        r"\bstruct\s+(\w+)",
        r"\b(Button|Text|Image|List|Column|Row|Flex)\b",
        r"\bbuild\(\)\s*\{",
        r"\b@Builder\b",
    ],
    "CONCEPT": [
        r"\b(ArkTS|ArkUI|Stage模型|FA模型)\b",
        r"\b(页面跳转|路由|导航)\b",
        r"\b(HAP|HAR|HSP)\b",
        r"\b(签名|证书|权限)\b",
        r"\b(白屏|黑屏|闪退|崩溃)\b",
        r"\b(性能优化|内存泄漏|卡顿)\b",
    ],
}
#: Strings in lower case of which a text must hold one for each of these patterns to match; () is any digit.
ENTITY_STRINGS = {
    "ERROR_CODE": [(), ("err",), ("auth_",), ("_",), ("错误码",), ("code",)],
    "API": [("@ohos.",), ("api",), ("接口",), ("api",), ("api",), ("()",), ("import",)],
    "FUNCTION": [
        ("oncreate", "ondestroy", "onstart", "onstop", "onresume", "onpause"), ("onwindowstage",), ("onforeground", "onbackground"), ("onpageshow", "onpagehide", "onbackpress"),
        ("{",), ("function",), ("def",),
    ],
    "CLASS": [("class",), ("ability",), ("extends",), ("implements",), ("@component",), ("@entry",), ("@component",)],
    "CONFIG": [("=",), ("config",), (".env", ".json", ".yaml", ".xml"), ("配置",), ("module.json",), ("app.json",)],
    "MODULE": [("@ohos.",), ("import",), ("ohos.",), ("npm",)],
    "LIFECYCLE": [("生命周期",), ("lifecycle",), ("lifecycle",), ("oncreate", "ondestroy", "onstart", "onstop", "onwindowstagecreate"), ("abilitylifecyclecallback",), ("uiability oncreate ondestroy",)],
    "COMPONENT": [("@component",), ("@entry",), ("struct",), ("button", "text", "image", "list", "column", "row", "flex"), ("build()",), ("@builder",)],
    "CONCEPT": [
        ("arkts", "arkui", "stage模型", "fa模型"), ("页面跳转", "路由", "导航"), ("hap", "har", "hsp"), ("签名", "证书", "权限"), ("白屏", "黑屏", "闪退", "崩溃"), ("性能优化", "内存泄漏", "卡顿"),
    ],
}
#: What is cut from either end of a match to give a name.
NAME_LEAD, NAME_TAIL = r"^(?:import|from|class|function|struct)\s+", r"[;:,{}\[\]()'\"]+$"
#: Kinds of relations and the patterns whose groups name their two ends, in the order in which they are tried; letters in either case.
RELATION_PATTERNS = {
    "CAUSES": [
        r"(\w+)\s*(导致|造成|引起|引发|触发)\s*(\w+)",
        r"(\w+)\s*(因为|由于|原因是)\s*(\w+)",
        r"(\w+)\s*(causes?|leads?\s+to|results?\s+in|triggers?)\s*(\w+)",
        r"(白屏|黑屏|闪退|崩溃|报错|异常)\s*(因为|由于|原因是)\s*(\w+)",
        r"(\w+)\s*(错误|异常|失败|超时|崩溃|卡死)\s*(因为|由于)\s*(\w+)",
        r"(\w+)\s*(导致|造成)\s*(白屏|黑屏|闪退|崩溃|报错|卡顿)",
    ],
    "FIXES": [
        r"(\w+)\s*(修复|解决|修正|处理)\s*(\w+)",
        r"(\w+)\s*(fixes?|resolves?|solves?)\s*(\w+)",
        r"(通过|使用|调用)\s*(\w+)\s*(修复|解决)\s*(\w+)",
        r"(\w+)\s*修复\s*(错误码|问题|Bug|bug)\s*(\w+)",
    ],
    "DEPENDS_ON": [
        r"(\w+)\s*(依赖|需要|必须|要求|取决于)\s*(\w+)",
        r"(\w+)\s*(depends?\s+on|requires?|needs?)\s*(\w+)",
        r"(\w+)\s*(import|require)\s+.*\s+from\s+['\"](\w+)['\"]",
        r"(\w+)\s*依赖于\s*(\w+)",
        r"配置\s*(\w+)\s*(依赖|需要)\s*(\w+)",
    ],
    "CALLS": [
        r"(\w+)\s*(调用|执行|触发|启动)\s*(\w+)",
        r"(\w+)\s*(calls?|invokes?|executes?)\s*(\w+)",
        r"(\w+)\.(\w+)\(",
        r"(\w+)\s*调用\s*(\w+)\s*(方法|函数|接口|API)",
        r"import\s+\{[^}]*(\w+)[^}]*\}\s+from\s+['\"]@ohos\.(\w+)['\"]",
    ],
    "BELONGS_TO": [
        r"(\w+)\s*(属于|归属于|是.*的一部分)\s*(\w+)",
        r"(\w+)\s*(belongs?\s+to|is\s+part\s+of)\s*(\w+)",
        r"(\w+)\s*位于\s*(\w+)\s*(模块|包|目录)",
        r"import\s+.*\s+from\s+['\"]@ohos\.(\w+)['\"]",
    ],
    "PART_OF": [
        r"(\w+)\s*(包含|包括|由.*组成)\s*(\w+)",
        r"(\w+)\s*(contains?|includes?|consists?\s+of)\s*(\w+)",
        r"(\w+)\s*(模块|组件|功能)\s*(包含|包括)\s*(\w+)",
        r"(\w+)\s*是\s*(\w+)\s*的\s*(一部分|子模块|组件)",
    ],
    "HAS_LIFECYCLE": [
        r"(\w+)\s*生命周期\s*(包括|包含|有)\s*(\w+)",
        r"(\w+)\s*(onCreate|onDestroy|onStart|onStop|onWindowStageCreate)\b",
        r"(\w+)\s*(的生命周期|生命周期方法|回调|callback)",
        r"(\w+Ability)\s*(的|拥有|有)\s*(onCreate|onWindowStageCreate|生命周期)",
    ],
    "AFFECTS": [
        r"(\w+)\s*(影响|波及|涉及)\s*(\w+)",
        r"(\w+)\s*(affects?|impacts?|influences?)\s*(\w+)",
        r"(\w+)\s*(修改|更新|变更)\s*后?\s*(影响|波及)\s*(\w+)",
        r"(\w+)\s*变更\s*(会影响|会波及)\s*(\w+)",
    ],
    "RELATED_TO": [
        r"(\w+)\s*(和|与|跟)\s*(\w+)\s*(相关|有关|关联|有关系|相关吗)",
        r"(\w+)\s*(和|与|跟)\s*(\w+)\s*(有什么关系|的关联|的调用链)",
        r"(\w+)\s*(is\s+)?related\s+to\s+(\w+)",
        r"(\w+)\s+→\s+(\w+)",
        r"(\w+)\s*>\s*(\w+)",
        r"(\w+)\s*->\s*(\w+)",
    ],
    "IMPORTS": [
        r"import\s+\{[^}]*(\w+)[^}]*\}\s+from\s+['\"]@ohos\.(\w+)['\"]",
        r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]",
        r"require\(['\"]([^'\"]+)['\"]\)",
        r"from\s+(\S+)\s+import\s+(\w+)",
    ],
    "EXTENDS": [r"class\s+(\w+)\s+extends\s+(\w+)", r"(\w+)\s+extends\s+(\w+)"],
    "IMPLEMENTS": [r"class\s+(\w+)\s+implements\s+([\w\s,]+)", r"(\w+)\s+implements\s+([\w\s,]+)"],
}


def both_ways(edges: DataFrame) -> DataFrame:
    """edges (edge_id, src, dst, rel, weight) in either direction."""
    back = edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight")
    return edges.select("edge_id", "src", "dst", "rel", "weight").unionByName(back)


def one_hop(seeds: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(seed, edge_id, node, rel, weight): the heaviest edges of each seed; ties by node and edge."""
    steps = seeds.select("seed").join(both_ways(edges), F.col("seed") == F.col("src")).filter("dst <> seed")
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "dst", "edge_id")
    return steps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("seed", "edge_id", F.col("dst").alias("node"), "rel", "weight", "rank")


def strongest(edges: DataFrame, limit: int, slack: Column) -> DataFrame:
    """Of each src the edges whose weight is within slack of that of its limit-th heaviest neighbour, ties included."""
    best = edges.groupBy("src", "dst").agg(F.max("weight").alias("top"))
    ranked = best.withColumn("rank", F.rank().over(Window.partitionBy("src").orderBy(F.desc("top")))).filter(F.col("rank") <= limit)
    floor = ranked.groupBy("src").agg(F.min("top").alias("floor"))
    return edges.join(floor, "src").filter(F.col("weight") >= F.col("floor") - slack).drop("floor")


def two_hop(seeds: DataFrame, edges: DataFrame, limit: int = 15, digits: int = 2) -> DataFrame:
    """(seed, mid, node, rels, weight): paths over two different edges to another node; weights multiply.

    Of a middle node only the edges to its limit + 2 heaviest neighbours are followed: two of them may be the seed and the
    node itself, and each of the others gives a path that is heavier than one over any other edge, by more than rounding takes.
    So a hub is left by few edges, whatever their number. That needs first edges of positive weight; if there are others all are followed.
    """
    both = cut(both_ways(edges))
    first = seeds.select("seed").join(both, F.col("seed") == F.col("src")).select("seed", F.col("edge_id").alias("e1"), F.col("dst").alias("mid"), F.col("rel").alias("r1"), F.col("weight").alias("w1"))
    least = first.agg(F.min("w1")).first()[0]
    slack = F.lit(10.0**-digits / least if least is not None and least > 0 else float("inf"))
    second = strongest(both, limit + 2, slack).select(F.col("edge_id").alias("e2"), F.col("src").alias("at"), F.col("dst").alias("node"), F.col("rel").alias("r2"), F.col("weight").alias("w2"))
    paths = first.join(second, F.col("mid") == F.col("at")).filter("node <> seed AND mid <> seed AND node <> mid AND e1 <> e2").withColumn("weight", F.round(F.col("w1") * F.col("w2"), digits))
    order = Window.partitionBy("seed").orderBy(F.desc("weight"), "node", "mid", "e1", "e2")
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("seed", "mid", "node", F.concat_ws(",", "r1", "r2").alias("rels"), "weight", "rank")


def match_entities(terms: DataFrame, entities: DataFrame, limit: int = 30) -> DataFrame:
    """(term, name, score): entities whose name equals, begins with or holds a term; the first rule that finds any counts.

    terms is a table of queries' terms and entities a dictionary, joined by their trigrams, so nothing is compared that
    has none in common; terms under three characters are joined by their first character.
    """
    grams = lambda c: F.when(F.length(c) < 3, F.array(F.substring(c, 1, 1))).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    left = terms.select("term", F.element_at(grams(F.lower("term")), 1).alias("gram"), F.lower("term").alias("low")).filter("term <> ''")
    held = F.array_union(grams(F.lower("name")), F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.lower("name"), i, F.lit(1))))
    right = entities.filter("name <> ''").select("name", F.explode(held).alias("gram"))
    hits = left.join(right, "gram").filter(F.contains(F.lower("name"), F.col("low"))).select("term", "name", match_score(F.col("term"), F.col("name")).alias("score")).distinct()
    best = Window.partitionBy("term")
    first = hits.withColumn("best", F.max("score").over(best)).filter("score = best")
    return first.withColumn("rank", F.row_number().over(best.orderBy("name"))).filter(F.col("rank") <= limit).select("term", "name", "score")


def match_score(term: Column, name: Column) -> Column:
    a, b = F.lower(term), F.lower(name)
    return F.when(a == b, 1.0).when(F.startswith(b, a), 0.8).when(F.contains(b, a), 0.6).otherwise(0.3)


def path_scores(paths: DataFrame, content: DataFrame, terms: int, digits: int = 4) -> DataFrame:
    """(chunk_id, score): entity coverage, mean weight, whether there is content, and short paths."""
    per = paths.groupBy("chunk_id").agg(F.countDistinct("seed").alias("seeds"), F.avg("weight").alias("weight"), F.avg("hops").alias("hops"))
    scored = per.join(content.select("chunk_id", (F.length("content") > 0).alias("has")), "chunk_id", "left")
    score = 0.4 * F.least(F.lit(1.0), F.col("seeds") / terms) + 0.3 * F.least(F.lit(1.0), F.col("weight")) + 0.2 * F.when(F.col("has"), 1.0).otherwise(0.0) + 0.1 / F.greatest(F.col("hops"), F.lit(1.0))
    return scored.select("chunk_id", F.round(score, digits).alias("score"))


def cooccurrence(mentions: DataFrame, within: int = 300) -> DataFrame:
    """(chunk_id, left, right, weight): entities of different kinds whose first places are at most so many characters apart.

    mentions (chunk_id, name, kind, pos). Places are cut into ranges of that width and a range meets itself and the next
    one, so a chunk's mentions are compared only where they can be near.
    """
    a = mentions.select("chunk_id", F.col("name").alias("left"), F.col("kind").alias("k1"), F.col("pos").alias("p1"), F.explode(F.array(F.floor(F.col("pos") / (within + 1)), F.floor(F.col("pos") / (within + 1)) + 1)).alias("cell"))
    b = mentions.select("chunk_id", F.col("name").alias("right"), F.col("kind").alias("k2"), F.col("pos").alias("p2"), F.floor(F.col("pos") / (within + 1)).alias("cell"))
    near = a.join(b, ["chunk_id", "cell"]).filter((F.col("k1") != F.col("k2")) & ((F.col("p1") < F.col("p2")) | ((F.col("p1") == F.col("p2")) & (F.col("left") < F.col("right")))) & (F.col("p2") - F.col("p1") <= within))
    return near.select("chunk_id", "left", "right", F.round(F.greatest(F.lit(0.1), 1 - (F.col("p2") - F.col("p1")) / within), 2).alias("weight"))


def word_led(pattern: str) -> Callable[[str], Iterator[re.Match]]:
    """What finditer gives for a pattern, letters in either case and by lines; in linear time where it begins with a group of word characters.

    Such a pattern that matches from inside a run of word characters matches from the start of the run, too, as its first group can
    take more. So it is tried where a run begins, and where the last match ended, instead of at every character of a run.
    """
    rule = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
    if r"\s+from\s+" in pattern:  # these look for "from" up to a line's end
        return lambda text: rule.finditer(text) if re.search("from", text, re.IGNORECASE) else iter(())
    if not pattern.startswith(r"(\w+"):
        return rule.finditer
    led = re.compile(r"(?<!\w)" + pattern, re.IGNORECASE | re.MULTILINE)

    def found(text: str) -> Iterator[re.Match]:
        at = 0
        while m := rule.match(text, at) or led.search(text, at):
            yield m
            at = m.end()

    return found


def any_case(text: str) -> str:
    """text in lower case, with letters in place of those that a pattern takes for i, k and s in either case."""
    for other, letter in ("\u0130i", "\u0131i", "\u017fs", "\u212ak"):
        text = text.replace(other, letter)
    return text.lower()


def extract_entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, normalized, kind, pos, snippet): first mention of each name and kind in a chunk.

    A name is a match's first group if that has two characters, else the whole match without keywords before it. Names of
    one character are left out; null and empty texts have no rows. Symbols of code are those of quern.operators.documents.
    """
    rules = [(kind, held, word_led(p)) for kind, patterns in ENTITY_PATTERNS.items() for p, held in zip(patterns, ENTITY_STRINGS[kind], strict=True)]
    digit = re.compile(r"\d")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, text in zip(frame.chunk_id, frame.content, strict=True):
                first, text = {}, text or ""
                low = any_case(text)
                for kind, held, rule in rules:
                    if not (any(x in low for x in held) if held else digit.search(text)):
                        continue
                    for m in rule(text):
                        group = 1 if m.lastindex and len(m[1] or "") > 1 else 0
                        name = m[1] if group else re.sub(NAME_LEAD, "", m[0].strip())
                        name = re.sub(NAME_TAIL, "", name).strip()
                        if len(name) > 1:
                            snippet = text[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ").strip()
                            first.setdefault((name.lower(), kind), (chunk, name, name.lower(), kind, m.start(group), snippet))
                rows.extend(first.values())
            yield pd.DataFrame(rows, columns=["chunk_id", "name", "normalized", "kind", "pos", "snippet"])

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id string, name string, normalized string, kind string, pos int, snippet string")


def pattern_relations(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, target, rel, snippet): patterns whose groups name two different mentions of their chunk.

    The first group that is a mention is the source, the next other one the target; each (source, target, rel) once a
    chunk. Names are normalized. Chunks without mentions have no rows.
    """
    rules = [(rel, word_led(p)) for rel, patterns in RELATION_PATTERNS.items() for p in patterns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, text, names in zip(frame.chunk_id, frame.content, frame.names, strict=True):
                known, first = set(names), {}
                for rel, rule in rules:
                    for m in rule(text or ""):
                        ends = list(dict.fromkeys(g for g in (x.strip().lower() for x in m.groups() if x and len(x) > 1) if g in known))[:2]
                        if len(ends) == 2:
                            first.setdefault((*ends, rel), (chunk, *ends, rel, text[max(0, m.start() - 30) : m.end() + 30].replace("\n", " ").strip()))
                rows.extend(first.values())
            yield pd.DataFrame(rows, columns=["chunk_id", "source", "target", "rel", "snippet"])

    named = mentions.groupBy("chunk_id").agg(F.collect_set("normalized").alias("names"))
    return chunks.select("chunk_id", "content").join(named, "chunk_id").mapInPandas(run, "chunk_id string, source string, target string, rel string, snippet string")


def build_graph(chunks: DataFrame, mentions: DataFrame, relations: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, name, content) and edges (src, dst, rel, n) of documents, chunks and entities; each key once.

    chunks (doc_id, chunk_id, content); a chunk keeps its first ``most`` characters. An entity is its normalized name, as
    relations name their ends so; its kinds are in ``content``, in order. n counts the rows that say the same of an edge.
    """
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    documents = chunks.select(node("document", "doc_id").alias("node_id"), F.lit("Document").alias("label"), F.col("doc_id").cast("string").alias("name"), none.alias("content"))
    pieces = chunks.select(node("chunk", "chunk_id").alias("node_id"), F.lit("Chunk").alias("label"), F.col("chunk_id").cast("string").alias("name"), F.substring("content", 1, most).alias("content"))
    entities = mentions.groupBy("normalized").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("content"))
    entities = entities.select(node("entity", "normalized").alias("node_id"), F.lit("Entity").alias("label"), F.col("normalized").alias("name"), "content")
    edges = (
        chunks.select(node("document", "doc_id").alias("src"), node("chunk", "chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("rel"))
        .unionByName(mentions.select(node("chunk", "chunk_id").alias("src"), node("entity", "normalized").alias("dst"), F.lit("MENTIONS").alias("rel")))
        .unionByName(relations.select(node("entity", "source").alias("src"), node("entity", "target").alias("dst"), "rel"))
    )
    nodes = merge_nodes(documents.unionByName(pieces), "node_id").unionByName(entities)
    return nodes, edges.groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


def entity_candidates(entities: DataFrame, found: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, chunk_id, doc_id, content, score): entities as candidates of queries without any evidence chunk.

    entities (query_id, entity_id, kind, name, score), found (query_id) of those that have evidence. Best first, ties by id.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    bare = entities.join(found.select("query_id").distinct(), "query_id", "left_anti").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return bare.select("query_id", F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("chunk_id"), F.lit("graph").alias("doc_id"), F.concat(F.lit("["), "kind", F.lit("] "), "name", F.lit(": 知识图谱实体")).alias("content"), "score")


def merge_nodes(rows: DataFrame, *key: str) -> DataFrame:
    """One row for each key, however often it is written."""
    return rows.dropDuplicates(list(key))
