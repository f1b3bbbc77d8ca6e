"""Query understanding and routing as projections: rewriting, query types, intents, plans, failures and what follows them."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: Separators that split a question.
SEPARATORS = ("？", "?", "；", ";", "。", "和", "与", "以及", "还有", "另外")
#: Synonyms that are put in after the first occurrence of a word.
SYNONYMS = {
    "API": "API 接口 应用程序接口",
    "认证": "认证 鉴权 登录",
    "密码": "密码 口令 凭证",
    "错误": "错误 异常 报错 故障",
    "权限": "权限 授权 访问控制",
    "配置": "配置 设置 参数",
    "部署": "部署 上线 发布",
}
#: Words left out when a search is tried again.
STOP_WORDS = ("的", "了", "是", "在", "和", "也", "就", "都", "而", "及", "与", "着", "或", "一个", "没有", "我们", "你们", "他们", "这个", "那个", "什么", "怎么", "为什么", "如何", "我", "你", "他", "她", "它")
#: Markers of query types.
SEMANTIC_MARKERS = ("是什么", "为什么", "如何", "怎样", "含义", "区别", "关系", "影响")
KEYWORD_MARKERS = ("工单", "TKT-", "错误码", "AUTH_", "版本", "配置")
#: What names an intent; letters in either case.
INTENT_PATTERNS = {
    "error_diagnosis": (
        r"报错|错误|异常|失败|error|failed|exception|denied|hvigor|crash|白屏|黑屏|闪退|卡顿|OOM|ANR|不工作|不行|无法|超时|401|403|404|500|502|503|"
        r"崩溃|宕机|挂掉|起不来|打不开|没反应|SIGABRT|SIGSEGV|TypeError|ReferenceError|SyntaxError|RangeError|URIError|BusinessError|ArkTS:ERROR|"
        r"compile.*failed|runtime.*error|install.*fail|启动.*闪退|启动.*黑屏|启动.*白屏|启动.*卡住"
    ),
    "project_debug": r"项目|页面|启动|首页|运行|工程|模块|编译|构建|build|打包|签名|发布|部署|安装|真机|模拟器|设备|预览|DevEco|IDE|调试|debug|运行不了|跑不起来|打不开页面|进不去|点了没反应",
    "code_generation": (
        r"写一个|生成|实现|封装|demo|示例代码|代码|怎么写|如何写|怎么实现|怎么封装|怎么生成|帮我写|帮我实现|帮我生成|给我.*代码|"
        r"一段代码|代码片段|snippet|example|完整代码|参考代码|代码示例|sample|模板|template|脚手架|scaffold"
    ),
    "migration": (
        r"迁移|升级|替换|改成|废弃|deprecated|从.*到|换成|替代|取代|改为|转为|不再维护|不再支持|下架|移除|淘汰|迁移到|升级到|替换为|替换成|"
        r"迁移方案|升级方案|迁移步骤|新版本|旧.*API|新.*API"
    ),
    "api_usage": (
        r"怎么用|如何使用|参数|返回值|接口|组件|API|使用方法|调用方式|怎么调|如何调|怎么发|如何发|传入什么|返回什么|参数说明|接口说明|"
        r"有哪些参数|参数列表|返回值类型|怎么调用|如何调用|调用示例|怎么请求|如何请求|调用方法|用法|使用方式|使用方法|配置项|配置参数|配置方法|"
        r"GET\s*请求|POST\s*请求|HTTP\s*请求|@ohos\.\w+"
    ),
    "concept_qa": (
        r"是什么|区别|原理|机制|生命周期|什么是|什么意思|含义|概念|有什么不同|和.*区别|和.*有什么不同|作用|功能|用途|介绍|说明|概述|"
        r"架构|设计.*理念|设计.*思想|为什么.*要|为什么要|关系|联系|关联|优点|缺点|优势|劣势|适用场景"
    ),
}
#: What names a scenario; letters in either case.
SCENARIO_PATTERNS = {
    "white_screen": r"白屏|white\s*screen|页面.*白|空白.*页",
    "black_screen": r"黑屏|black\s*screen|页面.*黑",
    "crash": r"闪退|crash|崩溃|SIGABRT|SIGSEGV|ANR",
    "permission_error": r"permission\s*denied|权限.*拒绝|权限.*错误|无权限|没权限|权限.*失败",
    "build_error": r"编译.*错误|编译.*失败|build.*fail|hvigor.*ERROR|compile.*error",
    "install_error": r"安装.*失败|install.*fail|签名.*错误|打包.*失败",
    "network_error": r"网络.*错误|网络.*异常|http.*error|请求.*失败|timeout|超时|连接.*失败",
    "router_to_navigation": r"Router.*Navigation|router.*navigation|路由.*迁移|路由.*升级",
    "fa_to_stage": r"FA.*Stage|fa.*stage|FA模型.*Stage|元服务.*迁移",
    "js_to_arkts": r"JS.*ArkTS|js.*arkts|JavaScript.*ArkTS|JS.*迁移",
    "api_deprecation": r"deprecated|废弃|不再.*维护|API.*变更|API.*变化|接口.*变更",
    "lifecycle": r"生命周期|lifecycle|onCreate|onDestroy|onForeground|onBackground",
    "data_persistence": r"数据.*存储|持久化|preferences|database|KV|关系型|数据库",
    "ui_layout": r"布局|layout|排列|对齐|居中|flex|Column|Row|Stack",
    "navigation": r"导航|跳转|Navigation|Router|页面.*跳转|路由",
    "notification": r"通知|Notification|notification|推送|push",
    "distributed": r"分布式|distributed|跨设备|多设备|协同|continuation",
}
#: Tools that an intent calls for besides the two searches, those that scenarios add, and modes.
INTENT_TOOLS = {
    "error_diagnosis": ("error_diagnosis_search", "official_doc_search"),
    "code_generation": ("sample_code_search", "api_reference_search", "official_doc_search", "code_review"),
    "migration": ("graph_search", "official_doc_search", "api_reference_search"),
    "api_usage": ("api_reference_search", "sample_code_search", "official_doc_search"),
    "concept_qa": ("official_doc_search", "hybrid_rag_search"),
}
SCENARIO_TOOLS = {"version_compatibility_check": ("permission_error",), "ticket_search": ("build_error", "install_error")}
INTENT_MODES = {"migration": "graph_first", "code_generation": "parallel", "api_usage": "parallel"}
#: Features of a query that routing asks for; letters as they are.
FEATURES = {
    "relation": r"关系|依赖|调用链|影响.*哪些|导致|上下游|链路|生命周期|路径|关联|有关|涉及|联系|相连|连接|触发|回调|监听|订阅|通知|依赖关系|调用关系|什么关系|之间.*关系",
    "error_code": r"\b\d{4,10}\b|\bERR[A-Z_]+\b|\bAUTH_\w+\b|\b[A-Z]{2,6}_\d{3,8}\b",
    "api_name": r"@ohos\.\w+|@\w+\.\w+|\b\w+API\b|\bimport\s+\{",
    "class_name": r"\b[A-Z][a-z]+Ability\b|\bclass\s+\w+|\bextends\s+\w+|\bComponent\b",
    "function_name": r"\bon\w+Create\b|\bon\w+Destroy\b|\b\w+\(\)",
    "config_name": r"\b[A-Z_]{3,30}\b|module\.json|app\.json|\.env\b",
    "semantic": r"为什么|怎么解决|可能原因|如何优化|区别|排查|怎么办|如何|怎么|怎样|什么是|含义|原因|可能|建议|推荐|最佳实践|有哪些|介绍|说明|解释",
    "several_entities": r"\b[A-Z][a-zA-Z]+\b.*(?:和|与|、|,|and).*\b[A-Z][a-zA-Z]+\b",
}
CODE_QUERY = (
    r"代码|示例|example|怎么写|怎么调用|demo|snippet|接入|使用示例|用法|implement|how\s+to\s+use|调用方法|怎么用|使用方法|"
    r"code\s+sample|example\s+code|完整示例|参考代码|代码片段"
)
#: Plans with their mode, weights and depths, how many rows each source gives, and how far the graph is followed.
PLANS = {
    "hybrid_only": {"mode": "hybrid_only", "keyword": 0.4, "vector": 0.6, "graph": 0.0, "keyword_k": 5, "vector_k": 5, "graph_k": 0, "graph_depth": 0},
    "graph_first": {"mode": "graph_first", "keyword": 0.2, "vector": 0.3, "graph": 0.5, "keyword_k": 5, "vector_k": 5, "graph_k": 30, "graph_depth": 2},
    "deep_keyword": {"mode": "parallel", "keyword": 0.6, "vector": 0.25, "graph": 0.15, "keyword_k": 10, "vector_k": 5, "graph_k": 15, "graph_depth": 1},
    "deep_vector": {"mode": "parallel", "keyword": 0.2, "vector": 0.65, "graph": 0.15, "keyword_k": 5, "vector_k": 10, "graph_k": 15, "graph_depth": 1},
    "exact": {"mode": "parallel", "keyword": 0.7, "vector": 0.3, "graph": 0.0, "keyword_k": 10, "vector_k": 5, "graph_k": 0, "graph_depth": 1},
    "semantic": {"mode": "parallel", "keyword": 0.2, "vector": 0.6, "graph": 0.2, "keyword_k": 5, "vector_k": 10, "graph_k": 30, "graph_depth": 1},
    "default": {"mode": "parallel", "keyword": 0.3, "vector": 0.5, "graph": 0.2, "keyword_k": 5, "vector_k": 5, "graph_k": 30, "graph_depth": 1},
}
#: Plans that a known intent calls for, and intents that stand for a feature.
INTENT_PLANS = {"migration": "graph_first", "api_usage": "deep_keyword", "code_generation": "deep_keyword", "error_diagnosis": "deep_keyword", "concept_qa": "deep_vector"}
RELATIONAL_INTENTS = ("relational", "relationship", "graph_query")
EXACT_INTENTS = ("exact", "precise", "keyword_lookup")
SEMANTIC_INTENTS = ("semantic", "explanation", "technical_question")
#: What follows a failure, and how often it is tried again (None: it is not tried again).
FALLBACKS = {
    "permission_denied": ("final_refusal", None),
    "no_relevant_docs": ("rewrite_query", 1),
    "low_retrieval_score": ("use_keyword_retriever", 1),
    "tool_failure": ("retry", 2),
    "answer_not_grounded": ("regenerate_answer", 1),
    "llm_failure": ("retry", 1),
    "unknown_intent": ("human_fallback", None),
    "code_execution_failed": ("retry", 2),
    "code_generation_failed": ("retry", 2),
}
#: Words that name a programming language, in the order in which languages are tried.
LANGUAGES = {
    "python": ("python", "py", "pytest"),
    "typescript": ("typescript", "ts", "arkts", "ets", "harmonyos", "@ohos"),
    "javascript": ("javascript", "js", "node"),
    "bash": ("bash", "shell", "sh", "命令行"),
}

#: Flags for Java: a dot is anything but a line feed, and classes are Unicode's.
EXACT_CASE, ANY_CASE = "(?dU)", "(?diuU)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def named(pairs: list[tuple[Column, str]]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_remove(F.array(*[F.when(held, F.lit(name)).otherwise(F.lit("")) for held, name in pairs]), "")  # a filter's function would be interpreted


def rewrite(query: Column) -> Column:
    """struct(rewritten, variants, strategy): parts of a compound question, else with synonyms, else unchanged."""
    at = "|".join("\\" + x if x == "?" else x for x in SEPARATORS)
    parts = F.filter(F.transform(F.split(query, at), strip), lambda x: x != "")
    expanded = reduce(lambda c, s: F.regexp_replace(c, f"(?s)^(.*?){s[0]}", f"$1{s[1]}"), SYNONYMS.items(), query)  # no synonym holds a later word
    several, changed = F.size(parts) > 1, expanded != query
    rewritten = F.when(several, F.array_join(parts, " ")).otherwise(expanded)
    variants = F.when(several, F.concat(F.array(query), parts)).when(changed, F.array(query, expanded)).otherwise(F.array(query))
    return F.struct(rewritten.alias("rewritten"), variants.alias("variants"), F.when(several, "decomposition").when(changed, "expansion").otherwise("none").alias("strategy"))


def recovery_rewrite(query: Column) -> Column:
    """The words of a query without stop words, longest first; all of them if nothing else is left."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda x: x != "")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.array_join(T.longest_first(F.when(F.size(kept) > 0, kept).otherwise(words)), " ")


def query_type(query: Column) -> Column:
    """semantic or keyword, whichever has more markers in the query; mixed in a tie."""
    count = lambda marks: reduce(lambda a, m: a + F.contains(query, F.lit(m)).cast("int"), marks, F.lit(0))
    meaning, words = count(SEMANTIC_MARKERS), count(KEYWORD_MARKERS)
    return F.when(meaning > words, "semantic").when(words > meaning, "keyword").otherwise("mixed")


def any_case(query: Column) -> Column:
    """In lower case, with letters in place of those that Java takes for i, k and s in either case."""
    return F.lower(F.translate(query, "\u0130\u0131\u017f\u212a", "iisk"))


def names_any(query: Column, low: Column, pattern: str) -> Column:
    """query.rlike(ANY_CASE + pattern) of a pattern without groups, in less time; low is any_case(query).

    Alternatives that are plain strings are looked for as such. The others are tried as a pattern only where the text has all the plain
    strings that they hold.
    """
    parts = [(p, [x.lower() for x in re.split(r"\.\*|\\s\*|\\w\+", p) if x]) for p in dict.fromkeys(pattern.split("|"))]
    plain = [x[0] for p, x in parts if x == [p.lower()]]
    plain = [x for x in dict.fromkeys(plain) if not any(y != x and y in x for y in plain)]  # a longer one says nothing more
    rest = [(p, x) for p, x in parts if x != [p.lower()] and not any(y in z for y in plain for z in x)]
    held = [F.contains(low, F.lit(x)) for x in plain]
    held += [reduce(lambda a, b: a & b, [F.contains(low, F.lit(y)) for y in dict.fromkeys(x)]) & query.rlike(ANY_CASE + p) for p, x in rest]
    return reduce(lambda a, b: a | b, held)


def intents(query: Column) -> Column:
    """Candidate intents, the first of which leads; concept_qa if nothing is named.

    Writing code goes before a project's troubles, these before an error, and migration, interfaces and concepts follow.
    """
    at = {name: i for i, name in enumerate(INTENT_PATTERNS)}

    def first(has: Column) -> Column:
        code, project = has[at["code_generation"]], has[at["project_debug"]]
        return named([(code & project, "code_generation"), (project, "project_debug"), (has[at["error_diagnosis"]], "error_diagnosis"), (code & ~project, "code_generation"), *((has[at[x]], x) for x in ("migration", "api_usage", "concept_qa"))])

    # arrays of one element, so that each step is taken once for a row
    has = F.transform(F.array(any_case(query)), lambda low: F.array(*[names_any(query, low, p) for p in INTENT_PATTERNS.values()]))
    found = F.transform(F.transform(has, first), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("concept_qa"))))
    return found[0]


def signals(query: Column) -> Column:
    """struct of each intent: the different strings that name it, sorted."""
    return F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(f"({ANY_CASE}{p})"), 1))).alias(name) for name, p in INTENT_PATTERNS.items()])


def scenarios(query: Column) -> Column:
    return named([(query.rlike(ANY_CASE + p), name) for name, p in SCENARIO_PATTERNS.items()])


def tools(primary: Column, hints: Column) -> Column:
    """Tools for the leading intent: both searches, then its own, and for errors those that scenarios add."""
    added = named([(F.arrays_overlap(hints, F.array(*map(F.lit, names))), tool) for tool, names in SCENARIO_TOOLS.items()])
    own = reduce(lambda rest, x: F.when(primary == x[0], F.array(*map(F.lit, x[1]))).otherwise(rest), INTENT_TOOLS.items(), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.lit("keyword_search"), F.lit("vector_search")), own, F.when(primary == "error_diagnosis", added).otherwise(none))


def mode(primary: Column) -> Column:
    return F.coalesce(*[F.when(primary == i, F.lit(m)) for i, m in INTENT_MODES.items()], F.lit("hybrid_only"))


def is_code_query(query: Column) -> Column:
    return query.rlike(EXACT_CASE + CODE_QUERY)


def features(query: Column) -> Column:
    """struct of flags, one for each feature."""
    return F.struct(*[query.rlike(EXACT_CASE + p).alias(name) for name, p in FEATURES.items()])


def plan_name(query: Column, graph_on: Column, intent: Column | None = None) -> Column:
    """The plan of a query: by its intent where that calls for one, else relational, exact and semantic questions in this order.

    Without a graph all queries take the hybrid plan.
    """
    intent = F.coalesce(intent if intent is not None else F.lit("general_question"), F.lit("general_question"))
    has = {name: query.rlike(EXACT_CASE + p) for name, p in FEATURES.items()}
    by_intent = F.coalesce(*[F.when(intent == i, F.lit(p)) for i, p in INTENT_PLANS.items()])
    relational = has["relation"] | intent.isin(*RELATIONAL_INTENTS)
    exact = has["error_code"] | (has["api_name"] & ~has["semantic"]) | has["class_name"] | has["function_name"] | has["config_name"] | intent.isin(*EXACT_INTENTS)
    asks = (F.length(query) > 20) & ~has["error_code"] & ~has["api_name"] & query.rlike("什么是|如何|为什么")
    semantic = (has["semantic"] & ~has["error_code"]) | intent.isin(*SEMANTIC_INTENTS) | asks
    ruled = F.when(relational, "graph_first").when(exact, "exact").when(semantic, "semantic").otherwise("default")
    return F.when(~graph_on, "hybrid_only").otherwise(F.coalesce(by_intent, ruled))


def plan(name: Column) -> Column:
    """The plan's mode, weights, row counts and depth as a struct."""
    pick = lambda key: F.coalesce(*[F.when(name == n, F.lit(p[key])) for n, p in PLANS.items()])
    return F.struct(*[pick(k).alias(k) for k in PLANS["default"]])


def fallback(kind: Column, tries: Column) -> Column:
    """struct(kind, action, exhausted, recoverable): what follows a failure of a kind after so many tries.

    An unknown kind counts as an unknown intent. When its tries are used up a failure goes to a person.
    """
    kind = F.when(kind.isin(*FALLBACKS), kind).otherwise(F.lit("unknown_intent"))
    action = F.coalesce(*[F.when(kind == k, F.lit(a)) for k, (a, _) in FALLBACKS.items()])
    most = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, (_, n) in FALLBACKS.items() if n is not None])
    exhausted = F.coalesce(tries >= most, F.lit(False))
    action = F.when(exhausted, "human_fallback").otherwise(action)
    return F.struct(kind.alias("kind"), action.alias("action"), exhausted.alias("exhausted"), (action != "final_refusal").alias("recoverable"))


def failure_kind(permissions: Column, intent: Column, docs: Column, best_score: Column, tool_errors: Column, verified: Column) -> Column:
    """The first failure that a state shows; unknown_intent if it shows none."""
    return (
        F.when(~F.array_contains(permissions, "knowledge_search"), "permission_denied")
        .when(intent == "unknown", "unknown_intent")
        .when(docs == 0, "no_relevant_docs")
        .when(best_score < 0.1, "low_retrieval_score")
        .when(tool_errors > 0, "tool_failure")
        .when(~verified, "answer_not_grounded")
        .otherwise("unknown_intent")
    )


def target_language(query: Column) -> Column:
    """The first programming language of which a word occurs anywhere in the query; typescript if none does."""
    low = F.lower(query)
    return F.coalesce(*[F.when(reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False)), F.lit(name)) for name, words in LANGUAGES.items()], F.lit("typescript"))


def expansion_terms(paths: DataFrame, queries: DataFrame, most: int = 15) -> DataFrame:
    """(query_id, term): path terms that aren't words of the query, longest first, ties by term."""
    words = queries.select("query_id", F.explode(T.word_set(F.col("query"))).alias("term"))
    terms = paths.select("query_id", F.lower("term").alias("term")).filter(F.length("term") >= 2).distinct().join(words, ["query_id", "term"], "left_anti")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "term")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "term", "rank")


#: Words in a query that call for a tool, letters in either case; tickets and error codes.
TOOL_TRIGGERS = {
    "get_system_status": ("系统状态", "服务状态", "健康检查", "运行状态"),
    "get_error_code_detail": ("错误码", "error code", "401", "429", "500", "AUTH"),
    "query_ticket": ("工单", "ticket", "Ticket", "TKT"),
    "get_user_profile": ("用户信息", "用户档案", "我的信息", "个人信息"),
    "execute_code": ("执行代码", "运行代码", "验证代码", "执行示例", "运行示例"),
}
TICKET = r"TKT-[0-9]{3}"
ERROR_CODE = r"AUTH_[0-9]{3}|RATE_[0-9]{3}|SYS_[0-9]{3}"
#: What names an entity of a query; the first two tables are patterns, letters in either case, the others plain words.
QUERY_APIS = (r"@ohos\.[\pL\pN_]+(?:\.[\pL\pN_]+)*", r"@system\.[\pL\pN_]+", r"@kit\.[\pL\pN_]+(?:\.[\pL\pN_]+)*")
QUERY_ERRORS = (
    r"BusinessError\s*[0-9]*", r"permission\s+denied", r"Cannot\s+find\s+module", r"hvigor\s+ERROR", r"compile\s+failed", r"runtime\s+error", "crash", "SIGABRT", "SIGSEGV",
    "ArkTS:ERROR", "ArkCompiler", "TypeError", "ReferenceError", "SyntaxError", "RangeError", "URIError", "白屏", "黑屏", "闪退", "卡顿", "OOM", "内存泄漏", "死锁", "ANR",
    "启动失败", "安装失败", "签名错误",
)
KNOWN_APIS = (
    "ohos.net.http", "ohos.router", "ohos.data.preferences", "ohos.file.fs", "ohos.notificationManager", "ohos.abilityAccessCtrl", "ohos.app.ability.UIAbility",
    "ohos.multimedia.media", "ohos.security.huks", "ohos.account.osAccount", "ohos.bundle.bundleManager", "ohos.distributedHardware.deviceManager", "ohos.telephony.radio", "ohos.wifiManager",
)
COMPONENTS = (
    "ActionSheet", "AlertDialog", "AlphabetIndexer", "Badge", "Button", "CalendarPicker", "Canvas", "Checkbox", "Column", "ContextMenu", "Counter", "CustomDialog", "DataPanel",
    "DatePicker", "Flex", "Gauge", "Grid", "GridCol", "GridItem", "GridRow", "Image", "List", "ListItem", "ListItemGroup", "LoadingProgress", "Marquee", "MenuItem",
    "NavDestination", "NavPathStack", "NavRouter", "Navigation", "Panel", "Picker", "Popup", "Progress", "QRCode", "Radio", "Rating", "Refresh", "RelativeContainer", "RichText",
    "Router", "Row", "Scroll", "Search", "SideBarContainer", "Slider", "Span", "Stack", "Swiper", "SymbolGlyph", "Tabs", "Text", "TextArea", "TextInput", "TextPicker",
    "TimePicker", "Toggle", "Video", "WaterFlow", "Web", "XComponent",
)
FILES = ("module.json5", "Index.ets", "EntryAbility.ets", "build-profile.json5", "hvigorfile.ts", "hvigorw.bat", "oh-package.json5", "AppScope", "src/main/ets", "src/main/resources", "app.json5", "hap", "hsp")
VERSIONS = {"HarmonyOS": r"HarmonyOS\s+([0-9]+\.[0-9]+(?:\.[0-9]+)?)", "OpenHarmony": r"OpenHarmony\s+([0-9]+\.[0-9]+(?:\.[0-9]+)?)", "SDK": r"SDK\s*([0-9]+)"}
API_LEVEL = r"API\s*(?:Level\s*)?([0-9]{1,2})"
MIGRATIONS = (
    ("Router", "Navigation", r"Router.*迁移.*Navigation|Router.*替换.*Navigation|Router.*升级.*Navigation|Router.*改为.*Navigation"),
    ("FA模型", "Stage模型", r"FA.*迁移.*Stage|FA.*替换.*Stage|FA.*升级.*Stage|FA.*改为.*Stage"),
    ("JS", "ArkTS", r"JS.*迁移.*ArkTS|JS.*替换.*ArkTS|JavaScript.*迁移|JS.*转为.*ArkTS"),
    ("Java", "ArkTS", r"Java.*迁移.*ArkTS|Java.*替换.*ArkTS|Java.*升级.*ArkTS"),
    ("旧API", "新API", r"废弃.*API|替换.*API|旧.*API.*新|deprecated.*API"),
    ("DataAbility", "DataShare", r"DataAbility.*迁移|DataAbility.*替换|DataAbility.*升级|DataAbility.*废弃"),
    ("XComponent", "XComponent", r"XComponent.*迁移|XComponent.*升级"),
)
MIGRATION = r"(?:从|把|将)?\s*([\pL\pN_]+(?:\s*[\pL\pN_]+)?)\s*(?:迁移|升级|替换|改成|转(?:换)?为|转向)\s*(?:到|为|成)?\s*([\pL\pN_]+(?:\s*[\pL\pN_]+)?)"
TERM_PATTERNS = (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[A-Z_]{3,}\b", r"\b\d{4,10}\b", r"\b@[\w.]+", r"\b\w+Ability\b", r"\bohos\.\w+(?:\.\w+)*\b")


def tool_calls(query: Column, intent: Column) -> Column:
    """array of struct(tool, param): the tools that an intent and the words of a query call for, each once.

    Tickets and error codes are named in capitals; only a ticket query asks for a ticket without a name (an empty param).
    Creating a ticket asks for a confirmation first, so it is never called from here.
    """
    lower, named_as = F.lower(query), lambda rule: F.upper(F.regexp_extract(query, f"(?i)({rule})", 1))
    ticket, error = named_as(TICKET), named_as(ERROR_CODE)
    asks = {tool: reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w.lower())) for w in words]) for tool, words in TOOL_TRIGGERS.items()}
    trouble, ticketing = intent == "troubleshooting", intent == "ticket_query"
    rules = (
        (trouble, "get_system_status", F.lit("")), (trouble & (error != ""), "get_error_code_detail", error), (ticketing, "query_ticket", ticket),
        (~trouble & asks["get_system_status"], "get_system_status", F.lit("")), (~trouble & asks["get_error_code_detail"] & (error != ""), "get_error_code_detail", error),
        (~ticketing & asks["query_ticket"] & (ticket != ""), "query_ticket", ticket), (asks["get_user_profile"], "get_user_profile", F.lit("")), (asks["execute_code"], "execute_code", F.lit("")),
    )
    return F.filter(F.array(*[F.when(held, F.struct(F.lit(tool).alias("tool"), param.alias("param"))) for held, tool, param in rules]), lambda x: x.isNotNull())


def query_entities(query: Column) -> Column:
    """struct(apis, components, errors, api_levels, versions, files, migration_from, migration_to) that a query names.

    Components and files are found anywhere in the text, in the order of their tables; APIs and errors that differ in case
    (or by a leading at-sign) count once. A known API needs two of its parts in the query, one of them of four letters.
    """
    lower = F.lower(query)
    every = lambda rule, group=0: F.regexp_extract_all(query, F.lit(f"(?i){rule}"), group)
    holds = lambda names: named([(F.contains(lower, F.lit(x.lower())), x) for x in names])
    after = lambda name, found: F.transform(found, lambda x: F.concat(F.lit(name + " "), x))
    none = F.array().cast("array<string>")

    def known(api: str) -> Column:
        parts = [(p, F.contains(lower, F.lit(p.lower()))) for p in api.split(".")]
        return (reduce(lambda a, b: a + b, [c.cast("int") for _, c in parts]) >= 2) & reduce(lambda a, b: a | b, [c for p, c in parts if len(p) > 3])

    bare = lambda x: F.lower(F.ltrim(x, F.lit("@")))
    apis = F.concat(*[every(p) for p in QUERY_APIS], named([(known(a), a) for a in KNOWN_APIS]))
    once = F.aggregate(apis, none, lambda acc, x: F.when(F.exists(acc, lambda y: bare(y) == bare(x)), acc).otherwise(F.array_append(acc, x)))
    errors = T.ordered_distinct(F.transform(F.concat(*[every(p) for p in QUERY_ERRORS]), strip))
    versions = F.concat(F.when(F.contains(lower, F.lit("harmonyos next")), F.array(F.lit("HarmonyOS NEXT"))).otherwise(none), *[after(name, every(p, 1)) for name, p in VERSIONS.items()])
    moved = lambda i: F.coalesce(*[F.when(query.rlike(m[2]), m[i]) for m in MIGRATIONS], F.nullif(strip(F.regexp_extract(query, MIGRATION, i + 1)), F.lit("")))
    return F.struct(
        once.alias("apis"), holds(COMPONENTS).alias("components"), errors.alias("errors"), after("API", every(API_LEVEL, 1)).alias("api_levels"),
        versions.alias("versions"), holds(FILES).alias("files"), moved(0).alias("migration_from"), moved(1).alias("migration_to"),
    )


def search_terms(entities: Column, keywords: Column, query: Column, most: int = 20) -> Column:
    """What to look for in a graph: entities, else keywords, else what looks like a name in the query; once each, 20 at most."""
    said = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    raw = F.concat(*[F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(f"(?U){p}"), 0) for p in TERM_PATTERNS])
    return F.slice(T.ordered_distinct(F.when(F.size(said(entities)) > 0, said(entities)).when(F.size(said(keywords)) > 0, said(keywords)).otherwise(raw)), 1, most)
