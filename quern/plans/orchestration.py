"""Retrieval in modes with degradation, and an agent with a cache, over tables of queries against documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import context, embed, orchestrate, search
from quern.operators.lineage import cut
from quern.operators.route import STOP_WORDS
from quern.plans.registry import Registry
from quern.plans.retrieval import BASE, WORDS, chunks, top
from quern.sources.tables import table
from quern.sources.versions import VersionedTables

Q = Registry()


def moded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in six modes and three states of the graph; some are cut to short words, which no path begins with, some name a source, some mean nothing."""
    item = F.col("item_id")
    short = F.array_join(F.filter(F.split("text", " "), lambda w: F.length(w) <= 6), " ")
    text = F.when(item % 22 == 3, "src5").when(item % 11 == 3, "zzzz").when(item % 5 == 0, short).otherwise(F.col("text"))
    modes = F.array(*map(F.lit, (*orchestrate.MODE_PLANS, "deep_dive")))
    state = F.when(item % 7 == 0, "off").when(item % 7 == 1, "failed").otherwise("on")
    return table(spark, sf_dir, "benchmark").select((-1 - item).alias("query_id"), text.alias("query"), F.element_at(modes, (item % 6 + 1).cast("int")).alias("mode"), state.alias("graph_state"))


def long_words(rows: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(key, word, n): words of nine letters or more, without what isn't a letter, and how often they occur; just those of ``only`` (word) if it is given."""
    letters = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{9,})"), 1)
    each = rows.select(key, F.explode_outer(letters).alias("word"))  # explode would look for them twice, to filter rows first
    return (each.filter("word IS NOT NULL") if only is None else each.join(only, "word", "left_semi")).groupBy(key, "word").agg(F.count("*").alias("n"))


def word_paths(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """Paths of a graph of chunks and the long words that they mention: from a query's word to a chunk, and on to the two longest
    other words of it. Chunks are ranked by how many of the query's words they mention, how often, and the path's length."""
    docs = chunks(spark, sf_dir)
    seeds = long_words(queries, "query_id", "query").select("query_id", "word")
    total = seeds.groupBy("query_id").agg(F.count("*").alias("terms"))
    mentions = long_words(docs, "chunk_id", "content", seeds.select("word").distinct())
    met = seeds.join(mentions, "word").groupBy("query_id", "chunk_id").agg(F.count("*").alias("seeds"), F.avg(F.least(F.lit(1.0), F.col("n") / 5)).alias("weight"), F.collect_list("word").alias("words"))
    score = 0.4 * F.col("seeds") / F.col("terms") + 0.3 * F.col("weight") + 0.2 + 0.1
    best = search.ranked(met.join(total, "query_id").withColumn("score", F.round(score, 6)), "query_id", [F.desc("score"), F.col("chunk_id")], k)
    best = cut(best)
    ends = long_words(docs.join(best.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "content")
    longest = search.ranked(ends, "chunk_id", [F.desc(F.length("word")), F.col("word")], 2).groupBy("chunk_id").agg(F.collect_list("word").alias("on"))
    return best.join(longest, "chunk_id").select("query_id", "chunk_id", "rank", F.array_distinct(F.concat("words", "on")).alias("entities"), F.array(F.lit("PART_OF")).alias("relations"))


def pair_hits(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """The nearest documents by cosine of signed counts of word pairs; ids of queries are negative, so none is a document's."""
    asked = embed.pair_vectors(queries, "query_id", "query").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    vectors = embed.pair_vectors(chunks(spark, sf_dir), "chunk_id", "content").select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"))
    hits = search.vector_search(asked, vectors, k).filter("score > 0")
    return hits.select("query_id", F.col("vec_id").alias("chunk_id"), "rank")


def orchestrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = chunks(spark, sf_dir).select("chunk_id", "content")
    keyword = lambda q: search.overlap_search(q, docs, 20).select("query_id", "chunk_id", "rank")
    titles = chunks(spark, sf_dir).select("chunk_id", F.col("source").alias("content"))
    last = lambda q: search.overlap_search(q, titles, 5).select("query_id", "chunk_id", "rank")
    return orchestrate.retrieve(moded_queries(spark, sf_dir), docs, keyword, lambda q: pair_hits(spark, sf_dir, q), lambda q: word_paths(spark, sf_dir, q), last)


MODES = (*orchestrate.MODE_PLANS, "deep_dive")
#: The same steps: graph paths, expanded queries, three lists, weights by plan, fusion, the last source, ranking again.
STEPS = rf"""
WITH q AS (SELECT -1 - item_id AS query_id, CASE WHEN item_id % 22 = 3 THEN 'src5' WHEN item_id % 11 = 3 THEN 'zzzz' WHEN item_id % 5 = 0 THEN array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) <= 6), ' ') ELSE text END AS query,
  {list(MODES)}[item_id % 6 + 1] AS mode, CASE WHEN item_id % 7 = 0 THEN 'off' WHEN item_id % 7 = 1 THEN 'failed' ELSE 'on' END AS state FROM benchmark),
c AS (SELECT doc_id AS chunk_id, text AS content, source FROM documents),
lw AS (SELECT chunk_id, word, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z]{{9,}}')) AS word FROM c) GROUP BY ALL),
wants AS (SELECT *, mode IN {orchestrate.GRAPH_MODES} AND state <> 'off' AS wants FROM q),
seeds AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{9,}}')) AS word FROM wants WHERE wants AND state = 'on'),
total AS (SELECT query_id, count(*) AS terms FROM seeds GROUP BY query_id),
met AS (SELECT query_id, chunk_id, count(*) AS hits, avg(least(1.0::DOUBLE, n / 5)) AS weight, list(word) AS words FROM seeds JOIN lw USING (word) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT met.*, round(0.4::DOUBLE * hits / terms + 0.3::DOUBLE * weight + 0.2::DOUBLE + 0.1::DOUBLE, 6) AS score FROM met JOIN total USING (query_id)) QUALIFY rank <= 10),
longest AS (SELECT chunk_id, word FROM lw QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY length(word) DESC, word) <= 2),
g AS (SELECT query_id, count(*) AS graph_hits FROM p GROUP BY query_id),
a AS (SELECT wants.*, coalesce(graph_hits, 0) AS graph_hits, CASE WHEN NOT wants OR (mode = 'graph_first' AND graph_hits IS NULL) THEN 'rrf_two_way' WHEN mode = 'graph_first' THEN 'rrf_three_way_graph_first' WHEN graph_hits > 0 THEN 'rrf_three_way' ELSE 'rrf_two_way_renormalised' END AS method,
  CASE WHEN state = 'off' AND mode = 'hybrid_only' THEN 'graph_unavailable' WHEN state = 'off' OR mode = 'deep_dive' THEN mode WHEN mode = 'graph_first' AND graph_hits IS NULL THEN mode WHEN wants AND state = 'failed' THEN mode ELSE '' END AS degraded_from FROM wants LEFT JOIN g USING (query_id)),
kt AS (SELECT chunk_id, list_concat(list_concat(regexp_extract_all(content, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'), regexp_extract_all(content, '\b[A-Z_]{{4,}}\b')), regexp_extract_all(content, '@ohos\.\w+(?:\.\w+)*')) AS l FROM c),
ku AS (SELECT chunk_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:5] AS l FROM kt),
f1 AS (SELECT p.* FROM p JOIN a USING (query_id) WHERE method = 'rrf_three_way_graph_first'),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(words) AS term FROM f1 UNION ALL SELECT query_id, word FROM f1 JOIN longest USING (chunk_id) UNION ALL SELECT query_id, unnest(['包含', '组成']) FROM f1 UNION ALL SELECT query_id, unnest(l) FROM f1 JOIN ku USING (chunk_id))),
own AS (SELECT query_id, {WORDS.format('query')} AS w FROM q),
best AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS rank FROM terms JOIN own USING (query_id) WHERE length(term) >= 2 AND NOT list_contains(w, lower(term)) QUALIFY rank <= 15),
extra AS (SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS terms, count(*) AS n FROM best GROUP BY query_id),
sq AS (SELECT query_id, query || coalesce(' ' || terms, '') AS query, coalesce(n, 0) AS n FROM q LEFT JOIN extra USING (query_id)),
qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM (SELECT query_id, list_distinct({WORDS.format('query')}) AS w FROM sq)),
cw AS (SELECT chunk_id, unnest(list_distinct({WORDS.format('content')})) AS word FROM c),
kw AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) / any_value(n) DESC, chunk_id) AS rank FROM cw JOIN qw USING (word) GROUP BY query_id, chunk_id QUALIFY rank <= 20),
t AS (SELECT query_id AS id, {WORDS.format('query')} AS w FROM sq UNION ALL SELECT chunk_id, {WORDS.format('content')} FROM c),
h AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1]))) AS h FROM t WHERE len(w) > 1),
n AS (SELECT id, substr(h, 1, 2) AS bucket, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL),
norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM n GROUP BY id HAVING norm > 0),
cs AS (SELECT x.id AS query_id, y.id AS chunk_id, round(sum(x.n * y.n) / any_value(nx.norm * ny.norm), 6) AS score FROM n x JOIN n y ON x.bucket = y.bucket AND x.id < 0 AND y.id >= 0 JOIN norm nx ON nx.id = x.id JOIN norm ny ON ny.id = y.id GROUP BY ALL),
vc AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs WHERE score > 0 QUALIFY rank <= 20),
lists AS (SELECT *, 'keyword' AS list FROM kw UNION ALL SELECT *, 'vector' FROM vc UNION ALL SELECT query_id, chunk_id, rank, 'graph' FROM p),
weights(plan, method, list, w, most) AS (VALUES {', '.join(f"('{p}', '{m}', '{x}', {w!r}::DOUBLE, {k})" for p, m, x, w, k in orchestrate.weight_rows())}),
hits AS (SELECT query_id, chunk_id, rank, lists.list AS list, w.w AS w FROM lists JOIN a USING (query_id) JOIN weights w ON w.list = lists.list AND w.method = a.method AND w.plan = CASE WHEN a.method = 'rrf_two_way' THEN 'hybrid_only' ELSE mode END WHERE rank <= most),
fused AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 8) AS score FROM hits WHERE w > 0 GROUP BY ALL),
top AS (SELECT query_id, chunk_id, score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10),
rescue AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS score FROM q JOIN c ON q.query = c.source WHERE query_id NOT IN (SELECT query_id FROM top) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 5),
found AS (SELECT *, 'fused' AS level FROM top UNION ALL SELECT *, 'last' FROM rescue)
"""


@Q.query("orchestrated_topk", STEPS + f""", s AS (SELECT query_id, chunk_id, round(score * 0.5 + 0.5 * len(list_intersect(list_distinct({WORDS.format('query')}), list_distinct({WORDS.format('content')}))), 6) AS rerank_score FROM found JOIN q USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5""")
def orchestrated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchestrated(spark, sf_dir)[0]


@Q.query("orchestrated_trace", STEPS + """, tally AS (SELECT query_id, count(DISTINCT chunk_id) FILTER (list = 'keyword') AS keyword_hits, count(DISTINCT chunk_id) FILTER (list = 'vector') AS vector_hits FROM hits GROUP BY query_id)
SELECT query_id, mode, method, degraded_from, CASE WHEN degraded_from = '' THEN '' WHEN wants AND state = 'failed' AND mode <> 'graph_first' THEN 'parallel_keyword_vector_only' ELSE 'hybrid_only' END AS degraded_to,
 coalesce(keyword_hits, 0) AS keyword_hits, coalesce(vector_hits, 0) AS vector_hits, graph_hits, sq.n AS terms, coalesce((SELECT any_value(level) FROM found WHERE found.query_id = a.query_id), 'none') AS level FROM a JOIN sq USING (query_id) LEFT JOIN tally USING (query_id)""")
def orchestrated_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchestrated(spark, sf_dir)[1]


#: Stop words alone make a query's score weak; the recovery rewrite drops them.
STOPS = " ".join(STOP_WORDS)


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as requests of three scopes; a quarter is two words behind all stop words, a tenth means nothing."""
    item, words = F.col("item_id"), F.split("text", " ")
    text = F.when(item % 10 == 7, "zzzz").when(item % 4 == 1, F.concat(F.lit(STOPS + " "), F.element_at(words, 1), F.lit(" "), F.element_at(words, 2))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(item.alias("request_id"), F.concat(F.lit("s"), (item % 3).cast("string")).alias("scope"), text.alias("query"))


@Q.query("agent_retrieval", f"""
WITH r AS (SELECT item_id AS request_id, CASE WHEN item_id % 8 = 2 THEN 'admin' ELSE 's' || (item_id % 3) END AS scope, CASE WHEN item_id % 10 = 7 THEN 'zzzz' WHEN item_id % 4 = 1 THEN '{STOPS} ' || string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] ELSE text END AS query,
  CASE WHEN length(string_split(text, ' ')[2]) > length(string_split(text, ' ')[1]) THEN string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[1] ELSE string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] END AS two FROM benchmark),
tries AS (SELECT request_id, 1 AS attempt, query FROM r UNION ALL SELECT request_id, 2, two FROM r WHERE request_id % 10 <> 7 AND request_id % 4 = 1),
qw AS (SELECT request_id, attempt, len(w) AS n, unnest(w) AS word FROM (SELECT request_id, attempt, list_distinct({WORDS.format('query')}) AS w FROM tries)),
cw AS (SELECT doc_id AS chunk_id, unnest(list_distinct({WORDS.format('text')})) AS word FROM documents),
ov AS (SELECT request_id, attempt, chunk_id, count(*) / any_value(n) AS score FROM cw JOIN qw USING (word) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id, attempt ORDER BY score DESC, chunk_id) AS rank FROM ov QUALIFY rank <= 10),
per AS (SELECT request_id, attempt, max(score) AS best, count(*) AS hits, arg_min(chunk_id, rank) AS first_chunk FROM top GROUP BY ALL),
done AS (SELECT r.request_id, r.scope, CASE WHEN coalesce(a.best, 0) < 0.1 THEN 2 ELSE 1 END AS attempts, CASE WHEN coalesce(a.best, 0) < 0.1 AND b.hits IS NOT NULL THEN b.hits ELSE a.hits END AS hits, CASE WHEN coalesce(a.best, 0) < 0.1 AND b.hits IS NOT NULL THEN b.first_chunk ELSE a.first_chunk END AS first_chunk
  FROM r LEFT JOIN per a ON a.request_id = r.request_id AND a.attempt = 1 LEFT JOIN per b ON b.request_id = r.request_id AND b.attempt = 2)
SELECT request_id, CASE WHEN hits IS NULL THEN 'fail' WHEN request_id % 2 = 0 AND scope <> 'admin' THEN 'cache_hit' ELSE 'workflow' END AS path, CASE WHEN hits IS NOT NULL AND request_id % 2 = 0 AND scope <> 'admin' THEN 0 ELSE attempts END AS attempts, coalesce(hits, 0) AS hits, coalesce(first_chunk, -1) AS first_chunk FROM done""")
def agent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the requests come first and fill the cache; then all come, some of them in another scope."""
    docs = chunks(spark, sf_dir).select("chunk_id", "content")
    workflow = lambda q: search.overlap_search(q, docs, 10)
    requests = requests_of(spark, sf_dir)
    store = VersionedTables(spark, schemas={"cache": "scope string, key string, hits array<struct<rank: int, chunk_id: bigint, score: double>>"})
    _, gained = orchestrate.answer_requests(requests.filter("request_id % 2 = 0"), store.read("cache"), workflow)
    store.replace(gained, "cache", "first half")
    now = requests.withColumn("scope", F.when(F.col("request_id") % 8 == 2, "admin").otherwise(F.col("scope")))
    answers, more = orchestrate.answer_requests(now, store.read("cache"), workflow)
    store.replace(store.read("cache").unionByName(more), "cache", "all")
    return answers.select("request_id", "path", "attempts", F.size("hits").cast("long").alias("hits"), F.coalesce(F.try_element_at("hits", F.lit(1))["chunk_id"], F.lit(-1)).alias("first_chunk"))


@Q.query("context_build", BASE + """, est AS (SELECT query_id AS id, rank, source, chunk_id, content, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 2) END AS tokens FROM top),
d AS (SELECT *, sum(tokens) OVER (PARTITION BY id ORDER BY rank) AS used FROM est),
tl AS (SELECT o_custkey - 1 AS id, o_orderkey AS place, greatest(1, length(repeat(o_orderstatus, 200)) // 2) AS tokens FROM orders),
tr AS (SELECT *, sum(tokens) OVER (PARTITION BY id ORDER BY place) AS used FROM tl),
h AS (SELECT q.query_id AS id, turn, role, text AS content, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END) OVER (PARTITION BY q.query_id ORDER BY turn DESC) AS used FROM q JOIN conversations ON conv_id = q.query_id % 50),
s AS (SELECT q.query_id AS id, query, greatest(1, length(query) // 2) AS qt, left(text, 400) AS summary, c_name AS user_context FROM q LEFT JOIN conversations ON conv_id = q.query_id % 50 AND turn = 0 LEFT JOIN customer ON c_custkey = q.query_id + 1),
a AS (SELECT s.*, least(qt, 4096) AS query_tokens FROM s),
b AS (SELECT a.*, coalesce((SELECT max(used) FROM d WHERE d.id = a.id AND used <= 4096 - query_tokens), 0) AS docs_tokens FROM a),
e AS (SELECT b.*, coalesce((SELECT max(used) FROM tr WHERE tr.id = b.id AND used <= 4096 - query_tokens - docs_tokens), 0) AS tools_tokens FROM b),
f AS (SELECT e.*, least(CASE WHEN coalesce(length(summary), 0) = 0 THEN 0 ELSE greatest(1, length(summary) // 2) END, 4096 - query_tokens - docs_tokens - tools_tokens) AS summary_tokens FROM e),
g AS (SELECT f.*, coalesce((SELECT max(used) FROM h WHERE h.id = f.id AND used <= 4096 - query_tokens - docs_tokens - tools_tokens - summary_tokens), 0) AS history_tokens FROM f),
dd AS (SELECT d.id, count(*) AS n, string_agg('- **[' || rank || ']** `' || source || '` — ' || replace(substr(content, 1, 120), chr(10), ' '), chr(10) ORDER BY rank) AS refs FROM d JOIN g ON g.id = d.id WHERE used <= 4096 - query_tokens GROUP BY d.id),
hh AS (SELECT id, string_agg('  ' || role || ': ' || substr(content, 1, 150), chr(10) ORDER BY turn) AS said FROM (SELECT h.*, row_number() OVER (PARTITION BY h.id ORDER BY turn DESC) AS back FROM h JOIN g ON g.id = h.id WHERE used <= history_tokens) WHERE back <= 6 GROUP BY id)
SELECT g.id AS query_id, query_tokens::BIGINT AS query_tokens, docs_tokens::BIGINT AS docs_tokens, tools_tokens::BIGINT AS tools_tokens, summary_tokens::BIGINT AS summary_tokens, history_tokens::BIGINT AS history_tokens, (4096 - query_tokens - docs_tokens - tools_tokens - summary_tokens - history_tokens)::BIGINT AS remaining,
 coalesce(chr(10) || '---' || chr(10) || '## 📚 参考来源' || chr(10) || chr(10) || refs, '') AS "references",
 concat_ws(chr(10) || chr(10), '[用户信息]' || chr(10) || nullif(user_context, ''), '[会话摘要]' || chr(10) || nullif(summary, ''), '[历史对话]' || chr(10) || said, '[参考文档] (' || n || ' 篇)') AS "window" FROM g LEFT JOIN dd USING (id) LEFT JOIN hh USING (id)""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with the documents that share most words, orders as outputs of tools, and a conversation before it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), (F.col("item_id") % 50).alias("conv_id"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    first = turns.filter("turn = 0").select("conv_id", F.substring("content", 1, 400).alias("summary"))
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("user_context"))
    docs = top(spark, sf_dir).select(F.col("query_id").alias("id"), "rank", "source", "chunk_id", "score", "content")
    tools = table(spark, sf_dir, "orders").select((F.col("o_custkey") - 1).alias("id"), F.col("o_orderkey").alias("place"), F.expr("repeat(o_orderstatus, 200)").alias("output"))
    queries = items.join(first, "conv_id", "left").join(names, "id", "left").select("id", "query", "summary", "user_context")
    built = context.build_contexts(queries, docs, tools, items.select("id", "conv_id").join(turns, "conv_id").drop("conv_id"))
    return built.select(F.col("id").alias("query_id"), "query_tokens", "docs_tokens", "tools_tokens", "summary_tokens", "history_tokens", "remaining", "references", "window")
