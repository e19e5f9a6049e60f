"""The pipelines as registered queries, and the SQL that gives the same rows; imported by skein.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import models, routing
from skein.operators import chunking as C
from skein.operators import ranking as K
from skein.plans import patterns as P
from skein.plans.layout import spread, stored, table
from skein.registry import FEW, NL, SENTS, TURNS, WS, any_of, asked, bm_sql, cosine_sql, documents, emb, few_queries, mmr_sql, near_sql, query, turns

CORPUS = "corpus AS (SELECT CAST(id AS BIGINT) AS doc_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id)"
WEB = "web AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)"
ASKS = f"f AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {FEW})"
#: What stands for the web and for stores of facts.
FACTS = [(0, "token_budget", "The token budget is 4096."), (1, "index_count", "There are 12 indexes."), (2, "market", "The market grew by 8%.")]
KNOWN = [(0, "sparse index", "A sparse index maps terms to the documents that hold them."), (1, "token budget", "A token budget bounds the length of a prompt.")]


def values(rows, names: str) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


def corpus(spark, d):
    """All records, each id once: the corpus that the pipelines retrieve from."""
    return table(spark, d, "chunks").where("text is not null").groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))


def web(spark, d):
    return table(spark, d, "documents").where("text is not null").select("text").distinct()


def facts(spark):
    return spark.createDataFrame(FACTS, "key_pos int, key string, value string")


def hits_sql(name: str, rows: str, docs: str, k: int, text: str = "query") -> str:
    """A CTE of the k texts of `docs` nearest to each row of `rows`, as patterns.retrieve."""
    pairs = f"SELECT q.query_id, d.text, {cosine_sql('q.v', 'd.v')} AS score FROM (SELECT query_id, {emb(text)} AS v FROM {rows}) q, (SELECT text, {emb('text')} AS v FROM {docs}) d WHERE q.v IS NOT NULL"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text DESC) AS rank FROM ({pairs})) WHERE rank <= {k})"


def bullets_sql(name: str, hits: str) -> str:
    return f"{name} AS (SELECT query_id, string_agg('- ' || text, {NL} ORDER BY rank) AS context FROM {hits} GROUP BY query_id)"


def prompt_sql(rows: str, contexts: str, lead: str) -> str:
    body = f"'{lead}' || {NL} || {NL} || 'Context:' || {NL} || coalesce(c.context, '') || {NL} || {NL} || 'Question: ' || r.query || {NL} || {NL} || 'Answer:'"
    return f"SELECT r.*, coalesce(c.context, '') AS context, {body} AS prompt, '[generated answer]' AS answer FROM {rows} r LEFT JOIN {contexts} c USING (query_id)"


@query(f"WITH {ASKS}, {CORPUS}, {hits_sql('h', 'f', 'corpus', 3)}, {bullets_sql('b', 'h')} {prompt_sql('f', 'b', P.ONLY_CONTEXT)}")
def simple_rag(spark, d):
    return P.simple(few_queries(spark), corpus(spark, d))


@query(f"""WITH {ASKS}, {CORPUS}, k AS (SELECT * FROM {values(KNOWN, 'key_pos, key, hypothesis')}), m AS (SELECT query_id, arg_min(hypothesis, key_pos) AS h FROM f, k WHERE len(list_filter(string_split(key, ' '), lambda w: contains(lower(query), w))) > 0 GROUP BY query_id),
g AS (SELECT f.*, coalesce(m.h, 'This document provides a comprehensive explanation of ' || query || '.') AS hypothesis FROM f LEFT JOIN m USING (query_id)), {hits_sql('h', 'g', 'corpus', 3, 'hypothesis')}, {bullets_sql('b', 'h')} {prompt_sql('g', 'b', P.ONLY_CONTEXT)}""")
def hyde_rag(spark, d):
    return P.hyde(few_queries(spark), corpus(spark, d), spark.createDataFrame(KNOWN, "key_pos int, key string, hypothesis string"))


@query(f"""WITH {TURNS}, w AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS last_answer, count(*) OVER w = 0 AS is_first, coalesce(string_agg(upper(role) || ': ' || text, {NL}) OVER w, '') AS transcript
FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
r AS (SELECT conv_id, turn, text AS query, CASE WHEN is_first THEN text ELSE text || ' (in the context of: ' || substring(coalesce(last_answer, ''), 1, 80) || '...)' END AS rewritten, transcript, conv_id || '/' || turn AS query_id FROM w WHERE role = 'user'),
{CORPUS}, {hits_sql('h', 'r', 'corpus', 3, 'rewritten')}, {bullets_sql('b', 'h')}, c AS (SELECT query_id, 'History:' || {NL} || transcript || {NL} || {NL} || 'Documents:' || {NL} || coalesce(context, '') AS context FROM r LEFT JOIN b USING (query_id)) {prompt_sql('r', 'c', 'Use the history and the documents.')}""")
def memory_rag(spark, d):
    return P.with_memory(turns(spark, d), corpus(spark, d))


@query(f"""WITH {ASKS}, {CORPUS}, r AS (SELECT *, CASE WHEN {any_of(routing.ITERATIVE)} THEN 'iterative' WHEN {any_of(routing.STANDARD)} THEN 'standard' WHEN {any_of(routing.DIRECT)} THEN 'direct' ELSE 'standard' END AS route FROM f),
s AS (SELECT * FROM r WHERE route = 'standard'), i AS (SELECT *, 'additional context for: ' || query AS follow_up FROM r WHERE route = 'iterative'),
{hits_sql('hs', 's', 'corpus', 3)}, {hits_sql('h1', 'i', 'corpus', 2)}, {hits_sql('h2', 'i', 'corpus', 2, 'follow_up')},
h AS (SELECT query_id, text, rank FROM hs UNION ALL SELECT query_id, text, min(rank) FROM (SELECT query_id, text, 10 + rank AS rank FROM h1 UNION ALL SELECT query_id, text, 20 + rank FROM h2) GROUP BY query_id, text), {bullets_sql('b', 'h')} {prompt_sql('r', 'b', 'Answer using this context, if there is any.')}""")
def adaptive_rag(spark, d):
    return P.adaptive(few_queries(spark), corpus(spark, d))


@query(f"""WITH {ASKS}, {CORPUS}, {WEB}, k AS (SELECT * FROM {values(FACTS, 'key_pos, key, value')}),
q AS (SELECT *, {any_of(routing.STRUCTURED_WORDS)} AS s, {any_of(routing.WEB_WORDS)} AS w, {any_of(routing.VECTOR_WORDS)} AS v FROM f), r AS (SELECT query_id, query, concat_ws(',', CASE WHEN s THEN 'structured' END, CASE WHEN w THEN 'web' END, CASE WHEN v OR NOT (s OR w) THEN 'vector' END) AS routes FROM q),
p AS (SELECT query_id, key_pos, value, contains(lower(query), key) OR len(list_filter(string_split(key, '_'), lambda x: x <> '' AND contains(lower(query), x))) > 0 AS hit FROM r, k WHERE contains(routes, 'structured')),
sh AS (SELECT query_id, value AS text, CASE WHEN any_hit THEN 1.0 ELSE 0.5 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY key_pos) AS rank FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM p) WHERE hit OR NOT any_hit),
rw AS (SELECT * FROM r WHERE contains(routes, 'web')), rv AS (SELECT * FROM r WHERE contains(routes, 'vector')), {hits_sql('hw', 'rw', 'web', 2)}, {hits_sql('hv', 'rv', 'corpus', 2)},
u AS (SELECT query_id, text, CAST(score AS DOUBLE) AS score, rank, 0 AS route_no, 'STRUCTURED' AS source FROM sh WHERE rank <= 2 UNION ALL SELECT query_id, text, score, rank, 1, 'WEB' FROM hw UNION ALL SELECT query_id, text, score, rank, 2, 'VECTOR' FROM hv),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY route_no, rank) AS n FROM u) WHERE n = 1),
b AS (SELECT query_id, string_agg('[' || source || ' | score=' || printf('%.3f', score) || ']' || {NL} || '  ' || text, {NL} || {NL} ORDER BY score DESC, route_no, rank) AS context FROM o GROUP BY query_id) {prompt_sql('r', 'b', 'Say which source each statement comes from.')}""")
def branched_rag(spark, d):
    return P.branched(few_queries(spark), corpus(spark, d), facts(spark), web(spark, d)).withColumn("routes", F.array_join("routes", ","))


def corrective_sql(hits: str) -> str:
    """The rows of corrective_context for labelled hits `l` and queries `f`."""
    return f"""{hits}, l AS (SELECT *, CASE WHEN score >= 0.75 THEN 'correct' WHEN score >= 0.45 THEN 'ambiguous' ELSE 'wrong' END AS label FROM h),
n AS (SELECT query_id, count(*) FILTER (label = 'correct') AS c, count(*) FILTER (label = 'ambiguous') AS a FROM l GROUP BY query_id), s AS (SELECT f.*, coalesce(c, 0) AS c, coalesce(a, 0) AS a, CASE WHEN coalesce(c, 0) > 0 THEN 'correct' WHEN coalesce(a, 0) > 0 THEN 'ambiguous' ELSE 'wrong' END AS action FROM f LEFT JOIN n USING (query_id)),
g AS (SELECT *, CASE WHEN action = 'correct' AND a > 0 THEN 1 WHEN action = 'ambiguous' THEN 2 WHEN action = 'wrong' THEN 3 ELSE 0 END AS web_k, CASE WHEN action = 'wrong' THEN 'detailed explanation of ' || query ELSE query END AS web_query FROM s), z AS (SELECT * FROM g WHERE web_k > 0), {hits_sql('hw', 'z', 'web', 3, 'web_query')},
x AS (SELECT l.query_id, 0 AS part, l.rank, '[VECTOR | ' || printf('%.2f', l.score) || '] ' || l.text AS line FROM l JOIN g USING (query_id) WHERE label = action AND action <> 'wrong' UNION ALL SELECT hw.query_id, 1, hw.rank, '[WEB] ' || hw.text FROM hw JOIN g USING (query_id) WHERE hw.rank <= web_k),
c AS (SELECT g.query_id, g.action, string_agg(line, {NL} ORDER BY part, rank) AS context FROM g LEFT JOIN x USING (query_id) GROUP BY ALL)"""


def corrective_rows(contexts: str = "c") -> str:
    body = f"'{P.ONLY_CONTEXT}' || {NL} || {NL} || 'Context:' || {NL} || coalesce(c.context, '') || {NL} || {NL} || 'Question: ' || f.query || {NL} || {NL} || 'Answer:'"
    return f"SELECT f.query_id, f.query, c.action, coalesce(c.context, '') AS context, {body} AS prompt, '[generated answer]' AS answer FROM f LEFT JOIN {contexts} c USING (query_id)"


@query(f"WITH {ASKS}, {CORPUS}, {WEB}, {corrective_sql(hits_sql('h', 'f', 'corpus', 3))} {corrective_rows()}")
def corrective_rag(spark, d):
    return P.corrective(few_queries(spark), corpus(spark, d), web(spark, d))


#: Queries whose stored hits have every label, so that all three branches are taken.
STORED = """f AS (SELECT CAST(min(result_id) AS BIGINT) AS query_id, query FROM retrieval_results WHERE similarity BETWEEN -1 AND 1 AND NOT isnan(similarity) AND context_chunk IS NOT NULL GROUP BY query HAVING count(DISTINCT result_id) BETWEEN 2 AND 3 AND min(result_id) % 50 = 0),
e AS (SELECT DISTINCT f.query_id, result_id, similarity AS score, context_chunk AS text FROM retrieval_results r JOIN f USING (query) WHERE similarity BETWEEN -1 AND 1 AND NOT isnan(similarity) AND context_chunk IS NOT NULL), h AS (SELECT query_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id, text) AS rank FROM e)"""


@query(f"WITH {WEB}, {corrective_sql(STORED)} SELECT query_id, action, context FROM c")
def corrective_branches(spark, d):
    # the stated set of queries is every one whose first result's id is divisible by 50, of those with two or three results
    rows = table(spark, d, "retrieval_results").where("similarity between -1 and 1 and not isnan(similarity) and context_chunk is not null")
    asks = rows.groupBy("query").agg(F.min("result_id").cast("long").alias("query_id"), F.count_distinct("result_id").alias("_n")).where("_n between 2 and 3 and query_id % 50 = 0").select("query_id", "query")
    # stored, so that its size is known and rows of other queries are not shuffled
    asks = stored(asks)
    hits = rows.join(asks, "query").select("query_id", "result_id", F.col("similarity").alias("score"), F.col("context_chunk").alias("text")).distinct()
    hits = hits.withColumn("rank", F.row_number().over(K.Window.partitionBy("query_id").orderBy(F.desc("score"), "result_id", "text")))
    return P.corrective_context(hits, web(spark, d), asks)


PASSAGE = f"""w AS (SELECT *, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS ws FROM h),
p AS (SELECT *, CASE WHEN len(ws) > 0 THEN 'Based on evidence: ''' || substring(text, 1, 60) || '...'' — the answer to ''' || query || ''' relates to ' || ws[1] || ' and ' || ws[-1] || '.' ELSE '' END AS passage FROM w),
o AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(passage), '{WS}+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda x: x <> '')) AS b, len(list_filter(regexp_split_to_array(passage, '{WS}+'), lambda x: x <> '')) AS n FROM p),
l AS (SELECT *, CASE WHEN score > 0.5 THEN 'relevant' ELSE 'irrelevant' END AS isrel, CASE WHEN len(list_intersect(a, b)) / (len(a) + 1e-9) > 0.3 THEN 'fully' WHEN len(list_intersect(a, b)) / (len(a) + 1e-9) > 0.1 THEN 'partially' ELSE 'no' END AS issup, CASE WHEN n > 20 THEN 'high' WHEN n > 10 THEN 'medium' ELSE 'low' END AS isuse FROM o),
c AS (SELECT *, round(0.2 * CASE WHEN isrel = 'relevant' THEN 1 ELSE 0 END + 0.5 * CASE issup WHEN 'fully' THEN 1 WHEN 'partially' THEN 0.5 ELSE 0 END + 0.3 * CASE isuse WHEN 'high' THEN 1 WHEN 'medium' THEN 0.6 ELSE 0.2 END, 6)::DOUBLE AS composite FROM l)"""


@query(f"""WITH {ASKS}, {CORPUS}, {hits_sql('h0', 'f', 'corpus', 3)}, h AS (SELECT h0.*, f.query FROM h0 JOIN f USING (query_id)), {PASSAGE}
SELECT query_id, query, text, passage, isrel, issup, isuse, composite, issup = 'fully' AND isuse = 'high' AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, rank) AS k FROM c) WHERE k = 1""")
def self_rag(spark, d):
    return P.self_reflective(few_queries(spark), corpus(spark, d)).withColumn("composite", F.round("composite", 6))


@query(f"""WITH h AS (SELECT DISTINCT result_id, query, similarity AS score, context_chunk AS text FROM retrieval_results WHERE similarity BETWEEN -1 AND 1 AND NOT isnan(similarity) AND context_chunk IS NOT NULL), {PASSAGE} SELECT result_id, isrel, issup, isuse, composite FROM c""")
def self_rag_score(spark, d):
    rows = table(spark, d, "retrieval_results").where("similarity between -1 and 1 and not isnan(similarity) and context_chunk is not null")
    scored = P.candidates(spread(rows.select("result_id", "query", F.col("similarity").alias("score"), F.col("context_chunk").alias("text")), "result_id"))
    # repeated rows count once; a hash of the text tells them apart, so that no text is shuffled
    names = ["result_id", "isrel", "issup", "isuse", "composite"]
    return scored.select(*names, "query", "score", F.xxhash64("text").alias("_h")).distinct().select(*names[:-1], F.round("composite", 6).alias("composite"))


# ---- graphs: nations, the regions that hold them, and trade between nations


def edges(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n"), F.col("n_regionkey").cast("int").alias("r"))
    down = n.select((F.col("n") * 2).alias("edge_pos"), F.concat(F.lit("r"), "r").alias("source_id"), F.concat(F.lit("n"), "n").alias("target_id"), F.lit("holds").alias("relation_type"))
    across = n.select((F.col("n") * 2 + 1).alias("edge_pos"), F.concat(F.lit("n"), "n").alias("source_id"), F.concat(F.lit("n"), ((F.col("n") * 7 + 3) % 25).cast("string")).alias("target_id"), F.lit("trades").alias("relation_type"))
    return down.unionByName(across)


EDGES = """e AS (SELECT CAST(n_nationkey * 2 AS INTEGER) AS edge_pos, 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'holds' AS relation_type FROM nation
UNION ALL SELECT CAST(n_nationkey * 2 + 1 AS INTEGER), 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), 'trades' FROM nation)"""


def bfs_sql(starts: str, depth: int, most: int) -> str:
    """CTEs of the visits of graph.traverse_all, level by level; the last is named v."""
    out = f"v0 AS (SELECT query_id, 0 AS depth, row_number() OVER (PARTITION BY query_id ORDER BY start_pos, id) AS visit, id, NULL AS parent_id, NULL::INTEGER AS edge_pos FROM {starts}), s0 AS (SELECT * FROM v0)"
    for k in range(1, depth + 1):
        out += f""", n{k} AS (SELECT query_id, count(*) AS c FROM s{k - 1} GROUP BY query_id), o{k} AS (SELECT * FROM (SELECT p.query_id, e.target_id AS id, p.id AS parent_id, p.visit AS ord, e.edge_pos, row_number() OVER (PARTITION BY p.query_id, e.target_id ORDER BY p.visit, e.edge_pos) AS n
FROM v{k - 1} p JOIN e ON e.source_id = p.id WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} x WHERE x.query_id = p.query_id AND x.id = e.target_id)) WHERE n = 1),
b{k} AS (SELECT query_id, ord, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o{k} GROUP BY query_id, ord),
v{k} AS (SELECT o.query_id, {k} AS depth, row_number() OVER (PARTITION BY o.query_id ORDER BY o.ord, o.edge_pos, o.id) + n.c AS visit, o.id, o.parent_id, o.edge_pos FROM o{k} o JOIN b{k} b USING (query_id, ord) JOIN n{k} n ON n.query_id = o.query_id WHERE b.before + n.c < {most} AND n.c < {most}),
s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM v{k})"""
    return out + f", v AS (SELECT * FROM s{depth})"


STARTS = "st AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 1 AS start_pos, 'r' || r_regionkey AS id FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 2, 'n' || r_regionkey FROM region)"


@query(f"WITH {EDGES}, {STARTS}, {bfs_sql('st', 3, 9)} SELECT query_id, CAST(depth AS INTEGER) AS depth, visit, id, parent_id, edge_pos FROM v")
def bfs_graph(spark, d):
    from skein.operators import graph as G

    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"))
    starts = r.select("query_id", F.lit(1).alias("start_pos"), F.concat(F.lit("r"), "query_id").alias("id")).unionByName(r.select("query_id", F.lit(2).alias("start_pos"), F.concat(F.lit("n"), "query_id").alias("id")))
    return G.traverse_all(edges(spark, d), starts, 3, 9)


@query("SELECT CAST(n_nationkey AS INTEGER) * 2 AS edge_pos, 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'holds' AS relation_type FROM nation WHERE n_regionkey = 1")
def graph_neighbours(spark, d):
    from skein.operators import graph as G

    return G.neighbours(edges(spark, d), "r1", "holds")


VERTICES = "x AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 'a nation' AS description FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'a region' FROM region)"


@query(f"""WITH {ASKS}, {EDGES}, {VERTICES}, nd AS (SELECT id, name || ' ' || description AS text FROM x), {near_sql('st0', 'f', 'nd', 2)}, st AS (SELECT query_id, rank AS start_pos, id FROM st0), {bfs_sql('st', 2, 10)},
g AS (SELECT v.query_id, v.visit, CASE WHEN v.depth = 0 THEN x.name || ': ' || x.description ELSE p.name || ' ' || e.relation_type || ' ' || x.name END AS line FROM v JOIN x ON x.id = v.id LEFT JOIN x p ON p.id = v.parent_id LEFT JOIN e ON e.edge_pos = v.edge_pos WHERE v.depth = 0 OR p.name IS NOT NULL),
b AS (SELECT query_id, string_agg(line, {NL} ORDER BY visit) AS context FROM g GROUP BY query_id) {prompt_sql('f', 'b', 'Answer from these facts of a graph.')}""")
def graph_rag(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("a nation").alias("description"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("a region").alias("description"))
    return P.graph_answers(few_queries(spark), n.unionByName(r), edges(spark, d))


def multimodal_sql(modality: str, only: str) -> str:
    def encoded(text, kind):
        noisy = f"list_transform(list_zip({emb(text)}, {emb(text, salt='image')}), lambda z: CAST(CAST(z[1] AS FLOAT) + CAST(z[2] AS FLOAT) * CAST(0.1 AS FLOAT) AS DOUBLE))"
        return f"CASE WHEN {kind} = 'image' THEN {noisy} ELSE {emb(text)} END"

    return f"""WITH {ASKS}, {CORPUS}, m AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'table' ELSE 'text' END AS modality FROM corpus), g AS (SELECT *, '{modality}' AS modality FROM f),
dv AS (SELECT *, {encoded('text', 'modality')} AS v FROM m WHERE {only}), qv AS (SELECT query_id, {encoded('query', 'modality')} AS v FROM g),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.query_id, doc_id, text, modality, {cosine_sql('q.v', 'dv.v')} AS score FROM qv q, dv)) WHERE rank <= 3),
b AS (SELECT query_id, string_agg(CASE WHEN modality = 'image' THEN '[IMAGE | ' || printf('%.3f', score) || '] (URL: https://images.example/' || doc_id || ')' || {NL} || 'Visual content: ' || text ELSE '[' || upper(modality) || ' | ' || printf('%.3f', score) || ']' || {NL} || text END, {NL} || {NL} ORDER BY rank) AS context FROM h GROUP BY query_id)
{prompt_sql('g', 'b', 'Answer from text, images and tables.')}"""


def media(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "table").otherwise("text")
    return corpus(spark, d).select("doc_id", F.col("text").alias("content"), kind.alias("modality"), F.create_map(F.lit("url"), F.concat(F.lit("https://images.example/"), "doc_id")).alias("metadata"))


@query(multimodal_sql("text", "true"))
def multimodal_rag(spark, d):
    return P.multimodal(few_queries(spark).withColumn("modality", F.lit("text")), media(spark, d))


@query(multimodal_sql("image", "modality = 'image'"))
def multimodal_images(spark, d):
    return P.multimodal(few_queries(spark).withColumn("modality", F.lit("image")), media(spark, d), only="image")


TASKS = [(1, "Report how the index grew"), (2, "Compare the competitor with our strategy"), (3, "Which market trends matter, in %?"), (4, "Calculate the growth and compare it")]
PLAN = """CASE {n} WHEN 1 THEN CASE WHEN t LIKE '%competitor%' OR t LIKE '%compare%' THEN ['retrieve', 'Q3 revenue operating margin'] WHEN t LIKE '%market%' OR t LIKE '%trend%' THEN ['web_search', 'market trends SaaS'] ELSE ['retrieve', query] END
WHEN 2 THEN CASE WHEN t LIKE '%competitor%' THEN ['web_search', 'competitor pricing revenue'] WHEN t LIKE '%calculate%' OR contains(t, '%') THEN ['calculate', '4.2 / 3.6 - 1'] ELSE ['FINISH', ''] END
ELSE CASE WHEN t LIKE '%strategy%' THEN ['retrieve', 'competitive strategy differentiation'] ELSE ['FINISH', ''] END END"""


@query(f"""WITH {CORPUS}, f AS (SELECT CAST(query_id AS BIGINT) AS query_id, query, lower(query) AS t FROM {values(TASKS, 'query_id, query')}), k AS (SELECT * FROM {values(FACTS, 'key_pos, key, value')}),
a AS (SELECT query_id AS task, query, s.n AS step, ({PLAN.format(n='s.n')}) AS call FROM f, (VALUES (1), (2), (3)) s(n)), c AS (SELECT *, task * 10 + step AS query_id, call[2] AS input FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.task = x.task AND y.step <= x.step AND y.call[1] = 'FINISH')),
cr AS (SELECT * FROM c WHERE call[1] = 'retrieve'), {hits_sql('h', 'cr', 'corpus', 2, 'input')}, b AS (SELECT query_id, string_agg('  - ' || text, {NL} ORDER BY rank) AS found FROM h GROUP BY query_id),
w AS (SELECT query_id, arg_min(value, key_pos) AS found FROM c, k WHERE call[1] = 'web_search' AND len(list_filter(string_split(key, ' '), lambda x: contains(lower(input), x))) > 0 GROUP BY query_id),
o AS (SELECT c.*, CASE call[1] WHEN 'retrieve' THEN 'Internal knowledge base results:' || {NL} || coalesce(b.found, '') WHEN 'web_search' THEN coalesce('Web search result: ' || w.found, 'Web search: No highly relevant results found.') ELSE 'Calculation result: 4.2 / 3.6 - 1 = 0.16666666666666674' END AS seen FROM c LEFT JOIN b USING (query_id) LEFT JOIN w USING (query_id)),
l AS (SELECT task, count(*) AS calls, string_agg('Step ' || step || ':' || {NL} || '  Action     : ' || call[1] || '(' || input || ')' || {NL} || '  Observation: ' || seen, {NL} ORDER BY step) AS trace FROM o GROUP BY task)
SELECT f.query_id, f.query, coalesce(trace, '') AS trace, coalesce(calls, 0) AS calls, '[Simulated Final Answer]' || {NL} || 'Task: ' || f.query || {NL} || 'Based on ' || coalesce(calls, 0) || ' tool calls, the agent has gathered all required information and synthesized a comprehensive response.' AS answer FROM f LEFT JOIN l ON l.task = f.query_id""")
def agentic_rag(spark, d):
    tasks = spark.createDataFrame(TASKS, "query_id long, query string")
    return P.agent(tasks, P.standard_tools(corpus(spark, d), facts(spark)))


# ---- hybrid retrieval: filter, two retrievers, fusion, floor, diversity, re-ranking


SCOPED = "(SELECT * FROM documents WHERE lang IN ('en', 'de', 'ru', 'zh') AND doc_id IS NOT NULL)"


@query(f"""WITH {bm_sql(SCOPED)}, sc AS (SELECT doc_id AS id, text FROM {SCOPED}), fq AS (SELECT query_id, query FROM {asked(None)}), {near_sql('dn', 'fq', 'sc', 50)},
sp AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 50), fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM dn UNION ALL SELECT * FROM sp) GROUP BY query_id, id),
ca AS (SELECT fu.query_id, fu.id, fu.score, {emb('sc.text')} AS v FROM fu JOIN sc USING (id) WHERE fu.score >= 0.01 AND sc.text IS NOT NULL), {mmr_sql('ca', 6)},
wd AS (SELECT p.query_id, q.query, p.id, p.score AS fused, p.pick, sc.text, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '{WS}+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(sc.text), '{WS}+'), lambda x: x <> '')) AS b FROM picks p JOIN fq q USING (query_id) JOIN sc USING (id)),
re AS (SELECT *, len(list_intersect(a, b)) / (len(a) + 1e-9) AS s FROM wd), ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM re)
SELECT query_id, query, CAST(rank AS INTEGER) AS rank, id, round(fused, 9) AS fused, CAST(pick AS INTEGER) AS mmr_rank, round(s, 6) AS score, text FROM ra WHERE rank <= 3""")
def hybrid_pipeline(spark, d):
    docs = documents(spark, d).where("doc_id is not null")
    rows = P.hybrid(docs, asked(spark), {"lang": {"$in": ["en", "de", "ru", "zh"]}}, k=3, floor=0.01, diverse=6, scorer=models.pair_scorer(models.shared_words))
    return rows.withColumn("fused", F.round("fused", 9)).withColumn("score", F.round("score", 6))


@query(f"""WITH {ASKS}, it AS (SELECT CAST(id AS BIGINT) AS id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), {near_sql('ne', 'f', 'it', 8)}, ca AS (SELECT query_id, id, score, {emb('text')} AS v FROM ne), {mmr_sql('ca', 4)}
SELECT query_id, CAST(pick AS INTEGER) AS rank, id, round(score, 6) AS score, round(red, 6) AS redundancy, round(value, 6) AS mmr_score FROM picks""")
def mmr_batch(spark, d):
    near = K.nearest(few_queries(spark), corpus(spark, d), 8, ident="doc_id")
    rows = K.mmr_batch(near.withColumn("vector", P.pseudo_embedding(F.col("text"))), 4)
    return rows.select("query_id", "rank", "id", *[F.round(c, 6).alias(c) for c in ("score", "redundancy", "mmr_score")])


# ---- expanded retrieval

LONG = f"lo AS (SELECT doc_id, i AS pos, s[i + 1] AS text FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, list_filter(s, lambda x: length(x) > 10) AS s FROM ({SENTS}))))"
AROUND = "string_agg(lo.text, ' ' ORDER BY lo.pos)"


def windows_found(spark, d, width=2):
    sents = C.sentence_index(documents(spark, d), "doc_id", "text")
    return K.sentence_window_retrieve(few_queries(spark), sents, "doc_id", width, 3)


WINDOWS = f"it AS (SELECT {{'doc': doc_id, 'pos': pos}} AS id, text FROM lo), {near_sql('ne', 'f', 'it', 3)}, wi AS (SELECT ne.query_id, ne.rank, ne.id.doc AS doc_id, ne.id.pos AS hit, ne.score, ne.text AS sentence, {AROUND} AS context FROM ne JOIN lo ON lo.doc_id = ne.id.doc AND lo.pos BETWEEN ne.id.pos - 2 AND ne.id.pos + 2 GROUP BY ALL)"


@query(f"WITH {ASKS}, {LONG}, {WINDOWS} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(hit AS INTEGER) AS hit, round(score, 6) AS score, sentence, context FROM wi")
def sentence_window_retrieve(spark, d):
    return windows_found(spark, d).withColumn("score", F.round("score", 6))


PARTS = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '([.!?]){WS}+', '\\1' || chr(1) || '|' || chr(2), 'g'), chr(1) || '|' || chr(2)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"
COMPRESSED = f"""{near_sql('nc', 'f', 'cit', 3)}, cs AS (SELECT query_id, id, rank, score, text, {PARTS} AS s FROM nc), cx AS (SELECT query_id, id, i AS pos, s[i + 1] AS sentence FROM (SELECT query_id, id, s, unnest(range(0, len(s))) AS i FROM cs)),
cq AS (SELECT cx.*, {cosine_sql('q.v', emb('sentence'))} AS sim FROM cx JOIN (SELECT query_id, {emb('query')} AS v FROM f) q USING (query_id)), ck AS (SELECT query_id, id, string_agg(sentence, ' ' ORDER BY pos) AS short FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY sim DESC, pos) AS n FROM cq) WHERE n <= 2 GROUP BY query_id, id),
co AS (SELECT cs.query_id, cs.rank, cs.id, cs.score, cs.text, CASE WHEN len(cs.s) <= 2 THEN cs.text ELSE ck.short END AS context FROM cs LEFT JOIN ck USING (query_id, id))"""
CHUNKS = "cit AS (SELECT CAST(id AS BIGINT) AS id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id)"


@query(f"WITH {ASKS}, {CHUNKS}, {COMPRESSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, text, context FROM co")
def contextual_compression(spark, d):
    return K.compress(few_queries(spark), corpus(spark, d), 3, 2, ident="doc_id").withColumn("score", F.round("score", 6))


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> ''))"


@query(f"""WITH {ASKS}, {LONG}, {WINDOWS}, {CHUNKS}, {COMPRESSED}, un AS (SELECT 'sentence_window' AS strategy, query_id, sentence AS indexed_text, context FROM wi WHERE rank = 1 UNION ALL SELECT 'compression', query_id, text, context FROM co WHERE rank = 1
UNION ALL SELECT 'sentence_window_1', ne.query_id, ne.text, {AROUND} FROM ne JOIN lo ON lo.doc_id = ne.id.doc AND lo.pos BETWEEN ne.id.pos - 1 AND ne.id.pos + 1 WHERE ne.rank = 1 GROUP BY ALL)
SELECT strategy, query_id, CAST({words_sql('indexed_text')} AS INTEGER) AS indexed, CAST({words_sql('context')} AS INTEGER) AS returned, round({words_sql('context')} / CAST({words_sql('indexed_text')} AS DOUBLE), 6) AS expansion FROM un""")
def compare_strategies(spark, d):
    short = K.compress(few_queries(spark), corpus(spark, d), 3, 2, ident="doc_id").withColumn("indexed_text", F.col("text"))
    named = {"sentence_window_1": windows_found(spark, d, 1).withColumnRenamed("sentence", "indexed_text"), "sentence_window": windows_found(spark, d).withColumnRenamed("sentence", "indexed_text"), "compression": short}
    return K.compare_strategies(named).withColumn("expansion", F.round("expansion", 6))


# ---- encoders


@query(f"SELECT id, list_transform({emb('text')}, lambda x: round(x, 4)) AS embedding FROM chunks WHERE text IS NOT NULL")
def batch_embeddings(spark, d):
    encoder = models.batch_encoder(models.digest_vectors)
    return table(spark, d, "chunks").where("text is not null").select("id", F.transform(encoder(F.col("text")), lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query(f"""WITH {ASKS}, {CORPUS}, u AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, q.query_id, d.doc_id AS id, {cosine_sql('q.v', 'd.v')} AS score FROM (SELECT query_id, {emb(f"'{a}' || query", salt=s)} AS v FROM f) q, (SELECT doc_id, {emb(f"'{b}' || text", salt=s)} AS v FROM corpus) d" for m, s, a, b in (("plain", "", "", ""), ("prefixed", "other", "query: ", "passage: ")))})
SELECT model, query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM u""")
def compare_models(spark, d):
    encoders = {"plain": P.pseudo_embedding, "prefixed": lambda text: P.pseudo_embedding(text, salt="other")}
    return K.compare_models(few_queries(spark), corpus(spark, d), "doc_id", "text", encoders, {"prefixed": ("query: ", "passage: ")}).withColumn("score", F.round("score", 6))


PAIRED = "pa AS (SELECT x.doc_id AS id, x.text AS a, y.text AS b, CASE WHEN x.doc_id % 4 = 0 THEN 0.2 ELSE 0.0 END AS expected FROM corpus x JOIN corpus y ON y.doc_id = x.doc_id + 1)"


@query(f"""WITH {CORPUS}, {PAIRED}, s AS (SELECT id, expected, {cosine_sql(emb('a'), emb('b'))} AS sim FROM pa) SELECT id, round(sim, 6) AS similarity, round(sim - expected, 6) AS gap, abs(sim - expected) > 0.3 AS bad FROM s""")
def evaluate_pairs(spark, d):
    c = corpus(spark, d)
    after = c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    pairs = c.join(after, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("a"), "b", F.when(F.col("doc_id") % 4 == 0, 0.2).otherwise(0.0).alias("expected"))
    return K.evaluate_pairs(pairs, P.pseudo_embedding).select("id", F.round("similarity", 6).alias("similarity"), F.round("gap", 6).alias("gap"), "bad")


@query(f"""WITH {CORPUS}, s AS (SELECT x.doc_id AS id, {cosine_sql(emb('x.text'), emb('y.text'))} AS near, {cosine_sql(emb('x.text'), emb('z.text'))} AS far FROM corpus x JOIN corpus y ON y.doc_id = x.doc_id + 1 JOIN corpus z ON z.doc_id = x.doc_id + 2) SELECT id, round(near, 6) AS near, round(far, 6) AS far, round(near - far, 6) AS gap, NOT near - far > 0.2 AS drifting FROM s""")
def embedding_drift(spark, d):
    c = corpus(spark, d).select("doc_id", F.col("text").alias("term"))
    near, far = (c.select((F.col("doc_id") - k).alias("doc_id"), F.col("term").alias(name)) for k, name in ((1, "related"), (2, "unrelated")))
    rows = K.drift(c.join(near, "doc_id").join(far, "doc_id"), P.pseudo_embedding)
    return rows.select(F.col("doc_id").alias("id"), *[F.round(x, 6).alias(x) for x in ("near", "far", "gap")], "drifting")
