"""Queries of the library over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import estimates, models, routing
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import chunking as C
from skein.operators import graph as G
from skein.operators import ranking as K
from skein.operators import retrieval as R
from skein.operators import semantic as S
from skein.plans import patterns as P
from skein.sources import files
from skein.plans.layout import numbered, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = T.SPACE


def trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def vector_of(spark: SparkSession, d: str, ident: int = 0):
    """One stored vector, of fixed length, as the literal of a single query."""
    return table(spark, d, "embeddings").where(F.col("vec_id") == ident).select("embedding").first()[0]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents for stages that cost much a row: spread over the cores where they lie in fewer files."""
    return spread(table(spark, d, "documents"), "doc_id")


def r6(name: str):
    return F.round(name, 6).alias(name)


E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0)"

NL = "chr(10)"


def emb(text: str, dim: int = 64, salt: str = "") -> str:
    """The pseudo-embedding of functions.vectors in SQL."""
    def part(k):
        return f"(CAST('0x' || substr(h, {k}, 12) AS UBIGINT) + 0.5) / 281474976710656.0"

    return f"list_transform(list_transform(range(0, {dim}), lambda i: md5(md5({text}) || '|{salt}|' || i)), lambda h: CAST(CAST(sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(13)}) AS FLOAT) AS DOUBLE))"


def cosine_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def near_sql(name: str, rows: str, items: str, k: int) -> str:
    """A CTE of the k items (id, text) nearest to each row (query_id, query), as ranking.nearest."""
    pairs = f"SELECT q.query_id, d.id, d.text, {cosine_sql('q.v', 'd.v')} AS score FROM (SELECT query_id, {emb('query')} AS v FROM {rows}) q, (SELECT id, text, {emb('text')} AS v FROM {items} WHERE text IS NOT NULL) d"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({pairs})) WHERE rank <= {k})"


def mmr_sql(rows: str, k: int, balance: float = 0.7) -> str:
    """CTEs of MMR over rows (query_id, id, score, v): the picks as (query_id, id, score, red, value, n), the last named picks."""
    first = f"m1 AS (SELECT *, 0.0::DOUBLE AS red FROM {rows})"
    pick = "p{k} AS (SELECT * FROM (SELECT *, {b} * score - {r} * red AS value, row_number() OVER (PARTITION BY query_id ORDER BY round({b} * score - {r} * red, 12) DESC, id) AS n FROM m{k}) WHERE n = 1)"
    out = [first, pick.format(k=1, b=balance, r=round(1 - balance, 6))]
    for j in range(2, k + 1):
        near = cosine_sql("m.v", "p.v")
        red = near if j == 2 else f"greatest(m.red, {near})"
        out.append(f"m{j} AS (SELECT m.query_id, m.id, m.score, m.v, {red} AS red FROM m{j - 1} m JOIN p{j - 1} p USING (query_id) WHERE m.id <> p.id)")
        out.append(pick.format(k=j, b=balance, r=round(1 - balance, 6)))
    return ", ".join(out) + ", picks AS (" + " UNION ALL ".join(f"SELECT query_id, id, score, red, value, {j} AS pick FROM p{j}" for j in range(1, k + 1)) + ")"


# ---- filters and top-k


@query(f"""WITH {Q0}, s AS (SELECT vec_id, label, list_cosine_similarity(v, qv) AS score FROM ({E}), q WHERE label IN (1, 3, 5))
SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""")
def topk_filtered(spark, d):
    rows = R.metadata_filter(table(spark, d, "embeddings"), {"label": {"$in": [1, 3, 5]}})
    return R.top_k(rows, V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))), "vec_id", 10).select("rank", "vec_id", "label", r6("score"))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, list_cosine_similarity(v, qv) AS score FROM ({E}), q)
SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 5""")
def topk_cosine(spark, d):
    return R.top_k(table(spark, d, "embeddings"), V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))), "vec_id", 5).select("rank", "vec_id", r6("score"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS score FROM ({E}) e, ({E} WHERE vec_id % 50 = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 3""")
def topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    return R.top_k_batch(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 3).select("query_id", "rank", "id", r6("score"))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, list_cosine_similarity(v, qv) AS score FROM ({E}), q)
SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s WHERE score >= 0.25 ORDER BY s.score DESC, vec_id LIMIT 5""")
def threshold_topk(spark, d):
    return R.top_k(table(spark, d, "embeddings"), V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))), "vec_id", 5, 0.25).select("rank", "vec_id", r6("score"))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, list_cosine_similarity(v, qv) AS score FROM ({E}), q),
g AS (SELECT vec_id, score, row_number() OVER w AS rank, lag(score) OVER w - score AS gap FROM s WINDOW w AS (ORDER BY score DESC, vec_id))
SELECT vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, round(gap, 6) AS gap, coalesce(gap > 0.08, false) AS marked FROM g""")
def score_distribution(spark, d):
    return R.score_distribution(table(spark, d, "embeddings"), V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))), "vec_id").select("vec_id", r6("score"), "rank", r6("gap"), "marked")


@query(f"""WITH {Q0}, s AS (SELECT list_cosine_similarity(v, qv) AS score FROM ({E}), q)
SELECT count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS greatest, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, count(*) FILTER (score < 0.1) AS rejected FROM s""")
def score_summary(spark, d):
    return R.score_summary(table(spark, d, "embeddings"), V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))), 0.1).select("n", *map(r6, ("least", "greatest", "mean", "deviation")), "rejected")


@query("""SELECT id, topic, source, year, difficulty, language FROM chunks
WHERE topic IS NOT DISTINCT FROM 'retrieval' AND source IN ('rag_guide', 'ml_handbook') AND year >= 2021 AND year <= 2024 AND difficulty IS DISTINCT FROM 'advanced' AND (language IS NULL OR language NOT IN ('de', 'fr'))""")
def filter_ops(spark, d):
    want = {"topic": "retrieval", "source": {"$in": ["rag_guide", "ml_handbook"]}, "year": {"$gte": 2021, "$lte": 2024}, "difficulty": {"$ne": "advanced"}, "language": {"$nin": ["de", "fr"]}}
    return R.metadata_filter(table(spark, d, "chunks").select("id", "topic", "source", "year", "difficulty", "language"), want)


@query("""SELECT id, topic, year FROM chunks WHERE (topic IS NOT DISTINCT FROM 'embeddings' OR year > 2023) AND contains(lower(text), 'index')""")
def filter_or_contains(spark, d):
    return R.metadata_filter(table(spark, d, "chunks"), {"$or": [{"topic": "embeddings"}, {"year": {"$gt": 2023}}], "text": {"$contains": "Index"}}).select("id", "topic", "year")


@query("SELECT id, topic, year, language FROM chunks WHERE year >= 2021 AND year < 2024 AND language IS NOT DISTINCT FROM 'de'")
def implied_filter(spark, d):
    want = R.implied_filter("German notes on retrieval since 2021 but before 2024", values={"language": {"german": "de", "french": "fr"}})
    return R.metadata_filter(table(spark, d, "chunks"), want).select("id", "topic", "year", "language")


# ---- vectors


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM ({E} WHERE vec_id % 50 = 0) a, ({E}) b WHERE a.vec_id <> b.vec_id""")
def similarity_matrix(spark, d):
    e = table(spark, d, "embeddings")
    pairs = R.in_blocks(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "vec_id", "embedding")
    return pairs.where("query_id <> id").select(F.col("query_id").alias("id_a"), F.col("id").alias("id_b"), F.round("score", 6).alias("sim"))


@query(f"""WITH {Q0} SELECT vec_id, round(list_inner_product(v, qv), 6) AS dot, round(list_distance(v, qv), 5) AS l2, round(1 / (1 + list_distance(v, qv)), 6) AS l2_similarity,
round(list_cosine_similarity(v, qv), 6) AS cosine, abs(list_distance(v, qv) ** 2 - (2 - 2 * list_cosine_similarity(v, qv))) < 1e-4 AS consistent FROM ({E}), q""")
def metrics_all(spark, d):
    v, q = F.col("embedding"), R.literal_vector(vector_of(spark, d))
    l2, cos = V.l2_distance(v, q), V.cosine(v, q)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(v, q), 6).alias("dot"), F.round(l2, 5).alias("l2"), F.round(1 / (1 + l2), 6).alias("l2_similarity"), F.round(cos, 6).alias("cosine"), (F.abs(l2 * l2 - (2 - 2 * cos)) < 1e-4).alias("consistent"))


@query(f"""SELECT vec_id, round(list_min(v), 6) AS least, round(list_max(v), 6) AS greatest, round(list_avg(v), 6) AS mean, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[8], 6) AS eighth,
round(sqrt(list_inner_product(w, w)), 6) AS scaled_norm FROM (SELECT vec_id, v, list_transform(v, lambda x: x * 3) AS w FROM ({E}))""")
def vector_statistics(spark, d):
    v = F.col("embedding")
    s = V.statistics(v)
    return table(spark, d, "embeddings").select("vec_id", *[F.round(s[k], 6).alias(k) for k in ("least", "greatest", "mean", "norm")], F.round(F.get(s["head"], F.lit(7)).cast("double"), 6).alias("eighth"), F.round(V.norm(V.scale(v, 3.0)), 6).alias("scaled_norm"))


@query("""SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS unit, round(list_inner_product(u, u) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(u, u)) + 1e-9), 6) AS self_cosine
FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def normalised(spark, d):
    u = V.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(u), 6).alias("unit"), F.round(V.cosine_eps(V.normalize_eps(F.col("embedding")), u), 6).alias("self_cosine"))


@query(f"SELECT id, list_transform({emb('text')}, lambda x: round(x, 4)) AS embedding FROM chunks WHERE text IS NOT NULL")
def pseudo_embeddings(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("id", F.transform(V.pseudo_embedding(F.col("text")), lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("""SELECT source, count(*) AS documents, round(count(*) * 400.0 / 1e6 * 0.02, 6) AS cost, round(count(*) * 384 * 4 / 1048576.0, 6) AS mib, round(count(*) * CAST(7.432 AS DOUBLE), 6) AS ms FROM documents GROUP BY source""")
def estimate_costs(spark, d):
    n = F.col("documents")
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return rows.select("source", "documents", F.round(estimates.cost(n, F.lit(400.0), F.lit(0.02)), 6).alias("cost"), F.round(estimates.storage_mib(n, F.lit(384)), 6).alias("mib"), F.round(estimates.latency(F.lit(7.432), n), 6).alias("ms"))


# ---- sources


@query(f"""SELECT CAST(id AS INTEGER) AS id, {trim("regexp_extract(coalesce(topic, ''), '^[^:' || chr(10) || ']*')")} AS topic, {trim("regexp_extract(replace(text, '---', '- -'), '^[^' || chr(10) || ']*')")} AS text FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL""")
def record_source(spark, d):
    # every record written as a block of a record file, and read again
    safe = F.replace("text", F.lit("---"), F.lit("- -"))
    block = F.concat(F.lit("# head\n---\nCHUNK_ID: "), F.col("id").cast("string"), F.lit("\nTOPIC: "), F.coalesce("topic", F.lit("")), F.lit("\nTEXT: "), safe, F.lit("\n---\n"))
    return files.records(table(spark, d, "chunks").where("text is not null and id is not null").select(block.alias("text")))


# ---- chunkers

FIXED = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, substring(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text, CAST(i * {step} AS INTEGER) AS start_pos, CAST(least(i * {step} + {size}, length(text)) AS INTEGER) AS end_pos FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {step}.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"
MARK = "chr(1) || '|' || chr(2)"
SENTS = f"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({trim('text')}, '([.!?]){WS}+', '\\1' || {MARK}, 'g'), {MARK}), lambda s: {trim('s')}), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL"


@query(FIXED.format(step=250, size=300))
def fixed_chunks(spark, d):
    return C.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 300, 50)


@query(FIXED.format(step=150, size=300))
def sliding_chunks(spark, d):
    return C.sliding_chunks(table(spark, d, "documents"), "doc_id", "text", 300, 150)


@query(f"""SELECT doc_id, count(*) AS chunks, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, round(avg(length(text)), 6) AS mean FROM ({FIXED.format(step=250, size=300)}) GROUP BY doc_id""")
def chunk_stats(spark, d):
    return C.chunk_stats(fixed_chunks(spark, d), "doc_id")


@query(f"""SELECT doc_id, round(avg(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> ''))), 6) AS mean_words FROM ({FIXED.format(step=250, size=300)}) GROUP BY doc_id""")
def chunk_words(spark, d):
    return C.mean_words(fixed_chunks(spark, d), "doc_id")


@query("""SELECT doc_id, CAST(stride AS INTEGER) AS stride, CAST(ceil(length(text) / CAST(stride AS DOUBLE)) AS BIGINT) AS chunks FROM documents, (VALUES (30), (60), (150), (210), (270), (300)) v(stride) WHERE text IS NOT NULL""")
def stride_sweep(spark, d):
    return C.stride_sweep(table(spark, d, "documents"), "doc_id", "text", (30, 60, 150, 210, 270, 300))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM ({SENTS}))""")
def sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"""SELECT doc_id, 'sent_' || i AS chunk_id, CAST(i AS INTEGER) AS pos, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, list_filter(s, lambda x: length(x) > 10) AS s FROM ({SENTS})))""")
def sentence_index(spark, d):
    return C.sentence_index(documents(spark, d), "doc_id", "text")


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, array_to_string(s[i + 1:i + 3], ' ') AS text, CAST(i AS INTEGER) AS first_sent, CAST(least(i + 3, len(s)) - 1 AS INTEGER) AS last_sent FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM ({SENTS}))""")
def sentence_windows(spark, d):
    return C.sentence_windows(documents(spark, d), "doc_id", "text", 3, 1, offsets=False)


@query(f"""WITH RECURSIVE b AS (SELECT s.doc_id, d.text, s.s FROM ({SENTS}) s JOIN documents d USING (doc_id) WHERE len(s.s) > 0),
r(doc_id, i, start_pos, end_pos) AS (SELECT doc_id, 1, strpos(text, s[1]) - 1, strpos(text, s[1]) - 1 + length(s[1]) FROM b
UNION ALL SELECT r.doc_id, r.i + 1, f.p, f.p + length(b.s[r.i + 1]) FROM r JOIN b USING (doc_id), LATERAL (SELECT r.end_pos + greatest(strpos(substring(b.text, CAST(r.end_pos + 1 AS BIGINT)), b.s[r.i + 1]) - 1, 0) AS p) f WHERE r.i < len(b.s))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos FROM r""")
def sentence_offsets(spark, d):
    return C.sentence_windows(documents(spark, d), "doc_id", "text", 1, 1).select("doc_id", "chunk_id", "start_pos", "end_pos")


@query(f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)""")
def word_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CAST(i * 40 AS INTEGER) AS first_word, array_to_string(w[i * 40 + 1:i * 40 + 50], ' ') AS text FROM
(SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 40.0) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))""")
def token_chunks(spark, d):
    return C.token_chunks(table(spark, d, "documents"), "doc_id", "text", 50, 10).withColumn("first_word", F.col("first_word").cast("int"))


@query(f"""SELECT doc_id, 'Summary: ' || CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') || '... [truncated]' ELSE text END AS summary FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)""")
def summarize(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, p[i + 1] AS paragraph FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {trim('s')}), lambda s: s <> '') AS p FROM documents WHERE text IS NOT NULL))""")
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(f"""WITH c AS ({FIXED.format(step=250, size=300)}), p AS (SELECT doc_id, chunk_id, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS b FROM c)
SELECT doc_id, chunk_id, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS INTEGER) AS shared FROM p WHERE b IS NOT NULL""")
def chunk_overlaps(spark, d):
    return C.shared_ends(fixed_chunks(spark, d), "doc_id")


@query(f"""WITH c AS ({FIXED.format(step=250, size=300)}), t AS (SELECT doc_id, chunk_id, {trim('text')} AS b FROM c) SELECT doc_id, chunk_id, regexp_matches(b, '^[\\p{{Lu}}"''\\-]') AS starts_clean, regexp_matches(b, '[.!?:,]$') AS ends_clean FROM t""")
def boundary_check(spark, d):
    return C.boundary_check(fixed_chunks(spark, d), "doc_id", "chunk_id")


PARENTS = f"SELECT doc_id, i AS parent_no, 'p' || i AS parent_id, t AS text FROM (SELECT *, min(CASE WHEN t = '' THEN i END) OVER (PARTITION BY doc_id) AS blank FROM (SELECT doc_id, i, {trim('substring(text, CAST(i * 512 + 1 AS BIGINT), 512)')} AS t FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0))) WHERE blank IS NULL OR i < blank"


@query(f"""SELECT doc_id, CAST(parent_no AS INTEGER) AS parent_no, parent_id, CAST(j AS INTEGER) AS child_no, parent_id || '_c' || j AS chunk_id, c[j + 1] AS text FROM (SELECT doc_id, parent_no, parent_id, c, unnest(range(0, len(c))) AS j FROM
(SELECT doc_id, parent_no, parent_id, list_filter(list_transform(range(0, CAST(ceil(length(text) / 128.0) AS BIGINT)), lambda k: {trim('substring(text, CAST(k * 128 + 1 AS BIGINT), 128)')}), lambda s: s <> '') AS c FROM ({PARENTS})))""")
def parent_child_index(spark, d):
    return C.parent_child(table(spark, d, "documents"), "doc_id", "text")[1]


@query()
def recursive_chunks(spark, d):
    return C.recursive_chunks(documents(spark, d), "doc_id", "text", 500, 50)


TOKENS = f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CAST(i * 40 AS INTEGER) AS first_word, array_to_string(w[i * 40 + 1:i * 40 + 50], ' ') AS text FROM
(SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 40.0) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))"""


@query(f"""WITH c AS (SELECT 'fixed' AS chunker, text FROM ({FIXED.format(step=450, size=500)}) UNION ALL SELECT 'sliding', text FROM ({FIXED.format(step=150, size=300)}) UNION ALL SELECT 'words', text FROM ({TOKENS}))
SELECT chunker, count(*) AS chunks, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, round(avg(length(text)), 6) AS mean FROM c GROUP BY chunker""")
def compare_chunkers(spark, d):
    docs = table(spark, d, "documents")
    return C.compare_chunkers({"fixed": C.fixed_chunks(docs, "doc_id", "text", 500, 50), "sliding": C.sliding_chunks(docs, "doc_id", "text", 300, 150), "words": C.token_chunks(docs, "doc_id", "text", 50, 10)})


#: The sections of Markdown texts: headings and the bodies between them by one pattern, and the path of each heading.
HEAD = f"(?m)^#{{1,6}}{WS}+[^\n]+$"
MARKDOWN = f"""md0 AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{HEAD}'), lambda h: {{'level': length(regexp_extract(h, '^#+')), 'heading': {trim("regexp_replace(h, '^#+', '')")}}}) AS h, string_split_regex(text, '{HEAD}') AS b FROM documents WHERE text IS NOT NULL),
md1 AS (SELECT doc_id, h, b, unnest(range(0, len(h) + 1)) AS k FROM md0),
md2 AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 0 ELSE h[k].level END AS heading_level, CASE WHEN k > 0 THEN h[k].heading WHEN len(h) > 0 THEN 'Preamble' ELSE 'Document' END AS heading, {trim("b[k + 1]")} AS body,
array_to_string(list_transform(list_filter(range(1, k + 1), lambda j: j = k OR h[j].level < list_min(list_transform(range(j + 1, k + 1), lambda i: h[i].level))), lambda j: h[j].heading), ' > ') AS path FROM md1),
md AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_id, CASE WHEN k = 0 THEN body ELSE {trim("repeat('#', CAST(heading_level AS BIGINT)) || ' ' || heading || chr(10) || chr(10) || body")} END AS text, heading, CAST(heading_level AS INTEGER) AS heading_level, CASE WHEN k = 0 THEN heading ELSE path END AS heading_path
FROM md2 WHERE k > 0 OR body <> '')"""


@query(f"WITH {MARKDOWN} SELECT *, false AS is_split FROM md")
def markdown_chunks(spark, d):
    return C.markdown_chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def html_chunks(spark, d):
    # the corpus has no HTML: every text becomes a page of headings and paragraphs first
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<html><body>"), F.regexp_replace(F.regexp_replace(safe, r"(?m)^(#{1,4}) (.+)$", "<h2>$2</h2>"), "\n\n", "<p>"), F.lit("</body></html>"))
    return C.html_chunks(documents(spark, d).select("doc_id", page.alias("html")), "doc_id", "html")


@query(f"WITH {MARKDOWN} SELECT doc_id, chunk_id, repeat('  ', CAST(greatest(0, heading_level - 1) AS BIGINT)) || heading AS line FROM md")
def document_outline(spark, d):
    return C.outline(C.markdown_chunks(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {MARKDOWN} SELECT doc_id, chunk_id, heading_path FROM md WHERE contains(lower(heading_path), 'index')")
def under_heading(spark, d):
    return C.under_heading(C.markdown_chunks(table(spark, d, "documents"), "doc_id", "text"), "Index").select("doc_id", "chunk_id", "heading_path")


@query(f"""WITH {MARKDOWN}, sc AS (SELECT doc_id || '/' || chunk_id AS section, heading_path, list_filter(list_transform(string_split(regexp_replace({trim('text')}, '([.!?]){WS}+', '\\1' || {MARK}, 'g'), {MARK}), lambda s: {trim('s')}), lambda s: length(s) > 10) AS s FROM md),
se AS (SELECT section, CAST(i AS INTEGER) AS pos, s[i + 1] AS t FROM (SELECT section, s, unnest(range(0, len(s))) AS i FROM sc)), ve AS (SELECT section, pos, t, {emb('t')} AS v FROM se), s AS (SELECT section, pos, t, {cosine_sql('v', 'lead(v) OVER w')} AS sim FROM ve WINDOW w AS (PARTITION BY section ORDER BY pos)),
b AS (SELECT *, coalesce(sim <= quantile_cont(sim, 0.25) OVER (PARTITION BY section), false) AS cut FROM s), g AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id FROM b)
SELECT section, CAST(chunk_id AS INTEGER) AS chunk_id, string_agg(t, ' ' ORDER BY pos) AS text, min(pos) AS first_sent, max(pos) AS last_sent, any_value(heading_path) AS heading_path FROM g JOIN sc USING (section) GROUP BY section, chunk_id""")
def structure_then_semantic(spark, d):
    parts = C.markdown_chunks(documents(spark, d), "doc_id", "text").select(F.concat_ws("/", "doc_id", "chunk_id").alias("section"), "heading_path", "text")
    sents = parts.select("section", F.posexplode(T.sentences(F.col("text"), 10)).alias("pos", "sentence")).withColumn("embedding", V.pseudo_embedding(F.col("sentence")))
    return S.by_percentile(sents, "section").join(parts.select("section", "heading_path"), "section").drop("avg_similarity")


# ---- semantic chunks: vectors of a label stand for the sentences of a document


def label_sentences(spark, d):
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").select("label", pos.alias("pos"), F.concat(F.lit("s"), F.col("vec_id")).alias("sentence"), "embedding")


SIMS = "s AS (SELECT label, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, 's' || vec_id AS t, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER w AS DOUBLE[])) AS sim FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"
GROUPED = """g AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id FROM b)
SELECT label, CAST(chunk_id AS INTEGER) AS chunk_id, string_agg(t, ' ' ORDER BY pos) AS text, min(pos) AS first_sent, max(pos) AS last_sent, round(CASE WHEN min(pos) = max(pos) THEN 1.0 ELSE coalesce(avg(CASE WHEN NOT cut THEN sim END), 1.0) END, 6) AS avg_similarity FROM g GROUP BY label, chunk_id"""


@query(f"WITH {SIMS}, b AS (SELECT *, coalesce(sim < 0.05, false) AS cut FROM s), {GROUPED}")
def semantic_threshold(spark, d):
    return S.by_threshold(label_sentences(spark, d), "label", 0.05).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query(f"WITH {SIMS}, b AS (SELECT *, coalesce(sim <= quantile_cont(sim, 0.25) OVER (PARTITION BY label), false) AS cut FROM s), {GROUPED}")
def semantic_percentile(spark, d):
    return S.by_percentile(label_sentences(spark, d), "label", 25.0).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query(f"WITH {SIMS} SELECT label, CAST(arg_min(pos, sim) AS INTEGER) AS shift_pos, round(min(sim), 6) AS sim FROM s GROUP BY label")
def clearest_shift(spark, d):
    return S.clearest_shift(label_sentences(spark, d), "label").withColumn("sim", F.round("sim", 6))


@query(f"WITH {SIMS} SELECT label, pos, round(sim, 6) AS sim, CASE WHEN sim < 0.5 THEN 'SPLIT' ELSE '' END AS mark FROM s WHERE sim IS NOT NULL")
def similarity_listing(spark, d):
    return S.listing(label_sentences(spark, d), "label").withColumn("sim", F.round("sim", 6))


# ---- ranking


@query(f"""WITH {Q0}, s AS (SELECT vec_id AS id, v, list_cosine_similarity(v, qv) AS score FROM ({E}), q),
p1 AS (SELECT * FROM s ORDER BY 0.7 * score DESC, id LIMIT 1),
c2 AS (SELECT s.id, s.v, s.score, list_cosine_similarity(s.v, p1.v) AS red FROM s, p1 WHERE s.id <> p1.id), p2 AS (SELECT * FROM c2 ORDER BY 0.7 * score - 0.3 * red DESC, id LIMIT 1),
c3 AS (SELECT c2.id, c2.score, greatest(c2.red, list_cosine_similarity(c2.v, p2.v)) AS red FROM c2, p2 WHERE c2.id <> p2.id), p3 AS (SELECT * FROM c3 ORDER BY 0.7 * score - 0.3 * red DESC, id LIMIT 1)
SELECT 1 AS rank, id, round(score, 6) AS score, 0.0::DOUBLE AS redundancy, round(0.7 * score, 6) AS mmr_score FROM p1 UNION ALL SELECT 2, id, round(score, 6), round(red, 6), round(0.7 * score - 0.3 * red, 6) FROM p2 UNION ALL SELECT 3, id, round(score, 6), round(red, 6), round(0.7 * score - 0.3 * red, 6) FROM p3""")
def mmr(spark, d):
    return K.mmr(table(spark, d, "embeddings"), "vec_id", "embedding", vector_of(spark, d), 3).select("rank", "id", *map(r6, ("score", "redundancy", "mmr_score")))


@query(f"""WITH {Q0}, ca AS (SELECT 1 AS query_id, vec_id AS id, list_cosine_similarity(v, qv) AS score, v FROM ({E}), q), {mmr_sql('ca', 5)}, tk AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ca ORDER BY ca.score DESC, id LIMIT 5),
j AS (SELECT CAST(t.rank AS INTEGER) AS rank, t.id AS topk_id, p.id AS mmr_id, p.id IN (SELECT id FROM tk) AS shared FROM tk t JOIN picks p ON p.pick = t.rank) SELECT *, CAST(count(*) FILTER (shared) OVER () AS INTEGER) AS n_shared FROM j""")
def compare_topk_mmr(spark, d):
    return K.compare_with_mmr(table(spark, d, "embeddings"), "vec_id", "embedding", vector_of(spark, d), 5)


def token_frames(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("doc_id"), F.floor(F.col("vec_id") / 20).alias("pos"), "embedding", "vec_id")
    return rows.where("vec_id % 50 = 0").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("pos"), "embedding"), rows


MAXSIM = f"b AS (SELECT d.vec_id % 20 AS doc_id, q.vec_id AS query_pos, max(list_cosine_similarity(q.v, d.v)) AS best, arg_max(d.vec_id // 20, list_cosine_similarity(q.v, d.v)) AS doc_pos FROM ({E} WHERE vec_id % 50 = 0) q, ({E}) d GROUP BY 1, 2)"


@query(f"WITH {MAXSIM} SELECT 0 AS query_id, doc_id, round(sum(best), 6) AS score FROM b GROUP BY doc_id")
def maxsim(spark, d):
    q, rows = token_frames(spark, d)
    return K.maxsim(q, rows, "query_id", "doc_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"""WITH {MAXSIM}, mm AS (SELECT doc_id, sum(best) AS multi FROM b GROUP BY doc_id), x AS (SELECT vec_id % 20 AS doc_id, vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM ({E})),
dm AS (SELECT doc_id, list(m ORDER BY i) AS v FROM (SELECT doc_id, i, avg(c) AS m FROM x GROUP BY doc_id, i) GROUP BY doc_id), qm AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(c) AS m FROM x WHERE vec_id % 50 = 0 GROUP BY i)),
s AS (SELECT doc_id, {cosine_sql('qm.v', 'dm.v')} AS single, multi FROM dm JOIN mm USING (doc_id), qm)
SELECT 0 AS query_id, doc_id, round(single, 6) AS single, round(multi, 6) AS multi, CAST(row_number() OVER (ORDER BY single DESC, doc_id) AS INTEGER) AS single_rank, CAST(row_number() OVER (ORDER BY multi DESC, doc_id) AS INTEGER) AS multi_rank FROM s""")
def single_and_multi(spark, d):
    q, rows = token_frames(spark, d)
    return K.single_and_multi(q, rows, "query_id", "doc_id", "embedding").withColumn("single", F.round("single", 6)).withColumn("multi", F.round("multi", 6))


@query(f"WITH {MAXSIM} SELECT 0 AS query_id, doc_id, query_pos, round(best, 6) AS best, doc_pos FROM b")
def maxsim_breakdown(spark, d):
    q, rows = token_frames(spark, d)
    return K.best_tokens(q, rows, "query_id", "doc_id", "embedding").withColumn("best", F.round("best", 6))


@query(f"""WITH q AS (SELECT 'the order of the index and of the vectors' AS query), c AS (SELECT CAST(id AS BIGINT) AS id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY id), s AS (SELECT id, text, query, {cosine_sql(emb('query'), emb('text'))} AS f FROM c, q),
t AS (SELECT *, row_number() OVER (ORDER BY f DESC, id) AS first_rank FROM s), u AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '{WS}+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda x: x <> '')) AS b FROM t WHERE first_rank <= 10),
w AS (SELECT *, len(list_intersect(a, b)) / (len(a) + 1e-9) AS g FROM u)
SELECT CAST(row_number() OVER (ORDER BY g DESC, text DESC) AS INTEGER) AS rank, id, CAST(first_rank AS INTEGER) AS first_rank, round(g, 6) AS score FROM w ORDER BY w.g DESC, text DESC LIMIT 3""")
def two_stage(spark, d):
    # the share of the query's words stands for a cross-encoder: a Python scorer of pairs, which sees the first ten only
    rows = table(spark, d, "chunks").where("text is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max("text").alias("text")).withColumn("query", F.lit("the order of the index and of the vectors"))
    first = V.dot(V.normalize(V.pseudo_embedding(F.lit("the order of the index and of the vectors"))), V.normalize(V.pseudo_embedding(F.col("text"))))
    out = K.two_stage(rows, first, models.pair_scorer(models.shared_words)(F.col("query"), F.col("text")), "id", tie="text")
    return out.select("rank", "id", "first_rank", r6("score"))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, list_cosine_similarity(v, qv) AS f, v[1] AS g FROM ({E}), q), r AS (SELECT vec_id, row_number() OVER (ORDER BY f DESC, vec_id) AS rank_a, row_number() OVER (ORDER BY g DESC, vec_id) AS rank_b FROM s)
SELECT vec_id, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b FROM r WHERE abs(rank_a - rank_b) >= 2""")
def rank_disagreements(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", V.cosine(F.col("embedding"), R.literal_vector(vector_of(spark, d))).alias("f"), F.get("embedding", F.lit(0)).cast("double").alias("g"))
    return K.disagreements(rows, "f", "g", "vec_id")


@query("SELECT strategy, result_id, CAST(row_number() OVER (PARTITION BY strategy ORDER BY similarity DESC, result_id) AS INTEGER) AS rank FROM (SELECT DISTINCT strategy, result_id, similarity FROM retrieval_results WHERE strategy IS NOT NULL AND similarity BETWEEN -1 AND 1 AND NOT isnan(similarity))")
def rank_models(spark, d):
    rows = table(spark, d, "retrieval_results").where("strategy is not null and similarity between -1 and 1 and not isnan(similarity)").select("strategy", "result_id", "similarity").distinct()
    return K.rank_by(rows, "strategy", "similarity", "result_id").select("strategy", "result_id", "rank")


@query(f"""WITH p AS ({PARENTS}), k AS (SELECT doc_id || '/' || parent_id AS parent_id, doc_id || '/' || parent_id || '_c' || j AS child_id, c[j + 1] AS text FROM (SELECT doc_id, parent_id, c, unnest(range(0, len(c))) AS j FROM
(SELECT doc_id, parent_id, list_filter(list_transform(range(0, CAST(ceil(length(text) / 128.0) AS BIGINT)), lambda k: {trim('substring(text, CAST(k * 128 + 1 AS BIGINT), 128)')}), lambda s: s <> '') AS c FROM p))),
s AS (SELECT *, {cosine_sql(emb("'how does the index stay small'"), emb('text'))} AS score FROM k), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, child_id) AS rank FROM s), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY rank) AS n FROM r WHERE rank <= 5) WHERE n = 1)
SELECT b.parent_id, child_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, p.text AS context FROM b JOIN p ON p.doc_id || '/' || p.parent_id = b.parent_id""")
def small_to_big(spark, d):
    parents, children = C.parent_child(documents(spark, d), "doc_id", "text")
    name = F.concat_ws("/", "doc_id", "parent_id")
    query_vector = V.pseudo_embedding(F.lit("how does the index stay small"))
    return K.small_to_big(children.withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_id")).withColumn("parent_id", name), parents.withColumn("parent_id", name), V.dot(V.normalize(V.pseudo_embedding(F.col("text"))), V.normalize(query_vector)), 5).select("parent_id", "child_id", "rank", r6("score"), "context")


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(len(w) / CAST(len(list_filter(regexp_split_to_array(substring(text, 1, 128), '{WS}+'), lambda x: x <> '')) AS DOUBLE), 6) AS expansion FROM w WHERE len(list_filter(regexp_split_to_array(substring(text, 1, 128), '{WS}+'), lambda x: x <> '')) > 0""")
def expansion_factor(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.round(K.expansion(F.col("text"), F.substring("text", 1, 128)), 6).alias("expansion"))
    return rows.where("expansion is not null")


# ---- sparse retrieval and fusion

ASKED = [(1, "sparse vector index"), (2, "how does the token budget drift"), (3, "Kovarianzschätzung der Vektoren"), (4, "нейронная сеть индекс"), (5, "向量索引 检索"), (6, "فهرس المتجهات"), (7, "ดัชนีเวกเตอร์")]
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"


def terms_sql(text: str) -> str:
    """functions.text.terms in SQL."""
    runs = f"regexp_extract_all(regexp_replace(lower({text}), '({UNSPACED}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^{UNSPACED}') THEN list_transform(range(1, greatest(2, length(r))), lambda i: substring(r, i, 2)) ELSE [r] END))"


def asked(spark):
    """The queries of sparse and hybrid retrieval, in several scripts; without a session, their SQL."""
    if spark is None:
        return "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") asked(query_id, query)"
    return spark.createDataFrame(ASKED, "query_id int, query string")


def bm_sql(docs: str = "documents") -> str:
    """CTEs of BM25 scores (query_id, id, score), the last named bm."""
    return f"""t AS (SELECT id, {terms_sql("coalesce(text, '')")} AS w FROM (SELECT doc_id AS id, text FROM {docs})), z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
a AS (SELECT DISTINCT query_id, unnest({terms_sql('query')}) AS term FROM {asked(None)}), f AS (SELECT id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM a) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term), bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM f JOIN df USING (term) JOIN a USING (term), z GROUP BY query_id, id)"""


BM_ALL = bm_sql()


def sparse_scores(spark, d):
    return K.bm25(documents(spark, d), asked(spark), "doc_id", "text", "query_id", "query")


@query(f"WITH {BM_ALL} SELECT query_id, id, round(score, 5) AS score FROM bm")
def bm25(spark, d):
    return sparse_scores(spark, d).withColumn("score", F.round("score", 5))


DENSE = f"fq AS (SELECT query_id, query FROM {asked(None)}), ds AS (SELECT doc_id AS id, text FROM documents), {near_sql('dn', 'fq', 'ds', 60)}"


def dense_scores(spark, d):
    return K.nearest(asked(spark), documents(spark, d), 60, ident="doc_id").select("query_id", "id", "score", "rank")


@query(f"""WITH {BM_ALL}, {DENSE}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, id) AS rank FROM bm UNION ALL SELECT query_id, id, rank FROM dn)
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r WHERE rank <= 50 GROUP BY query_id, id""")
def rrf_fusion(spark, d):
    return K.rrf([K.ranked(bm25(spark, d), 50), dense_scores(spark, d).where("rank <= 50")]).withColumn("score", F.round("score", 6))


@query(f"""WITH {BM_ALL}, {DENSE}, m AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM bm WINDOW w AS (PARTITION BY query_id)),
n AS (SELECT query_id, id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM dn WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(0.6 * coalesce(n.s, 0) + 0.4 * coalesce(m.s, 0), 5) AS score FROM n FULL JOIN m USING (query_id, id)""")
def weighted_fusion(spark, d):
    return K.weighted_fusion(dense_scores(spark, d), sparse_scores(spark, d), 0.6).withColumn("score", F.round("score", 5))


@query("""WITH a AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY length(text) DESC, id) AS rank, CAST(length(text) AS DOUBLE) AS score, text AS content FROM (SELECT id, max(text) AS text FROM chunks WHERE language = 'en' AND text IS NOT NULL GROUP BY id)),
b AS (SELECT 1 AS list_no, row_number() OVER (ORDER BY length(text) DESC, id) AS rank, CAST(length(text) AS DOUBLE) / 2 AS score, text AS content FROM (SELECT id, max(text) AS text FROM chunks WHERE year = 2023 AND text IS NOT NULL GROUP BY id)),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY list_no, rank) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT list_no, CAST(rank AS INTEGER) AS rank, score, content, CAST(row_number() OVER (ORDER BY score DESC, list_no, rank) AS INTEGER) AS place FROM f WHERE n = 1""")
def merge_dedup(spark, d):
    def listed(rows, weight):
        rows = rows.where("text is not null").groupBy("id").agg(F.max("text").alias("content")).transform(numbered, [-F.length("content"), F.col("id")])
        return rows.select("rank", (F.length("content").cast("double") * weight).alias("score"), "content")

    chunks = table(spark, d, "chunks")
    return K.merge_first([listed(chunks.where("language = 'en'"), 1.0), listed(chunks.where("year = 2023"), 0.5)])


# ---- chat history, routing and labels: the events of a user stand for the turns of a conversation

TURNS = "t AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn, CASE WHEN (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, event_type || ' what is ' || CAST(event_id AS VARCHAR) AS text FROM events)"


def turns(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("conv_id"), (n - 1).cast("long").alias("turn"), F.when(n % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat("event_type", F.lit(" what is "), F.col("event_id").cast("string")).alias("text"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS last_answer, count(*) OVER w = 0 AS is_first, coalesce(string_agg(upper(role) || ': ' || text, chr(10)) OVER w, '') AS transcript
FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def chat_window(spark, d):
    return P.history(turns(spark, d))


@query(f"""WITH {TURNS}, h AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS last_answer, count(*) OVER w = 0 AS first FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, text, CASE WHEN first THEN text ELSE text || ' (in the context of: ' || substring(coalesce(last_answer, ''), 1, 80) || '...)' END AS rewritten FROM h WHERE role = 'user'""")
def query_rewrite(spark, d):
    return P.rewrite_turns(turns(spark, d)).drop("transcript")


def any_of(words, column="lower(query)"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


QUERY_LIST = "(SELECT DISTINCT query FROM retrieval_results)"


def asked_queries(spark, d):
    return table(spark, d, "retrieval_results").select("query").distinct()


@query(f"""SELECT query, CASE WHEN {any_of(routing.ITERATIVE)} THEN 'iterative' WHEN {any_of(routing.STANDARD)} THEN 'standard' WHEN {any_of(routing.DIRECT)} THEN 'direct' ELSE 'standard' END AS strategy FROM {QUERY_LIST}""")
def classify_route(spark, d):
    return asked_queries(spark, d).select("query", routing.strategy(F.col("query")).alias("strategy"))


@query(f"""SELECT query, concat_ws(',', CASE WHEN s THEN 'structured' END, CASE WHEN w THEN 'web' END, CASE WHEN v OR NOT (s OR w) THEN 'vector' END) AS routes
FROM (SELECT query, {any_of(routing.STRUCTURED_WORDS)} AS s, {any_of(routing.WEB_WORDS)} AS w, {any_of(routing.VECTOR_WORDS)} AS v FROM {QUERY_LIST})""")
def branch_route(spark, d):
    return asked_queries(spark, d).select("query", F.array_join(routing.routes(F.col("query")), ",").alias("routes"))


LABELS = "SELECT DISTINCT query, result_id, similarity, CASE WHEN similarity >= 0.75 THEN 'correct' WHEN similarity >= 0.45 THEN 'ambiguous' ELSE 'wrong' END AS label FROM retrieval_results WHERE similarity BETWEEN -1 AND 1 AND NOT isnan(similarity)"


def labelled(spark, d):
    rows = table(spark, d, "retrieval_results").where("similarity between -1 and 1 and not isnan(similarity)").select("query", "result_id", "similarity").distinct()
    return rows.withColumn("label", routing.relevance(F.col("similarity")))


@query(f"""SELECT query, count(*) FILTER (label = 'correct') AS n_correct, count(*) FILTER (label = 'ambiguous') AS n_ambiguous, count(*) FILTER (label = 'wrong') AS n_wrong,
CASE WHEN count(*) FILTER (label = 'correct') > 0 THEN 'correct' WHEN count(*) FILTER (label = 'ambiguous') > 0 THEN 'ambiguous' ELSE 'wrong' END AS action FROM ({LABELS}) GROUP BY query""")
def crag_decision(spark, d):
    rows = P.decided(labelled(spark, d).withColumnRenamed("query", "query_id"))
    return rows.withColumnRenamed("query_id", "query")


# ---- pipelines

FEW = "(VALUES (1, 'What is a sparse vector index?'), (2, 'Compare our token budget over time'), (3, 'latest revenue count'), (4, 'Calculate 4.2 / 3.6 for market trends')) few(query_id, query)"


def few_queries(spark):
    rows = [(1, "What is a sparse vector index?"), (2, "Compare our token budget over time"), (3, "latest revenue count"), (4, "Calculate 4.2 / 3.6 for market trends")]
    return spark.createDataFrame(rows, "query_id long, query string")


from skein import pipelines  # noqa: E402,F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
