"""Re-ranking and diversity: MMR, late interaction, two-stage retrieval, context expansion, fusion of result lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.vectors import cosine, dot, normalize, pseudo_embedding
from skein.operators.retrieval import literal_vector, stated, top_k
from skein.plans.layout import cut, numbered

Encoder = Callable[[Column], Column]


def mmr(df: DataFrame, ident: str, vector: str, query, k: int = 5, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: (rank, id, score, redundancy, mmr_score), greedily for one query vector.

    Every row stays a candidate. Each of the k rounds is one distributed arg-max; the vector it picks, of fixed
    length, comes to the driver and enters the next round. The first pick has redundancy 0; ties go to the smaller
    id; null vectors are left out; fewer rows than k give fewer picks.
    """
    rows = cut(df.select(F.col(ident).alias("id"), F.col(vector).alias("v")).withColumn("score", cosine(F.col("v"), literal_vector(query))).where("score is not null and not isnan(score)"))
    redundancy: Column = F.lit(0.0)
    picks: list[tuple] = []
    for rank in range(1, k + 1):
        value = F.lit(float(balance)) * F.col("score") - F.lit(1.0 - balance) * F.col("redundancy")
        left = rows.where(~F.col("id").isin([p[1] for p in picks])) if picks else rows
        best = left.withColumn("redundancy", redundancy).withColumn("mmr_score", value).orderBy(F.desc("mmr_score"), "id").limit(1).collect()
        if not best:
            break
        b = best[0]
        picks.append((rank, b["id"], b["score"], b["redundancy"], b["mmr_score"]))
        near = cosine(F.col("v"), literal_vector(b["v"]))
        redundancy = near if rank == 1 else F.greatest(redundancy, near)
    kind = df.schema[ident].dataType.simpleString()
    return df.sparkSession.createDataFrame(picks, f"rank int, id {kind}, score double, redundancy double, mmr_score double")


def mmr_batch(candidates: DataFrame, k: int = 5, balance: float = 0.7) -> DataFrame:
    """MMR of every query over its list of candidates (query_id, id, score, vector): (query_id, rank, id, score, redundancy, mmr_score).

    A query's candidates are the bounded list that a retrieval before gave it, so that one task may hold them; the
    queries are spread over the tasks. Ties go to the smaller id; candidates without a vector are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def pick(group: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending"), ("id", "ascending")]).combine_chunks()
        x = np.array(group.column("vector").to_pylist(), float)
        sizes = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(sizes > 0, sizes, 1.0)
        score, near, left = group.column("score").to_numpy(), np.zeros(len(x)), np.ones(len(x), bool)
        place = np.argsort(np.array(group.column("id").to_pylist()), kind="stable").argsort()
        picks, values = [], []
        for n in range(min(k, len(x))):
            value = np.where(left, np.round(balance * score - (1 - balance) * near, 12), -np.inf)
            at = int(np.lexsort((place, -value))[0])
            picks.append(at)
            values.append((near[at], value[at]))
            left[at] = False
            near = x @ x[at] if n == 0 else np.maximum(near, x @ x[at])
        few = group.take(pa.array(picks))
        return pa.table([few.column("query_id"), pa.array(range(1, len(picks) + 1), pa.int32()), few.column("id"), few.column("score"), pa.array([v[0] for v in values]), pa.array([v[1] for v in values])], ["query_id", "rank", "id", "score", "redundancy", "mmr_score"])

    rows = candidates.where(F.col("vector").isNotNull() & F.col("score").isNotNull()).select("query_id", "id", F.col("score").cast("double").alias("score"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.groupBy("query_id").applyInArrow(pick, f"query_id {kinds['query_id']}, rank int, id {kinds['id']}, score double, redundancy double, mmr_score double")


def compare_with_mmr(df: DataFrame, ident: str, vector: str, query, k: int = 5, balance: float = 0.7) -> DataFrame:
    """Rank by rank the ids of top-k and of MMR, with a mark where MMR's id is not in top-k, and the number shared."""
    plain = top_k(df, cosine(F.col(vector), literal_vector(query)), ident, k).select("rank", F.col(ident).alias("topk_id"))
    diverse = mmr(df, ident, vector, query, k, balance).select("rank", F.col("id").alias("mmr_id"))
    inside = plain.select(F.col("topk_id").alias("mmr_id"), F.lit(True).alias("_in"))
    rows = plain.join(diverse, "rank").join(inside, "mmr_id", "left")
    both = F.sum(F.coalesce(F.col("_in"), F.lit(False)).cast("int")).over(Window.partitionBy(F.lit(0)))
    return rows.select("rank", "topk_id", "mmr_id", F.coalesce("_in", F.lit(False)).alias("shared"), both.cast("int").alias("n_shared"))


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, query_id: str, doc_id: str, vector: str) -> DataFrame:
    """(query_id, doc_id, score): the sum over query tokens of the best cosine among a document's tokens.

    The query tokens are the stated set of a nested loop; best-per-token is aggregated before the shuffle.
    """
    best = best_tokens(query_tokens, doc_tokens, query_id, doc_id, vector)
    return best.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))


def best_tokens(query_tokens: DataFrame, doc_tokens: DataFrame, query_id: str, doc_id: str, vector: str, pos: str = "pos") -> DataFrame:
    """(query_id, doc_id, query_pos, best, doc_pos): for each query token the best token of each document, first on ties."""
    q = query_tokens.select(F.col(query_id).alias("query_id"), F.col(pos).alias("query_pos"), normalize(F.col(vector)).alias("_q"))
    d = doc_tokens.select(F.col(doc_id).alias("doc_id"), F.col(pos).alias("doc_pos"), normalize(F.col(vector)).alias("_d"))
    pairs = d.join(stated(q), F.lit(True)).select("query_id", "doc_id", "query_pos", "doc_pos", dot(F.col("_q"), F.col("_d")).alias("sim"))
    best = pairs.groupBy("query_id", "doc_id", "query_pos").agg(F.min(F.struct((-F.col("sim")).alias("far"), "doc_pos")).alias("_b"))
    return best.select("query_id", "doc_id", "query_pos", (-F.col("_b.far")).alias("best"), F.col("_b.doc_pos").alias("doc_pos"))


def mean_vectors(tokens: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vector): the mean of the token vectors of each id, the single vector that stands for all of them."""
    each = tokens.select(F.col(ident).alias("id"), F.posexplode(vector).alias("_i", "_x")).groupBy("id", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return each.groupBy("id").agg(F.transform(ordered, lambda p: p["_x"]).alias("vector"))


def single_and_multi(query_tokens: DataFrame, doc_tokens: DataFrame, query_id: str, doc_id: str, vector: str) -> DataFrame:
    """(query_id, doc_id, single, multi, single_rank, multi_rank): documents by one vector and by all their token vectors.

    single is the cosine of the mean vectors, multi the MaxSim score; ranks are within the query, ties to the smaller id.
    """
    q = mean_vectors(query_tokens, query_id, vector).select(F.col("id").alias("query_id"), normalize(F.col("vector")).alias("_q"))
    d = mean_vectors(doc_tokens, doc_id, vector).select(F.col("id").alias("doc_id"), normalize(F.col("vector")).alias("_d"))
    single = d.join(stated(q), F.lit(True)).select("query_id", "doc_id", dot(F.col("_q"), F.col("_d")).alias("single"))
    both = single.join(maxsim(query_tokens, doc_tokens, query_id, doc_id, vector).withColumnRenamed("score", "multi"), ["query_id", "doc_id"])
    for name in ("single", "multi"):
        both = both.withColumn(f"{name}_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(name), "doc_id")))
    return both


def maxsim_arrays(query: Column, doc: Column) -> Column:
    """MaxSim of two arrays of token vectors of unit length in one row."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def two_stage(df: DataFrame, first: Column, second: Column, ident: str, retrieve_k: int = 10, rerank_k: int = 3, tie: str | None = None) -> DataFrame:
    """The rerank_k best by the second score among the retrieve_k best by the first, so that the costly score runs on few."""
    few = top_k(df, first, ident, retrieve_k).withColumnRenamed("score", "first_score").withColumnRenamed("rank", "first_rank")
    scored = few.withColumn("score", second)
    order = [F.desc("score"), F.desc(tie) if tie else F.col(ident)]
    return scored.orderBy(*order).limit(rerank_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_by(df: DataFrame, group: str, score: str, ident: str) -> DataFrame:
    """Rank of every candidate within its group, as for several models over one list."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.col(ident))))


def disagreements(df: DataFrame, one: str, two: str, ident: str, least: int = 2) -> DataFrame:
    """Rows that two scores rank at least `least` places apart, over one result list."""
    rows = df
    for score, name in ((one, "rank_a"), (two, "rank_b")):
        rows = numbered(rows, [-F.col(score), F.col(ident)]).withColumnRenamed("rank", name).drop("before")
    return rows.select(ident, "rank_a", "rank_b").where(F.abs(F.col("rank_a") - F.col("rank_b")) >= least)


def compare_models(queries: DataFrame, candidates: DataFrame, ident: str, text: str, encoders: dict[str, Encoder], prefixes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(model, query_id, id, score, rank): every candidate's rank for every query, by each of several encoders.

    prefixes has, for models that want them, what is put before queries and before candidates.
    """
    out = None
    for model, encoder in encoders.items():
        before = (prefixes or {}).get(model, ("", ""))
        q = queries.select("query_id", normalize(encoder(T.prefixed(F.col("query"), before[0]))).alias("_q"))
        d = candidates.select(F.col(ident).alias("id"), normalize(encoder(T.prefixed(F.col(text), before[1]))).alias("_d"))
        rows = d.join(stated(q), F.lit(True)).select(F.lit(model).alias("model"), "query_id", "id", dot(F.col("_q"), F.col("_d")).alias("score")).where("score is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("model", "query_id").orderBy(F.desc("score"), "id")))


def evaluate_pairs(pairs: DataFrame, encoder: Encoder, tolerance: float = 0.3) -> DataFrame:
    """Adds to (a, b, expected) the similarity, its gap from the expected one, and a mark where that exceeds the tolerance."""
    rows = pairs.withColumn("similarity", dot(normalize(encoder(F.col("a"))), normalize(encoder(F.col("b")))))
    return rows.withColumn("gap", F.col("similarity") - F.col("expected")).withColumn("bad", F.abs("gap") > tolerance)


def drift(triples: DataFrame, encoder: Encoder, least: float = 0.2) -> DataFrame:
    """Adds to (term, related, unrelated) both similarities and their gap; at most `least`, the term is drifting."""
    v = {c: normalize(encoder(F.col(c))) for c in ("term", "related", "unrelated")}
    rows = triples.withColumn("near", dot(v["term"], v["related"])).withColumn("far", dot(v["term"], v["unrelated"]))
    return rows.withColumn("gap", F.col("near") - F.col("far")).withColumn("drifting", ~(F.col("gap") > least))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], k: int, query: str = "query", text: str = "text", ident: str = "id") -> DataFrame:
    """The k best of each query's hits by a scorer of (query, text), as a cross-encoder: adds rerank_score and final_rank.

    The scorer sees only the hits, batch by batch (see functions.models.pair_scorer).
    """
    scored = hits.withColumn("rerank_score", scorer(F.col(query), F.col(text)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.col(ident)))
    return scored.withColumn("final_rank", place).where(F.col("final_rank") <= k)


def nearest(queries: DataFrame, items: DataFrame, k: int, encoder: Encoder = pseudo_embedding, ident: str = "id", text: str = "text") -> DataFrame:
    """(query_id, id, text, score, rank): the k items of highest cosine for each query of a stated set; ties to the smaller id.

    Every vector is scaled to unit length once, before the pairs are made.
    """
    q = queries.select("query_id", normalize(encoder(F.col("query"))).alias("_q"))
    d = items.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("_d", normalize(encoder(F.col("text"))))
    pairs = d.join(stated(q), F.lit(True)).select("query_id", "id", "text", dot(F.col("_q"), F.col("_d")).alias("score"))
    # scores are looked at behind the ranking, where they are computed once; null ones are last
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where((F.col("rank") <= k) & F.col("score").isNotNull())


def small_to_big(children: DataFrame, parents: DataFrame, score: Column, k: int = 3, ident: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    """The parents of the k best children, each once with its best child; may be fewer than k."""
    best = top_k(children, score, ident, k).select(F.col(ident).alias("child_id"), F.col(parent), "score", "rank")
    first = best.withColumn("_n", F.row_number().over(Window.partitionBy(parent).orderBy("rank"))).where("_n = 1").drop("_n")
    return first.join(parents.select(parent, F.col("text").alias("context")), parent)


def sentence_window(sents: DataFrame, hits: DataFrame, ident: str, width: int = 2, pos: str = "pos", text: str = "sentence") -> DataFrame:
    """The sentences within `width` of each hit, joined in order: an equi-join on the positions around it."""
    around = hits.select(ident, F.col(pos).alias("hit"), F.explode(F.sequence(F.col(pos) - width, F.col(pos) + width)).alias(pos))
    joined = around.join(sents.select(ident, pos, F.col(text).alias("_t")), [ident, pos])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_t").alias("t"))))
    return joined.groupBy(ident, "hit").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("context"))


def sentence_window_retrieve(queries: DataFrame, sents: DataFrame, ident: str, width: int = 2, k: int = 3, encoder: Encoder = pseudo_embedding, pos: str = "pos", text: str = "sentence") -> DataFrame:
    """(query_id, rank, id, hit, score, sentence, context): the k sentences nearest to each query with `width` around them.

    Windows of neighbouring hits may overlap; they are not merged.
    """
    items = sents.select(F.struct(F.col(ident).alias("doc"), F.col(pos).alias("pos")).alias("id"), F.col(text).alias("text"))
    hits = nearest(queries, items, k, encoder).select("query_id", "rank", F.col("id.doc").alias(ident), F.col("id.pos").alias("hit"), "score", F.col("text").alias("sentence"))
    around = sentence_window(sents, hits.select(ident, F.col("hit").alias(pos)).distinct(), ident, width, pos, text)
    return hits.join(around, [ident, "hit"])


def compress(queries: DataFrame, chunks: DataFrame, k: int = 3, n: int = 2, encoder: Encoder = pseudo_embedding, ident: str = "id", text: str = "text") -> DataFrame:
    """(query_id, rank, id, score, text, context): the k chunks nearest to each query, each cut to its n sentences nearest to it.

    The sentences keep their order; chunks of at most n sentences stay as they are; ties go to the earlier sentence.
    """
    hits = nearest(queries, chunks, k, encoder, ident, text)
    parts = hits.select("query_id", "id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    asked = queries.select("query_id", normalize(encoder(F.col("query"))).alias("_q"))
    scored = parts.join(asked, "query_id").withColumn("_s", dot(F.col("_q"), normalize(encoder(F.col("sentence")))))
    per = Window.partitionBy("query_id", "id")
    kept = scored.withColumn("_n", F.row_number().over(per.orderBy(F.desc("_s"), "pos"))).where(F.col("_n") <= n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("sentence").alias("t"))))
    short = kept.groupBy("query_id", "id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("_short"))
    whole = F.size(T.sentences(F.col("text"))) <= n
    return hits.join(short, ["query_id", "id"], "left").select("query_id", "rank", "id", "score", "text", F.when(whole, F.col("text")).otherwise(F.col("_short")).alias("context"))


def compare_strategies(results: dict[str, DataFrame]) -> DataFrame:
    """(strategy, query_id, indexed, returned, expansion): words of the best hit of each strategy and query, as indexed and as returned.

    results has frames of (query_id, rank, indexed_text, context) by the strategy's name.
    """
    out = None
    for name, rows in results.items():
        best = rows.where("rank = 1").select(F.lit(name).alias("strategy"), "query_id", T.word_count(F.col("indexed_text")).alias("indexed"), T.word_count(F.col("context")).alias("returned"), expansion(F.col("context"), F.col("indexed_text")).alias("expansion"))
        out = best if out is None else out.unionByName(best)
    return out


def expansion(returned: Column, indexed: Column) -> Column:
    """Words returned for each word indexed; null where nothing was indexed."""
    return F.when(T.word_count(indexed) > 0, T.word_count(returned) / T.word_count(indexed))


def bm25(docs: DataFrame, queries: DataFrame, ident: str, text: str, query_id: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); documents without any query term have no row.

    Documents are split once: a row keeps its length and those of its terms that a query has, whose set comes as one
    row; the rest works on these. Null and empty texts count as documents of length 0.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.terms(F.col(query)))).alias("term"))
    wanted = asked.agg(F.collect_set("term").alias("_wanted"))
    words = docs.select(F.col(ident).alias("id"), F.coalesce(T.terms(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    held = cut(words.join(wanted, F.lit(True)).select("id", F.size("_w").alias("len"), F.filter("_w", lambda w: F.array_contains("_wanted", w)).alias("hits")))
    size = held.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = held.where(F.size("hits") > 0).select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").join(asked, "term").join(size, F.lit(True))  # one row on the right
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    place = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return place.where(F.col("rank") <= k) if k else place


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion of frames with query_id, id and rank."""
    union = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "id", "rank"))
    return union.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def min_max(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0).alias("score"))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha x dense + (1 - alpha) x sparse after min-max scaling within the query; missing scores count as 0."""
    d, s = min_max(dense).withColumnRenamed("score", "d"), min_max(sparse).withColumnRenamed("score", "s")
    return d.join(s, ["query_id", "id"], "full").select("query_id", "id", (F.lit(alpha) * F.coalesce("d", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))


def merge_first(lists: list[DataFrame], content: str = "content") -> DataFrame:
    """Union of result lists (columns rank, score, content), each content once, from the first list that has it."""
    union = None
    for i, one in enumerate(lists):
        part = one.select(F.lit(i).alias("list_no"), "rank", "score", content)
        union = part if union is None else union.unionByName(part)
    first = union.withColumn("_n", F.row_number().over(Window.partitionBy(content).orderBy("list_no", "rank"))).where("_n = 1").drop("_n")
    placed = numbered(first.withColumnRenamed("rank", "_rank"), [-F.col("score"), F.col("list_no"), F.col("_rank")])
    return placed.withColumnRenamed("rank", "place").withColumnRenamed("_rank", "rank").drop("before")
