"""Retrieval pipelines over frames of queries (query_id, query) and documents (doc_id, text).

Each returns one row per query with its prompt and answer. Vectors come from an encoder, a function from a text
column to a vector column (by default the stable pseudo-embedding); answers from `generate`, a function from a
prompt column to a text column (by default a constant). Control flow is data: branches are unions of filtered
frames, never decisions of the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import routing as K
from skein.functions import text as T
from skein.functions.vectors import dot, multimodal_embedding, normalize, pseudo_embedding
from skein.operators.graph import describe, traverse_all
from skein.operators.retrieval import best_in_blocks, stated
from skein.plans.layout import stored

Encoder = Callable[[Column], Column]
Tool = Callable[[DataFrame], DataFrame]


def constant_answer(prompt: Column) -> Column:
    return F.when(prompt.isNotNull(), F.lit("[generated answer]"))


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 3, encoder: Encoder = pseudo_embedding, query: str = "query", source: str = "vector", many: bool = False) -> DataFrame:
    """(query_id, rank, score, text, source): the k best documents of every query; ties go to the greater text.

    The queries are a stated set, met with all documents; every vector is scaled to unit length once, before that, and
    each task keeps k documents of a query. With many, for hundreds of queries and more, documents are numbered and stored
    with their vectors, pairs are scored in blocks, by products of matrices, for which the queries' vectors are collected
    first, and texts meet only the pairs that are left.
    """
    if many:
        asked = queries.select("query_id", encoder(F.col(query)).alias("_q"))
        found = stored(docs.select("text").where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("_id"), "text", encoder(F.col("text")).alias("_d")))
        pairs = best_in_blocks(asked, found, "query_id", "_q", "_id", "text", "_d", k)
        pairs = pairs.withColumn("_near", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_near") <= k)
        pairs = pairs.join(found.select(F.col("_id").alias("id"), "text"), "id").select("query_id", "text", "score")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("text")))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k).withColumn("source", F.lit(source))
    q = queries.select("query_id", normalize(encoder(F.col(query))).alias("_q"))
    d = docs.select("text").where(F.col("text").isNotNull()).withColumn("_d", normalize(encoder(F.col("text"))))
    pairs = d.join(stated(q), F.lit(True)).select("query_id", "text", dot(F.col("_q"), F.col("_d")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("text")))
    return pairs.withColumn("rank", place).where((F.col("rank") <= k) & F.col("score").isNotNull()).withColumn("source", F.lit(source))


def context(hits: DataFrame, line: Column, order: list[Column], gap: str = "\n") -> DataFrame:
    """(query_id, context): the lines of a query's hits in order."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), gap).alias("context"))


def prompted(queries: DataFrame, contexts: DataFrame, lead: str, generate=constant_answer) -> DataFrame:
    """Queries with their context, the prompt (lead, context, question) and the answer; no hits give an empty context."""
    rows = queries.join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.concat(F.lit(f"{lead}\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:"))
    return rows.withColumn("prompt", prompt).withColumn("answer", generate(F.col("prompt")))


ONLY_CONTEXT = "Answer using only the context below."


def bullets(hits: DataFrame) -> DataFrame:
    return context(hits, F.concat(F.lit("- "), F.col("text")), [F.col("rank")])


def simple(queries: DataFrame, docs: DataFrame, k: int = 3, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    return prompted(queries, bullets(retrieve(queries, docs, k, encoder)), ONLY_CONTEXT, generate)


def hypothesis(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Adds hypothesis: the first known one (key_pos, key, hypothesis) with a word in the query, else a fallback."""
    q = queries.select("query_id", "query")
    hit = q.join(known, T.has_any_word_of(F.col("query"), F.col("key"))).groupBy("query_id").agg(F.min(F.struct("key_pos", "hypothesis")).alias("_h"))
    fallback = F.concat(F.lit("This document provides a comprehensive explanation of "), F.col("query"), F.lit("."))
    return queries.join(hit, "query_id", "left").withColumn("hypothesis", F.coalesce("_h.hypothesis", fallback)).drop("_h")


def hyde(queries: DataFrame, docs: DataFrame, known: DataFrame, k: int = 3, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    """Retrieval by the hypothesis; the prompt holds the original query and the documents, never the hypothesis."""
    rows = hypothesis(queries, known)
    return prompted(rows, bullets(retrieve(rows, docs, k, encoder, "hypothesis")), ONLY_CONTEXT, generate)


def history(turns: DataFrame, messages: int = 6) -> DataFrame:
    """Each turn (conv_id, turn, role, text) with its bounded past: last answer, emptiness, and a transcript."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-messages, -1)
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return turns.select("*", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w).alias("last_answer"), (F.count("*").over(w) == 0).alias("is_first"), F.array_join(F.collect_list(line).over(w), "\n").alias("transcript"))


def rewrite_turns(turns: DataFrame, messages: int = 6) -> DataFrame:
    rows = history(turns, messages).where("role = 'user'")
    return rows.select("conv_id", "turn", "text", K.in_conversation(F.col("text"), F.col("last_answer"), F.col("is_first")).alias("rewritten"), "transcript")


def with_memory(turns: DataFrame, docs: DataFrame, k: int = 3, messages: int = 6, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    """Retrieval by the rewritten turn, for any number of turns; the prompt holds the transcript and the turn as it was asked.

    Turns of no conversation have no query_id, so that no context belongs to them.
    """
    rows = stored(rewrite_turns(turns, messages).withColumn("query_id", F.concat("conv_id", F.lit("/"), "turn")).withColumnRenamed("text", "query"))
    found = bullets(retrieve(rows.where("query_id is not null"), docs, k, encoder, "rewritten", many=True)).withColumnRenamed("context", "_c")
    joined = rows.join(found, "query_id", "left")
    whole = joined.select("query_id", F.concat(F.lit("History:\n"), F.col("transcript"), F.lit("\n\nDocuments:\n"), F.coalesce("_c", F.lit(""))).alias("context"))
    return prompted(rows, whole, "Use the history and the documents.", generate)


def adaptive(queries: DataFrame, docs: DataFrame, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    """Direct queries get no context, standard ones the best three, iterative ones the best two of two passes."""
    rows = queries.withColumn("route", K.strategy(F.col("query")))
    standard, iterative = rows.where("route = 'standard'"), rows.where("route = 'iterative'")
    again = iterative.withColumn("follow_up", F.concat(F.lit("additional context for: "), F.col("query")))
    both = retrieve(iterative, docs, 2, encoder).withColumn("pass", F.lit(1)).unionByName(retrieve(again, docs, 2, encoder, "follow_up").withColumn("pass", F.lit(2)))
    once = both.groupBy("query_id", "text").agg(F.min(F.struct("pass", "rank")).alias("_p")).select("query_id", "text", (F.col("_p.pass") * 10 + F.col("_p.rank")).alias("rank"))
    hits = retrieve(standard, docs, 3, encoder).select("query_id", "text", "rank").unionByName(once)
    return prompted(rows, bullets(hits), "Answer using this context, if there is any.", generate)


def structured_hits(queries: DataFrame, facts: DataFrame, k: int = 2) -> DataFrame:
    """Facts (key_pos, key, value) whose key, or a part of it between underscores, occurs in the query: score 1; else the first k at 0.5."""
    pairs = facts.join(stated(queries.select("query_id", "query")), F.lit(True))
    hit = F.contains(F.lower("query"), F.col("key")) | T.has_any_word_of(F.col("query"), F.col("key"), "_")
    pairs = pairs.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    w = Window.partitionBy("query_id")
    kept = pairs.withColumn("_any", F.max("_hit").over(w)).where("_hit or not _any")
    place = F.row_number().over(w.orderBy("key_pos"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("_any"), 1.0).otherwise(0.5).alias("score"), F.col("value").alias("text"), F.lit("structured").alias("source"))


def branched(queries: DataFrame, docs: DataFrame, facts: DataFrame, web: DataFrame, k: int = 2, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    """Queries go to their routes; results are merged, each text once by the first route that has it, best score first."""
    rows = queries.withColumn("routes", K.routes(F.col("query")))

    def to(name: str) -> DataFrame:
        return rows.where(F.array_contains("routes", name))

    names = ["query_id", "rank", "score", "text", "source"]
    hits = structured_hits(to("structured"), facts, k).withColumn("route_no", F.lit(0)).select(*names, "route_no")
    hits = hits.unionByName(retrieve(to("web"), web, k, encoder, source="web").withColumn("route_no", F.lit(1)).select(*names, "route_no"))
    hits = hits.unionByName(retrieve(to("vector"), docs, k, encoder).withColumn("route_no", F.lit(2)).select(*names, "route_no"))
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("route_no", "rank"))).where("_n = 1")
    # a fixed value: the form of a line
    line = F.format_string("[%s | score=%.3f]\n  %s", F.upper("source"), F.col("score"), F.col("text"))
    return prompted(rows, context(first, line, [-F.col("score"), F.col("route_no"), F.col("rank")], "\n\n"), "Say which source each statement comes from.", generate)


def decided(labelled: DataFrame) -> DataFrame:
    """(query_id, n_correct, n_ambiguous, n_wrong, action) of labelled hits."""
    counts = labelled.groupBy("query_id").agg(*[F.count_if(F.col("label") == name).alias(f"n_{name}") for name in ("correct", "ambiguous", "wrong")])
    return counts.withColumn("action", K.action(F.col("n_correct"), F.col("n_ambiguous")))


def as_it_is(text: Column, query: Column) -> Column:
    """The refiner that changes nothing; another one is a function of text and query too."""
    return text


def corrective_context(hits: DataFrame, web: DataFrame, queries: DataFrame, encoder: Encoder = pseudo_embedding, refine: Callable[[Column, Column], Column] = as_it_is) -> DataFrame:
    """(query_id, action, context) of scored hits (query_id, rank, score, text).

    With correct hits these are used, refined, and one web result is added if others are ambiguous; with only ambiguous
    ones these and two web results; else three web results for the rewritten query. The hits, read several times, are
    stored.
    """
    labelled = stored(hits).withColumn("label", K.relevance(F.col("score")))
    state = queries.join(decided(labelled), "query_id", "left").na.fill(0, ["n_correct", "n_ambiguous"]).na.fill("wrong", ["action"])
    state = state.withColumn("web_k", F.when((F.col("action") == "correct") & (F.col("n_ambiguous") > 0), 1).when(F.col("action") == "ambiguous", 2).when(F.col("action") == "wrong", 3).otherwise(0))
    asked = state.where("web_k > 0").withColumn("web_query", F.when(F.col("action") == "wrong", K.rewritten(F.col("query"))).otherwise(F.col("query")))
    found = retrieve(asked, web, 3, encoder, "web_query", many=True).join(state.select("query_id", "web_k"), "query_id").where("rank <= web_k")
    kept = labelled.join(state.select("query_id", "action", "query"), "query_id").where("label = action and action <> 'wrong'")
    # fixed values: the forms of the lines
    lines = kept.select("query_id", F.lit(0).alias("part"), "rank", F.format_string("[VECTOR | %.2f] %s", F.col("score"), refine(F.col("text"), F.col("query"))).alias("text"))
    lines = lines.unionByName(found.select("query_id", F.lit(1).alias("part"), "rank", F.concat(F.lit("[WEB] "), F.col("text")).alias("text")))
    return state.select("query_id", "action").join(context(lines, F.col("text"), [F.col("part"), F.col("rank")]), "query_id", "left")


def corrective(queries: DataFrame, docs: DataFrame, web: DataFrame, k: int = 3, encoder: Encoder = pseudo_embedding, generate=constant_answer, refine: Callable[[Column, Column], Column] = as_it_is) -> DataFrame:
    return prompted(queries, corrective_context(retrieve(queries, docs, k, encoder), web, queries, encoder, refine), ONLY_CONTEXT, generate)


def candidates(hits: DataFrame) -> DataFrame:
    """Hits (query_id, query, rank, score, text) with a passage and its labels for relevance, support and use."""
    # a fixed value: the form of a passage
    def passage(w: Column) -> Column:
        told = F.concat(F.lit("Based on evidence: '"), F.substring("text", 1, 60), F.lit("...' — the answer to '"), F.col("query"), F.lit("' relates to "), F.get(w, F.lit(0)), F.lit(" and "), F.element_at(w, -1), F.lit("."))
        return F.when(F.size(w) > 0, told).otherwise("")

    rows = hits.withColumn("passage", T.let(T.word_list(F.col("text")), passage)).withColumn("isrel", K.is_relevant(F.col("score")))
    rows = rows.withColumn("issup", K.support(F.col("passage"), F.col("text"))).withColumn("isuse", K.usefulness(F.col("passage")))
    return rows.withColumn("composite", K.composite(F.col("isrel"), F.col("issup"), F.col("isuse")))


def self_reflective(queries: DataFrame, docs: DataFrame, k: int = 3, encoder: Encoder = pseudo_embedding) -> DataFrame:
    """The passage of highest composite score of each query, the first on ties. A second pass would repeat the first."""
    asked = queries.withColumn("retrieve", K.retrieves(F.col("query"))).where("retrieve = 'yes'")
    hits = retrieve(asked, docs, k, encoder).join(asked.select("query_id", "query"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("composite"), "rank"))
    best = candidates(hits).withColumn("_n", place).where("_n = 1")
    return best.select("query_id", "query", "text", "passage", "isrel", "issup", "isuse", "composite", ((F.col("issup") == "fully") & (F.col("isuse") == "high")).alias("final"))


def graph_answers(queries: DataFrame, vertices: DataFrame, edges: DataFrame, entry: int = 2, max_depth: int = 2, max_nodes: int = 10, encoder: Encoder = pseudo_embedding, generate=constant_answer) -> DataFrame:
    """For each query its nearest entities by name and description, the graph around them, and the prompt."""
    from skein.operators.ranking import nearest

    named = vertices.select("id", F.concat_ws(" ", "name", "description").alias("text"))
    starts = nearest(queries.select("query_id", "query"), named, entry, encoder).select("query_id", F.col("rank").alias("start_pos"), "id")
    visits = describe(traverse_all(edges, starts, max_depth, max_nodes), vertices, edges)
    line = F.when(F.col("depth") == 0, F.concat(F.col("name"), F.lit(": "), F.col("description"))).otherwise(F.concat_ws(" ", F.col("parent_name"), F.col("relation_type"), F.col("name")))
    return prompted(queries, context(visits, line, [F.col("visit")]), "Answer from these facts of a graph.", generate)


def multimodal(queries: DataFrame, docs: DataFrame, k: int = 3, only: str | None = None, generate=constant_answer) -> DataFrame:
    """queries (query_id, query, modality), docs (doc_id, content, modality, metadata): search across modalities, or in one.

    metadata is a map of strings; an image's url is taken from it.
    """
    q = queries.select("query_id", normalize(multimodal_embedding(F.col("query"), F.col("modality"))).alias("_q"))
    d = (docs.where(F.col("modality") == only) if only else docs).withColumn("_d", normalize(multimodal_embedding(F.col("content"), F.col("modality"))))
    pairs = d.join(stated(q), F.lit(True)).withColumn("score", dot(F.col("_q"), F.col("_d")))
    hits = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where((F.col("rank") <= k) & F.col("score").isNotNull())
    # fixed values: the forms of the lines
    image = F.format_string("[IMAGE | %.3f] (URL: %s)\nVisual content: %s", F.col("score"), F.coalesce(F.col("metadata")["url"], F.lit("N/A")), F.col("content"))
    line = F.when(F.col("modality") == "image", image).otherwise(F.format_string("[%s | %.3f]\n%s", F.upper("modality"), F.col("score"), F.col("content")))
    return prompted(queries, context(hits, line, [F.col("rank")], "\n\n"), "Answer from text, images and tables.", generate)


def planned(task: Column, step: int) -> tuple[Column, Column]:
    """(tool, input) of an agent's step, counted from 0; FINISH ends it. The wording of tasks decides (fixed values)."""
    t = F.lower(task)
    has = lambda *w: T.has_any(t, w)
    if step == 0:
        tool = F.when(has("competitor", "compare"), "retrieve").when(has("market", "trend"), "web_search").otherwise("retrieve")
        given = F.when(has("competitor", "compare"), "Q3 revenue operating margin").when(has("market", "trend"), "market trends SaaS").otherwise(task)
    elif step == 1:
        tool = F.when(has("competitor"), "web_search").when(has("calculate", "%"), "calculate").otherwise("FINISH")
        given = F.when(has("competitor"), "competitor pricing revenue").when(has("calculate", "%"), "4.2 / 3.6 - 1").otherwise("")
    elif step == 2:
        tool, given = F.when(has("strategy"), "retrieve").otherwise("FINISH"), F.when(has("strategy"), "competitive strategy differentiation").otherwise("")
    else:
        tool, given = F.lit("FINISH"), F.lit("")
    return tool, given


def web_lookup(queries: DataFrame, facts: DataFrame, query: str = "input") -> DataFrame:
    """(query_id, observation): the first fact (key_pos, key, value) with a word in the query, else a fixed message."""
    hit = queries.select("query_id", F.col(query).alias("_q")).join(facts, T.has_any_word_of(F.col("_q"), F.col("key"))).groupBy("query_id").agg(F.min(F.struct("key_pos", "value")).alias("_v"))
    found = F.concat(F.lit("Web search result: "), F.col("_v.value"))
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce(found, F.lit("Web search: No highly relevant results found.")).alias("observation"))


def standard_tools(docs: DataFrame, facts: DataFrame, encoder: Encoder = pseudo_embedding) -> dict[str, Tool]:
    """The tools by name: each takes calls (query_id, input) and gives (query_id, observation). Their messages are fixed values."""

    def look_up(calls: DataFrame) -> DataFrame:
        found = context(retrieve(calls, docs, 2, encoder, "input"), F.concat(F.lit("  - "), F.col("text")), [F.col("rank")])
        rows = calls.select("query_id").join(found, "query_id", "left")
        return rows.select("query_id", F.concat(F.lit("Internal knowledge base results:\n"), F.coalesce("context", F.lit(""))).alias("observation"))

    return {
        "retrieve": look_up,
        "web_search": lambda calls: web_lookup(calls, facts),
        "calculate": lambda calls: calls.select("query_id", K.calculated("input").alias("observation")),
        "summarize": lambda calls: calls.select("query_id", T.summary(F.col("input")).alias("observation")),
    }


def call_tools(calls: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """(query_id, observation) of calls (query_id, tool, input), each by its tool; unknown tools give a message."""
    seen = calls.where(~F.col("tool").isin(list(tools)) if tools else F.lit(True)).select("query_id", F.concat(F.lit("Unknown tool: "), F.col("tool")).alias("observation"))
    for name, tool in tools.items():
        seen = seen.unionByName(tool(calls.where(F.col("tool") == name).select("query_id", "input")))
    return seen


def agent(tasks: DataFrame, tools: dict[str, Tool], steps: int = 5, plan=planned) -> DataFrame:
    """(query_id, query, trace, calls, answer): tool calls of every task until its plan finishes.

    No standard plan has more than three calls, so that a fourth step is never begun.
    """
    trace = None
    live = tasks.select("query_id", "query")
    for step in range(min(steps, 4) if plan is planned else steps):
        tool, given = plan(F.col("query"), step)
        live = live.withColumn("tool", tool).withColumn("input", given).where("tool <> 'FINISH'")
        row = live.join(call_tools(live, tools), "query_id", "left").select("query_id", F.lit(step + 1).alias("step"), "tool", "input", "observation")
        trace = row if trace is None else trace.unionByName(row)
        live = live.select("query_id", "query")
    # fixed values: the forms of a step and of the answer
    line = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(":\n  Action     : "), F.col("tool"), F.lit("("), F.col("input"), F.lit(")\n  Observation: "), F.coalesce("observation", F.lit("")))
    told = trace.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda r: r["line"]), "\n").alias("trace"), F.count("*").alias("calls"))
    rows = tasks.join(told, "query_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    answer = F.concat(F.lit("[Simulated Final Answer]\nTask: "), F.col("query"), F.lit("\nBased on "), F.col("calls").cast("string"), F.lit(" tool calls, the agent has gathered all required information and synthesized a comprehensive response."))
    return rows.select("query_id", "query", F.coalesce("trace", F.lit("")).alias("trace"), "calls", answer.alias("answer"))


def hybrid(docs: DataFrame, queries: DataFrame, filters: dict | None = None, k: int = 3, depth: int = 50, floor: float = 0.0, diverse: int = 10, balance: float = 0.7, encoder: Encoder = pseudo_embedding, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, query, rank, id, fused, mmr_rank, score, text): the whole pipeline, for a stated set of queries.

    Metadata filter; BM25 and dense retrieval, `depth` of each; reciprocal rank fusion; a floor for the fused score;
    MMR down to `diverse`; re-ranking by the scorer down to k (by MMR's order where there is none).
    """
    from skein.operators.ranking import bm25, mmr_batch, nearest, ranked, rerank, rrf
    from skein.operators.retrieval import metadata_filter

    scoped = metadata_filter(docs, filters or {})
    dense = nearest(queries, scoped, depth, encoder, "doc_id").select("query_id", "id", "rank")
    sparse = ranked(bm25(scoped, queries, "doc_id", "text", "query_id", "query").withColumn("score", F.round("score", 9)), depth)
    fused = rrf([dense, sparse]).where(F.col("score") >= floor)
    texts = scoped.select(F.col("doc_id").alias("id"), "text")
    held = fused.join(texts, "id").withColumn("vector", encoder(F.col("text")))
    picked = mmr_batch(held, diverse, balance).select("query_id", "id", F.col("score").alias("fused"), F.col("rank").alias("mmr_rank"))
    hits = picked.join(texts, "id").join(queries.select("query_id", "query"), "query_id")
    best = rerank(hits, scorer or (lambda q, t: -F.col("mmr_rank").cast("double")), k)
    return best.select("query_id", "query", F.col("final_rank").alias("rank"), "id", "fused", "mmr_rank", F.col("rerank_score").alias("score"), "text")
