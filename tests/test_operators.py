import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import routing
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import chunking as C
from skein.operators import graph as G
from skein.operators import ranking as K
from skein.operators import retrieval as R
from skein.operators import semantic as S
from skein.plans import patterns as P
from skein.sources import files


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_fixed_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(4131))
    rows = C.fixed_chunks(one(spark, text), "doc_id", "text", 300, 50).orderBy("chunk_id").collect()
    assert len(rows) == 17 and rows[-1].start_pos == 4000 and rows[-1].end_pos == 4131
    assert all(r.text == text[r.start_pos : r.end_pos] for r in rows)
    assert C.fixed_chunks(one(spark, text), "doc_id", "text", 300, 0).count() == 14


def test_windows_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a😀é")], "doc_id long, text string")
    assert [r.text for r in C.fixed_chunks(df, "doc_id", "text", 2, 1).orderBy("chunk_id").collect()] == ["a😀", "😀é", "é"]
    assert C.sentence_windows(df.where("doc_id < 3"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(50, 50), (0, 0), (10, -1)])
def test_bad_sizes(spark, size, overlap):
    with pytest.raises(ValueError):
        C.fixed_chunks(one(spark, "x"), "doc_id", "text", size, overlap)


def test_stride_sweep(spark):
    rows = {r.stride: r.chunks for r in C.stride_sweep(one(spark, "x" * 4131), "doc_id", "text", (30, 150, 270, 300, 60, 210)).collect()}
    assert rows == {30: 138, 150: 28, 270: 16, 300: 14, 60: 69, 210: 20}


def test_packing_quirk_and_strict_form():
    words = [f"w0{i}" for i in range(1, 9)]
    assert [" ".join(words[a:b]) for a, b in C.packed([3] * 8, 1, 6, 0, False)] == ["w01", "w02 w03", "w04 w05", "w06 w07", "w07 w08"]
    assert [" ".join(words[a:b]) for a, b in C.packed([3] * 8, 1, 7, 0, True)] == ["w01 w02", "w03 w04", "w05 w06", "w07 w08"]
    assert list(C.packed([], 1, 7, 0, True)) == []


@given(st.lists(st.integers(1, 20), min_size=1, max_size=30), st.integers(0, 2), st.integers(0, 19))
def test_strict_packing(sizes, gap, overlap):
    runs = list(C.packed(sizes, gap, 20, overlap, True))
    length = lambda a, b: sum(sizes[a:b]) + gap * (b - a - 1)
    assert all(length(a, b) <= 20 for a, b in runs) and runs[0][0] == 0 and runs[-1][1] == len(sizes)
    assert all(x[1] >= y[0] > x[0] and y[1] > x[1] and (y[0] == x[1] or length(y[0], x[1]) <= overlap) for x, y in zip(runs, runs[1:]))
    assert all(length(x[0], x[1] + 1) > 20 for x in runs[:-1])


def test_section_parts():
    assert list(C.section_parts("# A\n\n", "A", ["x" * 30, "y" * 5, "z" * 5], 20)) == ["# A", "[continued] A\n\n" + "x" * 30, "[continued] A\n\n" + "y" * 5, "[continued] A\n\n" + "z" * 5]
    assert list(C.section_parts("# A\n\n", "A", [], 3)) == ["# A"]


def test_size_guard(spark):
    chunks = spark.createDataFrame([(1, 0, "short"), (1, 1, "word " * 30)], "doc_id int, chunk_id int, text string")
    rows = C.size_guarded(chunks, "doc_id", 40).collect()
    assert all(len(r.text) <= 40 for r in rows) and [r.text for r in rows if r.chunk_id == 0] == ["short"]
    assert " ".join(r.text for r in sorted(rows, key=lambda r: r.part_no) if r.chunk_id == 1).split() == ["word"] * 30


def test_recursive_chunks(spark):
    text = "First part.\n\n" + "word " * 300 + "\n\nLast part."
    rows = C.recursive_chunks(one(spark, text), "doc_id", "text", 100, 20, strict=True).collect()
    assert len(rows) > 10 and all(len(r.text) <= 100 for r in rows)
    assert C.recursive_chunks(one(spark, None), "doc_id", "text").count() == 0


def test_markdown(spark):
    text = "intro\n\n# A\n\nbody\n\n## B\n\nmore\n\n# C\n\nend"
    rows = C.markdown_chunks(one(spark, text), "doc_id", "text").orderBy("chunk_id").collect()
    assert [(r.heading_level, r.heading_path) for r in rows] == [(0, "Preamble"), (1, "A"), (2, "A > B"), (1, "C")]
    split = C.markdown_chunks(one(spark, "# A\n\n" + "\n\n".join(["x" * 50] * 4)), "doc_id", "text", 80).collect()
    assert any(r.text.startswith("[continued] A") for r in split) and all(r.is_split for r in split)


def test_html(spark):
    page = "<html><body><p>pre</p><h1>T</h1><p>a<b>b</b></p><h2>U</h2><div><h3>in</h3>c</div></body></html>"
    rows = C.html_chunks(one(spark, page), "doc_id", "text").orderBy("chunk_id").collect()
    assert [r.heading_path for r in rows][-2:] == ["T", "T > U"]
    assert any(r.heading == "in" for r in C.html_chunks(one(spark, page), "doc_id", "text", recursive=True).collect())


def test_sentence_offsets(spark):
    text = "One two.  Three four!\nFive?"
    rows = C.sentence_windows(one(spark, text), "doc_id", "text", 1, 1).orderBy("chunk_id").collect()
    assert [text[r.start_pos : r.end_pos] for r in rows] == ["One two.", "Three four!", "Five?"]


def sents(spark, angles):
    return spark.createDataFrame([(1, i, f"s{i}", [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "doc_id int, pos int, sentence string, embedding array<double>")


def test_percentile_counts(spark):
    angles = [0.01 * i * i for i in range(33)]
    for p in (10, 25, 40, 60, 75):
        assert S.by_percentile(sents(spark, angles), "doc_id", p).count() == math.floor(p / 100 * 31) + 2


def test_threshold_is_strict(spark):
    rows = S.by_threshold(sents(spark, [0, math.pi / 3, 2 * math.pi / 3 + 0.01]), "doc_id", 0.5 - 1e-12).orderBy("chunk_id").collect()
    assert [r.text for r in rows] == ["s0 s1", "s2"] and rows[1].avg_similarity == 1.0


VECTORS = [("a", [0.8, 0.6]), ("b", [0.6, 0.8]), ("c", [0.6, -0.8])]


def test_mmr(spark):
    df = spark.createDataFrame(VECTORS, "id string, v array<double>")
    rows = K.mmr(df, "id", "v", [1.0, 0.0], 3, 0.5).collect()
    assert [r.id for r in rows] == ["a", "c", "b"]
    assert [round(r.mmr_score, 6) for r in rows] == [0.4, 0.3, -0.18] and [round(r.redundancy, 6) for r in rows] == [0, 0, 0.96]
    assert [r.id for r in K.mmr(df, "id", "v", [1.0, 0.0], 9, 1.0).collect()] == ["a", "b", "c"]


def test_rrf(spark):
    def ranks(ids):
        return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")

    got = {r.id: round(r.score, 7) for r in K.rrf([ranks(["x", "y"]), ranks(["y", "z"])]).collect()}
    assert got == {"y": 0.0325225, "x": 0.0163934, "z": 0.016129}


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, None, None), (3, "b", 5)], "id int, t string, y int")

    def ids(f):
        return sorted(r.id for r in R.metadata_filter(df, f).collect())

    assert ids({"t": {"$ne": "a"}}) == [2, 3] and ids({"t": {"$nin": ["a"]}}) == [2, 3] and ids({"t": {"$in": ["a", "b"]}}) == [1, 3]
    assert ids({"y": {"$gt": 3}}) == [3] and ids({"y": {"$gte": 3, "$lt": 5}}) == [1] and ids({}) == [1, 2, 3]
    assert ids({"$or": [{"t": "a"}, {"y": 5}]}) == [1, 3]
    with pytest.raises(ValueError):
        R.condition({"t": {"$like": "a"}})


def test_implied_filters():
    assert R.implied_filter("papers since 2020 and before 2023") == {"year": {"$gte": 2020, "$lt": 2023}}
    assert R.implied_filter("In 2021, what?") == {"year": {"$eq": 2021}} and R.implied_filter("2021 things") == {}
    assert R.implied_filter("french or german", values={"language": {"german": "de", "french": "fr"}}) == {"language": "fr"}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) t").write.parquet(str(tmp_path / "t"))
    plan = R.metadata_filter(spark.read.parquet(str(tmp_path / "t")), {"id": {"$in": [1, 2]}, "t": {"$ne": "5"}})._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan and "Not(EqualNullSafe(t" in plan


def test_topk_plan_and_ties(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, float("nan")), (4, None)], "id int, s double")
    top = R.top_k(df, F.col("s"), "id", 2)
    assert [r.id for r in top.orderBy("rank").collect()] == [1, 3]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    zero, other = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.norm(F.col("a")).alias("n")).collect()
    assert zero.c == 0 and round(other.c, 6) == 0.96 and other.n == 5
    e = df.limit(1).select(V.pseudo_embedding(F.lit("x")).alias("x"), V.pseudo_embedding(F.lit("x")).alias("y"), V.pseudo_embedding(F.lit(None).cast("string")).alias("z")).first()
    assert e.x == e.y and len(e.x) == 64 and e.z is None


@pytest.mark.parametrize(("query", "want"), [("Explain the answer format", "standard"), ("What is gravity?", "direct"), ("Compare A and B", "iterative"), ("hello", "standard")])
def test_strategy(spark, query, want):
    assert spark.range(1).select(routing.strategy(F.lit(query)).alias("s")).first().s == want


def test_labels(spark):
    got = [r.x for r in spark.createDataFrame([(0.75,), (0.7499,), (0.45,), (0.4499,)], "s double").select(routing.relevance(F.col("s")).alias("x")).collect()]
    assert got == ["correct", "ambiguous", "ambiguous", "wrong"]
    c = spark.range(1).select(routing.composite(F.lit("relevant"), F.lit("fully"), F.lit("high")).alias("a"), routing.composite(F.lit("irrelevant"), F.lit("partially"), F.lit("medium")).alias("b")).first()
    assert round(c.a, 6) == 1.0 and round(c.b, 6) == 0.43


def test_calculate():
    assert routing.calculate("2 * (3 + 4)") == "Calculation result: 2 * (3 + 4) = 14"
    assert routing.calculate("__import__('os')").startswith("Calculation error") and routing.calculate(None).startswith("Calculation error")
    assert routing.calculate("9**9**9").startswith("Calculation error")


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "r") for i, (a, b) in enumerate(pairs)], "edge_pos int, source_id string, target_id string, relation_type string")


def test_traverse_order_and_cap(spark):
    e = edges(spark, [("e8", "e1"), ("e8", "e9"), ("e1", "e2"), ("e1", "e3"), ("e9", "e1"), ("e1", "e13")])
    start = spark.createDataFrame([(0, "e8"), (1, "e8")], "start_pos int, id string")
    rows = G.traverse(e, start, 2, 10).orderBy("visit").collect()
    assert [(r.parent_id, r.id) for r in rows] == [(None, "e8"), ("e8", "e1"), ("e8", "e9"), ("e1", "e2"), ("e1", "e3"), ("e1", "e13")]
    assert [r.id for r in G.traverse(e, start, 2, 2).orderBy("visit").collect()] == ["e8", "e1", "e9"]


def test_history_and_rewrite(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)], "conv_id int, turn int, role string, text string")
    rows = {r.turn: r for r in P.rewrite_turns(turns).collect()}
    assert rows[0].rewritten == "m0" and rows[2].rewritten == "m2 (in the context of: m1...)" and rows[8].transcript.count("\n") == 5


def test_appended_history(spark):
    rows = spark.range(1).select(F.lit(None).cast("array<struct<role:string,text:string>>").alias("h"))
    for k in range(4):
        rows = rows.withColumn("h", routing.appended(F.col("h"), F.lit("user"), F.lit(f"m{k}"), 3))
    assert [x.text for x in rows.first().h] == ["m1", "m2", "m3"]


def test_terms_of_all_scripts(spark):
    texts = ["Kovarianzschätzung, 2x!", "нейронная сеть", "向量索引", "فهرس المتجهات", "ab索c", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.terms(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["kovarianzschätzung", "2x"], ["нейронная", "сеть"], ["向量", "量索", "索引"], ["فهرس", "المتجهات"], ["ab", "索", "c"], None, []]


def test_blocks_of_queries(spark):
    items = spark.createDataFrame([(5, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (6, [1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0])], "id int, v array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 9.0])], "q int, w array<double>")
    rows = sorted((r.query_id, r["rank"], r.id, r.score) for r in R.top_k_batch(queries, items, "q", "w", "id", "v", 2).collect())
    assert rows == [(1, 1, 2, 1.0), (1, 2, 5, 1.0), (3, 1, 3, 1.0), (3, 2, None, round(0.5**0.5, 12))]
    assert R.top_k_batch(queries.where("q = 2"), items, "q", "w", "id", "v", 2).count() == 0
    with pytest.raises(ValueError):
        R.in_blocks(spark.range(R.MOST_QUERIES + 1).selectExpr("id q", "array(1.0d, 2.0d) w"), items, "q", "w", "id", "v")


def test_numbered(spark):
    from skein.plans.layout import numbered

    rows = [(i, (i * 37) % 11 if i % 3 else 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, s int")
    got = [(r.s, r.id, r.before) for r in numbered(df, [-F.col("s"), F.col("id")], 7).orderBy("rank").collect()]
    assert [(s, i) for s, i, _ in got] == [(s, i) for i, s in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert got[0][2] is None and all((-b.k0, b.k1) == (x[0], x[1]) for x, (_, _, b) in zip(got, got[1:]))
    assert numbered(df.where("id < 0"), [F.col("id")]).count() == 0


def test_mmr_of_many_queries_equals_one(spark):
    df = spark.createDataFrame([(q, i, v) for q in (1, 2) for i, v in VECTORS], "query_id int, id string, vector array<double>").withColumn("score", F.get("vector", F.lit(0)))
    rows = K.mmr_batch(df, 3, 0.5).orderBy("query_id", "rank").collect()
    assert [r.id for r in rows] == ["a", "c", "b"] * 2 and [round(r.mmr_score, 6) for r in rows[:3]] == [0.4, 0.3, -0.18]


def test_models_over_batches(spark):
    from skein.functions import models

    df = spark.createDataFrame([("a b", "B c"), (None, "x"), ("q", None)], "q string, t string")
    scorer = models.pair_scorer(models.shared_words)
    assert [None if r.s is None else round(r.s, 6) for r in df.select(scorer(F.col("q"), F.col("t")).alias("s")).collect()] == [0.5, None, None]
    encoder = models.batch_encoder(models.digest_vectors)
    for r in df.select(encoder(F.col("q")).alias("a"), V.pseudo_embedding(F.col("q")).alias("b")).collect():
        assert (r.a is None) == (r.b is None) and (r.a is None or max(abs(x - y) for x, y in zip(r.a, r.b)) < 1e-5)


def test_tools(spark):
    calls = spark.createDataFrame([(1, "summarize", "word " * 40), (2, "calculate", "1 +"), (3, "nothing", "x"), (4, "web_search", "zzz")], "query_id long, tool string, input string")
    docs = spark.createDataFrame([("d",)], "text string")
    facts = spark.createDataFrame([(0, "market", "It grew.")], "key_pos int, key string, value string")
    seen = {r.query_id: r.observation for r in P.call_tools(calls, P.standard_tools(docs, facts)).collect()}
    assert seen[1].startswith("Summary: word") and seen[1].endswith("... [truncated]") and seen[2].startswith("Calculation error")
    assert seen[3] == "Unknown tool: nothing" and seen[4] == "Web search: No highly relevant results found."


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    from skein.plans import layout

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda name, default: default)}), Context()

    with pytest.raises(RuntimeError):
        layout.shared_folder(Session())


def test_streaming_memory_equals_batch(spark, tmp_path):
    from skein.streaming.memory import remember

    turns = spark.createDataFrame([(str(c), t, "user" if t % 2 == 0 else "assistant", f"m{c}{t}") for c in range(3) for t in range(9)], "conv_id string, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t"))
    q = remember(stream).writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("memory_out").select("conv_id", "turn", "rewritten", "transcript").collect())
    assert got == sorted(tuple(r) for r in P.rewrite_turns(turns).select("conv_id", "turn", "rewritten", "transcript").collect())


def test_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# head\n---\n# second ---\nCHUNK_ID: 1\nTOPIC: a: b\nTEXT: one\nmore\n---\nCHUNK_ID: 2\nTEXT: two\n---\n\n---\nTOPIC: x\n")
    rows = files.records(files.whole_files(spark, str(tmp_path / "r.txt"))).orderBy("id").collect()
    assert [(r.id, r.topic, r.text) for r in rows] == [(1, "a", "one"), (2, None, "two")]


def test_vector_index_grows(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    files.append_index(one, path)
    files.append_index(one.selectExpr("id + 1 as id", "v"), path)
    assert sorted(r.id for r in files.read_index(spark, path).collect()) == [1, 2]
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [r.text for r in files.whole_files(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    assert files.inline(spark, [(1, "a")], "id int, t string").count() == 1


def test_vertices_and_graphs_of_many_queries(spark):
    v = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "id string, name string, description string")
    assert [r.name for r in G.vertex(v, "b").collect()] == ["B"] and G.vertex(v, "z").count() == 0
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    starts = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, None)], "query_id int, start_pos int, id string")
    got = sorted((r.query_id, r.visit, r.id) for r in G.traverse_all(e, starts, 2, 10).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b"), (2, 2, "a"), (2, 3, "c")]


def test_refined_and_decided(spark):
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 0.9, "long text")], "query_id long, rank int, score double, text string")
    web = spark.createDataFrame([("w",)], "text string")
    row = P.corrective_context(hits, web, queries, refine=lambda text, query: F.concat(F.substring(text, 1, 4), query)).first()
    assert row.context == "[VECTOR | 0.90] longa"


def test_corrective_branches(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 0.9, "x"), (1, 2, 0.5, "y"), (2, 1, 0.5, "z"), (3, 1, 0.1, "w")], "query_id long, rank int, score double, text string")
    web = spark.createDataFrame([(f"web{i}",) for i in range(5)], "text string")
    rows = {r.query_id: (r.action, r.context.count("[WEB]"), r.context.count("[VECTOR")) for r in P.corrective_context(hits, web, queries).collect()}
    assert rows == {1: ("correct", 1, 1), 2: ("ambiguous", 2, 1), 3: ("wrong", 3, 0)}


def test_structured_fallback(spark):
    facts = spark.createDataFrame([(0, "revenue", "r"), (1, "employee_count", "e"), (2, "product_count", "p")], "key_pos int, key string, value string")
    queries = spark.createDataFrame([(1, "Revenue count?"), (2, "zzz")], "query_id long, query string")
    rows = [(r.query_id, r.text, r.score) for r in P.structured_hits(queries, facts).orderBy("query_id", "rank").collect()]
    assert rows == [(1, "r", 1.0), (1, "e", 1.0), (2, "r", 0.5), (2, "e", 0.5)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c", "")], "a string, b string")
    r = df.select(T.word_count(F.col("a")).alias("a"), T.word_count(F.col("b")).alias("b"), T.trim_ws(F.lit("　x\n")).alias("t")).first()
    assert (r.a, r.b, r.t) == (3, 0, "x")


def test_shared_ends_of_repetitive_texts(spark, tmp_path):
    from skein import registry

    spark.createDataFrame([(1, "ab " * 300), (2, "x" * 700), (3, "".join(chr(97 + k * k % 23) for k in range(900))), (4, "-=" * 40 + "y" * 300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = {}
    for r in registry.fixed_chunks(spark, str(tmp_path)).orderBy("doc_id", "chunk_id").collect():
        chunks.setdefault(r.doc_id, []).append((r.chunk_id, r.text))
    longest = lambda a, b: max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])
    want = {(i, one[0]): longest(one[1], two[1]) for i, rows in chunks.items() for one, two in zip(rows, rows[1:])}
    assert max(want.values()) > 60
    assert {(r.doc_id, r.chunk_id): r.shared for r in registry.chunk_overlaps(spark, str(tmp_path)).collect()} == want


def test_shared_ends_of_long_chunks(spark):
    rows = spark.createDataFrame([(1, 0, "ab" * 1250), (1, 1, "ab" * 1250 + "c")], "doc_id long, chunk_id int, text string")
    assert [r.shared for r in C.shared_ends(rows, "doc_id").collect()] == [2500]


def test_best_in_blocks_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 8))
    x[rng.integers(0, 6000, 1500)] = x[7]
    items = spark.createDataFrame([(i, f"t{i * 7919 % 6000:04d}", v.tolist()) for i, v in enumerate(x)] + [(6000, "null", None), (6001, "nan", [float("nan")] * 8), (6002, "short", [1.0])], "id long, t string, v array<double>").repartition(3).cache()
    q = np.vstack([x[7], x[8], rng.normal(size=(1200, 8)), np.zeros(8)])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(-1, None)], "q long, w array<double>")
    found = R.best_in_blocks(asked, items, "q", "w", "id", "t", "v", 3).join(items.select("id", "t"), "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("t")))
    got = {(r.query_id, r.n): r.id for r in found.withColumn("n", place).where("n <= 3").collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims, last = np.round(unit(q) @ unit(x).T, 12), np.array([i * 7919 % 6000 for i in range(6000)])
    want = {(i, n + 1): int(j) for i, row in enumerate(sims) for n, j in enumerate(np.lexsort((-last, -row))[:3])}
    assert got == want


def test_corrective_pairs_hold_no_texts(spark):
    # texts of all pairs of a query and a document filled the disk
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(40)], "query_id long, query string")
    hits = spark.createDataFrame([(i, 1, 0.1, "w") for i in range(40)], "query_id long, rank int, score double, text string")
    web = spark.createDataFrame([(f"web{i}",) for i in range(500)], "text string")
    context = P.corrective_context(hits, web, queries)
    assert "NestedLoopJoin" not in context._jdf.queryExecution().executedPlan().toString()
    near = P.retrieve(queries.withColumn("query", F.concat(F.lit("detailed explanation of "), "query")), web)
    want = {q: "\n".join(f"[WEB] {r.text}" for r in sorted(rows, key=lambda r: r.rank)) for q, rows in ((i, [r for r in near.collect() if r.query_id == i]) for i in range(40))}
    assert {r.query_id: r.context for r in context.collect()} == want


def test_memory_of_any_number_of_turns(spark, monkeypatch):
    # more turns than one set of queries may hold ended in an error
    turns = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"what is {c * 10 + t}") for c in range(30) for t in range(5)], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    whole = sorted(map(tuple, P.with_memory(turns, docs).collect()))
    monkeypatch.setattr(R, "MOST_QUERIES", 16)
    assert len(whole) == 90 and sorted(map(tuple, P.with_memory(turns, docs).collect())) == whole


def test_memory_rag_takes_all_conversations(spark, tmp_path):
    # only every fiftieth user's turns were read; turns of no user have no query_id, as in the SQL
    from skein import registry

    events = [(i, f"2024-01-01 00:00:{i:02}", (1, 2, 50, None)[i % 4], ("view", None, "click")[i % 3]) for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i % 40, f"text {i}") for i in range(60)], "id int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    rows = registry.QUERIES["memory_rag"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id or 0, r.turn) for r in rows) == [(c, t) for c in (0, 1, 2, 50) for t in range(0, 10, 2)]
    assert {r.context for r in rows if r.conv_id is None} == {""} and not any(r.query_id for r in rows if r.conv_id is None)


def test_pairs_of_blocks_keep_ties_and_types(spark, monkeypatch):
    # blocks of both sides: the same rows as one set of queries, for doubles and floats, equal vectors and unusable ones
    odd = [None, [1.0], [float("nan")] * 3, [0.0, 0.0, 0.0]]
    vectors = [[float(i % 7), float(i % 5) - 2, float(i % 3)] for i in range(210)] + odd
    for kind in ("double", "float"):
        queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vectors[:90] + odd)], f"q string, v array<{kind}>").repartition(3)
        items = spark.createDataFrame([(i, f"t{i % 50}", v) for i, v in enumerate(vectors)], "id long, t string, v array<double>").repartition(5)

        def best():
            rows = R.best_in_blocks(queries, items, "q", "v", "id", "t", "v", 4).join(items, "id").selectExpr("query_id", "score", "t").collect()
            by = {}
            for r in rows:
                by.setdefault(r.query_id, []).append((r.score, r.t))
            return {q: sorted(x, reverse=True)[:4] for q, x in by.items()}

        whole = best()
        with monkeypatch.context() as m:
            m.setattr(R, "MOST_QUERIES", 16)
            m.setattr(R, "PACKED_ITEMS", 20)
            m.setattr(R, "TASK_ITEMS", 70)
            assert len(whole) == 91 and best() == whole
