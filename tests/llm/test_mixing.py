import numpy as np
import pytest

from skein.llm.mixing import balance, mix_plan, mix_sources, normal_source, short_sources


def frames(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ("Web Pages", "web-pages ", "books", "CODE", "other", None)[int(rng.choice(6, p=[0.3, 0.1, 0.3, 0.1, 0.15, 0.05]))], int(rng.integers(0, 400)), 1) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, slope int")
    targets = spark.createDataFrame([("web_pages", 0.5, 2), ("books", 0.1, 1), ("code", 0.3, 2), ("missing", 0.1, 3)], "source string, target_share double, max_passes int")
    return rows, docs, targets


def test_mix(spark):
    rows, docs, targets = frames(spark)
    copies, report = mix_sources(docs, targets, "doc_id")
    out = {r.source: r for r in report.collect()}
    whole = sum(r[2] for r in rows)
    assert out["code"].short and out["missing"].short and not out["books"].short and not out["web_pages"].short
    assert abs(out["books"].mixed / (0.1 * whole) - 1) < 0.05 and abs(out["web_pages"].mixed / (0.5 * whole) - 1) < 0.05
    assert out["code"].mixed == 2 * sum(r[2] for r in rows if r[1] == "CODE")
    assert abs(sum(r.share for r in out.values()) - 1) < 1e-9
    made = copies.collect()
    passes = {"web_pages": 2, "books": 1, "code": 2}
    assert all(0 <= r.copies <= passes[r.source] for r in made) and len({r.doc_id for r in made}) == len(made)
    assert sorted(r.source for r in short_sources(docs, targets).collect()) == ["code", "missing"]


def test_rates_solve_the_dual(spark):
    # against bisection over the single documents
    rows, docs, _ = frames(spark)
    targets = spark.createDataFrame([("web_pages", 0.004, 2), ("books", 0.299, 1), ("code", 0.15, 3), ("other", 0.001, 1)], "source string, target_share double, max_passes int")
    whole = sum(r[2] for r in rows)
    for p in mix_plan(docs, targets, "doc_id")[0].collect():
        n = np.array([r[2] for r in rows if r[1] and r[1].strip().lower().replace(" ", "_").replace("-", "_") == p.source])
        n = n[n > 0]
        tokens = lambda slope: (n * np.minimum(p.max_passes, np.exp(np.minimum(slope * n, 50)))).sum()  # noqa: E731, B023
        assert not p.short and abs(tokens(p.slope) / (p.target_share * whole) - 1) < 1e-8
        low, high = -200.0, 200.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if tokens((low + high) / 2) < p.target_share * whole else (low, (low + high) / 2)
        assert abs(p.slope - low) < 1e-6 and 0 < p.rounds < 60


@pytest.mark.parametrize("part", [1_000_000, 100])
def test_report_states_its_tolerance(spark, monkeypatch, part):
    monkeypatch.setattr("skein.llm.mixing.PART", part)
    _, docs, targets = frames(spark)
    copies, report = mix_sources(docs, targets, "doc_id")
    rows = report.collect()
    assert all(r.within for r in rows) and all(r.short or abs(r.mixed - r.goal) <= 2 * r.largest for r in rows)
    # documents of one size and source differ by no more than a copy, and the same ones come out again
    made = sorted((r.doc_id, r.source, r.n_tokens, r.copies) for r in copies.collect())
    assert made == sorted((r.doc_id, r.source, r.n_tokens, r.copies) for r in mix_sources(docs, targets, "doc_id")[0].collect())
    by = {}
    for _, s, n, c in made:
        by.setdefault((s, n), set()).add(c)
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_unsettled_rounds_raise(spark, monkeypatch):
    monkeypatch.setattr("skein.llm.mixing.MOST_ROUNDS", 2)
    sizes = spark.createDataFrame([("a", 3, 50), ("a", 700, 9)], "source string, n_tokens long, documents long")
    targets = spark.createDataFrame([("a", 1234.5, 2)], "source string, goal double, max_passes int")
    with pytest.raises(RuntimeError):
        balance(sizes, targets)


def test_short_sources_follow_from_the_rounds(spark, monkeypatch):
    _, docs, targets = frames(spark)
    plan = {r.source: r for r in mix_plan(docs, targets)[0].collect()}
    assert plan["code"].short and plan["code"].rounds > 1 and not plan["books"].short and plan["books"].rounds > 1
    # all documents twice are 12,900 tokens; a millionth of a token more or less decides
    sizes = spark.createDataFrame([(k, n, d) for k in "abcd" for n, d in ((3, 50), (700, 9))], "source string, n_tokens long, documents long")
    goals = spark.createDataFrame([("a", 12900.0, 2), ("b", 12900.000001, 2), ("c", 12899.999999, 2), ("d", 6450.5, 1)], "source string, goal double, max_passes int")
    assert {s["source"]: s["short"] for s in balance(sizes, goals)} == {"a": False, "b": True, "c": False, "d": True}
    monkeypatch.setattr("skein.llm.mixing.MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        short_sources(docs, targets)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", 0), (None, "A ", 10), (3, None, 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("A", 0.2, 2), (None, 0.5, 1), ("b", None, None)], "source string, target_share double, max_passes int")
    copies, report = mix_sources(docs, targets, "doc_id")
    assert {r.source: r.short for r in report.collect()} == {"A": False, "b": False} and copies.count() == 1
    empty = docs.where("doc_id = 9")
    assert mix_sources(empty, targets, "doc_id")[0].count() == 0 and short_sources(empty, targets).count() == 0


@pytest.mark.parametrize("name", ["  Forum Answers", "forum-answers", "FORUM__answers\n", "forum _ answers"])
def test_names(spark, name):
    df = spark.createDataFrame([(name,)], "s string")
    assert df.select(normal_source(df.s)).first()[0] == "forum_answers"
