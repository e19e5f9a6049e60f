import numpy as np

from skein.llm.topn import normal_query, top_n


def brute(rows, n, low=None, high=None):
    groups = {}
    for g, s, i in set(rows):
        if g is not None and i is not None and s is not None and s == s and (low is None or low <= s) and (high is None or s <= high):
            groups.setdefault(g, set()).add((-s, i))
    return sorted((g, -s, i) for g, v in groups.items() for s, i in sorted(v)[:n])


def run(spark, rows, *args, parts=5):
    df = spark.createDataFrame(rows, "q string, s double, r long").selectExpr("q", "s", "r", "'x' as `group`", "1.0 as score", "2 as id").repartition(parts)
    return sorted((r.group, r.score, r.id) for r in top_n(df, "q", "s", "r", *args).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.integers(300)}", float(rng.integers(0, 20)) / 20, i) for i in range(4000)]
    rows += rows[:200] + [("g1", float("nan"), 9001), ("g1", None, 9002), ("g1", float("inf"), 9003), ("g2", -3.0, 9004), (None, 0.5, 9005), ("g3", 0.5, None), ("only", -0.0, 9006)]
    for n in (1, 5, 50):
        assert run(spark, rows, n, -1.0, 1.0) == brute(rows, n, -1.0, 1.0)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_batches_break_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a", 0.5, i) for i in range(10)] * 2 + [("b", 0.1 * i, i) for i in range(10)]
        assert run(spark, rows, 4, parts=1) == brute(rows, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_empty_and_queries(spark):
    assert run(spark, [], 5) == []
    df = spark.createDataFrame([(" A\tB  c ",), (None,), ("a b C",)], "q string")
    assert [r[0] for r in df.select(normal_query(df.q)).collect()] == ["a b c", None, "a b c"]
