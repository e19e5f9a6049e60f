import numpy as np
import pytest

from skein.llm import knn


def clustered(n, dim=16, clusters=40, noise=0.3, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    return (centers[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def truth(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def run(spark, rows, k=5, dim=16):
    df = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("id", "embedding", "1 as vec", "2 as shard", "3 as h")
    out = {}
    for r in knn.nearest_neighbours(df, "id", "embedding", dim, k).collect():
        out.setdefault(r.id, []).append((r["rank"], r.neighbour, r.similarity))
    return {i: [n for _, n, _ in sorted(v)] for i, v in out.items()}


def recall(got, want, k):
    return np.mean([len(set(got[i]) & set(want[i])) / k for i in range(len(want))])


def test_recall_one_shard(spark):
    x = clustered(3000)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall(got, truth(x, 5), 5) >= 0.95 and all(len(set(v)) == 5 and i not in v for i, v in got.items())


def test_recall_many_shards(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 500)
    x = clustered(4000, clusters=150)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall(got, truth(x, 5), 5) >= 0.9


def around(rng, direction, n, noise, dim=64):
    return direction / np.linalg.norm(direction) * 8 + noise * rng.normal(size=(n, dim))


UNPLANTED = {
    "no structure": lambda rng: rng.normal(size=(4000, 64)),
    "loose clusters": lambda rng: np.concatenate([around(rng, d, 400, 1.0) for d in rng.normal(size=(12, 64))]),
    "one group holds three quarters": lambda rng: np.concatenate([around(rng, rng.normal(size=64), 3000, 0.5), rng.normal(size=(1000, 64))]),
    "one group holds a third": lambda rng: np.concatenate([around(rng, rng.normal(size=64), 1500, 0.5), *(around(rng, d, 250, 0.7) for d in rng.normal(size=(12, 64)))]),
}


@pytest.mark.parametrize("name", UNPLANTED)
def test_recall_without_planted_groups(spark, monkeypatch, name):
    # eight shards or more, every vector a query
    monkeypatch.setattr(knn, "SHARD", 450)
    monkeypatch.setattr(knn, "SAMPLE_PER_SHARD", 128)
    x = UNPLANTED[name](np.random.default_rng(17)).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], dim=64)
    assert recall(got, truth(x, 5), 5) >= 0.9


def test_parts_of_outgrown_shards():
    # a third of the vectors fall to one centroid: its shard is split, everyone is indexed once and asks all parts
    rng = np.random.default_rng(3)
    x = np.concatenate([around(rng, rng.normal(size=64), 2000, 1.5), *(around(rng, d, 400, 0.5) for d in rng.normal(size=(10, 64)))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = knn.Router(x[::4], 6, 40 * knn.SHARD)
    assert router.total > 6
    row, part, role = router.route(x)
    assert np.bincount(row[role == 0], minlength=len(x)).tolist() == [1] * len(x)
    assert len({*zip(row.tolist(), part.tolist())}) == len(row) and part.max() < router.total
    indexed = set(part[role == 0].tolist())
    assert indexed == set(range(router.total))


def test_recall_dense_group_over_many_shards(spark, monkeypatch):
    # a third of the vectors lie around one direction and fill several shards
    monkeypatch.setattr(knn, "SHARD", 400)
    rng = np.random.default_rng(6)
    center = rng.normal(size=16)
    hot = center / np.linalg.norm(center) + 0.45 / 4 * rng.normal(size=(2000, 16))
    x = np.concatenate([hot, clustered(4000, clusters=100)]).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    want = truth(x, 5)[:2000]
    assert recall(got, want, 5) >= 0.9


def test_unstructured_vectors():
    x = np.random.default_rng(2).normal(size=(2000, 16)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = knn.search_shard(np.arange(2000), u, np.arange(2000), u, 5)
    assert recall(dict(enumerate(ids.tolist())), truth(x, 5), 5) >= 0.9


def test_copies_and_unusable_rows(spark):
    x = clustered(300)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(150)]  # a third are copies of one vector
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 5), (2004, [float("inf")] * 16), (None, x[1].tolist()), (3, x[3].tolist()), (2005, [None] * 16), (2006, [])]
    got = run(spark, rows)
    assert set(got) == {*range(300), *range(1000, 1150)}
    assert got[0] == [1000, 1001, 1002, 1003, 1004] and got[1100] == [0, 1000, 1001, 1002, 1003]
    assert all(len(v) == 5 for v in got.values())


def test_few_vectors(spark):
    assert run(spark, []) == {} and run(spark, [(1, [1.0] * 16)]) == {}
    assert run(spark, [(1, [1.0] * 16), (2, [2.0] * 16), (3, [1.0] * 15 + [0.0])]) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
