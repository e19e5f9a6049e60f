from collections import Counter

import numpy as np
import pytest

from skein.llm import neardup


def brute(rows, least=8, similarity=0.7):
    bags = {}
    for i, t in rows:
        if i is not None and t is not None and len(w := neardup.words(t)) >= least:
            bags.setdefault(i, []).append(Counter(w))
    out = set()
    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in bags[a]:
                for y in bags[b]:
                    common = sum((x & y).values())
                    if common >= similarity * (x.total() + y.total() - common) - 1e-9:
                        out.add((a, b))
    return out


def corpus(seed=3, families=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, ident = [], 0
    for _ in range(families):
        base = list(rng.choice(vocabulary, 40))
        for _ in range(int(rng.integers(1, 7))):
            words = list(base)
            for _ in range(int(rng.integers(0, 9))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                rng.shuffle(words)
            rows.append((ident, " ".join(words) + ("." if rng.random() < 0.5 else " !")))
            ident += 1
    rows += [(0, rows[0][1]), (900, rows[1][1].upper()), (901, rows[1][1]), (902, None), (903, ""), (904, "too few words"), (None, rows[2][1]), (905, "Ａ b c d e f g h"), (906, "a b c d e f g h")]
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "'x' as bag", "1 as n", "2 as class")
    return {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, "id", "text").collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_split_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    rows = corpus(5, 6) + [(2000 + k, " ".join(f"c{j}" for j in range(30)) + f" u{k}") for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string")
    out = neardup.near_duplicate_groups(df, "id", "text").collect()
    group = {r.id: r.group for r in out}
    parent = {i: i for i in group}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in group} == group
    assert {r.id for r in out} == {i for i, t in rows if i is not None and t and len(neardup.words(t)) >= 8}


def test_groups_of_long_chains(spark):
    # every record is similar to the one before and the one after only
    ids = np.random.default_rng(4).permutation(200).tolist()
    rows = [(i, " ".join(f"c{2 * k + j}" for j in range(20))) for k, i in enumerate(ids)]
    assert len(brute(rows)) == 199
    out = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {(r.id, r.group) for r in out} == {(i, 0) for i in ids}


def test_unsettled_groups_raise(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    with pytest.raises(RuntimeError):
        neardup.smallest_linked(links, 1)
    assert {r.group for r in neardup.smallest_linked(links).collect()} == {0}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert neardup.near_duplicate_pairs(df, "id", "text").count() == 0
    assert neardup.near_duplicate_groups(df, "id", "text").count() == 0


def test_bits_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (10, 80, 2000):
        a, b = ([f"x{k}" for k in rng.integers(0, n, n)] for _ in range(2))
        flat, starts = neardup.elements([a, b])
        bits = neardup.bitmaps(flat, starts)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(flat[: starts[1]], flat[starts[1] :]))
        assert len(np.intersect1d(flat[: starts[1]], flat[starts[1] :])) == sum((Counter(a) & Counter(b)).values())


@pytest.mark.parametrize("held", [10, 1000])
def test_meetings_are_the_shared_buckets(held, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "SLICE", 8)
    monkeypatch.setattr(neardup, "HELD", held)
    rng = np.random.default_rng(held)
    slices = neardup.Slices(150)
    key = np.concatenate([rng.integers(0, 60, 150), np.full(40, 30), np.full(9, 59)]).astype(np.uint64) << np.uint64(slices.shift - 2)
    classes = rng.integers(0, 12, len(key))
    parts = [slices.pack(key[a : a + 50], classes[a : a + 50]) for a in range(0, len(key), 50)]
    packed = sorted((r for b in parts for r in b.to_pylist()), key=lambda r: r["slice"])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist(packed[k : k + 3], parts[0].schema) for k in range(0, len(packed), 3)]
    out = [tuple(r.values()) for b in slices.meetings(iter(batches)) for r in b.to_pylist()]
    buckets = {k: set(classes[key == k].tolist()) for k in key.tolist()}
    assert {(k, c) for k, c, _ in out} == {(k, c) for k, v in buckets.items() if len(v) > 1 for c in v}
    assert {k for k, _, large in out if large} == {k for k, v in buckets.items() if len(v) > 4}
    assert len([r for r in out if not r[2]]) == sum(len(v) for v in buckets.values() if 1 < len(v) <= 4)
