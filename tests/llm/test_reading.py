import os

import numpy as np
import pytest

from skein.llm import reading
from skein.llm.reading import fit_ordinal, prose, reading_levels

DATA = "/root/testdata/sf0.01"


def test_prose():
    text = "# Head\n\n```py\ncode()\n```\n\nPlain words here.\n> quoted line\nhttps://a.example/b\n\n    SELECT 1\n\n- an item of words.\n\nNorvik 42"
    assert prose(text).split() == "Plain words here. an item of words.".split()
    assert prose(None) == prose("") == prose("## x\n\nhttps://a.example") == ""


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = np.clip(np.round(3 + 1.2 * x[:, 0] - 0.6 * x[:, 1] + 0.2 * rng.normal(size=800)), 1, 5)
    model = fit_ordinal(x, y)
    assert (np.abs(model.level(x) - y) <= 1).mean() > 0.98 and np.all(np.diff(model.cuts) >= 0)


def frame(spark):
    easy, hard = "The cat sat on the mat and it was fun. ", "Notwithstanding heterogeneity, posterior indeterminacy obviates commensurable inference. "
    rows = [(i, (easy if i % 2 else hard) * (3 + i % 5), 1) for i in range(120)]
    rows += [(500, None, 1), (501, "", 1), (502, "# only a heading", 1), (503, hard * 3000, 1), (504, easy, 1), (504, easy, 1)]
    labels = [(i, f"r{i % 3}", 1 if i % 2 else 5) for i in range(0, 80)] + [(1, "r1", 9), (2, "r2", None), (999, "r1", 3), (3, "r0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, level int"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")


def test_levels(spark):
    docs, labels = frame(spark)
    rows = reading_levels(docs, labels).collect()
    got = {r.doc_id: r.level for r in rows}
    assert len(rows) == 126 and [got[k] for k in (500, 501, 502)] == [None] * 3 and got[503] >= 4
    assert all((got[i] <= 2) if i % 2 else (got[i] >= 4) for i in range(80, 120))


def test_no_labels_and_no_rows(spark):
    docs, labels = frame(spark)
    assert {r.level for r in reading_levels(docs, labels.where("doc_id = -1")).collect()} == {None}
    assert reading_levels(docs.where("doc_id = -1"), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/reading_labels.parquet")
    fit, held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 > 0), labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 0) & F.col("reading_level").between(1, 5))
    got = reading_levels(docs, fit).join(held.groupBy("doc_id").agg(F.avg("reading_level").alias("y")), "doc_id").where("level is not null").toPandas()
    assert len(got) > 10 and (np.abs(got.level - got.y) <= 1).mean() >= 0.8


def test_diversity_of_the_whole_text():
    rng = np.random.default_rng(5)
    for n in (3, 150, 200, 201, 700):
        ids = rng.integers(0, 120, n)
        w = min(n, 200)
        want = np.mean([len(set(ids[a : a + w])) for a in range(n - w + 1)]) / w**0.8
        assert abs(reading.diversity(ids) - want) < 1e-9
    names = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "rstvxz"]
    opening, body = " ".join(["the cat sat on the mat."] * 40), " ".join(" ".join(names[k : k + 12]) + "." for k in range(0, 240, 12)) + " "
    value = lambda t: reading.measure(t).plain[6]
    assert value(opening + " " + body * 4) > 3 * value(opening)


def test_unspaced_share_of_the_whole_text():
    text = "plain words stand here. " * 120 + "\u4f60\u597d\u4e16\u754c\u3002" * 200
    words = reading.words_of(reading.prose(text))
    share = sum(bool(reading.THAI_OR_HAN.match(w)) for w in words) / len(words)
    assert share > 0.3 and reading.measure(text).plain[-1] == share
