"""Reading level of documents: regularised ordinal regression over features of their prose.

Features: sentence and word length, lexical diversity, rarity of words in the corpus, connectives, a proxy of
clause depth, and the mean grade of a text's words as graded texts use them. Words of scripts without spaces are
pairs of characters. Words are counted in a fixed number of hash buckets, so that every table that leaves the
executors has at most BUCKETS rows, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.layout import cut, spread

BUCKETS = 1 << 17
#: Bound of the labelled documents that the model is fitted on, taken in the order of a hash of their ids.
MOST_LABELLED = 20_000
LEVELS = (1, 2, 3, 4, 5)
#: Weight, in documents, of the mean grade in the grade of a word.
PRIOR = 2.0
RIDGE = 1.0
#: Words of a run in which different words are counted, so that long and short texts compare.
WINDOW = 200
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
URL = re.compile(r"(?:https?://|www\.|mailto:)\S+")
QUOTED = re.compile(r"(?:^|(?<=[\s]))>+\s[^\n\r]*", re.M)
LISTED = re.compile(r"^(?:[-*•]|\d{1,3}[.)])\s+")
ENDED = re.compile(r"[.!?…。！？।؟:;,\"”’'»」)][\s*_]*$")
THAI_OR_HAN = re.compile(r"[぀-ヿ一-鿿฀-๿]")
#: Thai has no marks at sentence ends; its spaces stand for them.
THAI, SPACE = re.compile(r"[฀-๿]"), re.compile(r"\s+")
SPACED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN = re.compile(r"[぀-ヿ一-鿿฀-๿]+|[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?…]+[\"”’'»)]*(?=\s|$)|[。！？।؟]+|\n")
CLAUSE_MARK = re.compile(r"[,;:，、；：،؛—–]")
#: Connectives and subordinating words; of Chinese and Japanese those of two characters, as words are pairs there.
CONNECTIVES = frozenset(
    "however therefore thus hence whence moreover nevertheless nonetheless notwithstanding although though whereas unless because since while insofar conversely whereby wherein lest whose which irrespective "
    "jedoch daher deshalb dennoch ungeachtet obwohl während weil inwiefern wenngleich welche sofern sodass "
    "cependant donc toutefois néanmoins nonobstant bien lorsque puisque dont laquelle ainsi "
    "sin embargo pues aunque mientras porque cuya cuyo obstante ende "
    "однако поэтому хотя поскольку невзирая посредством отсюда следует нежели которые "
    "因此 所以 然而 虽然 因为 尽管 由于 从而 此外 ため ので のに 故に 即ち 一方 "
    "وعلى فإن أن التي الذي إلا अतः जिसकी बावजूद परंतु यद्यपि जो".split()
)
NAMES = ("length", "log_words", "sentence", "long_sentence", "word", "long_words", "diversity", "rarity", "rare", "connectives", "clauses", "grade", "grade_high", "grade_low", "grade_spread", "unspaced")


def prose(text: str | None) -> str:
    """A text without code, headings, tables, link lists, quoted lines and addresses."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2029", "\n\n").replace("\u2028", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n\n", text)
    if ">" in text:
        text = QUOTED.sub(" ", text)
    linked = any(mark in text for mark in ("://", "www.", "mailto:"))
    out = []
    for paragraph in re.split(r"\n[^\S\n]*\n", text):
        lines = []
        for line in paragraph.split("\n"):
            bare = line.strip()
            if not bare or bare[0] in "#|" or bare.count("|") > 2 or line.startswith(("    ", "\t")) or not (URL.sub("", bare) if linked else bare).strip(" -*•()<>[]·"):
                continue
            if bare[0] in "-*•" or bare[0].isdecimal():
                bare = LISTED.sub("", bare)
            lines.append(URL.sub(" ", bare) if linked else bare)
        if len(lines) == 1 and len(lines[0]) < 60 and not ENDED.search(lines[0]) and not THAI_OR_HAN.search(lines[0]):
            continue
        out.append("\n".join(lines))
    return "\n\n".join(p for p in out if p)


class Known(dict):
    """What a worker remembers of words, in one number: bucket, length and whether a connective; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode()) % BUCKETS | min(len(word), 4095) << 20 | (word in CONNECTIVES) << 32
        return out


_known = Known()


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not THAI_OR_HAN.search(text):
        return SPACED.findall(text)
    out: list[str] = []
    for w in TOKEN.findall(text):
        if THAI_OR_HAN.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


@dataclass
class Measures:
    """What a text's prose yields before corpus tables are known."""

    buckets: np.ndarray
    plain: list[float]
    size: int


def diversity(ids: np.ndarray, window: int = WINDOW) -> float:
    """The mean number of different words in all runs of `window` consecutive words, over window ** 0.8."""
    n = len(ids)
    window = min(n, window)
    # a word counts in the runs that hold it but not its occurrence before
    by = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    again = ids[by[1:]] == ids[by[:-1]]
    before[by[1:][again]] = by[:-1][again]
    at = np.arange(n)
    runs = np.minimum(at, n - window) - np.maximum(before, at - window)
    return float(np.maximum(runs, 0).sum() / (n - window + 1) / window**0.8)


def measure(text: str | None) -> Measures | None:
    body = prose(text)
    words = words_of(body)
    if len(words) < 3:
        return None
    n = len(words)
    of = np.fromiter(map(_known.__getitem__, words), np.int64, n)
    ids, lengths = of & 0xFFFFF, of >> 20 & 0xFFF
    mixed = bool(THAI_OR_HAN.search(body))
    pieces = [p for p in (SPACE if THAI.search(body) else SENTENCE_END).split(body) if p.strip()]
    per = np.array(([len(p) / 2 if THAI_OR_HAN.search(p) else p.strip().count(" ") + 1 for p in pieces] if mixed else [p.strip().count(" ") + 1 for p in pieces]) or [n])
    unspaced = sum(map(bool, map(THAI_OR_HAN.match, words))) / n if mixed else 0.0
    plain = [
        np.log1p(len(body)), np.log1p(n), np.log1p(per.mean()), float((per > 25).mean()), float(lengths.mean()), float((lengths > 8).mean()),
        diversity(ids), float((of >> 32).mean()), len(CLAUSE_MARK.findall(body)) / max(1, len(pieces)), unspaced,
    ]
    return Measures(ids, plain, n)


def features(m: Measures, rarity: np.ndarray, total: np.ndarray, count: np.ndarray, mean: float, own: float | None = None) -> np.ndarray:
    """The row of a text; own is the text's own level, which is taken out of its words' grades when fitting."""
    ids = m.buckets
    n, s = count[ids], total[ids]
    if own is not None:
        s, n = s - own * (n > 0), np.maximum(n - 1, 0)
    grade = (s + PRIOR * mean) / (n + PRIOR)
    trust = n / (n + PRIOR)
    weight = trust * (0.05 + np.abs(grade - mean))
    whole = weight.sum() + 1e-9
    rare = rarity[ids]
    middle = float((grade * weight).sum() / whole)
    plain = m.plain
    return np.array([
        plain[0], plain[1], plain[2], plain[3], plain[4], plain[5], plain[6], float(rare.mean()), float((rare > 7).mean()), plain[7], plain[8],
        middle, float((weight * (grade > mean + 0.7)).sum() / whole), float((weight * (grade < mean - 0.5)).sum() / whole), float(np.sqrt((weight * (grade - middle) ** 2).sum() / whole)), plain[9],
    ])


@dataclass
class Ordinal:
    """Cumulative logits P(level > k) = sigmoid(x.w - cut_k), with a ridge penalty on w."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def level(self, x: np.ndarray) -> np.ndarray:
        score = ((x - self.center) / self.scale).clip(-6, 6) @ self.weights
        return 1 + (score[:, None] > self.cuts[None]).sum(axis=1)


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> Ordinal:
    """Newton's method on the sum of the four cumulative logistic losses, with shared weights."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - center) / scale).clip(-6, 6)
    d, k = z.shape[1], len(LEVELS) - 1
    theta = np.concatenate([np.zeros(d), np.linspace(-1, 1, k)])
    above = (y[:, None] > np.arange(1, k + 1)[None]).astype(float)
    for _ in range(rounds):
        score = (z @ theta[:d])[:, None] - theta[d:][None]
        p = 1 / (1 + np.exp(-score.clip(-30, 30)))
        gap, bend = p - above, p * (1 - p) + 1e-6
        gradient = np.concatenate([z.T @ gap.sum(axis=1) + ridge * theta[:d], -gap.sum(axis=0)])
        hessian = np.zeros((d + k, d + k))
        hessian[:d, :d] = z.T @ (z * bend.sum(axis=1)[:, None]) + ridge * np.eye(d)
        hessian[:d, d:] = -(z.T @ bend)
        hessian[d:, :d] = hessian[:d, d:].T
        hessian[d:, d:] = np.diag(bend.sum(axis=0) + 1e-3)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-9))
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ordinal(center, scale, theta[:d], np.sort(theta[d:]))


def measured(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, plain, buckets) of every row, null where there is no prose."""
    rows = spread(documents.select(ident, text), ident)
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [measure(t) for t in part.column(1).to_pylist()]
                plain = pa.array([m and m.plain for m in found], pa.list_(pa.float64()))
                buckets = pa.array([None if m is None else m.buckets.astype(np.int32) for m in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), plain, buckets], [ident, "plain", "buckets"])

    return rows.mapInArrow(run, f"`{ident}` {kind}, plain array<double>, buckets array<int>")


def each(batch: pa.RecordBatch, plain: int, buckets: int) -> Iterator[Measures | None]:
    """The measures of a batch's rows."""
    values, offsets = batch.column(buckets).values.to_numpy(zero_copy_only=False), batch.column(buckets).offsets.to_numpy()
    for k, p in enumerate(batch.column(plain).to_pylist()):
        yield None if p is None else Measures(values[offsets[k] : offsets[k + 1]].astype(np.int64), p, int(offsets[k + 1] - offsets[k]))


def bucket_counts(rows: DataFrame, level: bool) -> DataFrame:
    """(bucket, n, s) of (plain, buckets[, level]): texts that hold a word of the bucket, and the sum of their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
        for batch in batches:
            levels = batch.column(2).to_pylist() if level else [0.0] * batch.num_rows
            for m, y in zip(each(batch, 0, 1), levels):
                if m is not None:
                    ids = np.unique(m.buckets)
                    n[ids] += 1
                    s[ids] += y
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n[ids]), pa.array(s[ids])], ["bucket", "n", "s"])

    return rows.mapInArrow(run, "bucket int, n long, s double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def graded(rows: DataFrame, labels: DataFrame, ident: str, most: int = MOST_LABELLED) -> DataFrame:
    """(plain, buckets, level) of at most `most` labelled documents: the mean over raters of the levels on the scale."""
    level = F.col("reading_level").cast("double")
    clean = labels.where(level.between(min(LEVELS), max(LEVELS)) & F.col(ident).isNotNull()).select(F.col(ident), "rater", level.alias("level"))
    per = clean.groupBy(ident, "rater").agg(F.avg("level").alias("level")).groupBy(ident).agg(F.avg("level").alias("level"))
    chosen = per.orderBy(F.xxhash64(ident), ident).limit(most)
    one = rows.where(F.col("plain").isNotNull()).join(chosen, ident).groupBy(ident).agg(F.max(F.struct("buckets", "plain", "level")).alias("_r"))
    return one.select("_r.plain", "_r.buckets", "_r.level")


def reading_levels(documents: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, level, n_words): the reading level 1 to 5 of each document's prose.

    Defined results: a document without prose (null, empty, only headings, code, links or quoted lines) has a null
    level; with no usable label at all every level is null; rows are kept one for one. Labels off the scale, null,
    or of unknown documents are left out, and raters of one document are averaged. Corpus counts cover all
    documents; only the fit is bounded, by MOST_LABELLED documents.
    """
    spark = documents.sparkSession
    rows = cut(measured(documents, ident, text))
    rarity = np.zeros(BUCKETS)
    # every collected table below has at most BUCKETS or MOST_LABELLED rows of fixed width
    seen = bucket_counts(rows.select("plain", "buckets"), False).toPandas()
    total_documents = max(1, rows.where(F.col("plain").isNotNull()).count())
    rarity[:] = np.log1p(total_documents)
    rarity[seen.bucket] = np.log((1 + total_documents) / (1 + seen.n))
    sample = graded(rows, labels, ident)
    words = bucket_counts(sample, True).toPandas()
    total, count = np.zeros(BUCKETS), np.zeros(BUCKETS)
    total[words.bucket], count[words.bucket] = words.s, words.n
    mean = float(total.sum() / max(1, count.sum())) if len(words) else 3.0
    tables = spark.sparkContext.broadcast((rarity.astype(np.float32), total.astype(np.float32), count.astype(np.float32), mean))

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for m, y in zip(each(batch, 0, 1), batch.column(2).to_pylist()):
                xs.append(features(m, *tables.value, own=y).tolist())
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["x", "y"])

    fit = sample.mapInArrow(training, "x array<double>, y double").toPandas()
    kind = rows.schema[ident].dataType.simpleString()
    model = fit_ordinal(np.stack(fit.x), fit.y.to_numpy()) if len(fit) else None

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, sizes = [], []
            for m in each(batch, 1, 2):
                sizes.append(m.size if m else 0)
                levels.append(int(model.level(features(m, *tables.value)[None])[0]) if m and model else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(sizes, pa.int32())], [ident, "level", "n_words"])

    return rows.mapInArrow(scoring, f"`{ident}` {kind}, level int, n_words int")
