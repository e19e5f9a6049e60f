"""Exact retrieval over rows that hold their vector: filters, top-k, thresholds, score distributions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.layout import numbered

COMPARISONS = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


def condition(filters: dict) -> Column:
    """A metadata filter as one Column that parquet scans can push down.

    A bare value means equality, a dict of operators their conjunction, several fields their conjunction, and
    "$or" a list of filters of which one must hold. Nulls: equality, $in, comparisons and $contains fail on a
    null field, $ne and $nin pass. Unknown operators raise ValueError; an empty filter passes every row.
    """
    parts: list[Column] = []
    for field, want in filters.items():
        if field == "$or":
            parts.append(reduce(Column.__or__, [condition(f) for f in want]) if want else F.lit(False))
            continue
        column = F.col(field)
        if not isinstance(want, dict):
            parts.append(column.eqNullSafe(want))
            continue
        for name, value in want.items():
            if name in COMPARISONS:
                parts.append(COMPARISONS[name](column, F.lit(value)))
            elif name == "$in":
                parts.append(column.isin(list(value)))
            elif name == "$nin":
                parts.append(column.isNull() | ~column.isin(list(value)))
            elif name == "$ne":
                parts.append(~column.eqNullSafe(value))
            elif name == "$eq":
                parts.append(column.eqNullSafe(value))
            elif name == "$contains":
                parts.append(F.contains(F.lower(column), F.lit(str(value).lower())))
            else:
                raise ValueError(f"unknown operator {name}")
    return reduce(Column.__and__, parts) if parts else F.lit(True)


#: What the words before a year ask of it.
YEARS = {"since": "$gte", "from": "$gte", "after": "$gt", "before": "$lt", "until": "$lte", "in": "$eq", "of": "$eq"}


def implied_filter(query: str, field: str = "year", values: dict[str, dict[str, str]] | None = None) -> dict:
    """The metadata filter that a query implies: years behind words like since, before or in, and named values.

    values maps fields to the words that stand for their values, as {"language": {"german": "de"}}. The first word of a
    field decides; a query that implies nothing gives the empty filter.
    """
    words = re.findall(r"\w+", query.lower())
    found: dict = {}
    for before, word in zip(words, words[1:]):
        if before in YEARS and re.fullmatch(r"(?:19|20)\d\d", word):
            found.setdefault(field, {})[YEARS[before]] = int(word)
    for name, known in (values or {}).items():
        hit = next((known[w] for w in words if w in known), None)
        if hit is not None:
            found[name] = hit
    return found


def metadata_filter(df: DataFrame, filters: dict) -> DataFrame:
    return df.where(condition(filters))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(df: DataFrame, score: Column, ident: str, k: int = 3, threshold: float | None = None) -> DataFrame:
    """The k rows of highest score with score and rank; ties go to the smaller id, null and NaN scores are not ranked.

    One query needs no shuffle of the input: every task keeps k rows and the driver merges them. Scores are computed once:
    those that are not ranked are last in order, and left out of the k rows afterwards.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    usable = F.get(F.transform(F.array(score.cast("double")), lambda s: F.when(~F.isnan(s), s)), F.lit(0))
    best = df.withColumn("score", usable).orderBy(F.desc_nulls_last("score"), F.col(ident)).limit(k)
    best = best.where(F.col("score").isNotNull() if threshold is None else F.col("score") >= F.lit(float(threshold)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(ident))))


#: Queries that a stated set may hold: their vectors are sent out once. The sharded index takes larger ones.
MOST_QUERIES = 16_384


def stated(queries: DataFrame) -> DataFrame:
    """A stated set of queries as a side that is sent to every task: at most MOST_QUERIES rows, more raise when run."""
    few = queries.limit(MOST_QUERIES + 1).withColumn("_many", F.count("*").over(Window.partitionBy(F.lit(0))))
    error = F.raise_error(F.lit(f"more than {MOST_QUERIES} queries: use an index")).cast("boolean")
    return F.broadcast(few.where(F.when(F.col("_many") > MOST_QUERIES, error).otherwise(True)).drop("_many"))


def plain_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that are vectors of the given length, and these; null components are NaN."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
    return rows, flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    """Vectors at unit length; no length stays zero."""
    sizes = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(sizes > 0, sizes, 1.0)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that are vectors of the given length, and these as unit vectors."""
    rows, x = plain_rows(column, dim)
    return rows, units(x)


def in_blocks(queries: DataFrame, items: DataFrame, query_id: str, query_vector: str, ident: str, vector: str, k: int | None = None, threshold: float | None = None, greater: bool = False) -> DataFrame:
    """(query_id, id, score): cosines of a stated set of queries with all items, as products of normalised matrices.

    The queries' vectors are collected when this is called, and sent out. With k, a block of items gives no more than k
    rows of a query, ties to the smaller id, or to the greater one if that is asked for. Queries without a vector
    take no part, nor items whose vectors are null or of another length. Scores are rounded to 12 digits, so that
    equal vectors have equal scores wherever they lie. More than MOST_QUERIES queries raise.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).where(F.size("v") > 0).limit(MOST_QUERIES + 1).toArrow().combine_chunks()
    if asked.num_rows > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: use an index")
    rows = items.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    kinds = queries.schema[query_id].dataType.simpleString(), items.schema[ident].dataType.simpleString()
    if not asked.num_rows:
        return items.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    vectors = asked.column("v").combine_chunks()
    dim = int(vectors.value_lengths()[0].as_py())
    kept, matrix = unit_rows(vectors, dim)
    names = asked.column("q").combine_chunks().take(pa.array(kept))
    shared = items.sparkSession.sparkContext.broadcast((matrix, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                at, x = unit_rows(part.column(1), dim)
                sims = np.round(matrix @ x.T, 12)
                take = sims >= (-np.inf if threshold is None else threshold)
                if k is not None and sims.shape[1] > k:
                    take &= sims >= np.partition(np.where(take, sims, -np.inf), sims.shape[1] - k, axis=1)[:, -k][:, None]
                row, col = np.nonzero(take)
                ids = part.column(0).take(pa.array(at))
                if k is not None and len(row):
                    place = np.empty(len(ids), np.int64)
                    place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    order = np.lexsort((-place[col] if greater else place[col], -sims[row, col], row))
                    row, col = row[order], col[order]
                    head = np.searchsorted(row, row)
                    few = np.arange(len(row)) - head < k
                    row, col = row[few], col[few]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(col)), pa.array(sims[row, col])], ["query_id", "id", "score"])

    return rows.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


#: Queries and items of a product of best_in_blocks; items of its first product, which every later one doubles.
QUERY_BLOCK, ITEM_BLOCK, FIRST_ITEMS = 1024, 4096, 256


def rare(mask: np.ndarray) -> np.ndarray:
    """Where a long flat mask is true, which it seldom is: words of eight are looked at first."""
    whole = len(mask) // 8 * 8
    words = np.flatnonzero(mask[:whole].view(np.uint64) != 0)
    near = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(mask))])
    return near[mask[near]]


class Best:
    """The k best scores so far of each of a set of unit vectors, and which new items reach them.

    Products are made in single precision, whose error is below `slack`; what comes within that of a query's k-th best
    score is scored again in double precision, so that no item is lost and all scores are exact.
    """

    def __init__(self, matrix: np.ndarray, k: int) -> None:
        self.exact, self.single, self.k = matrix, matrix.astype(np.float32), k
        self.scores = np.full((len(matrix), k), -np.inf)
        self.slack = (matrix.shape[1] + 8) * 2.0**-22
        # room for a product and what it is compared to, which would else be asked of the system again for each
        self.room = np.empty(0, np.float32), np.empty(0, bool)

    def add(self, x: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, item, score) of the items, unit vectors, that are among a query's k best here and reach its best so
        far; of equal scores those of greater place. Items that only equal the k-th best score are given too."""
        single = x.astype(np.float32).T
        if len(self.room[0]) < min(len(self.exact), QUERY_BLOCK) * len(x):
            self.room = tuple(np.empty(min(len(self.exact), QUERY_BLOCK) * len(x), r.dtype) for r in self.room)
        for a in range(0, len(self.exact), QUERY_BLOCK):
            block = self.single[a : a + QUERY_BLOCK]
            sims, reach = (r[: len(block) * len(x)].reshape(len(block), len(x)) for r in self.room)
            np.matmul(block, single, out=sims)
            floor = self.scores[a : a + QUERY_BLOCK, -1]
            if sims.shape[1] > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(sims, sims.shape[1] - self.k, axis=1)[:, -self.k] - self.slack)
            np.greater_equal(sims, (floor - self.slack).astype(np.float32)[:, None], out=reach)
            row, col = np.divmod(rare(reach.ravel()), sims.shape[1])
            score = np.round(np.einsum("ij,ij->i", self.exact[a + row], x[col]), 12)
            few = score >= self.scores[a + row, -1]
            row, col, score = row[few], col[few], score[few]
            order = np.lexsort((-place[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            few = nth < self.k
            row, col, score, nth = row[few], col[few], score[few], nth[few]
            if len(row):
                seen, at = np.unique(row, return_inverse=True)
                fresh = np.full((len(seen), self.k), -np.inf)
                fresh[at, nth] = score
                self.scores[a + seen] = -np.sort(-np.hstack([self.scores[a + seen], fresh]), axis=1)[:, : self.k]
                yield a + row, col, score


def best_in_blocks(queries: DataFrame, items: DataFrame, query_id: str, query_vector: str, ident: str, text: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score): cosines of queries, however many, with the items that may be among their k nearest.

    All of the k nearest are there, ties to the greater text, and few others: a task gives what is among the k best of
    all it has seen. Only ids leave it, never texts. Items whose vectors are null, of another length or hold anything but
    numbers take no part, nor such queries. Scores are rounded to 12 digits, so that equal vectors have equal scores.
    The vectors of up to MOST_QUERIES queries are collected when this is called, and sent out; more are scored by
    best_of_pairs.
    """
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {items.schema[ident].dataType.simpleString()}, score double"
    rows = items.select(F.col(ident).alias("id"), F.col(text).alias("t"), F.col(vector).alias("v"))
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    if (n := queries.count()) > MOST_QUERIES:
        return best_of_pairs(asked, rows, -(-n // MOST_QUERIES), kinds, k)
    spark, got = items.sparkSession, asked.where(F.size("v") > 0).toArrow().combine_chunks()
    if not got.num_rows:
        return spark.createDataFrame([], kinds)
    dim = int(got.column("v").combine_chunks().value_lengths()[0].as_py())
    # every task gives k rows a query, so that there are no more tasks than keep the cores busy
    return rows.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(scorer(spark, got, dim, k), kinds)


#: Items of a packed block, and of all the blocks that a task of best_of_pairs holds.
PACKED_ITEMS, TASK_ITEMS = 8192, 524_288


def best_of_pairs(asked: DataFrame, rows: DataFrame, n: int, kinds: str, k: int) -> DataFrame:
    """best_in_blocks for queries (q, v) and items (id, t, v) of any number: blocks of both are packed, and all pairs of blocks meet.

    Nothing is collected or sent out. A task has one n-th of the queries and at most about TASK_ITEMS items, and gives
    k rows a query when it has met all of these, and what equals the last of them.
    """
    # no filter on the vectors themselves: Spark would make them once for it and again for what passes
    first = asked.select(F.size("v").alias("dim")).where("dim > 0").head()
    if first is None:
        return asked.sparkSession.createDataFrame([], kinds)
    names, ids = (f.schema[c].dataType.simpleString() for f, c in ((asked, "q"), (rows, "id")))
    single = [f.schema["v"].dataType.simpleString() == "array<float>" for f in (asked, rows)]
    queries = asked.select("q", "v").mapInArrow(packer(first.dim, single[0], MOST_QUERIES), f"number long, ids array<{names}>, vectors binary").toDF("number", "names", "vectors")
    items = rows.mapInArrow(packer(first.dim, single[1], PACKED_ITEMS), f"number long, ids array<{ids}>, vectors binary").select("ids", F.col("vectors").alias("items"))
    parts = max(-(-rows.count() // TASK_ITEMS), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // n))
    pairs = queries.repartition(n).join(items.repartition(parts).hint("shuffle_replicate_nl"), F.lit(True))
    return pairs.mapInArrow(pair_scorer(first.dim, single, k), kinds)


def packer(dim: int, single: bool, size: int) -> Callable:
    """What packs rows (id, v) or (id, t, v) into blocks (number, ids, vectors) of at most `size`; those with a text lie in its order."""
    kind = np.float32 if single else np.float64

    def block(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        if "t" in table.column_names:
            table = table.take(pc.array_sort_indices(table.column("t").combine_chunks()))
        at, x = plain_rows(table.column("v").combine_chunks(), dim)
        good = np.isfinite(x).all(axis=1)
        ids = table.column(0).combine_chunks().take(pa.array(at[good]))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x[good].astype(kind).tobytes()], pa.binary())], ["number", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held, n = [*held, part], n + part.num_rows
                if n == size:
                    yield block(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield block(number, held)

    return run


def pair_scorer(dim: int, single: list[bool], k: int) -> Callable:
    """What scores pairs of blocks (number, names, vectors, ids, items), in which all pairs of a block of queries follow each other."""

    def vectors(cell: pa.Scalar, single: bool) -> np.ndarray:
        return units(np.frombuffer(cell.as_buffer(), np.float32 if single else np.float64).astype(np.float64).reshape(-1, dim))

    def result(names: pa.Array, best: Best, held: list[tuple]) -> pa.RecordBatch:
        row, score = (np.concatenate([h[i] for h in held]) for i in (0, 2))
        few = np.flatnonzero(score >= best.scores[row, -1])
        return pa.RecordBatch.from_arrays([names.take(pa.array(row[few])), pa.concat_arrays([h[1] for h in held]).take(pa.array(few)), pa.array(score[few])], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for number, own, matrix, ids, items in zip(*batch.columns):
                if at != number.as_py():
                    if held:
                        yield result(names, best, held)
                    at, held, names, best, size = number.as_py(), [], own.values, Best(vectors(matrix, single[0]), k), max(FIRST_ITEMS, k)
                x, a = vectors(items, single[1]), 0
                while a < len(x):
                    for row, col, score in best.add(x[a : a + size], np.arange(len(x[a : a + size]))):
                        held.append((row, ids.values.take(pa.array(a + col)), score))
                    a, size = a + size, min(2 * size, ITEM_BLOCK)
        if held:
            yield result(names, best, held)

    return run


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """As unit_rows, without the vectors that hold anything but numbers."""
    at, x = unit_rows(column, dim)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def scorer(spark, asked: pa.Table, dim: int, k: int) -> Callable:
    """What scores Arrow batches (id, t, v) against the queries (q, v), whose vectors are sent out."""
    kept, matrix = finite_rows(asked.column("v").combine_chunks(), dim)
    shared = spark.sparkContext.broadcast((matrix, asked.column("q").combine_chunks().take(pa.array(kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = shared.value
        best, size = Best(matrix, k), max(FIRST_ITEMS, k)
        for batch in batches:
            at, x = finite_rows(batch.column(2), dim)
            ids = batch.column(0).take(pa.array(at))
            place = np.empty(len(at), np.int64)
            place[pc.array_sort_indices(batch.column(1).take(pa.array(at))).to_numpy()] = np.arange(len(at))
            a = 0
            while a < len(x):
                for row, col, score in best.add(x[a : a + size], place[a : a + size]):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(a + col)), pa.array(score)], ["query_id", "id", "score"])
                a, size = a + size, min(2 * size, ITEM_BLOCK)

    return run


def top_k_batch(queries: DataFrame, items: DataFrame, query_id: str, query_vector: str, ident: str, vector: str, k: int = 3, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, id, score) for every query: a stated set of queries against all items (see in_blocks)."""
    few = in_blocks(queries, items, query_id, query_vector, ident, vector, k, threshold)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return few.where(~F.isnan("score")).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def score_distribution(df: DataFrame, score: Column, ident: str, gap: float = 0.08) -> DataFrame:
    """Every row's rank, score and gap to the score before, with a mark where the gap exceeds `gap` (never first)."""
    scored = df.select(F.col(ident), score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    ranked = numbered(scored, [-F.col("score"), F.col(ident)])
    before = -F.col("before.k0") - F.col("score")
    return ranked.select(F.col(ident), "score", "rank", before.alias("gap"), F.coalesce(before > gap, F.lit(False)).alias("marked"))


def score_summary(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Count, least, greatest, mean and population deviation of scores, and how many miss the threshold."""
    s = F.col("score")
    return df.select(score.alias("score")).where(s.isNotNull() & ~F.isnan(s)).agg(
        F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("greatest"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), F.count_if(s < threshold).alias("rejected"))
