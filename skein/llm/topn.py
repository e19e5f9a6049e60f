"""The N best rows of every group, by secondary sort and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_query(column):
    """Queries that differ only in letter case or in white space are one: lower case, single inner spaces."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))


def first_rows(n: int):
    """A function over Arrow batches sorted by group, score and id: passes on each group's first n distinct ids.

    Only the last group's name and count are kept between batches, never a group's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            group, score, ident = batch.column(0), batch.column(1), batch.column(2)

            def differs(a: pa.Array) -> np.ndarray:
                return np.concatenate([[True], pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)])

            head = (group[0].as_py(), score[0].as_py(), ident[0].as_py())
            new = differs(group)
            new[0] = last is None or head[0] != last[0]
            again = ~new & ~differs(score) & ~differs(ident)
            again[0] = last is not None and head == last
            seen = np.cumsum(~again)
            starts = np.flatnonzero(new)
            base = np.zeros(size, np.int64)
            carried = count if not new[0] else 0
            base[: starts[0] if len(starts) else size] = -carried
            for_rows = np.searchsorted(starts, np.arange(size), side="right") - 1
            inside = for_rows >= 0
            base[inside] = seen[starts[for_rows[inside]]] - 1
            rank = seen - base
            last = (group[size - 1].as_py(), score[size - 1].as_py(), ident[size - 1].as_py())
            count = int(rank[-1])
            keep = (rank <= n) & ~again
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """The n rows of highest score in each group: columns (group, score, id), as strings, doubles and longs.

    Two passes of one plan: each input partition is sorted by (group, score, id) and streamed, which leaves at
    most n rows of a group and splits hot groups as their rows lie; the survivors are hash-partitioned by group,
    sorted and streamed again. No group is ever buffered.

    Defined results: rows whose score is null or not a number, or outside low..high when given, are not ranked,
    nor rows without id; rows without group form no group; equal scores go to the smaller id; a repeated row
    (same group, score and id) counts once; extra columns are ignored; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("group"), (value + F.lit(0.0)).alias("score"), F.col(ident).cast("long").alias("id"))
    rows = rows.where(F.col("group").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    if low is not None:
        rows = rows.where(F.col("score") >= F.lit(float(low)))
    if high is not None:
        rows = rows.where(F.col("score") <= F.lit(float(high)))
    order = [F.col("group"), F.col("score").desc(), F.col("id")]
    part = rows.sortWithinPartitions(*order).mapInArrow(first_rows(n), rows.schema)
    return part.repartition(F.col("group")).sortWithinPartitions(*order).mapInArrow(first_rows(n), rows.schema)
