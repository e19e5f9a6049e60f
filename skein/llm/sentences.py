"""Sentence units of whole tables of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.segmentation import sentences
from skein.plans.layout import spread


def split_sentences(df: DataFrame, keys: list[str], text: str, language: str | None = None) -> DataFrame:
    """One row per sentence: the keys, sent_no from 0, sent_start, sent_end (code points) and sentence.

    Rows that repeat a key count once: of differing texts under one key, that with most sentences is taken, then
    the greatest list of offsets. Null keys are keys like others. Defined results as in segmentation: null, empty
    and blank texts have no row. The language column is a hint; the script of the text decides first.
    """
    hint = F.col(language).cast("string") if language else F.lit(None).cast("string")
    rows = df.select(*keys, F.col(text).alias("_text"), hint.alias("_hint")).where(F.col("_text").isNotNull())
    rows = spread(rows, *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                spans = [sentences(t, h) for t, h in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist())]
                starts = pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32()))
                ends = pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], starts, ends], [*keys, "_text", "_starts", "_ends"])

    spans = rows.mapInArrow(run, f"{fields}, _text string, _starts array<int>, _ends array<int>")
    one = spans.groupBy(*keys).agg(F.max(F.struct(F.size("_starts").alias("n"), "_starts", "_ends", "_text")).alias("_one"))
    each = one.select(*keys, F.col("_one._text").alias("_text"), F.posexplode(F.arrays_zip("_one._starts", "_one._ends")).alias("sent_no", "_at"))
    start, end = F.col("_at._starts"), F.col("_at._ends")
    return each.select(*keys, "sent_no", start.alias("sent_start"), end.alias("sent_end"), F.substring("_text", start + 1, end - start).alias("sentence"))


def sentence_starts(df: DataFrame, keys: list[str], text: str, language: str | None = None) -> DataFrame:
    """split_sentences without the texts: keys and sent_start; nothing but offsets is shuffled."""
    hint = F.col(language).cast("string") if language else F.lit(None).cast("string")
    rows = df.select(*keys, F.col(text).alias("_text"), hint.alias("_hint")).where(F.col("_text").isNotNull())
    rows = spread(rows, *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [[a for a, _ in sentences(t, h)] for t, h in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(starts, pa.list_(pa.int32()))], [*keys, "_starts"])

    spans = rows.mapInArrow(run, f"{fields}, _starts array<int>")
    one = spans.groupBy(*keys).agg(F.max(F.struct(F.size("_starts").alias("n"), "_starts")).alias("_one"))
    return one.select(*keys, F.explode("_one._starts").alias("sent_start"))
