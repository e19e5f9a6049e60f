"""Reading and writing: whole text files, delimited record files, parquet vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import trim_ws


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def records(files: DataFrame, text: str = "text") -> DataFrame:
    """(id, topic, text) of record files: blocks between `---`, lines CHUNK_ID:, TOPIC: and TEXT:.

    Blank blocks and those that start with # are skipped; a block counts if it has an id and a text; a topic ends
    at a second colon; a text is one line.
    """
    block = trim_ws(F.col("block"))
    rows = files.select(F.explode(F.split(text, "---")).alias("block")).select(block.alias("block")).where((F.col("block") != "") & ~F.startswith("block", F.lit("#")))

    def field(pattern):
        found = F.regexp_extract("block", pattern, 1)
        return F.when(F.regexp_like("block", F.lit(pattern)), trim_ws(found))

    parsed = rows.select(field(r"(?m)^CHUNK_ID:[ \t]*(\d+)").cast("int").alias("id"), field(r"(?m)^TOPIC:([^:\n]*)").alias("topic"), field(r"(?m)^TEXT:([^\n]*)").alias("text"))
    return parsed.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def append_index(df: DataFrame, path: str) -> None:
    """Add rows that hold their vectors to a parquet index."""
    df.write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
