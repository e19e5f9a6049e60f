"""How rows are laid out: spreading small inputs over the cores, cutting long lineages, numbering rows in order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Hash-partition a frame that has fewer partitions than the cluster has cores, for costly narrow stages.

    Frames that already have enough partitions are returned as they are, so large inputs are not shuffled.
    The keys should be unique or nearly so; a hot key would undo the spreading.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, *[F.col(k) for k in keys]) if keys else df.repartition(cores * per_core)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local session gets a temporary one, and any
    other raises: executors on several machines could not read each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(remove, spark, spark.sparkContext.getCheckpointDir())
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, if the session is still there to do it."""
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that lost executors cost no recomputation of its past."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that cut() made, once nothing reads them any more; others are left alone."""
    try:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())
    except Exception:
        pass


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but written as a columnar table: smaller for wide rows with repeated values, and read by column.

    The table lies in the session's own folder beneath the shared one, which is deleted when the session's process ends.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], buckets: int | None = None) -> DataFrame:
    """Adds rank, from 1, in the total order of `by`, and before, the struct of `by` of the row before (null at first).

    No task sees more than its share: rows go to buckets between bounds drawn from a sample of at most 64 rows a
    bucket, are numbered inside them, and the counts of the buckets, one row each, are added. `by` must tell all rows
    apart; expressions in it are ascending, so negate numbers for a falling order.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)]))
    drawn = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(64 * buckets)
    row = F.row_number().over(Window.orderBy("_key")) - 1
    # a row per bucket: the bounds between them, at even places of the sorted sample
    bounds = drawn.select("_key", row.alias("_at")).where(F.pmod("_at", F.lit(64)) == 0).where("_at > 0").agg(F.array_sort(F.collect_list("_key")).alias("_bounds"))
    placed = keyed.join(F.broadcast(bounds), F.lit(True)).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_bounds")
    inside = Window.partitionBy("_bucket").orderBy("_key")
    local = placed.withColumn("_nth", F.row_number().over(inside)).withColumn("_prior", F.lag("_key").over(inside))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"), F.max("_key").alias("_last"))
    ordered = Window.orderBy("_bucket")
    offsets = sizes.select("_bucket", (F.sum("_n").over(ordered) - F.col("_n")).alias("_offset"), F.lag("_last").over(ordered).alias("_end"))
    out = local.join(F.broadcast(offsets), "_bucket")
    return out.withColumn("rank", (F.col("_nth") + F.col("_offset")).cast("int")).withColumn("before", F.coalesce("_prior", "_end")).drop("_key", "_bucket", "_nth", "_prior", "_offset", "_end")
