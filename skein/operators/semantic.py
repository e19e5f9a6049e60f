"""Semantic chunking: sentences with vectors are grouped between drops of neighbouring similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine


def neighbour_similarity(sents: DataFrame, ident: str, pos: str = "pos", vector: str = "embedding") -> DataFrame:
    """Adds sim, the cosine to the next sentence of the document (null at its last)."""
    after = F.lead(vector).over(Window.partitionBy(ident).orderBy(pos))
    return sents.withColumn("_next", after).withColumn("sim", F.when(F.col("_next").isNotNull(), cosine(F.col(vector), F.col("_next")))).drop("_next")


def grouped(sims: DataFrame, ident: str, pos: str, text: str, cut) -> DataFrame:
    """Chunks between the rows where `cut` holds: text, first and last sentence, and the mean of the inner similarities."""
    order = Window.partitionBy(ident).orderBy(pos)
    rows = sims.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("chunk_id", F.coalesce(F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    inner = F.when(F.col("_cut") == 0, F.col("sim"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    made = rows.groupBy(ident, "chunk_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"), F.min(pos).cast("int").alias("first_sent"), F.max(pos).cast("int").alias("last_sent"), F.avg(inner).alias("_mean"))
    return made.select(ident, "chunk_id", "text", "first_sent", "last_sent", F.when(F.col("first_sent") == F.col("last_sent"), 1.0).otherwise(F.coalesce("_mean", F.lit(1.0))).alias("avg_similarity"))


def by_threshold(sents: DataFrame, ident: str, threshold: float = 0.5, pos: str = "pos", text: str = "sentence", vector: str = "embedding") -> DataFrame:
    """A chunk ends behind a sentence whose similarity to the next is below the threshold."""
    return grouped(neighbour_similarity(sents, ident, pos, vector), ident, pos, text, F.col("sim") < F.lit(threshold))


def by_percentile(sents: DataFrame, ident: str, percentile: float = 25.0, pos: str = "pos", text: str = "sentence", vector: str = "embedding") -> DataFrame:
    """A chunk ends where the similarity is at most the document's exact percentile (linear interpolation)."""
    sims = neighbour_similarity(sents, ident, pos, vector)
    bound = F.percentile("sim", F.lit(percentile / 100)).over(Window.partitionBy(ident))
    return grouped(sims.withColumn("_bound", bound), ident, pos, text, F.col("sim") <= F.col("_bound"))


def clearest_shift(sents: DataFrame, ident: str, pos: str = "pos", vector: str = "embedding") -> DataFrame:
    """The position of each document's least similarity, the first on ties."""
    sims = neighbour_similarity(sents, ident, pos, vector).where("sim is not null")
    return sims.groupBy(ident).agg(F.min(F.struct("sim", pos)).alias("_m")).select(ident, F.col(f"_m.{pos}").alias("shift_pos"), F.col("_m.sim").alias("sim"))


def listing(sents: DataFrame, ident: str, pos: str = "pos", vector: str = "embedding", bound: float = 0.5) -> DataFrame:
    sims = neighbour_similarity(sents, ident, pos, vector).where("sim is not null")
    return sims.select(ident, pos, "sim", F.when(F.col("sim") < bound, "SPLIT").otherwise("").alias("mark"))
