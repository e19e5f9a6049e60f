"""Vector algebra on ARRAY<FLOAT> or ARRAY<DOUBLE> columns, in double precision and on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where either vector is null or their lengths differ, as the missing components are null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size.isNotNull(), F.lit(0.0))


def cosine_eps(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Cosine with a small constant in the denominator, so that a zero vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def with_norm(a: Column, then) -> Column:
    """then(vector, norm) with both bound, so that neither is computed for every component."""
    bound = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.flatten(F.transform(bound, lambda s: then(s["v"], s["n"])))


def normalize(a: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    return with_norm(a, lambda v, n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def normalize_eps(a: Column, eps: float = 1e-9) -> Column:
    return with_norm(a, lambda v, n: F.transform(v, lambda x: x.cast("double") / (n + F.lit(eps))))


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.lit(float(factor)))


def pseudo_embedding(text: Column, dim: int = 64, salt: str = "") -> Column:
    """Stable pseudo-embedding: Box-Muller over MD5 digests of the text's digest, the salt and the component's number.

    The same on every run, partition, machine and engine that has MD5; the text is read once, whatever the length of
    the vector; null texts give null.
    """

    def uniform(digest: Column, start: int) -> Column:
        return (F.conv(F.substring(digest, start, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    def gauss(digest: Column) -> Column:
        return (F.sqrt(-2 * F.log(uniform(digest, 1))) * F.cos(2 * 3.141592653589793 * uniform(digest, 13))).cast("float")

    # arrays of one element bind the digest, so that it is not computed for every component
    names = F.flatten(F.transform(F.array(F.md5(text)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.md5(F.concat(h, F.lit(f"|{salt}|"), i.cast("string"))))))
    return F.when(text.isNotNull(), F.transform(names, gauss))


def image_embedding(description: Column, dim: int = 64) -> Column:
    """The text embedding with a tenth of a second one added as noise."""
    return F.zip_with(pseudo_embedding(description, dim), pseudo_embedding(description, dim, "image"), lambda x, y: (x + y * F.lit(0.1).cast("float")).cast("float"))


def multimodal_embedding(content: Column, modality: Column, dim: int = 64) -> Column:
    return F.when(modality == "image", image_embedding(content, dim)).otherwise(pseudo_embedding(content, dim))


def statistics(a: Column) -> Column:
    """Struct of least, greatest and mean value, norm and the first eight components."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.struct(F.array_min(a).cast("double").alias("least"), F.array_max(a).cast("double").alias("greatest"), (total / F.size(a)).alias("mean"), norm(a).alias("norm"), F.slice(a, 1, 8).alias("head"))
