"""Cost, storage and latency estimates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column


def cost(documents: Column, tokens_per_document: Column, per_million: Column) -> Column:
    return documents * tokens_per_document / 1e6 * per_million


def storage_mib(vectors: Column, dim: Column) -> Column:
    return vectors * dim * 4 / float(1 << 20)


def latency(per_document: Column, documents: Column) -> Column:
    return per_document * documents
