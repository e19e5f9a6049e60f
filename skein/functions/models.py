"""Models that run in Python, over Arrow batches, loaded once for each task's worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def batch_encoder(load: Callable[[], Callable[[Sequence[str]], Sequence]]):
    """An encoder, from a text column to a vector column, of a model that takes lists of texts.

    load is called once in each worker and returns the model, a function from texts to one vector each. Null texts
    are not shown to it and give null.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts.notna().to_numpy()
            out = np.empty(len(texts), object)
            for at, vector in zip(np.flatnonzero(known), model(texts[known].tolist()) if known.any() else ()):
                out[at] = np.asarray(vector, np.float32)
            yield pd.Series(out)

    return encode


def pair_scorer(load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]):
    """A scorer of (query, text) columns, as a cross-encoder: load() gives a function from two lists to a score each.

    Pairs with a null side are not shown to it and score null.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            known = (queries.notna() & texts.notna()).to_numpy()
            out = np.full(len(texts), np.nan)
            if known.any():
                out[known] = model(queries[known].tolist(), texts[known].tolist())
            yield pd.Series(out, dtype="float64").where(known, None)

    return score


def shared_words() -> Callable[[Sequence[str], Sequence[str]], list[float]]:
    """A stand-in for a cross-encoder: the share of the query's distinct words that the text has."""

    def score(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        return [len((asked := set(q.lower().split())) & set(t.lower().split())) / (len(asked) + 1e-9) for q, t in zip(queries, texts)]

    return score


def digest_vectors(dim: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """The pseudo-embedding of functions.vectors as a model over lists of texts."""
    from hashlib import md5

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.empty((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            whole = md5(text.encode()).hexdigest()
            parts = [md5(f"{whole}||{i}".encode()).hexdigest() for i in range(dim)]
            u, v = (np.array([int(p[a : a + 12], 16) for p in parts]) for a in (0, 12))
            out[row] = np.sqrt(-2 * np.log((u + 0.5) / float(1 << 48))) * np.cos(2 * np.pi * (v + 0.5) / float(1 << 48))
        return out

    return encode
