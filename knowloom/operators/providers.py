"""Pluggable models as pandas UDFs: embedder, reranker, text provider; the offline ones are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions.text import col, tokens

DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
ZERO_DIMENSIONS = 768


def hashed_buckets(text, dimensions: int = 64) -> Column:
    """Bucket of every token: the first four hex digits of its md5, modulo the dimensions."""
    return F.transform(tokens(text), lambda t: F.pmod(F.conv(F.left(F.md5(t), F.lit(4)), 16, 10).cast("int"), F.lit(dimensions)))


def hash_embedding(text, dimensions: int = 64) -> Column:
    """Unit vector of token counts per bucket; texts without tokens give the zero vector.

    Tokens and buckets are made in the JVM; Python only counts a batch of small integers.
    """
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            lengths = batch.map(len).to_numpy()
            flat = np.concatenate(batch.to_list()) if lengths.sum() else np.zeros(0, dtype=np.int64)
            row = np.repeat(np.arange(len(batch)), lengths)
            m = np.bincount(row * dimensions + flat.astype(np.int64), minlength=len(batch) * dimensions).reshape(len(batch), dimensions)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list((m / np.where(norm == 0, 1, norm)).astype(np.float32)))

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "array<float>")(hashed_buckets(text, dimensions))


def zero_embedding(text) -> Column:
    """The stub embedder: all zeros, so every distance is equal."""
    return F.when(col(text).isNotNull(), F.array_repeat(F.lit(0.0).cast("float"), ZERO_DIMENSIONS))


def embed(text, provider: str = "hash", load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, prefix: str = DOCUMENT_PREFIX) -> Column:
    """Embedding column; a model provider passes ``load``, called once per worker."""
    if provider == "stub":
        return zero_embedding(text)
    if provider == "hash":
        return hash_embedding(text)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(encode([prefix + t for t in batch]), dtype=np.float32)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(col(text))


def model_scores(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A reranker as ``score_udf(query_text, text)``: ``load`` gives the model, once per worker.

    A batch on which the model fails, or all of them where it cannot be loaded, has no scores, and neither has a text whose
    score is no finite number; the callers keep the order that such rows came in.
    """
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for query, text in batches:
            try:
                found = np.asarray(model([*query], [*text]), dtype=np.float64)
                if found.shape != (len(query),):
                    raise ValueError("one score per pair")
            except Exception:
                found = np.full(len(query), np.nan)
            yield pd.Series(found).where(np.isfinite(found))  # not a number becomes null

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def stub_answer(question, excerpt_count) -> Column:
    return F.format_string("[stub] %s (%d excerpts)", col(question), col(excerpt_count))
