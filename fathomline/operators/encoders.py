"""What turns texts into vectors and pairs into scores: deterministic stand-ins, and a slot for a model.

An embedder takes (rows, keys, text column) and gives (keys, embedding); a reranker takes hits with
query and text and gives them with a score column.  ``model_embedder`` and ``model_reranker``
load a model once for each worker, when the first batch comes; where it can't be
loaded they fall back to the stand-in, or raise if there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, Embedding
from . import search

Embedder = Callable[[DataFrame, list[str], str], DataFrame]
Reranker = Callable[[DataFrame], DataFrame]


def limited(text: Column, max_tokens: int) -> Column:
    """The part of a text that a model reads: its window, by characters. What is stored stays whole."""
    return F.substring(text, 1, max_tokens * CHARS_PER_TOKEN)


def hashed(config: Embedding = Embedding()) -> Embedder:
    """Term counts in hashed places; needs no model, reads texts whole."""
    return partial(search.hashed_vectors, dim=config.dim)


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], config: Embedding = Embedding()) -> Embedder:
    """load() gives a function from texts to a matrix of config.dim columns. Blank texts get zeros without being asked for."""

    def embed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = None
            for frame in frames:
                texts, out = frame["__t"].tolist(), np.zeros((len(frame), config.dim))
                said = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
                if said and encode is None:
                    encode = load()
                for k in range(0, len(said), config.batch_size):
                    part = said[k : k + config.batch_size]
                    out[part] = encode([texts[i] for i in part])
                yield frame[keys].assign(embedding=list(out))

        schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<double>"
        return df.select(*keys, limited(F.col(text), config.max_tokens).alias("__t")).mapInPandas(run, schema)

    return embed


def lexical(hits: DataFrame) -> DataFrame:
    """Share of the query's terms in the text."""
    return search.with_lexical_score(hits, out="rescored")


def model_reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Reranker:
    """load() gives a function from pairs of query and text to scores."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, texts in parts:
            yield pd.Series(model(list(zip(asked, texts))), dtype="float64")

    return lambda hits: hits.withColumn("rescored", score("query", "text"))


def or_else(first: Callable, fallback: Callable) -> Callable:
    """load() of a model, or of what stands in where it can't be loaded."""

    def load():
        try:
            return first()
        except (ImportError, OSError, ValueError):
            return fallback()

    return load
