"""Text to vector: a built-in token-hash embedder and a hook for user models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.functions import text


def _counter(dim: int):
    """Arrow function: text per row to a count of its tokens per hash bucket."""

    def count(texts: pa.Array) -> pa.Array:
        tokens = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        # Every distinct token of the batch is hashed once.
        coded = tokens.flatten().cast(pa.binary()).dictionary_encode()
        words = coded.dictionary
        raw = words.to_numpy(zero_copy_only=False)
        digests = b"".join([hashlib.md5(word).digest() for word in raw])
        bucket = np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % dim
        which = coded.indices.to_numpy()
        filled = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[which]
        slot = (row * dim + bucket[which])[filled]
        counts = np.bincount(slot, minlength=len(tokens) * dim)
        ends = np.arange(0, len(tokens) * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(ends, counts.astype(np.float64))

    # Spark reads the hints as types, not as text.
    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, S.VECTOR)


def hash_vector(prompt: Column | str, dim: int = 256) -> Column:
    """Built-in embedder: how many tokens of the whole prompt fall into each of ``dim`` buckets.

    Tokens are lower-case and separated by whitespace. The work is row by row on Arrow batches,
    so there is no shuffle. A prompt without tokens gives a zero vector, which validation rejects.
    """
    if dim < 1:
        raise ValueError("dim must be at least 1")
    return _counter(dim)(text.clean(prompt))


def embed_hash(rows: DataFrame, prompt: str = "prompt", dim: int = 256) -> DataFrame:
    return rows.withColumn("vector", hash_vector(prompt, dim))


def embed_with(
    rows: DataFrame,
    model: Callable[[Iterator[pd.Series]], Iterator[pd.Series]],
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``vector`` from a user model, called once per worker with batches of clean prompts.

    An empty reply stays in the table as an empty vector and is rejected by vector validation.
    """

    @F.pandas_udf(S.VECTOR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return rows.withColumn("vector", run(text.clean(prompt)))
