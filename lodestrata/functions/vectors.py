"""Vectors as arrays: norms, cosine, query vectors from a digest, an offline embedder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Exact cosine; 0 where either vector is 0."""
    return T.ratio(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def md5_vector(c: Column, dim: int) -> Column:
    """The digest's 16 bytes over 255, then zeros."""
    digest = F.md5(c)
    byte = lambda i: F.conv(F.substr(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("double") / 255
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(i <= 16, byte(i)).otherwise(F.lit(0.0)))


def hashing_embedding(c: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for an embedding model, by Arrow batches as a model would run: word counts by hash bucket, to unit length."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hashed(t, dim) for t in texts], dtype=object)

    return embed(c)


def hashed(text: str | None, dim: int) -> np.ndarray:
    return _unit(np.bincount([zlib.crc32(w.encode()) % dim for w in re.findall(r"\w+", text.lower())] if text else [], minlength=dim))


def _unit(counts: np.ndarray) -> np.ndarray:
    size = np.sqrt((counts * counts).sum())
    return counts / size if size else counts.astype(float)


def dimension_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.size(column).alias("dims")).agg(F.count("*").alias("n"))


def check_dimensions(df: DataFrame, column: str) -> int:
    """The one length of all vectors; raises for mixed lengths or non-finite components, 0 for an empty table."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad")).first()
    if row["bad"]:
        raise ValueError("vectors hold null or non-finite components")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors have different lengths: {row['lo']} to {row['hi']}")
    return row["hi"] or 0
