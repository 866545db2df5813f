"""Exact vector search over a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..semantics import Value

METRICS = {"euclidean": vectors.euclidean, "manhattan": vectors.manhattan, "cosine": vectors.cosine_distance}


def nearest(df: DataFrame, column: str, query: list[float], k: int, metric: str = "euclidean", name: str = "distance", tie: str | None = None) -> DataFrame:
    """The k rows nearest to query: each task keeps its own k best, so k rows a task are exchanged."""
    q = Value(F.lit([float(x) for x in query]).cast("array<double>"), T.ArrayType(T.DoubleType()))
    d = METRICS[metric](Value(F.col(column), df.schema[column].dataType), q)
    return df.withColumn(name, d.col).where(F.col(name).isNotNull()).orderBy(name, *([tie] if tie else [])).limit(k)
