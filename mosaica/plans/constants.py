"""Values of constant expressions, on the driver."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession


def value_of(column: Column):
    """The Python value of an expression that reads no row. Spark folds it; nothing runs on executors."""
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(column.alias("v")).first()["v"]


def text_of(column: Column) -> str:
    v = value_of(column)
    return "" if v is None else str(v)
