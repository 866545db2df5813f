"""Rows of a table at a moment, from an append-only change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(log: DataFrame, moment: Column, key: str = "key", ts: str = "ts", op: str = "op", before: bool = False, tie: str | None = None) -> DataFrame:
    """The last entry of each key up to the moment (``before``: short of it), unless that is a DELETE."""
    some = log.where(F.col(ts) < moment if before else F.col(ts) <= moment)
    last = Window.partitionBy(key).orderBy(F.col(ts).desc(), *([F.col(tie).desc()] if tie else []))
    return some.withColumn("__n", F.row_number().over(last)).where((F.col("__n") == 1) & (F.col(op) != "DELETE")).drop("__n")
