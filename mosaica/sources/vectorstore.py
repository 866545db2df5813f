"""A store of texts with vectors, over a table of a session: upsert, similarity search, delete."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.vectors import nearest
from ..sources.storage import stored


class VectorStore:
    def __init__(self, session, table: str = "vectors", metric: str = "cosine"):
        self.session, self.table, self.metric = session, table, metric

    def upsert(self, rows: list[tuple[str, str, list[float]] | tuple[str, str, list[float], dict]]) -> int:
        """(key, text, vector[, metadata]) rows, written over those with the same key."""
        flat = [(f"{self.table}:{r[0]}", r[1], [float(x) for x in r[2]], json.dumps(r[3] if len(r) > 3 else {})) for r in rows]
        df = self.session.spark.createDataFrame(flat, "id string, text string, embedding array<double>, metadata string")
        return self.upsert_frame(df)

    def upsert_frame(self, df) -> int:
        """A DataFrame (id, text, embedding, metadata), of any size."""
        df = stored(df.select("id", "text", "embedding", "metadata"), "vectors")
        t = self.session._own(self.table)
        t.write(t.state.changed(df, df.select("id")))
        return df.count()

    def delete(self, keys: list[str]) -> None:
        t = self.session._own(self.table)
        t.write(t.state.changed(None, self.session.spark.createDataFrame([(f"{self.table}:{k}",) for k in keys], "id string")))

    def search(self, vector: list[float], k: int = 4, where: str | None = None):
        """The k rows nearest to vector, best first, with score = 1 - distance. where: a condition in the language."""
        df = self.session.query(f"SELECT * FROM {self.table}" + (f" WHERE {where}" if where else ""))
        return nearest(df, "embedding", vector, k, self.metric, tie="id").withColumn("score", 1 - F.col("distance"))
