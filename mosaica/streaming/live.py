"""Live queries: a change log on shared storage, read by Structured Streaming.

Every change appends (seq, table, action, before, after) to the log, rows as JSON. A subscription reads its table's part as a
stream, keeps changes whose after-image (before-image for DELETE) meets its WHERE, and projects or compares them.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import nodes as n
from ..sources.storage import new_path

LOG = "seq long, `table` string, action string, id string, before string, after string"


def changes(log: DataFrame, kind: T.StructType, where=None, project=None) -> DataFrame:
    """Changes with parsed images, for batch and stream alike: action, id, seq, before, after, row (the image that counts).

    where, project: functions from a DataFrame of rows to a condition, and to columns."""
    parsed = log.select("seq", "action", "id", F.from_json("before", kind).alias("before"), F.from_json("after", kind).alias("after"))
    parsed = parsed.withColumn("row", F.coalesce("after", "before"))
    flat = parsed.select("*", *(F.col("row").getField(f.name).alias(f.name) for f in kind.fields if f.name not in ("seq", "action", "id", "before", "after", "row")))
    if where is not None:
        flat = flat.where(where(flat))
    columns = project(flat) if project is not None else [F.col("row").alias("result")]
    return flat.select("seq", "action", "id", "before", "after", *columns)


def patch(before: dict | None, after: dict | None) -> list[dict]:
    """JSON Patch between two rows, top-level fields only."""
    before, after = ({k: v for k, v in (x or {}).items() if v is not None} for x in (before, after))
    out = [{"op": "remove", "path": f"/{k}"} for k in before if k not in after]
    out += [{"op": "add" if k not in before else "replace", "path": f"/{k}", "value": v} for k, v in after.items() if k not in before or before[k] != v]
    return out


class Subscription:
    def __init__(self, feed: Feed, live: n.Live, receive: Callable[[dict], None] | None):
        self.id, self.feed, self.live = uuid.uuid4().hex, feed, live
        self.received: list[dict] = []
        self.receive = receive or self.received.append
        self.stream = None

    def start(self) -> None:
        """Starts the stream. Each micro-batch is read with the fields that the table has by then."""
        spark, table = self.feed.session.spark, self.live.select.target.table
        log = spark.readStream.schema(LOG).json(self.feed.path(table))
        self.stream = log.writeStream.foreachBatch(self._deliver).option("checkpointLocation", new_path(spark, "live")).trigger(processingTime="200 milliseconds").start()

    def _told(self, log: DataFrame) -> DataFrame:
        feed, session, q = self.feed, self.feed.session, self.live.select
        from ..plans.expressions import Rows, condition, lower, output_name

        rows = lambda df: Rows(df, session, labels={q.target.table: ""}, table=q.target.table)
        where = (lambda df: condition(q.where, rows(df))) if q.where is not None else None

        def project(df: DataFrame) -> list:
            if any(f.expr is None for f in q.fields):
                return [F.col("row").alias("result")]
            return [F.struct(*(lower(f.expr, rows(df)).col.alias(f.alias or output_name(f.expr)) for f in q.fields)).alias("result")]

        return changes(log, feed.kinds[q.target.table], where, project)

    def _deliver(self, batch: DataFrame, _: int) -> None:
        plain = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if v is not None} if r is not None else None
        for r in self._told(batch).orderBy("seq").toLocalIterator():  # the driver holds a partition's changes
            told = {"action": r.action, "id": r.id}
            told |= {"patch": patch(plain(r.before), plain(r.after))} if self.live.diff else {"result": plain(r.result)}
            self.receive(told)

    def drain(self) -> list[dict]:
        """What has been received, once all that was published has been read."""
        if self.stream is not None:
            self.stream.processAllAvailable()
        return self.received

    def stop(self) -> None:
        if self.stream is not None:
            self.stream.stop()
            self.stream = None


class Feed:
    def __init__(self, session):
        self.session = session
        self.root: str | None = None
        self.kinds: dict[str, T.StructType] = {}
        self.subscriptions: dict[str, Subscription] = {}
        self.counter = itertools.count()

    def path(self, table: str) -> str:
        if self.root is None:
            self.root = new_path(self.session.spark, "changes")
        return f"{self.root}/{table}"

    def subscribe(self, live: n.Live, receive) -> Subscription:
        s = Subscription(self, live, receive)
        self.subscriptions[s.id] = s
        rows = self.session.table(live.select.target.table).rows()
        self.kinds.setdefault(live.select.target.table, rows.schema)
        if len(rows.schema) > 1:
            self._begin(s)
        return s

    def _begin(self, s: Subscription) -> None:
        spark, table = self.session.spark, s.live.select.target.table
        spark.createDataFrame([], LOG).write.mode("append").json(self.path(table))
        s.start()

    def publish(self, table: str, action: str, before: DataFrame | None, after: DataFrame | None) -> None:
        mine = [s for s in self.subscriptions.values() if s.live.select.target.table == table]
        if not mine:
            return
        df = after if after is not None else before
        self.kinds[table] = df.schema
        for s in mine:
            if s.stream is None:
                self._begin(s)
        image = lambda d, name: d.select("id", F.to_json(F.struct(*(F.col(f"`{c}`") for c in d.columns))).alias(name))
        rows = image(df, "after" if after is not None else "before")
        if after is not None and before is not None:
            rows = rows.join(image(before, "before"), "id", "left")
        for name in ("before", "after"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        seq = next(self.counter)
        rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(table).alias("table"), F.lit(action).alias("action"), "id", "before", "after").write.mode("append").json(self.path(table))

    def kill(self, id_: str) -> bool:
        s = self.subscriptions.pop(id_, None)
        if s is not None:
            s.stop()
        return s is not None

    def kill_all(self) -> None:
        for k in list(self.subscriptions):
            self.kill(k)


__all__ = ["Feed", "Subscription", "changes", "patch"]
