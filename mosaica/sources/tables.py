"""Tables: a base DataFrame under an overlay of changed rows, with definitions and earlier versions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import col, common, conform
from ..semantics import Value
from .storage import stored

ID = "id"
DEEPEST = 4  # changes that an overlay keeps as plans before it is written


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, by name; missing columns are NULL, differing types are widened."""
    names = dict.fromkeys([*a.columns, *b.columns])
    kinds = {c: common([d.schema[c].dataType for d in (a, b) if c in d.columns]) for c in names}

    def shaped(d: DataFrame) -> DataFrame:
        return d.select(*((conform(Value(col(c), d.schema[c].dataType), kinds[c]) if c in d.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names))

    return shaped(a).unionByName(shaped(b))


@dataclass(frozen=True)
class State:
    """Rows of a table: base, without the ids in gone, with the rows of put (whose ids are in gone, too)."""

    base: DataFrame | None = None
    put: DataFrame | None = None
    gone: DataFrame | None = None
    depth: int = 0  # changes since the overlay was written

    def rows(self) -> DataFrame | None:
        df = self.base
        if df is not None and self.gone is not None:
            df = df.join(self.gone, ID, "left_anti").select(*df.columns)
        if self.put is not None:
            df = self.put if df is None else aligned(df, self.put)
        return df

    def changed(self, put: DataFrame | None, gone: DataFrame) -> State:
        """With rows written (by id) and ids gone (those of the written rows included)."""
        ids = gone if self.gone is None else self.gone.union(gone).distinct()
        kept = self.put.join(gone, ID, "left_anti").select(*self.put.columns) if self.put is not None else None
        if put is not None:
            kept = put if kept is None else aligned(kept, put)
        return State(self.base, kept, ids, self.depth + 1)

    def settled(self, name: str) -> State:
        """The same rows, with an overlay that is written once it has grown deep: plans stay as long after any number of changes."""
        if self.depth < DEEPEST:
            return self
        put = stored(self.put, f"put-{name}") if self.put is not None else None
        return State(self.base, put, stored(self.gone, f"gone-{name}"))


@dataclass
class Table:
    name: str
    state: State = field(default_factory=State)
    key: str | None = None  # column that record keys are compared with, where the table has no id column
    fields: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    permissions: dict[str, object] = field(default_factory=dict)
    schemafull: bool = False
    versions: list[tuple[float, State]] = field(default_factory=list)
    source: Callable[[], DataFrame] | None = None  # of the base, opened when first used
    path: str | None = None  # of the base's files, where it is read from some
    postings: dict[str, tuple] = field(default_factory=dict)  # by search index: the base it was built for, and what was built

    def opened(self) -> Table:
        if self.source is not None:
            self.state, self.source = State(self.source()), None
        return self

    def rows(self) -> DataFrame | None:
        return self.opened().state.rows()

    def write(self, state: State) -> None:
        if not self.opened().versions:
            self.versions.append((0.0, self.state))
        self.state = state = state.settled(self.name)
        self.versions.append((time.time(), state))

    def at(self, moment: float, before: bool) -> State:
        """As of a moment, or just before it; empty before the first version."""
        self.opened()
        seen = [s for t, s in self.versions if t < moment or t == moment and not before]
        if not self.versions:
            return self.state
        return seen[-1] if seen else State()


def empty(spark, fields: dict[str, dict] | None = None) -> DataFrame:
    kinds = {"int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}
    return spark.createDataFrame([], T.StructType([T.StructField(ID, T.StringType())] + [T.StructField(f, kinds.get(o.get("type"), T.StringType())) for f, o in (fields or {}).items() if f != ID and "." not in f]))
