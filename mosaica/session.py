"""A session: tables, variables and definitions, and the statements that use and change them."""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import semantics as sem
from .functions.types import cast
from .lang import nodes as n
from .lang import parse, render
from .operators import fulltext, graph
from .plans import constants
from .plans.expressions import Rows, Unsupported, col, common, condition, conform, hidden, literal, lower, struct, walk
from .plans.explain import strategy
from .plans.select import Plan, Planner
from .semantics import Value
from .sources.kv import KeyValues
from .sources.storage import new_path, stored
from .sources.tables import ID, State, Table, aligned, empty
from .streaming.live import Feed, Subscription


AUDITED = 10_000  # entries of the audit log that the driver holds before they are written
KINDS = 10_000  # of edges
VERDICTS = ("SAFE", "WARNING", "DANGER")
_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # postings of tables read from files, by Spark session


class Refused(ValueError):
    """A statement that a rule, a check or a constraint does not allow."""


class Session:
    def __init__(self, spark: SparkSession, namespace: str = "main", database: str = "main"):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.namespace, self.database = namespace, database
        self.databases: dict[tuple[str, str], dict[str, Table]] = {}
        self.variables: dict[str, object] = {}
        self.definitions: dict[tuple[str, str], n.Define] = {}
        self.links: dict[str, Callable[[str], DataFrame]] = {}
        self.link_keys: dict[str, str | None] = {}
        self.edges: DataFrame | None = None  # registered ones
        self.related: DataFrame | None = None  # those that RELATE has made
        self._loose = 0  # statements since these were written
        self.kinds: set[str] = set()
        self.auth_rules: list[str] = []
        self.masks: list[str] = []
        self.keys = KeyValues(spark)
        self.feed = Feed(self)
        self.audit: list[tuple] = []
        self.audited: list[DataFrame] = []  # earlier entries, written
        self.audit_rules: list[tuple[re.Pattern, str]] = []
        self._stack: list[tuple[str | None, dict, DataFrame | None, dict]] = []
        self._held: list[tuple] = []

    # ------------------------------------------------------------ catalog
    @property
    def tables(self) -> dict[str, Table]:
        return self.databases.setdefault((self.namespace, self.database), {})

    def register(self, name: str, source: DataFrame | str, key: str | None = None) -> Session:
        """A DataFrame, or the Parquet files at a path, as a table. ``key``: the column that ``name:key`` compares with."""
        if isinstance(source, str):
            self.tables[name] = Table(name, key=key, source=lambda: self.spark.read.parquet(source), path=source)
        else:
            self.tables[name] = Table(name, State(source), key)
        return self

    def register_all(self, path: str, *names: str) -> Session:
        for name in names:
            self.register(name, f"{path}/{name}.parquet")
        return self

    def register_edges(self, edges: DataFrame, *kinds: str) -> Session:
        """Edges (src, kind, dst), ids being ``table:key``. Kinds are looked up unless they are named."""
        some = edges.select("src", "kind", "dst")
        found = set(kinds) or {r[0] for r in some.select("kind").distinct().limit(KINDS + 1).collect()}
        if len(found) > KINDS:
            raise Refused(f"more than {KINDS} kinds of edges")
        self.kinds |= found
        self.edges = some if self.edges is None else self.edges.union(some)
        return self

    def link(self, name: str, reader: Callable[[str], DataFrame] | dict[str, str], key: str | None = None) -> Session:
        """A remote database: a reader of tables by name, or options of Spark's JDBC source. Filters are pushed to it by Spark.

        ``key``: the column that record keys (``name.table:key``) are compared with; default: ``id``."""
        self.link_keys[name] = key
        if isinstance(reader, dict):
            options = dict(reader)
            self.links[name] = lambda table: self.spark.read.format("jdbc").options(**options).option("dbtable", table).load()
        else:
            self.links[name] = reader
        return self

    def table(self, name: str, db: str | None = None) -> Table:
        if db is not None and db in self.links:
            return Table(name, State(self.links[db](name)), self.link_keys.get(db))
        if name in ("AUDIT_LOG", "AUDIT_CASES") and db is None:
            return Table(name, State(self._audit_rows(name)))
        tables = self.databases.setdefault((self.namespace, db), {}) if db is not None else self.tables
        t = tables.setdefault(name, Table(name))
        return t if t.rows() is not None else Table(name, State(empty(self.spark, t.fields)), None, t.fields, t.indexes, t.permissions, t.schemafull, t.versions)

    def _own(self, name: str) -> Table:
        return self.tables.setdefault(name, Table(name)).opened()

    def _audit_rows(self, name: str) -> DataFrame:
        schema = "id string, time timestamp, user string, statement string, verdict string"
        df = self.spark.createDataFrame(list(reversed(self.audit)), schema)
        for earlier in reversed(self.audited):
            df = df.union(earlier)
        df = df.orderBy(F.desc("time")) if self.audited else df
        return df if name == "AUDIT_LOG" else df.where("verdict <> 'SAFE'")

    def _note(self, s: n.Node, verdict: str) -> None:
        self.audit.append((uuid.uuid4().hex, dt.datetime.now(dt.UTC).replace(tzinfo=None), None, render(s), verdict))
        if len(self.audit) >= AUDITED:
            self.audited.append(stored(self.spark.createDataFrame(self.audit, "id string, time timestamp, user string, statement string, verdict string"), "audit"))
            self.audit = self.audit[-1:]
            self.audited[-1] = self.audited[-1].where(F.col("id") != self.audit[0][0])

    def analyzer(self, name: str) -> dict:
        d = self.definitions.get(("analyzer", name))
        if d is None:
            raise Refused(f"no analyzer {name}")
        return {"lowercase": bool(d.get("lowercase")), "stopwords": tuple(d.get("stopwords") or ()), "stemming": bool(d.get("stemming"))}

    def variable(self, name: str):
        return self.variables.get(name)

    def array_of(self, df: DataFrame) -> Value:
        """A stored result as an array value. It is brought to the driver, so it is for small results."""
        rows = df.collect()
        one = len(df.columns) == 1 and df.columns[0] == "value"
        kind = df.schema[0].dataType if one else df.schema
        made = self.spark.createDataFrame([([r[0] if one else r for r in rows],)], T.StructType([T.StructField("a", T.ArrayType(kind))])).first()
        return literal([x for x in made["a"]])

    # ------------------------------------------------------------ rules
    def act_as(self, rules: list[str] = (), masks: list[str] = ()) -> Session:
        """Data rules that hold for this session, and patterns (LIKE, any case) of columns that it sees masked.

        A rule that compares a field which a table does not have does not concern that table: its rows are all seen. To keep a table
        closed, name a field that it has, or define its permissions."""
        self.auth_rules, self.masks = list(rules), list(masks)
        return self

    def _rules(self) -> list[n.Define]:
        found = [self.definitions.get(("data rule", r)) for r in self.auth_rules]
        return [d for d in found if d is not None]

    def row_rules(self, table: str, action: str) -> list[n.Expr]:
        out = [d.get("where") for d in self._rules()]
        own = self.tables.get(table)
        if own and action in own.permissions:
            out.append(own.permissions[action])
        columns = set(own.rows().columns) if own and own.rows() is not None else set()
        # a rule over fields that a table lacks does not concern it
        return [e for e in out if action != "select" or not isinstance(e, n.Binary) or not columns or _names(e) <= columns | {"value"}]

    def is_masked(self, column: str) -> bool:
        patterns = [*self.masks, *(p for d in self._rules() for p in d.get("mask") or ())]
        return any(re.fullmatch(re.escape(p.lower()).replace("%", ".*").replace("_", "."), column.lower()) for p in patterns)

    def as_of(self, table: Table, moment: str, what: str, before: bool) -> DataFrame:
        """A table at a moment: ISO text, milliseconds since 1970, or the id that the audit log gives a statement."""
        if what == "STATEMENT":
            moment = next((r[1].replace(tzinfo=dt.UTC).isoformat() for r in self.audit if r[0] == moment), moment)
        at = float(moment) / 1000 if moment.replace(".", "", 1).isdigit() else dt.datetime.fromisoformat(moment.replace("Z", "+00:00")).replace(tzinfo=dt.UTC).timestamp()
        df = table.at(at, before).rows()
        return df if df is not None else empty(self.spark, table.fields)

    def judge(self, pattern: str, verdict: str) -> Session:
        """An audit rule: statements whose text the pattern matches (anywhere, any case) are noted with this verdict, and not run if
        it is DANGER. The gravest verdict of all rules counts."""
        if verdict not in VERDICTS:
            raise ValueError(f"a verdict is one of {', '.join(VERDICTS)}")
        self.audit_rules.append((re.compile(pattern, re.IGNORECASE), verdict))
        return self

    # ------------------------------------------------------------ running
    def execute(self, text: str, **params):
        """Runs all statements; gives the last one's result: a DataFrame for SELECT, a Python value otherwise."""
        self.variables |= params
        out = None
        for s in parse(text):
            found = max((v for rule, v in self.audit_rules if rule.search(render(s))), key=VERDICTS.index, default="SAFE") if self.audit_rules else "SAFE"
            if found == "DANGER":
                self._note(s, found)
                raise Refused(f"an audit rule forbids {render(s)}")
            try:
                out = self.run(s)
                self._note(s, found)
            except Refused:
                self._note(s, "WARNING")
                raise
        return out

    def query(self, text: str, **params) -> DataFrame:
        """The DataFrame of one SELECT."""
        out = self.execute(text, **params)
        if not isinstance(out, DataFrame):
            raise TypeError("not a SELECT")
        return out

    def sql(self, text: str, params: tuple = ()) -> DataFrame:
        """Spark SQL over the session's tables, as they are now."""
        for name, t in self.tables.items():
            if name in text:
                df = t.rows()
                if df is not None:
                    df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(params) or None)

    def rows(self, text: str, **params) -> object:
        """A SELECT's result as Python values: a list of dicts, of bare values for VALUE, one alone for ONLY or a record."""
        *before, last = parse(text)
        self.variables |= params
        for s in before:
            self.run(s)
        plan = Planner(self).plan(last, {})
        got = [r["value"] if plan.value else r.asDict(recursive=True) for r in plan.df.collect()]
        return got[0] if plan.single and len(got) == 1 else got

    def run(self, s: n.Node, params: dict | None = None):
        params = params or {}
        if isinstance(s, (n.Select, n.Combine)):
            return Planner(self).plan(s, params).df
        if isinstance(s, n.Evaluate):
            return self.evaluate(s.expr, params)
        if isinstance(s, n.Control):
            return self._control(s, params)
        if isinstance(s, n.Change):
            return self._change(s, params)
        if isinstance(s, n.Relate):
            return self._relate(s, params)
        if isinstance(s, n.Define):
            return self._define(s)
        if isinstance(s, n.Drop):
            return self._drop(s)
        if isinstance(s, n.Info):
            return self._info(s)
        if isinstance(s, n.Explain):
            return self._explain(s, params)
        if isinstance(s, n.Live):
            return self.live(s)
        raise Unsupported(type(s).__name__)

    def one_row(self, params: dict | None = None) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("__one")), self, params=params or {})

    def evaluate(self, e: n.Expr, params: dict | None = None):
        if isinstance(e, n.Query):
            return Planner(self).plan(e.select, params or {}).df
        if isinstance(e, n.Block):
            out = None
            for s in e.body:
                out = self.run(s, params)
                if isinstance(s, n.Control) and s.op == "RETURN":
                    break
            return out
        if isinstance(e, n.Branch):
            for when, then in e.when:
                if self.evaluate(n.Unary("not", n.Unary("not", when)), params):
                    return self.evaluate(then, params)
            return self.evaluate(e.otherwise, params) if e.otherwise is not None else None
        if isinstance(e, n.Call) and e.name.lower().startswith("kv::"):  # values keep their own types
            return self.keys.call(e.name.lower(), [self.evaluate(a, params) for a in e.args])
        rows = Planner(self).attach(self.one_row(params), e)
        v = lower(e, rows)
        return _plain(rows.df.select(v.col.alias("v")).first()["v"]) if not v.null else None

    def _control(self, s: n.Control, params: dict):
        if s.op == "LET":
            self.variables[s.name] = self.evaluate(s.value, params)
            return None
        if s.op == "RETURN":
            return self.evaluate(s.value, params)
        if s.op == "ERROR":
            raise Refused(str(self.evaluate(s.value, params)))
        if s.op == "USE":
            for what, name in s.extra:
                setattr(self, what, name)
            return None
        if s.op == "KILL":
            return self.feed.kill(str(self.evaluate(s.value, params)))
        state = lambda: ({k: dict((x, t.opened().state) for x, t in v.items()) for k, v in self.databases.items()}, (self.edges, self.related), dict(self.keys.items))
        if s.op in ("BEGIN", "SAVEPOINT"):
            if s.op == "SAVEPOINT" and not self._stack:
                raise Refused("no transaction")
            self._stack.append((s.name, *state()))
            return None
        names = [x[0] for x in self._stack]
        if s.op in ("RELEASE", "ROLLBACK"):
            if s.name not in names:
                raise Refused(f"no savepoint {s.name}")
            at = len(names) - 1 - names[::-1].index(s.name)
            if s.op == "RELEASE":
                del self._stack[at:]
            else:
                self._restore(self._stack[at])
                del self._stack[at + 1 :]
            return None
        if not self._stack:
            raise Refused("no transaction")
        if s.op == "CANCEL":
            self._restore(self._stack[0])
            self._held.clear()
        self._stack.clear()
        held, self._held = self._held, []
        for event in held:
            self.feed.publish(*event)
        return None

    def _restore(self, saved: tuple) -> None:
        _, databases, edges, keys = saved
        for where, tables in self.databases.items():
            for name, t in tables.items():
                state = databases.get(where, {}).get(name, State())
                if t.state is not state:
                    t.write(state)
        (self.edges, self.related), self.keys.items = edges, dict(keys)

    # ------------------------------------------------------------ changes
    def insert(self, name: str, df: DataFrame) -> int:
        """Rows of a DataFrame into a table, with defaults, checks and rules; they need no pass through the driver."""
        if ID not in df.columns:
            df = df.withColumn(ID, F.concat(F.lit(f"{name}:"), F.uuid()))
        return self._write(name, df, "CREATE").count()

    def _new_rows(self, s: n.Change, params: dict) -> DataFrame:
        """The rows that CREATE or INSERT give, fixed (random keys included)."""
        name, rows = s.target.table, self.one_row(params)
        made = rows.find("id")
        if s.mode == "ROWS":
            data = lower(s.data, Planner(self).attach(rows, s.data))
            df = rows.df.select((data.col if data.array else F.array(data.col)).alias("__a")).select(F.inline("__a")) if isinstance(data.kind.elementType if data.array else data.kind, T.StructType) else None
            if df is None:
                return empty(self.spark)
        else:
            if s.data is not None:
                v = lower(s.data, Planner(self).attach(rows, s.data))
                items = [(f.name, Value(v.col.getField(f.name), f.dataType)) for f in v.kind.fields] if isinstance(v.kind, T.StructType) else [(k, literal(x)) for k, x in (self.evaluate(s.data, params) or {}).items()]
            else:
                items = self._set_items(s.sets, rows)
            df = rows.df.select(*((v.col if not v.null else F.lit(None).cast("string")).alias(k) for k, v in items))
        if s.target.key is not None:
            key = lower(s.target.key, rows).col.cast("string")
            df = df.withColumn(ID, F.concat(F.lit(f"{name}:"), key))
        elif ID in df.columns:
            own = df[ID].cast("string")
            df = df.withColumn(ID, F.when(own.startswith(f"{name}:"), own).otherwise(F.concat(F.lit(f"{name}:"), own)))
        else:
            df = df.withColumn(ID, F.concat(F.lit(f"{name}:"), F.uuid()))
        del made
        if any(isinstance(x, n.Query) for x in walk((s.data, s.sets))):
            return stored(df, f"new-{name}")
        return self.spark.createDataFrame(df.collect(), df.schema)  # a statement's own rows, spelled out in its text

    def _set_items(self, sets, rows: Rows) -> list[tuple[str, Value]]:
        """Top-level fields of SET, nested paths as objects."""
        out: dict[str, object] = {}
        for path, e in sets:
            at, *rest = path.split(".")
            v = lower(e, Planner(self).attach(rows, e))
            if rest:
                out.setdefault(at, {})
                node = out[at]
                for part in rest[:-1]:
                    node = node.setdefault(part, {})
                node[rest[-1]] = v
            else:
                out[at] = v
        build = lambda x: struct([(k, build(y)) for k, y in x.items()]) if isinstance(x, dict) else x
        return [(k, build(x)) for k, x in out.items()]

    def _checked(self, name: str, df: DataFrame, action: str) -> DataFrame:
        """Rows with defaults, coercions, injected values; refused if a check does not hold."""
        t = self._own(name)
        for f, o in t.fields.items():
            if "." in f:
                continue
            if "default" in o:
                rows = Rows(df, self)
                d = lower(o["default"], rows)
                own = rows.find(f)
                kind = common([own.kind, d.kind]) if own else d.kind
                df = df.withColumn(f, F.coalesce(conform(own, kind), conform(d, kind)) if own else d.col)
            if o.get("type") and f in df.columns and f != ID:
                df = self._coerced(df, f, o["type"])
        for d in self._rules():
            for f, v in _equalities(d.get("where")):
                if action in ("CREATE", "UPDATE"):
                    df = df.withColumn(f, lower(v, Rows(df, self)).col)
        for f, o in t.fields.items():
            rows = Rows(df, self)
            own = rows.find(f) or sem.nothing()
            if "assert" in o:
                bad = ~sem.truthy(lower(o["assert"], Rows(df, self, params={"value": own})))
                if df.where(bad).take(1):
                    raise Refused(f"field {f} of {name} does not meet {render(o['assert'])}")
            if o.get("references") and not own.null:
                other = self.table(o["references"]).rows()
                ids = F.when(own.col.contains(":"), own.col).otherwise(F.concat(F.lit(o["references"] + ":"), own.col.cast("string")))
                lost = df.where(own.col.isNotNull()).select(ids.alias("__r")).join(other.select(F.col(ID).alias("__r")), "__r", "left_anti")
                if lost.take(1):
                    raise Refused(f"field {f} of {name} refers to a missing {o['references']}")
        allowed = t.permissions.get(action.lower())
        for rule in [*([allowed] if allowed is not None else []), *(d.get("where") for d in self._rules())]:
            rows = Rows(df, self)
            if df.where(~sem.truthy(lower(rule, rows))).take(1):
                raise Refused(f"{action} on {name} is not allowed by {render(rule)}")
        return df

    def _coerced(self, df: DataFrame, f: str, type_text: str) -> DataFrame:
        v = Rows(df, self).find(f)
        want = {"int": "int", "float": "float", "number": "number", "string": "string", "bool": "bool", "datetime": "datetime", "varchar": "string", "bigint": "int", "double": "float", "boolean": "bool", "timestamp": "datetime", "text": "string"}.get(type_text)
        if want is None:
            shape = {"array": v.array, "object": v.object, "geometry": v.object and "coordinates" in getattr(v.kind, "names", ()), "vector": v.array and sem.is_number(v.kind.elementType)}.get(type_text, True)
            if not shape and df.where(v.col.isNotNull()).take(1):
                raise Refused(f"field {f} is no {type_text}")
            return df
        out = cast(want, v)
        bad = None
        if want in ("int", "float", "number") and not v.number:
            bad = v.col.cast("string").try_cast("double").isNull()
        elif want == "datetime":
            bad = out.col.isNull()
        elif want == "bool" and not isinstance(v.kind, T.BooleanType):
            bad = ~F.lower(v.col.cast("string")).isin("true", "false")
        if bad is not None and df.where(v.col.isNotNull() & bad).take(1):
            raise Refused(f"field {f} is no {type_text}")
        return df.withColumn(f, F.when(v.col.isNotNull(), out.col))

    def _unique(self, name: str, df: DataFrame) -> None:
        """Rows to be written, against each other and the rest, for every unique index; NULL exempts."""
        t = self._own(name)
        for index in t.indexes.values():
            columns = list(index["columns"])
            if index["kind"] != "unique" or not set(columns) <= set(df.columns):
                continue
            some = df.dropna(subset=columns).select(ID, *columns)
            twice = some.groupBy(*columns).count().where("count > 1")
            old = t.rows()
            clash = old is not None and set(columns) <= set(old.columns) and old.select(F.col(ID).alias("__o"), *columns).join(some, columns).where(F.col("__o") != F.col(ID)).take(1)
            if twice.take(1) or clash:
                raise Refused(f"{name} already has such {', '.join(columns)}")

    def _write(self, name: str, df: DataFrame, action: str, before: DataFrame | None = None) -> DataFrame:
        t = self._own(name)
        df = stored(self._checked(name, df, action), f"rows-{name}")
        self._unique(name, df)
        if action == "CREATE" and t.rows() is not None and ID in t.rows().columns and t.rows().select(ID).join(df.select(ID), ID, "left_semi").take(1):
            raise Refused(f"{name} already has a record with this id")
        t.write(t.state.changed(df, df.select(ID)))
        self._after(name, action, before, df)
        return df

    def _after(self, name: str, action: str, before: DataFrame | None, after: DataFrame | None) -> None:
        """Live queries and events of a change."""
        if self._stack:
            self._held.append((name, action, before, after))
        else:
            self.feed.publish(name, action, before, after)
        events = [d for (what, _), d in self.definitions.items() if what == "event" and d.get("table") == name]
        if not events:
            return
        # events see one row at a time, as their statements do; the driver holds a partition's rows
        image = lambda df, what: df.select(F.col(ID).alias("__id"), F.struct(*map(col, df.columns)).alias(what))
        if before is not None and after is not None:
            both = image(after, "a").join(image(before, "b"), "__id", "full").select("a", "b")
        else:
            both = image(after, "a").withColumn("b", F.lit(None)) if after is not None else image(before, "b").withColumn("a", F.lit(None))
        for r in both.toLocalIterator():
            b, a = r["b"], r["a"]
            params = {"event": action, "before": _dict(b), "after": _dict(a), "value": _dict(a if a is not None else b)}
            for d in events:
                if self.evaluate(n.Unary("not", n.Unary("not", d.get("when"))), params):
                    for s in d.get("then"):
                        self.run(s, params)

    def _change(self, s: n.Change, params: dict):
        name = s.target.table
        if s.target.db is not None:
            raise Unsupported("changes go to the database in use")
        if s.op in ("CREATE", "INSERT"):
            return self._returned(s, None, self._write(name, self._new_rows(s, params), "CREATE"))
        t = self._own(name)
        df = t.rows()
        hit = None
        if df is not None:
            if ID not in df.columns:
                raise Refused(f"{name} has no record ids; register it with an id column to change it")
            rows = Planner(self).source(s.target, None, params)
            for rule in self.row_rules(name, s.op.lower() if s.op != "UPSERT" else "update"):
                rows.df = rows.df.where(condition(rule, rows))
            rows = Planner(self).where(rows, n.Select((n.Output(None),), s.target, where=s.where))
            hit = stored(rows.df.select(*map(col, rows.visible())), f"hit-{name}")
        found = hit is not None and bool(hit.take(1))
        if s.op == "DELETE":
            if found:
                t.write(t.state.changed(None, hit.select(ID)))
                self._after(name, "DELETE", hit, None)
            return hit if s.returns == "BEFORE" and found else None
        if not found:
            if s.op == "UPSERT":
                fresh = n.Change("CREATE", s.target, "CONTENT" if s.mode in ("MERGE", "PATCH", "REPLACE", "CONTENT") else s.mode, s.data, s.sets)
                return self._returned(s, None, self._write(name, self._new_rows(fresh, params), "CREATE"))
            return empty(self.spark)
        return self._returned(s, hit, self._write(name, self._updated(s, hit, params), "UPDATE", hit))

    def _updated(self, s: n.Change, hit: DataFrame, params: dict) -> DataFrame:
        rows = Planner(self).attach(Rows(hit, self, params=params, labels={s.target.table: ""}, table=s.target.table), (s.sets, s.data))
        if s.mode in ("CONTENT", "REPLACE"):
            v = lower(s.data, rows)
            return rows.df.select(col(ID), *(v.col.getField(f.name).alias(f.name) for f in v.kind.fields if f.name != ID))
        items = []
        if s.mode == "SET":
            for path, e in s.sets:
                at, *rest = path.split(".")
                v, own = lower(e, rows), rows.find(at)
                if rest:
                    items.append((at, Value(_with_field(own, rest, v).col, _with_field(own, rest, v).kind)))
                    continue
                if own is not None and own.number and v.string:
                    v = Value(v.col.try_cast(own.kind), own.kind)
                items.append((at, v))
        elif s.data is not None:
            v = lower(s.data, rows)
            items = [(f.name, Value(v.col.getField(f.name), f.dataType)) for f in v.kind.fields]
        new = {}
        for at, v in items:
            own = rows.find(at)
            kind = common([own.kind, v.kind]) if own is not None and not v.null else own.kind if own is not None else v.kind if not v.null else T.StringType()
            new[at] = (conform(v, kind) if not v.null else F.lit(None).cast(kind)).alias(at)
        shown = [c for c in rows.df.columns if not c.startswith("__")]
        return rows.df.select(*(new.pop(c) if c in new else col(c) for c in shown), *new.values())

    def _returned(self, s: n.Change, before: DataFrame | None, after: DataFrame):
        if s.returns == "NONE":
            return None
        return before if s.returns == "BEFORE" else after

    def _relate(self, s: n.Relate, params: dict):
        ids = []
        for e in (s.source, s.target):
            v = self.evaluate(e, params)
            ids.append([str(x) for x in v] if isinstance(v, list) else [str(v)])
        made = self.spark.createDataFrame([(a, s.kind, b) for a in ids[0] for b in ids[1]], graph.EDGES)
        self.related = made if self.related is None else self.related.union(made)
        self._loose += 1
        if self._loose >= 8:
            self.related, self._loose = stored(self.related, "edges"), 0
        self.kinds.add(s.kind)
        rows = self.one_row(params)
        data = self._set_items(s.sets, rows) if s.sets else []
        out = {k: _plain(rows.df.select(v.col.alias("v")).first()["v"]) for k, v in data}
        return {"in": ids[0][0], "out": ids[1][0], "kind": s.kind, **out}

    # ------------------------------------------------------------ graph, records, keys
    def _edges(self) -> DataFrame:
        if self.edges is None or self.related is None:
            some = self.edges if self.edges is not None else self.related
            return some if some is not None else self.spark.createDataFrame([], graph.EDGES)
        return self.edges.union(self.related)

    def hop(self, e: n.Hop, rows: Rows) -> Value:
        """Record ids that a traversal reaches from each row, as an array. It starts once from each distinct id (or list of ids), and
        is joined to the rows by these: they say all that it depends on."""
        begun, name = hidden(), hidden()
        start = lower(e.base, rows) if e.base is not None else Value(col("id"), T.StringType())
        starts = rows.df.select(start.col.alias("row")).where("row IS NOT NULL").distinct()
        found = graph.hops(starts.select("row", (F.explode("row") if start.array else F.col("row")).alias("node")), self._edges(), e.steps, self.kinds)
        rows.df = rows.df.join(found.select(F.col("row").alias(begun), F.col("nodes").alias(name)), start.col == F.col(begun), "left").drop(begun)
        return Value(F.coalesce(F.col(name), F.array().cast("array<string>")), T.ArrayType(T.StringType()))

    def graph_call(self, name: str, args: tuple, rows: Rows) -> Value:
        v = [constants.value_of(lower(a, self.one_row(rows.params)).col) for a in args]
        kind, most = (str(v[2]) if len(v) > 2 else "*"), (int(v[3]) if len(v) > 3 else 10)
        if name == "graph::connected":
            return literal(graph.connected(self._edges(), str(v[0]), str(v[1]), kind, most))
        if name == "graph::path":
            return literal(graph.path(self._edges(), str(v[0]), str(v[1]), kind, most))
        raise Unsupported(name)

    def records(self, ids: DataFrame, key: str) -> tuple[DataFrame, T.DataType] | None:
        """(id, record) of the records that ids name, whatever their tables. Which tables: one distinct over prefixes."""
        known = {name: t for name, t in self.tables.items() if t.rows() is not None and ID in t.rows().columns}
        prefixes = ids.select(F.substring_index(key, ":", 1).alias("p")).distinct().where(F.col("p").isin(*known)).limit(len(known)).collect() if known else []
        frames = [known[r["p"]].rows() for r in prefixes]
        if not frames:
            return None
        every = frames[0]
        for f in frames[1:]:
            every = aligned(every, f)
        wanted = ids.select(F.col(key).alias(ID)).distinct()
        made = every.join(wanted, ID, "left_semi").select(F.col(ID), F.struct(*map(col, every.columns)).alias("record"))
        return made, T.StructType([every.schema[c] for c in every.columns])

    def kv_call(self, name: str, args: list[Value], rows: Rows) -> Value:
        v = [constants.value_of(a.col) for a in args]
        return literal(self.keys.call(name, [_plain(x) for x in v]))

    def postings(self, name: str, index: dict, body, terms) -> tuple[DataFrame, DataFrame, str] | None:
        """Postings of a table's rows as they are, their totals, and the column of their keys; None where rows have no unique key.

        Built once for a table's base and written, sorted by term; for a base read from files also kept for other sessions, as long
        as the files are the same. What changes have put is analysed when it is searched, what they have removed is left out."""
        t = self._own(name)
        state = t.state
        if t.rows() is None:
            return None
        key = ID if ID in t.rows().columns else t.key
        if key is None:
            return None
        mark = tuple(sorted((k, str(v)) for k, v in index.items()))
        if state.base is None:
            found, whole = None, None
        else:
            kept = t.postings.get(mark)
            if kept is None or kept[0] is not state.base:
                kept = t.postings[mark] = (state.base, *self._built(t, key, mark, terms))
            _, found, whole = kept
            if found is None:
                return None
        if state.gone is not None or state.base is None:
            if found is not None:
                found = found.join(state.gone.select(F.col(ID).alias("key")), "key", "left_anti").select(*found.columns)
            if state.put is not None:
                put = fulltext.postings(state.put, key, terms)
                found = put if found is None else found.unionByName(put)
            whole = fulltext.totals(found)
        return found, whole, key

    def _built(self, t: Table, key: str, mark: tuple, terms) -> tuple[DataFrame | None, DataFrame | None]:
        known, made = _built.setdefault(self.spark, {}), None
        if t.path is not None:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(t.path)
            files = where.getFileSystem(conf)
            size = files.getContentSummary(where)
            made = (t.path, key, mark, str(sorted(self.analyzer(dict(mark)["analyzer"]).items())), size.getLength(), size.getFileCount(), files.getFileStatus(where).getModificationTime())
            if made in known:
                return known[made]
        base = t.state.base
        if base.groupBy(col(key)).count().where(F.col("count") > 1).take(1) or base.where(col(key).isNull()).take(1):
            out = (None, None)
        else:
            found = fulltext.write_postings(fulltext.postings(base, key, terms), new_path(self.spark, f"postings-{t.name}"))
            n_, all_ = fulltext.totals(found).first()
            out = (found, self.spark.range(1).select(F.lit(n_).cast("long").alias("__n"), F.lit(all_).cast("long").alias("__all")))
        if made is not None:
            known[made] = out
        return out

    def subquery(self, s: n.Node, rows: Rows) -> Value:
        return Planner(self).subquery(s, rows)

    # ------------------------------------------------------------ definitions
    def _define(self, s: n.Define):
        if s.what in ("table", "field", "index"):
            name = s.get("table") or s.name
            t = self._own(name)
            if s.what == "field":
                t.fields[s.name] = dict(s.options)
            elif s.what == "index":
                t.indexes[s.name] = dict(s.options)
                if s.get("kind") == "unique" and t.rows() is not None:
                    self._unique(name, t.rows())
            elif s.get("changes"):
                for what, column, options in s.get("changes"):
                    if what == "drop":
                        t.fields.pop(column, None)
                        if t.rows() is not None:
                            t.write(State(t.rows().drop(column)))
                    else:
                        t.fields[column] = dict(options)
            else:
                t.schemafull = bool(s.get("schemafull"))
                t.permissions = dict(s.get("permissions") or ())
                for column, options in s.get("columns") or ():
                    t.fields[column] = dict(options)
        elif s.what == "link":
            url = s.get("url")
            reader = {"url": url, **{k: v for k, v in s.options if k in ("user", "password")}} if url.startswith("jdbc:") else (lambda table: self.spark.read.parquet(f"{url}/{table}.parquet"))
            self.link(s.name, reader)
        self.definitions[s.what, s.name] = s
        return None

    def _drop(self, s: n.Drop):
        if s.what == "table":
            self.tables.pop(s.name, None)
        elif s.what == "link":
            self.links.pop(s.name, None)
        elif s.what in ("field", "index"):
            for t in self.tables.values():
                if s.table in (None, t.name):
                    (t.fields if s.what == "field" else t.indexes).pop(s.name, None)
        self.definitions.pop((s.what, s.name), None)
        return None

    def _info(self, s: n.Info):
        named = lambda what: sorted(k for w, k in self.definitions if w == what)
        if s.what == "root":
            return {"namespaces": sorted({a for a, _ in self.databases}), "users": named("user"), "links": sorted(self.links)}
        if s.what == "namespace":
            return {"databases": sorted({b for a, b in self.databases if a == self.namespace})}
        if s.what == "database":
            return {"tables": sorted(self.tables), "analyzers": named("analyzer"), "events": named("event"), "rules": named("data rule"), "users": named("user"), "accesses": named("access")}
        if s.what == "data rules":
            return {name: render(self.definitions["data rule", name].get("where")) for name in named("data rule")}
        t = self._own(s.name)
        if s.what == "table":
            return {"fields": {k: dict(v) for k, v in t.fields.items()}, "indexes": {k: dict(v) for k, v in t.indexes.items()}, "events": sorted(k for (w, k), d in self.definitions.items() if w == "event" and d.get("table") == s.name), "permissions": {k: render(v) for k, v in t.permissions.items()}, "schemafull": t.schemafull}
        df = t.rows()
        found = {f.name: f.dataType.simpleString() for f in df.schema} if df is not None else {}
        return {"table": s.name, "fields": {**found, **{k: v["type"] for k, v in t.fields.items() if v.get("type")}}}

    def _explain(self, s: n.Explain, params: dict):
        q = s.select
        table = q.target.table if isinstance(q, n.Select) and q.target else None
        label, index = strategy(q, self._own(table).indexes if table else {}) if isinstance(q, n.Select) else ("FULL_SCAN", None)
        df = Planner(self).plan(q, params).df
        out = {"strategy": label, "table": table, "indexName": index, "plan": df._jdf.queryExecution().toString()}
        if s.analyze:
            out["rows"] = df.count()
            out["examinedRows"] = self.table(table).rows().count() if table else out["rows"]
        return out

    # ------------------------------------------------------------ live queries
    def live(self, s: n.Live | str, receive: Callable[[dict], None] | None = None) -> Subscription:
        """A live query. ``receive`` gets each change as a dict: action, result (or patch for DIFF), id."""
        if isinstance(s, str):
            (s,) = parse(s)
        q = s.select
        if q.joins or q.group is not None or q.order or q.limit or q.start or q.fetch or q.target is None or q.target.table is None:
            raise Unsupported("a live query has fields, a table and WHERE alone")
        return self.feed.subscribe(s, receive)

    def now(self) -> int:
        return int(time.time() * 1000)


# ---------------------------------------------------------------- helpers
def _plain(v):
    if hasattr(v, "asDict"):
        return v.asDict(recursive=True)
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _dict(row):
    return None if row is None else {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def _names(e: n.Expr) -> set[str]:
    from .plans.expressions import walk

    return {x.name for x in walk(e) if isinstance(x, n.Name)}


def _equalities(e: n.Expr) -> list[tuple[str, n.Expr]]:
    from .plans.expressions import conjuncts

    return [(p.left.name, p.right) for p in conjuncts(e) if isinstance(p, n.Binary) and p.op == "=" and isinstance(p.left, n.Name) and not isinstance(p.right, n.Name)]


def _with_field(own: Value | None, path: list[str], v: Value) -> Value:
    """An object with the field at a path replaced or added."""
    head, *rest = path
    fields = {f.name: Value(own.col.getField(f.name), f.dataType) for f in own.kind.fields} if own is not None and isinstance(own.kind, T.StructType) else {}
    fields[head] = _with_field(fields.get(head), rest, v) if rest else v
    return struct(list(fields.items()))


__all__ = ["Plan", "Refused", "Session"]
