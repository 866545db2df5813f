"""SELECT statements to DataFrames.

Order of work: source, row rules and masks, joins, WHERE, search scores, then either grouping or ordering and the window of rows,
then FETCH and projection. Catalyst does the rest: push-down, pruning, join strategy, top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import semantics as sem
from ..lang import nodes as n
from ..lang.render import render
from ..operators import fulltext, geo
from ..semantics import Value, nothing
from . import constants
from .expressions import Rows, Unsupported, array, col, common, condition, conform, conjuncts, hidden, literal, lower, member, output_name, over, path_of, struct, walk

AGGREGATES = {"count", "sum", "avg", "min", "max"}
MOST_ROWS = 100_000  # of a subquery that becomes one array, sent to every task


@dataclass
class Plan:
    df: DataFrame
    value: bool = False  # bare values instead of objects
    single: bool = False  # one object instead of a list


class Planner:
    def __init__(self, session):
        self.session = session
        self.spark = session.spark

    # ------------------------------------------------------------ entry
    def plan(self, s: n.Node, params: dict | None = None) -> Plan:
        params = params or {}
        if isinstance(s, n.Combine):
            a, b = self.plan(s.left, params), self.plan(s.right, params)
            both = {"union": lambda: a.df.unionByName(b.df).distinct(), "union all": lambda: a.df.unionByName(b.df), "intersect": lambda: a.df.intersect(b.df), "except": lambda: a.df.subtract(b.df)}
            return Plan(both[s.op](), a.value)
        rows = self.filtered(s, params)
        return self.finish(s, rows)

    def filtered(self, s: n.Select, params: dict) -> Rows:
        """Source, rules, joins and WHERE."""
        rows = self.source(s.target, s.version, params, s.alias)
        for j in s.joins:
            rows = self.join(rows, j)
        return self.where(rows, s)

    def finish(self, s: n.Select, rows: Rows) -> Plan:
        if any(self._is_aggregate(f.expr) for f in s.fields if f.expr is not None):
            df = self.aggregate(s, rows)
            return Plan(self._window(s, df), s.value, s.only)
        rows = self.attach(rows, (s.fields, s.order))
        named = {f.alias: f.expr for f in s.fields if f.alias}
        order = tuple((named[e.name] if isinstance(e, n.Name) and e.name in named and rows.find(e.name) is None else e, down) for e, down in s.order)
        if not order and self._hybrid(s) and rows.score is not None:
            order = ((n.Call("search::score", ()), True),)
        kept = []  # the sort keys, as columns of the rows
        for e, down in order:
            kept.append((hidden(), down))
            rows.df = rows.df.withColumn(kept[-1][0], lower(e, rows).col)
        keys = [k for name, down in kept for k in sem.sort_key(Value(col(name), rows.kind(name)), down)]
        if s.distinct:
            return Plan(self._distinct(s, rows, kept), s.value, s.only)
        if not keys and (s.limit or s.start) and rows.id_column:
            keys = [col(rows.id_column).asc()]
        if keys:
            rows.df = rows.df.orderBy(*keys)
        rows.df = self._window(s, rows.df)
        for f in s.fetch:
            rows = self.fetch(rows, f)
        if s.fetch and kept:  # its joins do not keep an order
            rows.df = rows.df.orderBy(*keys)
        rows = self._masked(rows)
        df = self.project(s, rows)
        single = s.only or bool(s.target and s.target.key is not None and not s.joins)
        return Plan(df, s.value, single)

    def _distinct(self, s: n.Select, rows: Rows, kept: list[tuple[str, bool]]) -> DataFrame:
        """Distinct rows, then their order and window. A row that several source rows give stands where the first of them would."""
        for f in s.fetch:
            rows = self.fetch(rows, f)
        df = self.project(s, self._masked(rows), [name for name, _ in kept])
        shown = [c for c in df.columns if c not in {name for name, _ in kept}]
        if not kept:
            return self._window(s, df.distinct())
        df = df.groupBy(*map(col, shown)).agg(*((F.max if down else F.min)(col(name)).alias(name) for name, down in kept))
        df = df.orderBy(*(k for name, down in kept for k in sem.sort_key(Value(col(name), df.schema[name].dataType), down)))
        return self._window(s, df).select(*map(col, shown))

    # ------------------------------------------------------------ sources
    def source(self, t: n.Target | None, version, params: dict, alias: str | None = None) -> Rows:
        base = dict(session=self.session, params=params)
        if t is None:
            return Rows(self.spark.range(1).select(F.lit(1).alias("__one")), **base)
        if t.query is not None:
            plan = self.plan(t.query, params)
            return Rows(plan.df, labels={alias: ""} if alias else {}, **base)
        if t.expr is not None:
            return self._from_expression(t.expr, base, alias)
        return self._from_table(t, version, base, alias)

    def _from_expression(self, e: n.Expr, base: dict, alias: str | None) -> Rows:
        if isinstance(e, n.Param):
            v = base["params"].get(e.name, self.session.variable(e.name))
            if isinstance(v, DataFrame):
                return Rows(v, labels={alias: ""} if alias else {}, **base)
            if isinstance(v, str) and ":" in v:
                table, _, key = v.partition(":")
                return self._from_table(n.Target(table=table, key=n.Literal(key)), None, base, alias)
            v = v if isinstance(v, Value) else literal(v)
        else:
            v = lower(e, Rows(self.spark.range(1), **base))
        one = self.spark.range(1).select((v.col if v.array else F.array(v.col)).alias("__a"))
        item = v.kind.elementType if v.array else v.kind
        df = one.select(F.inline("__a")) if isinstance(item, T.StructType) else one.select(F.explode("__a").alias("value"))
        return Rows(df, labels={alias: ""} if alias else {}, **base)

    def _from_table(self, t: n.Target, version, base: dict, alias: str | None) -> Rows:
        table = self.session.table(t.table, t.db)
        df = table.rows()
        if version is not None:
            way, what, moment = version
            at = constants.value_of(lower(moment, Rows(self.spark.range(1), **base)).col.cast("string"))
            df = self.session.as_of(table, str(at), what, way == "BEFORE")
        labels = {t.table: "", **({alias: ""} if alias else {})}
        rows = Rows(df, labels=labels, table=t.table, id_column="id" if "id" in df.columns else table.key, **base)
        if t.key is not None:
            key = lower(t.key, rows)
            if not table.key and "id" not in df.columns:
                raise Unsupported(f"{t.table} has neither an id column nor a key to read records by")
            if table.key:
                rows.df = rows.df.where(sem.eq(Value(col(table.key), rows.kind(table.key)), key).col)
            else:
                rows.df = rows.df.where(col("id") == F.concat(F.lit(f"{t.table}:"), key.col.cast("string")))
        for rule in self.session.row_rules(t.table, "select"):
            rows.df = rows.df.where(condition(rule, rows))
        return rows

    def _masked(self, rows: Rows) -> Rows:
        """Masked columns become ***, before projection, so that no alias escapes."""
        hide = [c for c in rows.visible() if self.session.is_masked(c.rsplit(".", 1)[-1])]
        if hide:
            rows.df = rows.df.withColumns({c: F.when(col(c).isNotNull(), F.lit("***")) for c in hide})
        return rows

    # ------------------------------------------------------------ joins
    def join(self, left: Rows, j: n.Join) -> Rows:
        """An equi-join. Columns become ``table.field``; keys are found by qualifier, whichever side they stand on."""
        right = self.source(j.target, None, left.params, None)
        label = j.alias or j.target.table or hidden()
        if not any(p for p in left.labels.values()):  # first join: the left side's columns get their prefix
            own = next((a for a, t in ((a, a) for a in reversed(left.labels))), None) or "left"
            left = self._prefixed(left, own)
        right = self._prefixed(right, label, {j.target.table} if j.target.table else set())
        sides = {**left.labels, **right.labels}

        def side(e: n.Expr) -> str | None:
            names = {x.base.name for x in walk(e) if isinstance(x, n.Field) and isinstance(x.base, n.Name)}
            if names & set(right.labels):
                return "right"
            return "left" if names & set(left.labels) else None

        a, b = j.left, j.right
        if side(a) == "right" or side(b) == "left":
            a, b = b, a
        x, y = lower(self._bare(a, left), left), lower(self._bare(b, right), right)
        if not (x.number and y.number or type(x.kind) is type(y.kind)):
            test = F.lit(False)
        else:
            test = x.col == y.col
        how = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "inner"}[j.how]
        out = Rows(left.df.join(right.df, test, how), session=self.session, labels=left.labels if how in ("left_semi", "left_anti") else sides, params=left.params)
        return out

    @staticmethod
    def _bare(e: n.Expr, rows: Rows) -> n.Expr:
        """A qualified name of neither side is the last part alone."""
        if isinstance(e, n.Field) and isinstance(e.base, n.Name) and e.base.name not in rows.labels and rows.find(e.base.name) is None:
            return n.Name(e.name)
        return e

    def _prefixed(self, rows: Rows, label: str, more: set[str] = frozenset()) -> Rows:
        df = rows.df.select(*(col(c).alias(c if c.startswith("__") else f"{label}.{c}") for c in rows.df.columns))
        return replace(rows, df=df, labels={**{k: f"{label}." for k in {*rows.labels, *more}}, label: f"{label}."}, id_column=None)

    # ------------------------------------------------------------ WHERE
    def where(self, rows: Rows, s: n.Select) -> Rows:
        parts = conjuncts(s.where)
        done = self._search(rows, s, parts)
        for e in parts:
            if e is done:
                continue
            joined = self._in_subquery(rows, e)
            if joined is not None:
                rows = joined
                continue
            rows = self.attach(rows, e)
            near = self._near(rows, e)
            if near is not None:
                rows.df = rows.df.where(near)
            rows.df = rows.df.where(condition(e, rows))
        return rows

    def _near(self, rows: Rows, e: n.Expr):
        """For ``geo::distance(x, point) < metres``: plain ranges that all rows meet which the distance lets pass, or None.

        They are cheap, and reach the scan where x is a geometry::point of two columns. Missing places, other geometries and
        coordinates out of range pass."""
        if not (isinstance(e, n.Binary) and e.op in ("<", "<=") and isinstance(e.left, n.Call) and e.left.name.lower() == "geo::distance" and len(e.left.args) == 2):
            return None
        fixed = lambda x: not any(isinstance(y, (n.Name, n.Query, n.Hop)) or isinstance(y, n.Param) and y.name in ("parent", "this") for y in walk(x))
        a, b = e.left.args
        a, b = (a, b) if fixed(b) else (b, a)
        if not fixed(b) or fixed(a) or not fixed(e.right):
            return None
        one = Rows(self.spark.range(1), self.session, params=rows.params)
        point, metres = lower(b, one), lower(e.right, one)
        if not (isinstance(point.kind, T.StructType) and "coordinates" in point.kind.names and metres.number):
            return None
        centre, most = constants.value_of(F.struct(point.col.alias("p"), metres.col.cast("double").alias("m")))
        if most is None or most < 0 or centre is None or centre["type"] != "Point":
            return None
        around = geo.box(*map(float, centre["coordinates"]), most)
        if around is None:
            return None
        other = F.lit(False)
        if isinstance(a, n.Call) and a.name.lower() == "geometry::point" and len(a.args) == 2:
            x, y = (lower(z, rows) for z in a.args)
            if not (x.number and y.number):
                return None
            lon, lat = x.col, y.col
        else:
            v = lower(a, rows)
            if not (isinstance(v.kind, T.StructType) and "coordinates" in v.kind.names and isinstance(v.kind["coordinates"].dataType, T.ArrayType) and sem.is_number(v.kind["coordinates"].dataType.elementType)):
                return None
            lon, lat = (F.get(v.col.getField("coordinates"), F.lit(i)) for i in (0, 1))
            other = v.col.getField("type") != "Point" if "type" in v.kind.names else other
        inside = lon.between(around[0], around[1]) & lat.between(around[2], around[3])
        return inside | lon.isNull() | lat.isNull() | (lon < -180) | (lon > 180) | (lat < -90) | (lat > 90) | F.coalesce(other, F.lit(True))

    def _index(self, rows: Rows, e: n.Expr, kind: str) -> dict | None:
        name = path_of(e)
        if rows.table is None or name is None:
            return None
        for index in self.session.table(rows.table).indexes.values():
            if index["kind"] == kind and name.rsplit(".", 1)[-1] in index["columns"]:
                return index
        return None

    def _hybrid(self, s: n.Select) -> bool:
        parts = conjuncts(s.where)
        return len(parts) == 2 and any(_is_match(p) for p in parts) and any(_is_similarity(p) for p in parts)

    def _search(self, rows: Rows, s: n.Select, parts: list[n.Expr]) -> n.Expr | None:
        """For a WHERE that is one match, or a match and a similarity: the rows that hold all terms, and their scores. Gives the
        match if these rows meet it without a further test.

        Scores are relative to the whole table, so their statistics are taken before the filter. A table with record ids or a key is
        searched through the postings that its index keeps; any other, and one behind row rules or of an earlier time, is read and
        analysed."""
        match = next((p for p in parts if _is_match(p)), None)
        if match is None or not (len(parts) == 1 or self._hybrid(s)):
            return None
        index = self._index(rows, match.left, "search")
        if index is None:
            return None
        analyzer = self.session.analyzer(index["analyzer"])
        query = constants.text_of(lower(match.right, Rows(self.spark.range(1), self.session, params=rows.params)).col)
        terms = fulltext.analyze_query(query, **analyzer)
        columns = [rows.find(c) for c in index["columns"]]
        body = F.concat_ws(" ", *(sem.text(c) for c in columns if c is not None))
        value = fulltext.analyze(body, **analyzer)
        rows.terms = terms
        mine = hidden()
        wanted = any(isinstance(x, n.Call) and x.name.lower() == "search::score" for x in walk((s.fields, s.order))) or len(parts) == 2
        plain = s.version is None and s.target.key is None and s.target.db is None and not s.joins and not self.session.row_rules(rows.table, "select")
        kept = self.session.postings(rows.table, index, body, value) if plain else None
        if kept is not None:
            found, whole, key = kept
            hits = fulltext.indexed(found, terms, mine if wanted else None, whole).withColumnRenamed("key", "__key")
            rows.df = rows.df.join(hits, col(key) == F.col("__key")).drop("__key")
        else:
            found = fulltext.holding(rows.df, body, value, terms, analyzer["lowercase"])
            rows.df = fulltext.bm25(rows.df, value, terms, mine, found) if wanted else found
        # a text of all the query's words as they stand, in this column, matches
        words = fulltext.analyze_query(query)
        done = match if len(index["columns"]) == 1 and words and not analyzer["stemming"] and not set(analyzer["stopwords"]) & set(words) and analyzer["lowercase"] else None
        if not wanted:
            return done
        if len(parts) == 1:
            rows.score = Value(col(mine), T.DoubleType())
            return done
        similarity = next(p for p in parts if _is_similarity(p)).left
        total = hidden()
        rows.df = fulltext.normalised(rows.df, mine, total)
        cosine = lower(similarity, rows).col
        rows.score = Value(col(total) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))), T.DoubleType())
        return done

    # ------------------------------------------------------------ subqueries
    def _in_subquery(self, rows: Rows, e: n.Expr) -> Rows | None:
        """``x IN (SELECT VALUE y ...)`` as a semi-join, NOT IN as an anti-join; NULL equals NULL."""
        if not (isinstance(e, n.Binary) and e.op in ("in", "not_in") and isinstance(e.right, n.Query) and isinstance(e.right.select, n.Select) and e.right.select.value):
            return None
        rows = self.attach(rows, e.left)
        item = lower(e.left, rows)
        inner, keys = self._inner(e.right.select, rows)
        name = hidden()
        kind = inner.df.schema[inner.df.columns[0]].dataType
        df = inner.df.withColumnRenamed(inner.df.columns[0], name)
        test = sem.eq(item, Value(col(name), kind)).col
        for outer, own in keys:
            test = test & sem.eq(outer, Value(col(own), df.schema[own].dataType)).col
        rows.df = rows.df.join(df, test, "left_semi" if e.op == "in" else "left_anti")
        return rows

    def _inner(self, s: n.Select, rows: Rows) -> tuple[Plan, list[tuple[Value, str]]]:
        """A subquery with ``$parent.x = y`` taken out: its plan, with hidden columns of y, and the outer values of x."""
        keys, rest = [], []
        for p in conjuncts(s.where):
            if _parent(p):
                if not (isinstance(p, n.Binary) and p.op in ("=", "==") and bool(_parent(p.left)) != bool(_parent(p.right))):
                    raise Unsupported(f"a subquery depends on its parent through {render(p)}; only equality does")
                outer, own = (p.left, p.right) if _parent(p.left) else (p.right, p.left)
                keys.append((lower(_own(outer), rows), own))
            else:
                rest.append(p)
        where = None
        for p in rest:
            where = p if where is None else n.Binary("and", where, p)
        bare = replace(s, where=where)
        if _parent(replace(bare, joins=())):
            raise Unsupported("a subquery depends on its parent outside its WHERE")
        inner = self.filtered(bare, {k: v for k, v in rows.params.items() if k != "parent"})
        names = []
        for _, own in keys:
            names.append(hidden())
            inner.df = inner.df.withColumn(names[-1], lower(own, inner).col)
        outers = [(o, name) for (o, _), name in zip(keys, names, strict=True)]
        if not keys:
            return self.finish(bare, inner), []
        return self._per_key(bare, inner, names), outers

    def _per_key(self, s: n.Select, rows: Rows, keys: list[str]) -> Plan:
        """A subquery's result for every value of its keys at once."""
        if any(self._is_aggregate(f.expr) for f in s.fields if f.expr is not None):
            return Plan(self.aggregate(s, rows, keys), s.value)
        rows = self.attach(rows, (s.fields, s.order))
        first = s.limit is not None and not s.start and isinstance(s.limit, n.Literal) and s.limit.value == 1
        if first and s.order and len({down for _, down in s.order}) == 1 and all(not isinstance(lower(e, rows).kind, (T.MapType, T.VariantType)) for e, _ in s.order):
            # the one best row of each key needs no sort: partial aggregation keeps one row a key and task
            by = F.struct(*(lower(e, rows).col for e, _ in s.order))
            df = self.project(s, rows, keys)
            shown = [c for c in df.columns if c not in keys]
            rows.df = rows.df.withColumn("__by", by)
            best = (F.max_by if s.order[0][1] else F.min_by)(F.struct(*map(col, shown)), F.col("__by")).alias("__best")
            df = self.project(s, rows, [*keys, "__by"]).groupBy(*map(col, keys)).agg(best)
            return Plan(df.select(*map(col, keys), *(F.col("__best").getField(c).alias(c) for c in shown)), s.value)
        if s.limit or s.start:
            order = [k for e, down in s.order for k in sem.sort_key(lower(e, rows), down)] or [col(rows.id_column) if rows.id_column else F.monotonically_increasing_id()]
            n_ = hidden()
            first, most = (int(constants.value_of(lower(x, Rows(self.spark.range(1), self.session)).col.cast("int"))) if x else d for x, d in ((s.start, 0), (s.limit, 1 << 30)))
            rows.df = rows.df.withColumn(n_, F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(*order))).where(col(n_).between(first + 1, first + most)).drop(n_)
        return Plan(self.project(s, rows, keys), s.value)

    def subquery(self, s: n.Node, rows: Rows) -> Value:
        """A subquery as an array value. One without reference to its parent is computed once and joined as a broadcast row; beyond
        MOST_ROWS rows it is an error."""
        name = hidden()
        if not isinstance(s, n.Select):
            plan, keys = self.plan(s, rows.params), []
        else:
            plan, keys = self._inner(s, rows)
        own = {k for _, k in keys}
        shown = [c for c in plan.df.columns if c not in own]
        item = col(shown[0]) if plan.value else F.struct(*(col(c) for c in shown))
        kind = T.ArrayType(plan.df.schema[shown[0]].dataType if plan.value else T.StructType([plan.df.schema[c] for c in shown]))
        gathered = F.collect_list(item).alias(name)
        if not keys:
            too_many = F.raise_error(F.lit(f"a subquery of more than {MOST_ROWS} rows as an array; use a join, IN, or array::len"))
            whole = F.when(F.count(F.lit(1)) > MOST_ROWS, too_many).otherwise(F.collect_list(item)).alias(name)
            rows.df = rows.df.crossJoin(F.broadcast(plan.df.limit(MOST_ROWS + 1).agg(whole)))  # one row
            return Value(col(name), kind)
        inner = plan.df.groupBy(*map(col, own)).agg(gathered)
        test = F.lit(True)
        for outer, k in keys:
            test = test & sem.eq(outer, Value(col(k), inner.schema[k].dataType)).col
        rows.df = rows.df.join(inner, test, "left").drop(*own)
        return Value(F.coalesce(col(name), F.array().cast(kind)), kind)

    def attach(self, rows: Rows, part: object) -> Rows:
        """Joins what subqueries and graph hops within an expression need, and remembers their values."""
        if isinstance(part, n.Call) and part.name.lower() in ("array::len", "array::length") and len(part.args) == 1 and isinstance(part.args[0], n.Query) and not _parent(part.args[0]):
            if part not in rows.special:  # its rows are counted, not gathered
                name = hidden()
                counted = self.plan(part.args[0].select, rows.params).df.agg(F.count(F.lit(1)).alias(name))
                rows.df = rows.df.crossJoin(F.broadcast(counted))  # one row
                rows.special[part] = Value(col(name), T.LongType())
            return rows
        if isinstance(part, n.Query):
            if part not in rows.special:
                rows.special[part] = self.subquery(part.select, rows)
            return rows
        if isinstance(part, n.Hop):
            if part not in rows.special:
                rows.special[part] = self.session.hop(part, rows)
            return rows
        if isinstance(part, n.Over) and part not in rows.special:  # over all rows, before LIMIT takes some
            rows = self.attach(rows, (part.call, part.partition, part.order))
            name, v = hidden(), over(part, rows)
            rows.df = rows.df.withColumn(name, v.col)
            rows.special[part] = Value(col(name), v.kind)
            return rows
        if isinstance(part, n.Node):
            for v in part.__dict__.values():
                rows = self.attach(rows, v)
        elif isinstance(part, tuple):
            for x in part:
                rows = self.attach(rows, x)
        return rows

    # ------------------------------------------------------------ aggregation
    @staticmethod
    def _is_aggregate(e: n.Expr | None) -> bool:
        return isinstance(e, n.Call) and e.name.lower() in AGGREGATES and len(e.args) <= 1

    def aggregate(self, s: n.Select, rows: Rows, keys: list[str] = ()) -> DataFrame:
        """Group keys come out as group.0, group.1, ...; plain fields are dropped."""
        rows = self.attach(rows, (s.fields, s.group or ()))
        rows = self._masked(rows)
        groups = [lower(e, rows).col.alias(f"group.{i}") for i, e in enumerate(s.group or ())]
        made: dict[str, object] = {}
        for f in s.fields:
            if f.expr is not None and self._is_aggregate(f.expr):
                name = f.alias or f.expr.name
                made[name] = self._aggregated(f.expr, rows).alias(name)
        grouped = rows.df.groupBy(*map(col, keys), *groups) if keys or groups else rows.df
        df = grouped.agg(*made.values())
        inner = Rows(df, self.session, params=rows.params)
        if s.having is not None:
            df = df.where(condition(s.having, inner))
        order = []
        for e, down in s.order:
            at = (s.group or ()).index(e) if e in (s.group or ()) else None
            v = inner.find(f"group.{at}") if at is not None else lower(e, inner)
            order += sem.sort_key(v, down)
        return df.orderBy(*order) if order else df

    @staticmethod
    def _aggregated(e: n.Call, rows: Rows):
        name = e.name.lower()
        if name == "count":
            return F.count(F.lit(1))
        v = lower(e.args[0], rows)
        if name in ("min", "max"):
            return getattr(F, name)(v.col)
        if not v.number:
            return F.sum(F.lit(0).cast("long")) if name == "sum" else F.avg(F.lit(None).cast("double"))
        if name == "avg":
            return F.avg(v.col)
        whole = isinstance(v.kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return F.coalesce(F.sum(v.col), F.lit(0).cast("long" if whole else "double" if not isinstance(v.kind, T.DecimalType) else "decimal(38,10)"))

    def _window(self, s: n.Select, df: DataFrame) -> DataFrame:
        one = Rows(self.spark.range(1), self.session)
        number = lambda e: int(e.value) if isinstance(e, n.Literal) else int(constants.value_of(lower(e, one).col.cast("int")) or 0)
        if s.start:
            df = df.offset(number(s.start))
        return df.limit(number(s.limit)) if s.limit else df

    # ------------------------------------------------------------ FETCH
    def fetch(self, rows: Rows, e: n.Expr) -> Rows:
        """Record ids in a column become the records; ids without a record keep their id alone."""
        name = path_of(e)
        v = rows.find(name) if name else None
        if v is None or not (v.string or v.array and isinstance(v.kind.elementType, T.StringType)):
            return rows
        key = hidden()
        ids = rows.df.select(v.col.alias(key)) if v.string else rows.df.select(F.explode(v.col).alias(key))
        found = self.session.records(ids, key)
        if found is None:
            return rows
        records, kind = found  # (id, record)
        missing = lambda c: conform(struct([("id", Value(c, T.StringType()))]), kind)
        if v.string:
            joined = rows.df.join(records.select(F.col("id").alias(key), F.col("record").alias(key + "r")), v.col == F.col(key), "left")
            rows.df = joined.withColumn(name, F.when(v.col.isNotNull(), F.coalesce(F.col(key + "r"), missing(v.col)))).drop(key, key + "r")
            return rows
        ids = hidden()  # a list of ids stands for itself, however often and wherever it occurs
        parts = rows.df.select(v.col.alias(ids)).distinct().select(ids, F.posexplode(ids).alias("__p", key)).join(records.withColumnRenamed("id", "__i"), F.col(key) == F.col("__i"), "left")
        lists = parts.groupBy(ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", F.coalesce("record", missing(F.col(key))).alias("r")))), lambda x: x["r"]).alias(key + "r"))
        rows.df = rows.df.join(lists, v.col == F.col(ids), "left").withColumn(name, F.col(key + "r")).drop(ids, key + "r")
        return rows

    # ------------------------------------------------------------ projection
    def project(self, s: n.Select, rows: Rows, keys: list[str] = ()) -> DataFrame:
        out: dict[str, object] = {}
        for f in s.fields:
            if f.expr is None:
                if s.value and len(rows.visible()) == 1 and rows.visible()[0] == "value":
                    out["value"] = col("value")
                elif s.value:
                    out["value"] = F.struct(*map(col, rows.visible())).alias("value")
                else:
                    out |= {c: col(c) for c in rows.visible()}
                continue
            v = lower(f.expr, rows)
            name = "value" if s.value else f.alias or output_name(f.expr)
            out[name] = (v.col if not v.null else F.lit(None).cast("string")).alias(name)
            if s.value:
                break
        return rows.df.select(*map(col, keys), *out.values())


def _is_match(e: n.Expr) -> bool:
    return isinstance(e, n.Binary) and e.op == "@@"


def _is_similarity(e: n.Expr) -> bool:
    return isinstance(e, n.Binary) and e.op in (">", ">=") and isinstance(e.left, n.Call) and e.left.name.lower().startswith("vector::similarity::")


def _parent(e: object) -> list:
    return [x for x in walk(e) if isinstance(x, n.Param) and x.name == "parent"]


def _own(e: n.Expr) -> n.Expr:
    """An expression over $parent as one over the parent's row."""
    if isinstance(e, n.Field) and isinstance(e.base, n.Param) and e.base.name == "parent":
        return n.Name(e.name)
    if isinstance(e, n.Node):
        return type(e)(**{k: _own(v) if isinstance(v, n.Node) else tuple(_own(x) if isinstance(x, n.Node) else x for x in v) if isinstance(v, tuple) else v for k, v in e.__dict__.items()})
    return e


__all__ = ["Plan", "Planner", "array", "common", "member", "nothing"]
