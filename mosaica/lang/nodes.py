"""Syntax tree. Expressions and statements are frozen, so that they can be compared and used as keys."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


class Expr(Node):
    pass


# ---------------------------------------------------------------- expressions
@dataclass(frozen=True)
class Literal(Expr):
    value: object
    kind: str = "plain"  # plain, decimal, duration (ms), datetime, uuid, bytes (hex)


@dataclass(frozen=True)
class Name(Expr):
    name: str
    quoted: bool = False


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Record(Expr):
    table: str
    key: Expr


@dataclass(frozen=True)
class Field(Expr):
    base: Expr
    name: str


@dataclass(frozen=True)
class Item(Expr):
    base: Expr
    index: Expr


@dataclass(frozen=True)
class Every(Expr):
    """``.*``, ``[*]``: the base itself; ``[WHERE c]``: the items that meet c."""

    base: Expr
    where: Expr | None = None


@dataclass(frozen=True)
class Hop(Expr):
    """Graph steps: (direction, name) pairs from base, or from the row where base is None."""

    base: Expr | None
    steps: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Over(Expr):
    """A call over a window of rows. frame: rows before (negative) and after the current one; None: all."""

    call: Call
    partition: tuple[Expr, ...] = ()
    order: tuple[tuple[Expr, bool], ...] = ()
    frame: tuple[int | None, int | None] | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    value: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Cast(Expr):
    kind: str
    value: Expr


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]
    is_set: bool = False


@dataclass(frozen=True)
class ObjectOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Query(Expr):
    select: Node


@dataclass(frozen=True)
class Branch(Expr):
    """IF ... THEN ... ELSE ... END."""

    when: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Block(Expr):
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Span(Expr):
    start: Expr
    end: Expr
    op: str


# ---------------------------------------------------------------- statements
@dataclass(frozen=True)
class Output(Node):
    expr: Expr | None  # None: *
    alias: str | None = None


@dataclass(frozen=True)
class Target(Node):
    """What a statement reads or writes: one of table (with key, db), expr, query."""

    table: str | None = None
    key: Expr | None = None
    db: str | None = None
    expr: Expr | None = None
    query: Node | None = None


@dataclass(frozen=True)
class Join(Node):
    target: Target
    alias: str | None
    left: Expr
    right: Expr
    how: str = "inner"


@dataclass(frozen=True)
class Select(Node):
    fields: tuple[Output, ...]
    target: Target | None
    value: bool = False
    only: bool = False
    alias: str | None = None
    version: tuple[str, str, Expr] | None = None  # (AT or BEFORE, TIMESTAMP or COMMIT or STATEMENT, value)
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] | None = None
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()
    limit: Expr | None = None
    start: Expr | None = None
    fetch: tuple[Expr, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Combine(Node):
    """UNION [ALL], INTERSECT, EXCEPT of two selects."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Change(Node):
    """CREATE, INSERT, UPDATE, UPSERT, DELETE."""

    op: str
    target: Target
    mode: str | None = None  # CONTENT, SET, MERGE, PATCH, REPLACE, ROWS
    data: Expr | None = None
    sets: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None
    returns: object = None  # BEFORE, AFTER, NONE, DIFF or an expression
    ignore: bool = False


@dataclass(frozen=True)
class Relate(Node):
    source: Expr
    kind: str
    target: Expr
    sets: tuple[tuple[str, Expr], ...] = ()
    data: Expr | None = None


@dataclass(frozen=True)
class Define(Node):
    """DEFINE, CREATE or ALTER of anything but rows."""

    what: str
    name: str
    verb: str = "DEFINE"
    options: tuple[tuple[str, object], ...] = ()

    def get(self, key: str, default=None):
        return dict(self.options).get(key, default)


@dataclass(frozen=True)
class Drop(Node):
    what: str
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Info(Node):
    what: str
    name: str | None = None


@dataclass(frozen=True)
class Explain(Node):
    select: Node
    analyze: bool = False


@dataclass(frozen=True)
class Live(Node):
    select: Select
    diff: bool = False


@dataclass(frozen=True)
class Control(Node):
    """BEGIN, COMMIT, CANCEL, SAVEPOINT, RELEASE, ROLLBACK TO, USE, KILL, LET, RETURN, ERROR."""

    op: str
    name: str | None = None
    value: Expr | None = None
    extra: tuple[tuple[str, str], ...] = field(default=())


@dataclass(frozen=True)
class Evaluate(Node):
    """An expression as a statement."""

    expr: Expr
