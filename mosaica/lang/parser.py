"""Tokens to a syntax tree: precedence climbing for expressions, one method a statement."""

from __future__ import annotations

from . import nodes as n
from .lexer import SyntaxProblem, Token, tokens

__all__ = ["SyntaxProblem", "parse", "parse_expression"]

#: Binding strength of infix operators; words are operators too.
STRENGTH = {
    **dict.fromkeys(("??", "?:"), 1),
    **dict.fromkeys(("or", "|", "||"), 2),
    **dict.fromkeys(("and", "&", "&&"), 3),
    **dict.fromkeys(("=", "==", "!=", "*=", "?="), 4),
    **dict.fromkeys(("@@", "<", ">", "<=", ">=", "..", "..=", ">..", "contains", "contains_not", "contains_all", "contains_any", "contains_none", "in", "not_in", "inside", "all_inside", "any_inside", "none_inside", "outside", "intersects"), 5),
    **dict.fromkeys(("+", "-"), 6),
    **dict.fromkeys(("*", "/", "%"), 7),
    "**": 8,
}
_SAME = {"||": "or", "|": "or", "&&": "and", "&": "and", "inside": "in"}
_WORDS = {w for w in STRENGTH if w[0].isalpha()} | {"not"}
#: Words that end an expression or a clause and so are no aliases.
_RESERVED = {"from", "where", "order", "group", "having", "limit", "start", "fetch", "join", "left", "right", "full", "inner", "cross", "semi", "anti", "on", "as", "at", "before", "set", "content", "merge", "patch", "replace", "return", "then", "else", "end", "union", "intersect", "except", "only", "asc", "desc", "diff", "when", "assert", "readonly", "value", "default", "references", "permissions", "with", "for", "and", "or", "in", "inside", "contains", "not", "values", "outside", "intersects"}
_CASTS = {"int", "float", "number", "string", "bool", "datetime", "decimal"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    # ------------------------------------------------------------ reading
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def fail(self, wanted: str):
        raise SyntaxProblem(f"expected {wanted} but found {self.now.text or 'the end'!r} at {self.now.start}")

    def next(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def is_word(self, *words: str, k: int = 0) -> bool:
        t = self.peek(k)
        return t.kind == "ident" and t.text.lower() in words

    def word(self, *words: str) -> str | None:
        return self.next().text.lower() if self.is_word(*words) else None

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words).upper())

    def is_op(self, *ops: str, k: int = 0) -> bool:
        t = self.peek(k)
        return t.kind == "op" and t.text in ops

    def op(self, *ops: str) -> str | None:
        return self.next().text if self.is_op(*ops) else None

    def need_op(self, *ops: str) -> str:
        return self.op(*ops) or self.fail(" or ".join(ops))

    def ident(self) -> str:
        if self.now.kind not in ("ident", "quoted"):
            self.fail("a name")
        return str(self.next().value)

    def name_or_string(self) -> str:
        return str(self.next().value) if self.now.kind == "string" else self.ident()

    def string(self) -> str:
        if self.now.kind != "string":
            self.fail("a string")
        return str(self.next().value)

    def comma_list(self, read) -> tuple:
        out = [read()]
        while self.op(","):
            out.append(read())
        return tuple(out)

    # ------------------------------------------------------------ expressions
    def expression(self, least: int = 0) -> n.Expr:
        left = self.prefix()
        while (op := self._infix()) and (power := STRENGTH[op]) > least:
            self.at += 2 if op in ("not_in", "contains_not") else 1
            right = self.expression(power - 1 if op == "**" else power)
            op = _SAME.get(op, op)
            left = n.Span(left, right, op) if op in ("..", "..=", ">..") else n.Binary(op, left, right)
        return left

    def _infix(self) -> str | None:
        t = self.now
        if t.kind == "op":
            return t.text if t.text in STRENGTH else None
        if t.kind == "ident":
            w = t.text.lower()
            if w == "not" and self.is_word("in", "inside", "contains", k=1):
                return "contains_not" if self.is_word("contains", k=1) else "not_in"
            w = {"containsall": "contains_all", "containsany": "contains_any", "containsnone": "contains_none", "allinside": "all_inside", "anyinside": "any_inside", "noneinside": "none_inside"}.get(w, w)
            return w if w in STRENGTH else None
        return None

    def prefix(self) -> n.Expr:
        if self.op("!") or self.word("not"):
            return n.Unary("not", self.prefix())
        if op := self.op("-", "+"):
            value = self.prefix()
            if op == "-" and isinstance(value, n.Literal) and value.kind in ("plain", "decimal") and isinstance(value.value, (int, float)) and not isinstance(value.value, bool):
                return n.Literal(-value.value, value.kind)
            return n.Unary(op, value)
        if self.is_op("<") and self.peek().kind == "ident" and self.peek().text.lower() in _CASTS and self.is_op(">", k=2):
            self.at += 1
            kind = self.next().text.lower()
            self.at += 1
            return n.Cast(kind, self.prefix())
        return self.postfix(self.primary())

    def postfix(self, e: n.Expr) -> n.Expr:
        while True:
            if self.is_op(".") and self.is_op("*", k=1):
                self.at += 2
                e = n.Every(e)
            elif self.is_op(".") and self.peek().kind in ("ident", "quoted"):
                self.at += 1
                name = self.ident()
                e = n.Call(name, (e, *self.arguments())) if self.is_op("(") else n.Field(e, name)
            elif self.is_op("[") and self.now.start == self.tokens[self.at - 1].end:
                self.at += 1
                if self.op("*"):
                    e = n.Every(e)
                elif self.word("where"):
                    e = n.Every(e, self.expression())
                else:
                    e = n.Item(e, self.expression())
                self.need_op("]")
            elif self.is_op("->", "<-", "<->") and (self.peek().kind in ("ident", "quoted") or self.is_op("*", "?", k=1)):
                e = n.Hop(e, self.steps())
            else:
                return e

    def steps(self) -> tuple:
        out = []
        while self.is_op("->", "<-", "<->"):
            way = self.next().text
            out.append((way, "*" if self.op("*", "?") else self.ident()))
        return tuple(out)

    def arguments(self) -> tuple:
        self.need_op("(")
        if self.op(")"):
            return ()
        out = self.comma_list(self.argument)
        self.need_op(")")
        return out

    def argument(self) -> n.Expr:
        return n.Query(self.select()) if self.is_word("select") else n.Name("*") if self.is_op("*") and self.next() else self.expression()

    def primary(self) -> n.Expr:
        t = self.now
        if t.kind in ("int", "float", "string"):
            self.at += 1
            return n.Literal(t.value)
        if t.kind in ("decimal", "duration", "datetime", "uuid", "bytes"):
            self.at += 1
            return n.Literal(t.value, t.kind)
        if t.kind == "record":
            self.at += 1
            table, _, key = str(t.value).partition(":")
            return n.Record(table, n.Literal(int(key) if key.isdigit() else key))
        if t.kind == "param":
            self.at += 1
            return n.Param(str(t.value))
        if self.is_op("->", "<-", "<->"):
            return n.Hop(None, self.steps())
        if self.op("("):
            if self.is_word("select"):
                e: n.Expr = n.Query(self.select())
            else:
                e = self.expression()
            self.need_op(")")
            return e
        if self.op("["):
            items = () if self.is_op("]") else self.comma_list(self.expression)
            self.need_op("]")
            return n.ArrayOf(items)
        if self.is_op("{"):
            return self.braces()
        if t.kind in ("ident", "quoted"):
            w = t.text.lower() if t.kind == "ident" else ""
            if w in ("true", "false"):
                self.at += 1
                return n.Literal(w == "true")
            if w in ("null", "none"):
                self.at += 1
                return n.Literal(None)
            if w == "if":
                return self.branch()
            if w == "case":
                return self.case()
            if w in ("from", "where", "then", "else", "select", "join"):
                self.fail("an expression")
            self.at += 1
            if self.is_op("(") and t.kind == "ident":
                made = n.Call(t.text.removeprefix("fn::"), self.arguments())
                return self.over(made) if self.is_word("over") and self.is_op("(", k=1) else made
            if self.is_op(":") and self.now.start == t.end and self.peek().start == self.now.end and self.peek().kind in ("ident", "quoted", "int", "string", "param", "uuid", "duration"):
                self.at += 1
                k = self.next()
                if k.kind in ("int", "duration") and self.now.kind == "ident" and self.now.start == k.end:
                    return n.Record(str(t.value), n.Literal(k.text + self.next().text))
                return n.Record(str(t.value), n.Param(str(k.value)) if k.kind == "param" else n.Literal(k.text if k.kind == "duration" else k.value))
            return n.Name(str(t.value), t.kind == "quoted")
        return self.fail("an expression")

    def braces(self) -> n.Expr:
        """``{k: v}`` is an object, ``{a, b}`` a set, ``{stmt; stmt}`` a block."""
        self.need_op("{")
        if self.op("}"):
            return n.ObjectOf(())
        if self.now.kind in ("ident", "quoted", "string", "int") and self.is_op(":", k=1):
            items = []
            while not self.is_op("}"):
                key = str(self.next().value)
                self.need_op(":")
                items.append((key, self.expression()))
                if not self.op(","):
                    break
            self.need_op("}")
            return n.ObjectOf(tuple(items))
        start = self.at
        try:
            items = self.comma_list(self.expression)
            if self.op("}"):
                return n.ArrayOf(items, is_set=True) if len(items) > 1 else n.Block((n.Evaluate(items[0]),))
        except SyntaxProblem:
            pass
        self.at = start
        body = []
        while not self.is_op("}"):
            body.append(self.statement())
            if not self.op(";"):
                break
        self.need_op("}")
        return n.Block(tuple(body))

    def branch(self) -> n.Branch:
        self.need_word("if")
        cases, otherwise = [], None
        while True:
            when = self.expression()
            self.need_word("then")
            cases.append((when, self.statement_expression()))
            if self.word("else"):
                if self.word("if"):
                    continue
                otherwise = self.statement_expression()
            break
        self.word("end")
        return n.Branch(tuple(cases), otherwise)

    def case(self) -> n.Branch:
        self.need_word("case")
        cases, otherwise = [], None
        while self.word("when"):
            when = self.expression()
            self.need_word("then")
            cases.append((when, self.expression()))
        if self.word("else"):
            otherwise = self.expression()
        self.need_word("end")
        return n.Branch(tuple(cases), otherwise)

    def statement_expression(self) -> n.Expr:
        e = self.expression() if not self.is_word(*_STATEMENTS) else n.Block((self.statement(),))
        self.op(";")
        return e

    # ------------------------------------------------------------ select
    def select(self) -> n.Node:
        left: n.Node = self.simple_select()
        while op := self.word("union", "intersect", "except"):
            if op == "union" and self.word("all"):
                op = "union all"
            left = n.Combine(op, left, self.simple_select())
        return left

    def output(self) -> n.Output:
        if self.is_op("*"):
            self.at += 1
            return n.Output(None)
        e = self.expression()
        if self.word("as"):
            return n.Output(e, self.ident())
        return n.Output(e)

    def alias(self) -> str | None:
        if self.word("as"):
            return self.ident()
        if self.now.kind in ("ident", "quoted") and self.now.text.lower() not in _RESERVED:
            return self.ident()
        return None

    def simple_select(self) -> n.Select:
        self.need_word("select")
        kw: dict = {"value": bool(self.word("value")), "distinct": bool(self.word("distinct"))}
        kw["fields"] = self.comma_list(self.output)
        kw["only"] = bool(self.word("only"))
        kw["target"] = None
        if self.word("from"):
            kw["only"] |= bool(self.word("only"))
            kw["target"], kw["alias"] = self.target(), self.alias()
        if self.is_word("at", "before") and self.is_op("(", k=1):
            way = self.next().text.upper()
            self.need_op("(")
            what = self.need_word("timestamp", "commit", "statement").upper()
            self.need_op("=>")
            kw["version"] = (way, what, self.expression())
            self.need_op(")")
        joins = []
        while self.is_word("join", "inner", "left", "right", "full", "cross", "semi", "anti"):
            how = self.next().text.lower()
            if how != "join":
                self.word("outer", "semi", "anti")
                self.need_word("join")
            how = "inner" if how in ("join", "inner") else how
            target, alias = self.target(), self.alias()
            self.need_word("on")
            cond = self.expression()
            if not (isinstance(cond, n.Binary) and cond.op == "="):
                raise SyntaxProblem("a join condition is one equality")
            joins.append(n.Join(target, alias, cond.left, cond.right, how))
        kw["joins"] = tuple(joins)
        while True:
            if self.word("where"):
                kw["where"] = self.expression()
            elif self.word("order"):
                self.word("by")
                kw["order"] = self.comma_list(self.ordering)
            elif self.word("group"):
                self.word("by")
                kw["group"] = () if self.word("all") else self.comma_list(self.expression)
            elif self.word("having"):
                kw["having"] = self.expression()
            elif self.word("limit"):
                self.word("by")
                kw["limit"] = self.expression()
            elif self.word("start"):
                self.word("at")
                kw["start"] = self.expression()
            elif self.word("fetch"):
                kw["fetch"] = self.comma_list(self.expression)
            elif self.word("only"):
                kw["only"] = True
            else:
                return n.Select(**kw)

    def over(self, call: n.Call) -> n.Over:
        self.need_word("over")
        self.need_op("(")
        kw: dict = {}
        if self.word("partition"):
            self.need_word("by")
            kw["partition"] = self.comma_list(self.expression)
        if self.word("order"):
            self.need_word("by")
            kw["order"] = self.comma_list(self.ordering)
        if self.word("rows"):
            self.need_word("between")
            start = self.bound()
            self.need_word("and")
            kw["frame"] = (start, self.bound())
        self.need_op(")")
        return n.Over(call, **kw)

    def bound(self) -> int | None:
        """An end of a frame: rows from the current one, None for all."""
        if self.word("current"):
            self.need_word("row")
            return 0
        many = None if self.word("unbounded") else int(self.next().value)
        before = self.need_word("preceding", "following").lower() == "preceding"
        return many if many is None else -many if before else many

    def ordering(self) -> tuple[n.Expr, bool]:
        e = self.expression()
        return e, (self.word("asc", "desc") or "asc") == "desc"

    def target(self) -> n.Target:
        if self.op("("):
            q = self.select()
            self.need_op(")")
            return n.Target(query=q)
        if self.now.kind == "param" or self.is_op("["):
            return n.Target(expr=self.primary())
        name = self.name_or_string()
        if self.is_op(":") and self.now.start == self.tokens[self.at - 1].end:
            self.at -= 1
            e = self.primary()
            return n.Target(table=e.table, key=e.key)
        if self.op("."):
            db, name = name, self.ident()
            if self.op(":"):
                k = self.next()
                return n.Target(table=name, db=db, key=n.Param(str(k.value)) if k.kind == "param" else n.Literal(k.value))
            return n.Target(table=name, db=db)
        return n.Target(table=name)

    # ------------------------------------------------------------ statements
    def script(self) -> tuple[n.Node, ...]:
        out = []
        while self.now.kind != "end":
            if self.op(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end" and not self.is_op(";"):
                self.fail("; or the end")
        return tuple(out)

    def statement(self) -> n.Node:
        word = self.now.text.lower() if self.now.kind == "ident" else ""
        if word in ("create", "alter", "define") and self._defines():
            return self.define()
        read = getattr(self, f"_{_STATEMENTS.get(word, '')}", None) if word in _STATEMENTS and not self.is_op("(", "=", ".", k=1) or word == "return" or word == "select" and self.is_op("(", k=1) else None
        return read() if read else n.Evaluate(self.expression())

    def _defines(self) -> bool:
        if self.is_word("define", "alter"):
            return True
        if self.is_op(":", k=2) or self.is_word("content", "set", "return", k=2):  # a record of a table so named
            return False
        return self.is_word("table", "field", "index", "analyzer", "event", "user", "access", "database", "data", "ai", "jks", "namespace", k=1)

    def _select(self):
        return self.select()

    def _live(self):
        self.at += 1
        s = self.simple_select()
        return n.Live(s, bool(self.word("diff")))

    def _explain(self):
        self.at += 1
        analyze = bool(self.word("analyze"))
        return n.Explain(self.select(), analyze)

    def sets(self) -> tuple:
        def one():
            path = self.path()
            return path, (self.need_op("=") and self.expression())

        return self.comma_list(one)

    def path(self) -> str:
        parts = [self.ident()]
        while self.op("."):
            parts.append(self.ident())
        return ".".join(parts)

    def returning(self):
        if not self.word("return"):
            return None
        w = self.word("before", "after", "none", "diff")
        return w.upper() if w else self.expression()

    def _change(self):
        op = self.next().text.upper()
        kw: dict = {"ignore": bool(self.word("ignore"))} if op == "INSERT" else {}
        if op == "INSERT":
            self.word("relation")
            self.need_word("into")
        elif op == "DELETE":
            self.word("from")
        self.word("only")
        target = self.target()
        if op == "INSERT":
            if self.is_op("(") and not self.is_word("select", k=1):
                self.at += 1
                names = self.comma_list(self.ident)
                self.need_op(")")
                self.need_word("values")

                def row():
                    self.need_op("(")
                    values = self.comma_list(self.expression)
                    self.need_op(")")
                    return n.ObjectOf(tuple(zip(names, values, strict=True)))

                kw |= {"mode": "ROWS", "data": n.ArrayOf(self.comma_list(row))}
            elif self.is_op("[", "{") or self.now.kind == "param" or self.is_op("("):
                kw |= {"mode": "ROWS", "data": self.expression()}
        elif w := self.word("content", "merge", "patch", "replace"):
            kw |= {"mode": w.upper(), "data": self.expression()}
        elif self.word("set"):
            kw |= {"mode": "SET", "sets": self.sets()}
        if self.word("where"):
            kw["where"] = self.expression()
        return n.Change(op, target, returns=self.returning(), **kw)

    def _relate(self):
        self.at += 1
        source = self.primary()
        self.need_op("->")
        kind = self.ident()
        self.need_op("->")
        target = self.primary()
        if self.word("set"):
            return n.Relate(source, kind, target, self.sets())
        return n.Relate(source, kind, target, data=self.expression() if self.word("content") else None)

    def permissions(self) -> tuple:
        out = []
        if self.word("none", "full"):
            return ()
        while self.word("for"):
            actions = self.comma_list(lambda: self.need_word("select", "create", "update", "delete"))
            rule = n.Literal(True) if self.word("full") else n.Literal(False) if self.word("none") else (self.need_word("where"), self.expression())[1]
            out += [(a, rule) for a in actions]
        return tuple(out)

    def type_text(self) -> str:
        text = self.ident().lower()
        if self.op("("):
            while not self.op(")"):
                self.next()
        if self.op("<"):
            text += f"<{self.type_text()}>"
            self.need_op(">")
        return text

    def column(self) -> tuple[str, tuple]:
        opts: dict = {}
        name = self.ident()
        opts["type"] = self.type_text()
        while True:
            if self.word("primary"):
                self.need_word("key")
                opts["primary"] = True
            elif self.word("not"):
                self.need_word("null")
                opts["required"] = True
            elif self.word("unique"):
                opts["unique"] = True
            elif self.word("null"):
                pass
            elif self.word("default"):
                opts["default"] = self.expression()
            elif self.word("check"):
                self.need_op("(")
                opts["assert"] = self.expression()
                self.need_op(")")
            elif self.word("references"):
                opts["references"] = self.ident()
                if self.op("("):
                    self.ident()
                    self.need_op(")")
            else:
                return name, tuple(opts.items())

    def define(self) -> n.Node:
        verb = self.next().text.upper()
        what = self.need_word("table", "field", "index", "analyzer", "event", "user", "access", "database", "data", "ai", "jks", "namespace")
        o: dict = {}
        if what in ("data", "ai"):
            self.need_word("rule", "audit")
            what = {"data": "data rule", "ai": "ai audit"}[what]
        if what == "database" and self.word("link"):
            what = "link"
        if self.word("if"):
            self.need_word("not")
            self.need_word("exists")
        if what == "field":
            name = self.path()
        else:
            name = self.name_or_string()
        if what == "table":
            if verb == "ALTER":
                return n.Define(what, name, verb, (("changes", self.comma_or_space(self.alteration)),))
            if self.word("drop"):
                o["drop"] = True
            if w := self.word("schemafull", "schemaless"):
                o["schemafull"] = w == "schemafull"
            if self.op("("):
                o["columns"] = self.comma_list(self.column)
                self.need_op(")")
            if self.word("with"):
                self.need_op("(")
                self.need_word("schema")
                self.need_op("=")
                o["schemafull"] = self.string().upper() != "FLEXIBLE"
                self.need_op(")")
            if self.word("permissions"):
                o["permissions"] = self.permissions()
        elif what == "field":
            self.need_word("on")
            self.word("table")
            o["table"] = self.ident()
            while True:
                if self.word("type"):
                    o["type"] = self.type_text()
                elif self.word("assert"):
                    o["assert"] = self.expression()
                elif self.word("readonly"):
                    o["readonly"] = True
                elif self.word("value"):
                    o["value"] = self.expression()
                elif self.word("default"):
                    o["default"] = self.expression()
                elif self.word("references"):
                    o["references"] = self.ident()
                else:
                    break
        elif what == "index":
            self.need_word("on")
            self.word("table")
            o["table"] = self.ident()
            self.need_word("columns", "fields")
            o["columns"] = self.comma_list(self.path)
            o["kind"] = self.word("unique", "count", "geo", "columnar", "search", "hnsw") or "plain"
            if o["kind"] == "search":
                self.need_word("analyzer")
                o["analyzer"] = self.ident()
            elif o["kind"] == "hnsw":
                self.need_word("dimension")
                o["dimension"] = self.next().value
                o["dist"] = self.ident().lower() if self.word("dist") else "euclidean"
                while w := self.word("m", "efc", "efs"):
                    o[w] = self.next().value
        elif what == "analyzer":
            while w := self.word("lowercase", "stemming", "stopwords"):
                o[w] = self.comma_list(self.string) if w == "stopwords" else True
        elif what == "event":
            self.need_word("on")
            self.word("table")
            o["table"] = self.ident()
            self.need_word("when")
            o["when"] = self.expression()
            self.need_word("then")
            self.need_op("(")
            body = [self.statement()]
            while self.op(";") and not self.is_op(")"):
                body.append(self.statement())
            self.need_op(")")
            o["then"] = tuple(body)
        elif what == "data rule":
            self.need_word("apply")
            o["where"] = self.expression()
            if self.word("mask"):
                o["mask"] = self.comma_list(self.string)
        elif what == "link":
            self.need_word("connect")
            self.need_word("by")
            o["url"] = self.string()
            if self.word("with"):
                while self.now.kind == "ident":
                    key = self.ident().lower()
                    self.op("=")
                    o[key] = self.string()
                    self.op(",")
        else:  # users, accesses, audits, key stores: kept as they are, for the catalog alone
            first = self.at
            while self.now.kind != "end" and not self.is_op(";"):
                self.at += 1
                if self.is_word("rule", k=-1) and self.now.kind == "ident":
                    o["data_rules"] = self.comma_list(self.ident)
            o["text"] = self.text[self.tokens[first].start : self.tokens[self.at].start].strip()
        return n.Define(what, name, verb, tuple(o.items()))

    def comma_or_space(self, read) -> tuple:
        out = [read()]
        while self.op(",") or self.is_word("add", "drop", "modify", "alter"):
            out.append(read())
        return tuple(out)

    def alteration(self):
        what = self.need_word("add", "drop", "modify", "alter")
        self.word("column")
        return ("drop", self.ident(), ()) if what == "drop" else (what, *self.column())

    def _drop(self):
        self.at += 1
        what = self.need_word("table", "field", "index", "analyzer", "event", "user", "access", "database", "data", "ai", "jks", "saga", "namespace")
        if what in ("data", "ai"):
            self.need_word("rule", "audit")
            what = {"data": "data rule", "ai": "ai audit"}[what]
        if what == "database" and self.word("link"):
            what = "link"
        if self.word("if"):
            self.need_word("exists")
        name = self.path() if what == "field" else self.name_or_string()
        table = (self.word("table"), self.ident())[1] if self.word("on") else None
        return n.Drop(what, name, table)

    def _info(self):
        self.at += 1
        self.need_word("for")
        what = self.need_word("root", "namespace", "ns", "database", "db", "table")
        return n.Info({"ns": "namespace", "db": "database"}.get(what, what), self.ident() if what == "table" else None)

    def _describe(self):
        self.at += 1
        self.word("table")
        return n.Info("describe", self.ident())

    def _show(self):
        self.at += 1
        self.need_word("data")
        self.need_word("rules")
        return n.Info("data rules")

    def _use(self):
        self.at += 1
        out = []
        while w := self.word("ns", "namespace", "db", "database"):
            out.append(({"ns": "namespace", "db": "database"}.get(w, w), self.name_or_string()))
        return n.Control("USE", extra=tuple(out))

    def _let(self):
        self.at += 1
        if self.now.kind != "param":
            self.fail("a parameter")
        name = str(self.next().value)
        self.need_op("=")
        return n.Control("LET", name, n.Query(self.select()) if self.is_word("select") else self.expression())

    def _return(self):
        self.at += 1
        return n.Control("RETURN", value=n.Query(self.select()) if self.is_word("select") else self.expression())

    def _error(self):
        self.at += 1
        return n.Control("ERROR", value=self.expression())

    def _kill(self):
        self.at += 1
        return n.Control("KILL", value=self.expression())

    def _begin(self):
        self.at += 1
        self.word("transaction")
        return n.Control("BEGIN")

    def _commit(self):
        self.at += 1
        self.word("transaction")
        return n.Control("COMMIT")

    def _cancel(self):
        self.at += 1
        self.word("transaction")
        return n.Control("CANCEL")

    def _savepoint(self):
        self.at += 1
        return n.Control("SAVEPOINT", self.ident())

    def _release(self):
        self.at += 1
        self.word("savepoint")
        return n.Control("RELEASE", self.ident())

    def _rollback(self):
        self.at += 1
        if self.word("to"):
            self.word("savepoint")
            return n.Control("ROLLBACK", self.ident())
        return n.Control("CANCEL")


#: First words of statements, and the methods that read them.
_STATEMENTS = {
    "select": "select", "live": "live", "explain": "explain", "create": "change", "insert": "change", "update": "change", "upsert": "change",
    "delete": "change", "relate": "relate", "drop": "drop", "remove": "drop", "info": "info", "describe": "describe", "show": "show", "use": "use",
    "let": "let", "return": "return", "error": "error", "kill": "kill", "begin": "begin", "commit": "commit", "cancel": "cancel",
    "savepoint": "savepoint", "release": "release", "rollback": "rollback",
}


def parse(text: str) -> tuple[n.Node, ...]:
    return Parser(text).script()


def parse_expression(text: str) -> n.Expr:
    p = Parser(text)
    e = p.expression()
    if p.now.kind != "end":
        p.fail("the end")
    return e
