"""The access path that a SELECT's shape calls for, beside Spark's own plan."""

from __future__ import annotations

from ..lang import nodes as n
from .expressions import conjuncts, path_of


def strategy(s: n.Select, indexes: dict[str, dict]) -> tuple[str, str | None]:
    """(strategy, index name)."""

    def index(e: n.Expr, kind: str, single: bool = False) -> str | None:
        name = path_of(e)
        return next((k for k, i in indexes.items() if i["kind"] == kind and name in i["columns"] and (not single or len(i["columns"]) == 1)), None) if name else None

    parts = conjuncts(s.where)
    one = parts[0] if len(parts) == 1 else None
    if isinstance(one, n.Binary) and one.op == "=" and isinstance(one.right, n.Literal) and (k := index(one.left, "unique", True)):
        return "UNIQUE_LOOKUP", k
    if len(parts) == 2:
        match = next((p for p in parts if isinstance(p, n.Binary) and p.op == "@@"), None)
        near = next((p for p in parts if isinstance(p, n.Binary) and p.op in (">", ">=") and isinstance(p.left, n.Call) and p.left.name.lower().startswith("vector::similarity::")), None)
        if match and near and (k := index(match.left, "search")):
            return "HYBRID", k
    if isinstance(one, n.Binary) and one.op == "=" and (k := index(one.left, "columnar")):
        return "COLUMNAR", k
    if s.order and isinstance(s.order[0][0], n.Call) and s.order[0][0].name.lower().startswith("vector::distance::") and s.order[0][0].args and (k := index(s.order[0][0].args[0], "hnsw")):
        return "VECTOR", k
    if isinstance(one, n.Binary) and one.op in ("<", "<=") and isinstance(one.left, n.Call) and one.left.name.lower() == "geo::distance" and one.left.args and (k := index(one.left.args[0], "geo")):
        return "GEO", k
    if isinstance(one, n.Binary) and one.op == "@@" and (k := index(one.left, "search")):
        return "FULLTEXT", k
    return "FULL_SCAN", None
