import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.lang import SyntaxProblem, nodes as n, parse, parse_expression, render

STATEMENTS = """SELECT * FROM person WHERE age >= 18
CREATE person CONTENT {name: "Ana", age: 30}
DEFINE FIELD email ON TABLE user TYPE string ASSERT $value CONTAINS "@"
IF $age >= 18 THEN "adulto" ELSE "menor" END
INSERT INTO person [{name: "Ana", age: 30}, {name: "Bob", age: 17}]
INSERT INTO person (id, name) VALUES ('u1', 'Ana'), ('u2', 'Bob')
RELATE user:tobie->wrote->article:surreal SET time = 1
SELECT sum(valor) FROM venda GROUP BY cidade
SELECT *, a.b[0].c AS x FROM t:1 ORDER BY x DESC, y LIMIT 3 START 1 FETCH z
SELECT VALUE -x ** 2 + <int> y FROM [{x: 1}]
SELECT ->wrote->article AS a, <-knows<-* AS b FROM user
LIVE SELECT name FROM person WHERE age > 18 DIFF
DEFINE EVENT log ON TABLE person WHEN $event = "CREATE" THEN (CREATE log SET a = $after.name; RETURN 1)
ALTER TABLE user ADD COLUMN age INT DEFAULT 18 CHECK (age >= 0), DROP COLUMN z
SELECT * FROM person AT (TIMESTAMP => "2024-01-01T00:00:00Z")
SELECT * FROM person BEFORE (STATEMENT => "x")
CREATE TABLE customer (id VARCHAR(64) PRIMARY KEY, name STRING NOT NULL, age INT DEFAULT 18 CHECK (age >= 0))
UPDATE person SET age = age + 1, b.c = 2 WHERE x NOT CONTAINS 3 RETURN AFTER
UPSERT person:1 MERGE {a: 1} RETURN BEFORE
DELETE person:1
DEFINE INDEX v ON TABLE item COLUMNS embedding HNSW DIMENSION 3 DIST cosine M 8 EFC 32
DEFINE INDEX u ON TABLE item COLUMNS a, b UNIQUE
DEFINE INDEX s ON TABLE item COLUMNS body SEARCH ANALYZER pt
DEFINE ANALYZER pt LOWERCASE STOPWORDS "o", "a" STEMMING
DEFINE TABLE doc SCHEMALESS PERMISSIONS FOR select WHERE published = true FOR create WHERE x > 1
CREATE DATA RULE adult APPLY age > 18
DROP TABLE person
DROP INDEX i ON TABLE person
INFO FOR TABLE person
DESCRIBE person
SHOW DATA RULES
EXPLAIN ANALYZE SELECT * FROM t WHERE a = 1
BEGIN
SAVEPOINT a
ROLLBACK TO a
RELEASE a
USE NAMESPACE x DATABASE y
LET $x = 10
RETURN 1 + 2 * 3
SELECT a.k AS k FROM a JOIN b ON a.k = b.k LEFT JOIN c ON b.z = c.z WHERE a.x = 1
SELECT name FROM person WHERE city IN (SELECT VALUE name FROM city WHERE x = $parent.y)
SELECT n FROM a UNION ALL SELECT n FROM b
RETURN d"2024-01-01T00:00:00Z" + 1h30m""".splitlines()


@pytest.mark.parametrize("text", STATEMENTS)
def test_text_survives_rendering(text):
    tree = parse(text)
    assert parse("; ".join(map(render, tree))) == tree


def test_precedence():
    assert render(parse_expression("1 + 2 * 3 ** 2 ** 2")) == "1 + 2 * 3 ** 2 ** 2"
    assert parse_expression("1 + 2 * 3") == n.Binary("+", n.Literal(1), n.Binary("*", n.Literal(2), n.Literal(3)))
    assert parse_expression("a or b and c = 1").op == "or"
    assert parse_expression("!a and b").op == "and"
    assert parse_expression("(1 + 2) * 3") == parse_expression(render(parse_expression("(1 + 2) * 3")))


def test_operators_without_blanks():
    assert parse_expression("a!=b") == parse_expression("a != b")
    assert parse_expression("a&&b||c") == parse_expression("a and b or c")
    assert parse_expression("x<-5") == n.Binary("<", n.Name("x"), n.Literal(-5))
    assert parse_expression("1dec").kind == "decimal"


def test_literals():
    assert parse_expression("1_000").value == 1000
    assert parse_expression("2f").value == 2.0
    assert parse_expression("1h30m").value == 5_400_000
    assert parse_expression('"a\\"b\\n"').value == 'a"b\n'
    assert parse_expression('r"person:1"') == n.Record("person", n.Literal(1))
    assert parse_expression("person:$id") == n.Record("person", n.Param("id"))
    assert parse_expression("`odd name`") == n.Name("odd name", True)


@pytest.mark.parametrize("text", ["SELECT FROM", "SELECT * FROM a JOIN b ON a.x > b.y", "CREATE", "1 +", "SELECT * FROM t WHERE", "'open", "{a: "])
def test_bad_text_is_refused(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


leaf = st.one_of(st.integers(-1000, 1000).map(n.Literal), st.text("abc \"'\\", max_size=4).map(n.Literal), st.sampled_from("xyz").map(n.Name), st.booleans().map(n.Literal))
tree = st.recursive(leaf, lambda e: st.one_of(st.builds(n.Binary, st.sampled_from(["+", "-", "*", "/", "**", "=", "<", "and", "or", "??", "contains", "in", "not_in"]), e, e), st.builds(lambda a: n.ArrayOf(tuple(a)), st.lists(e, max_size=3)), st.builds(lambda v: n.Unary("not", v), e), st.builds(lambda v: n.Call("f", (v,)), e)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_any_tree_survives_rendering(e):
    assert parse_expression(render(e)) == e
