import pytest

from mosaica import Session
from mosaica.client import Client, connect, literal
from mosaica.sources import dump
from mosaica.sources.storage import new_path
from mosaica.sources.vectorstore import VectorStore


@pytest.fixture
def c(spark):
    return Client(Session(spark))


def test_verbs(c):
    c.create("person:1", {"name": "A\"na", "tags": [1, 2], "x": None})
    c.insert("person", [{"name": "Bob"}, {"name": "Eve"}])
    c.update("person:1", {"age": 3})
    c.upsert("person:9", {"name": "New"})
    assert sorted(r.name for r in c.select("person").collect()) == ['A"na', "Bob", "Eve", "New"]
    assert c.delete("person:9").count() == 1 and c.select("person").count() == 3
    c.relate("person:1", "knows", "person:2", {"since": 1})
    assert c.query("SELECT VALUE ->knows FROM person:1").first()[0] == ["person:2"]
    assert c.peek("person", 2).__len__() == 2 and c.info()["tables"] == ["person"]
    assert c.graphql("{ person { name age } }").columns == ["name", "age"]
    c.kv_set("a", 1)
    assert c.kv_get("a") == 1 and c.kv_scan("a") == [{"key": "a", "value": 1}] and c.kv_del("a") and c.kv_get("a") is None
    assert literal({"a b": [True, None, 1.5]}) == '{"a b": [true, null, 1.5]}'


def test_cursor(c):
    c.insert("t", [{"a": 1}, {"a": 2}, {"a": 3}])
    cur = connect(c.session).cursor().execute("SELECT a FROM t WHERE a >= ? ORDER BY a", (2,))
    assert cur.description[0][0] == "a" and cur.fetchone() == (2,) and cur.fetchall() == [(3,)] and cur.fetchone() is None


def test_vector_store(c):
    store = VectorStore(c.session, "docs")
    store.upsert([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0], {"k": 1}), ("c", "z", [1.0, 1.0])])
    store.upsert([("b", "new", [0.0, 2.0])])
    got = store.search([1.0, 0.0], 2).collect()
    assert [r.id for r in got] == ["docs:a", "docs:c"] and got[0].score == pytest.approx(1.0)
    assert [r.text for r in store.search([0.0, 1.0], 1, "text != 'z'").collect()] == ["new"]
    store.delete(["a"])
    assert store.search([1.0, 0.0], 3).count() == 2


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_dump_and_restore(c, spark, form):
    c.query("DEFINE ANALYZER pt LOWERCASE; DEFINE FIELD a ON TABLE t TYPE int DEFAULT 5; DEFINE INDEX u ON TABLE t COLUMNS a UNIQUE")
    c.insert("t", [{"a": 1}, {"a": 2}])
    c.relate("t:1", "k", "t:2")
    path = new_path(spark, "dump")
    assert dump.dump(c.session, path, form) == ["t"]
    other = Session(spark)
    assert dump.restore(other, path, form) == ["t"]
    assert sorted(other.rows("SELECT VALUE a FROM t")) == [1, 2] and other.tables["t"].indexes["u"]["kind"] == "unique" and other.kinds == {"k"}
    again = Session(spark)
    again.execute(dump.script(c.session))
    assert sorted(again.rows("SELECT VALUE a FROM t")) == [1, 2]


def test_remote_tables(spark, sf):
    s = Session(spark)
    s.execute(f"CREATE DATABASE LINK far CONNECT BY '{sf}'")
    assert s.query("SELECT * FROM far.nation WHERE n_nationkey = 3").count() == 1


def test_audit_log(c):
    c.query("RETURN 1; RETURN 2")
    assert [r.statement for r in c.query("SELECT statement FROM AUDIT_LOG").collect()] == ["RETURN 2", "RETURN 1"]
