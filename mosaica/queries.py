"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .client import Client, connect
from .operators import fulltext, geo, graph, timetravel, vectors
from .session import Session
from .sources.dump import dump, restore
from .sources.kv import scan_table
from .sources.storage import new_path, stored
from .sources.vectorstore import VectorStore
from .streaming.live import changes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Registered] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark).register_all(sf_dir, *TABLES)


def ask(name: str, text: str, sql: str, **keys: str) -> None:
    """A query in the language. keys: columns that record keys of a table are compared with."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        for table, key in keys.items():
            s.tables[table].key = key
        return s.query(text)

    REGISTERED[name] = Registered(run, sql)


def build(name: str, sql: str | None):
    """A query that Python code makes."""

    def register(f):
        REGISTERED[name] = Registered(f, sql)
        return f

    return register


# ---------------------------------------------------------------- scans, projection, filter
ask("scan_star", "SELECT * FROM nation", "SELECT * FROM nation")
ask("point_read", "SELECT * FROM orders:7", "SELECT * FROM orders WHERE o_orderkey = 7", orders="o_orderkey")
ask("derived_table", "SELECT n_name FROM (SELECT * FROM nation WHERE n_regionkey = 1)", "SELECT n_name FROM nation WHERE n_regionkey = 1")
ask("array_source", "SELECT a, a * 2 AS b FROM [{a: 1}, {a: 2}, {a: 3}] WHERE a > 1", "SELECT CAST(a AS BIGINT) AS a, CAST(a * 2 AS BIGINT) AS b FROM (VALUES (2), (3)) t(a)")
ask("no_from", "SELECT VALUE 1 + 2 * 3", "SELECT CAST(7 AS BIGINT) AS value")
ask("project_alias", "SELECT o_orderkey, o_totalprice AS price, o_totalprice > 100000 AS big FROM orders", "SELECT o_orderkey, o_totalprice AS price, o_totalprice > 100000 AS big FROM orders")
ask("project_mixed_star", "SELECT *, n_nationkey + 1 AS next FROM nation", "SELECT *, CAST(n_nationkey + 1 AS BIGINT) AS next FROM nation")
ask("select_value", "SELECT VALUE r_name FROM region", "SELECT r_name AS value FROM region")
ask("nested_path", "SELECT event_id, props.k AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
ask("nested_object", "SELECT VALUE o.b.c FROM (SELECT {b: {c: n_nationkey}} AS o FROM nation)", "SELECT n_nationkey AS value FROM nation")
ask("array_index", "SELECT vec_id, embedding[0] AS first, embedding[-1] AS none FROM embeddings", "SELECT vec_id, embedding[1] AS first, CAST(NULL AS FLOAT) AS none FROM embeddings")
ask("filter_pushdown", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000")
ask("filter_precedence", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice < 50000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice < 50000)")
_gaps = "(SELECT c_custkey AS k, (IF c_custkey % 3 = 0 THEN null ELSE c_custkey % 7 END) AS x FROM customer)"
_gaps_sql = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 7 END AS x FROM customer)"
ask("filter_total_order_lt", f"SELECT k FROM {_gaps} WHERE x < 3", f"SELECT k FROM {_gaps_sql} WHERE x IS NULL OR x < 3")
ask("filter_total_order_ge", f"SELECT k FROM {_gaps} WHERE x >= 3", f"SELECT k FROM {_gaps_sql} WHERE x >= 3")
ask("filter_null_equals_null", f"SELECT k FROM {_gaps} WHERE x = null", f"SELECT k FROM {_gaps_sql} WHERE x IS NULL")
ask("filter_not_equal_missing", f"SELECT k FROM {_gaps} WHERE x != 5", f"SELECT k FROM {_gaps_sql} WHERE x IS DISTINCT FROM 5")
ask("filter_truthy", f"SELECT k FROM {_gaps} WHERE x", f"SELECT k FROM {_gaps_sql} WHERE coalesce(x, 0) <> 0")
ask("filter_not_truthy", f"SELECT k FROM {_gaps} WHERE !x", f"SELECT k FROM {_gaps_sql} WHERE coalesce(x, 0) = 0")
ask("compare_number_text", "SELECT VALUE n_nationkey FROM nation WHERE n_nationkey = '7'", "SELECT n_nationkey AS value FROM nation WHERE n_nationkey = 7")
ask("coalesce_op", f"SELECT k, x ?? -1 AS y FROM {_gaps}", f"SELECT k, coalesce(x, -1) AS y FROM {_gaps_sql}")
ask("filter_in_array", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ['1-URGENT', '2-HIGH']", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
ask("filter_not_in_array", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ['1-URGENT', '2-HIGH']", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
ask("contains_string", "SELECT p_partkey FROM part WHERE p_name CONTAINS 'a' AND p_type NOT CONTAINS 'S'", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND NOT contains(p_type, 'S')")
ask("contains_each", "SELECT k FROM (SELECT c_custkey AS k, [c_custkey % 2, c_custkey % 3] AS a FROM customer) WHERE a CONTAINSALL [0, 1] OR a CONTAINSNONE [0, 1]", "SELECT c_custkey AS k FROM customer WHERE (list_has_all([c_custkey % 2, c_custkey % 3], [0, 1])) OR NOT list_has_any([c_custkey % 2, c_custkey % 3], [0, 1])")
ask("all_equal", "SELECT k FROM (SELECT c_custkey AS k, [c_custkey % 2, c_custkey % 3] AS a FROM customer) WHERE a *= 1", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 1")
ask("any_equal", "SELECT k FROM (SELECT c_custkey AS k, [c_custkey % 2, c_custkey % 3] AS a FROM customer) WHERE a ?= 2", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 2")
ask("match_no_index", "SELECT doc_id FROM documents WHERE text @@ 'the er'", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'er')")
ask("arith_mixed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber ** 2 AS sq, l_linenumber % 3 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(power(l_linenumber, 2) AS DOUBLE) AS sq, CAST(l_linenumber % 3 AS BIGINT) AS m FROM lineitem")
ask("arith_decimal", "SELECT n_nationkey, <string> (n_nationkey / 3) AS third FROM nation", "SELECT n_nationkey, CAST(CAST(round(n_nationkey * 10000000000::HUGEINT / 3.0, 0) / 10000000000 AS DECIMAL(38,10)) AS VARCHAR) AS third FROM nation")
ask("arith_missing", f"SELECT k, x + 5 AS a, x * 5 AS b, x - 5 AS c FROM {_gaps}", f"SELECT k, coalesce(x, 5) + 5 AS a, coalesce(x, 5) * 5 AS b, coalesce(x, 5) - 5 AS c FROM {_gaps_sql}")
ask("datetime_plus_duration", "SELECT event_id, ts + 1h30m AS later, ts - 1d AS before FROM events", "SELECT event_id, ts + INTERVAL '90 minutes' AS later, ts - INTERVAL '1 day' AS before FROM events")
ask("cast_ops", "SELECT n_nationkey, <string> n_nationkey AS s, <float> n_name AS f, <int> '12' AS i, <bool> n_regionkey AS b FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS s, CAST(0 AS DOUBLE) AS f, CAST(12 AS BIGINT) AS i, n_regionkey <> 0 AS b FROM nation")
ask("if_else", "SELECT o_orderkey, IF o_totalprice > 200000 THEN 'high' ELSE IF o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
ask("block_expression", "SELECT n_nationkey, { LET $d = n_nationkey * 2; $d + 1 } AS v FROM nation", "SELECT n_nationkey, CAST(n_nationkey * 2 + 1 AS BIGINT) AS v FROM nation")
ask("params", "LET $min = 20; SELECT n_name FROM nation WHERE n_nationkey >= $min", "SELECT n_name FROM nation WHERE n_nationkey >= 20")
ask("array_where", "SELECT VALUE [n_nationkey, n_regionkey][WHERE value > 3] FROM nation", "SELECT list_filter([n_nationkey, n_regionkey], lambda x: x > 3) AS value FROM nation")

# ---------------------------------------------------------------- order and limit
ask("order_limit_start", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 START 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
ask("order_missing_first", f"SELECT k, x FROM {_gaps} ORDER BY x, k LIMIT 20", f"SELECT k, x FROM {_gaps_sql} ORDER BY x NULLS FIRST, k LIMIT 20")
ask("order_missing_last", f"SELECT k, x FROM {_gaps} ORDER BY x DESC, k LIMIT 800", f"SELECT k, x FROM {_gaps_sql} ORDER BY x DESC NULLS LAST, k LIMIT 800")

# ---------------------------------------------------------------- aggregation
ask("agg_group_one", "SELECT count() AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag", 'SELECT l_returnflag AS "group.0", count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity < 24 GROUP BY 1')
ask("agg_group_two", "SELECT count() AS n, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY l_returnflag, l_linestatus", 'SELECT l_returnflag AS "group.0", l_linestatus AS "group.1", count(*) AS n, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1, 2')
ask("agg_group_expression", "SELECT count() AS n FROM events GROUP BY time::hour(ts)", 'SELECT CAST(hour(ts) AS BIGINT) AS "group.0", count(*) AS n FROM events GROUP BY 1')
ask("agg_global", "SELECT count() AS n, sum(o_totalprice) AS s, min(o_orderdate) AS d FROM orders", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS d FROM orders")
ask("agg_global_empty", "SELECT count() AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders WHERE o_totalprice < -1", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s, avg(o_totalprice) AS a FROM orders WHERE o_totalprice < -1")
ask("agg_count_ignores_argument", f"SELECT count(x) AS n, sum(x) AS s, avg(x) AS a, min(x) AS lo FROM {_gaps}", f"SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS s, avg(x) AS a, min(x) AS lo FROM {_gaps_sql}")
ask("agg_text_sum", "SELECT sum(n_name) AS s, min(n_name) AS lo, max(n_name) AS hi FROM nation", "SELECT CAST(0 AS BIGINT) AS s, min(n_name) AS lo, max(n_name) AS hi FROM nation")
ask("agg_order_limit", "SELECT sum(o_totalprice) AS s FROM orders ORDER BY s DESC GROUP BY o_custkey LIMIT 7", 'SELECT o_custkey AS "group.0", sum(o_totalprice) AS s FROM orders GROUP BY 1 ORDER BY s DESC LIMIT 7')
ask("agg_having", "SELECT count() AS n FROM orders GROUP BY o_custkey HAVING n > 12", 'SELECT o_custkey AS "group.0", count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12')
ask("agg_join", "SELECT sum(o_totalprice) AS s FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY c_mktsegment", 'SELECT c_mktsegment AS "group.0", sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1')
ask("group_without_aggregate", "SELECT r_name FROM region GROUP BY r_regionkey", "SELECT r_name FROM region")

# ---------------------------------------------------------------- windows
ask("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, rank() OVER (ORDER BY o_orderpriority) AS p, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, rank() OVER (ORDER BY o_orderpriority) AS p, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
ask("window_aggregate", "SELECT event_id, count() OVER (PARTITION BY user_id) AS n, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS m FROM events", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS m FROM events")
ask("window_before_limit", "SELECT o_orderkey, count() OVER () AS n FROM orders ORDER BY o_orderkey LIMIT 5", "SELECT o_orderkey, count(*) OVER () AS n FROM orders ORDER BY o_orderkey LIMIT 5")

# ---------------------------------------------------------------- joins and subqueries
ask("join_inner", "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey", 'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
ask("join_where_after", "SELECT orders.o_orderkey AS k, customer.c_name AS c FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey WHERE customer.c_acctbal > 5000 AND orders.o_orderstatus = 'O'", "SELECT o_orderkey AS k, c_name AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'O'")
ask("join_chain", "SELECT o.o_orderkey AS k, n.n_name AS nation, r.r_name AS region FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name != 'ASIA'", "SELECT o_orderkey AS k, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
ask("join_null_keys", f"SELECT a.k AS k, n.n_name AS n FROM {_gaps} a JOIN nation n ON a.x = n.n_nationkey", f"SELECT k, n_name AS n FROM {_gaps_sql} JOIN nation ON x = n_nationkey")
ask("join_left", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
ask("join_anti", "SELECT c.c_custkey AS c FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
ask("join_right", "SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey AS o, c_custkey AS c FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
ask("join_full", f"SELECT a.k AS k, n.n_name AS n FROM {_gaps} a FULL JOIN nation n ON a.x = n.n_nationkey", f"SELECT k, n_name AS n FROM {_gaps_sql} FULL JOIN nation ON x = n_nationkey")
ask("join_semi", "SELECT c.c_custkey AS c FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
ask("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT VALUE n_nationkey FROM nation WHERE n_regionkey = 2)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
ask("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT VALUE o_custkey FROM orders WHERE o_orderstatus = 'F')", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
ask("correlated_subquery", "SELECT r_name, array::sort((SELECT VALUE n_name FROM nation WHERE n_regionkey = $parent.r_regionkey)) AS nations FROM region", "SELECT r_name, list_sort(list(n_name)) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
ask("correlated_aggregate", "SELECT c_custkey, (SELECT VALUE count() FROM orders WHERE o_custkey = $parent.c_custkey)[0] ?? 0 AS n FROM customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
ask("correlated_top", "SELECT c_custkey, (SELECT VALUE o_orderkey FROM orders WHERE o_custkey = $parent.c_custkey ORDER BY o_totalprice DESC LIMIT 1)[0] AS best FROM customer", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC LIMIT 1) AS best FROM customer")
ask("scalar_subquery", "SELECT n_nationkey, array::len((SELECT VALUE r_regionkey FROM region)) AS regions FROM nation", "SELECT n_nationkey, (SELECT count(*) FROM region) AS regions FROM nation")
ask("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name AS x FROM region", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
ask("intersect_distinct", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey AS n FROM supplier", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
ask("order_distinct", "SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY o_orderpriority DESC LIMIT 3", "SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p DESC LIMIT 3")
ask("except_distinct", "SELECT DISTINCT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey AS n FROM supplier", "SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier")

# ---------------------------------------------------------------- functions
ask("fn_string_basic", "SELECT p_partkey, string::concat(p_brand, '-', p_type) AS a, string::contains(p_name, 'e') AS b, string::ends_with(p_brand, '1') AS c, string::starts_with(p_brand, 'Brand') AS d, string::len(p_name) AS e, string::lowercase(p_name) AS f, string::uppercase(p_name) AS g, string::repeat(p_brand, 2) AS h, string::replace(p_name, 'a', '_') AS i, string::reverse(p_brand) AS j FROM part",
    "SELECT p_partkey, p_brand || '-' || p_type AS a, contains(p_name, 'e') AS b, suffix(p_brand, '1') AS c, prefix(p_brand, 'Brand') AS d, length(p_name) AS e, lower(p_name) AS f, upper(p_name) AS g, repeat(p_brand, 2) AS h, replace(p_name, 'a', '_') AS i, reverse(p_brand) AS j FROM part")
ask("fn_string_more", "SELECT p_partkey, string::slice(p_name, 1, 3) AS a, string::slice(p_name, -3) AS b, string::split(p_name, ' ') AS c, string::trim('  x ') AS d, string::words(p_name) AS e, string::matches(p_brand, 'Brand#\\\\d+') AS f, string::capitalize(p_name) AS g, string::pad_start(p_brand, 12, '*') AS h, string::pad_end(p_brand, 3) AS i, string::join('-', p_brand, p_type) AS j, string::slug('Olá Mundo Cão') AS k FROM part",
    r"SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 3) AS b, string_split(p_name, ' ') AS c, 'x' AS d, string_split(p_name, ' ') AS e, regexp_full_match(p_brand, 'Brand#\d+') AS f, upper(p_name[1]) || p_name[2:] AS g, lpad(p_brand, 12, '*') AS h, p_brand AS i, p_brand || '-' || p_type AS j, 'ola-mundo-cao' AS k FROM part")
ask("fn_math_basic", "SELECT c_custkey, math::abs(c_acctbal) AS a, math::sign(c_acctbal) AS b, math::ceil(c_acctbal) AS c, math::floor(c_acctbal) AS d, math::round(c_acctbal) AS e, math::sqrt(math::abs(c_acctbal)) AS f, math::pow(c_nationkey, 2) AS g, math::clamp(c_acctbal, 0, 1000) AS h, math::min(c_nationkey, 7, 3) AS i, math::max(c_nationkey, 7, 3) AS j, math::sum([1, 2, c_nationkey]) AS k FROM customer",
    "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS b, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS d, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS e, sqrt(abs(c_acctbal)) AS f, CAST(power(c_nationkey, 2) AS DOUBLE) AS g, greatest(0, least(1000, c_acctbal)) AS h, CAST(least(c_nationkey, 3) AS BIGINT) AS i, CAST(greatest(c_nationkey, 7) AS BIGINT) AS j, CAST(3 + c_nationkey AS BIGINT) AS k FROM customer")
ask("fn_math_more", "SELECT n_nationkey, math::round(math::mean([1, 2, n_nationkey]) * 1000) AS a, math::median([5, 1, n_nationkey]) AS b, math::product([2, n_nationkey]) AS c, math::round(math::ln(n_nationkey + 1) * 1000) AS d, math::round(math::log(n_nationkey + 1, 2) * 1000) AS e, math::round(math::log10(n_nationkey + 1) * 1000) AS f, math::round(math::exp(1) * 1000) AS g, math::round(math::pi * 1000) AS h, math::fixed(2.345, 2) AS i FROM nation",
    "SELECT n_nationkey, CAST(floor(round((3 + n_nationkey) / 3.0::DOUBLE, 10) * 1000 + 0.5) AS BIGINT) AS a, CAST(greatest(1, least(5, n_nationkey)) AS DOUBLE) AS b, CAST(2 * n_nationkey AS DOUBLE) AS c, CAST(floor(ln(n_nationkey + 1) * 1000 + 0.5) AS BIGINT) AS d, CAST(floor(ln(n_nationkey + 1) / ln(2) * 1000 + 0.5) AS BIGINT) AS e, CAST(floor(log10(n_nationkey + 1) * 1000 + 0.5) AS BIGINT) AS f, CAST(2718 AS BIGINT) AS g, CAST(3142 AS BIGINT) AS h, CAST(2.35 AS DOUBLE) AS i FROM nation")
_a, _al = "[n_nationkey, n_regionkey, 3, 3]", "[n_nationkey, n_regionkey, 3, 3]::BIGINT[]"
ask("fn_array_basic", f"SELECT n_nationkey, array::append({_a}, 9) AS a, array::prepend({_a}, 9) AS b, array::at({_a}, -1) AS c, array::concat({_a}, [7]) AS d, array::distinct({_a}) AS e, array::find_index({_a}, 3) AS f, array::first({_a}) AS g, array::last({_a}) AS h, array::len({_a}) AS i, array::max({_a}) AS j, array::min({_a}) AS k, array::sort({_a}) AS l, array::sort::desc({_a}) AS m, array::reverse({_a}) AS n FROM nation",
    f"SELECT n_nationkey, list_append({_al}, 9) AS a, list_prepend(9, {_al}) AS b, CAST(3 AS BIGINT) AS c, list_concat({_al}, [7]) AS d, list_filter({_al}, lambda x, i: list_position({_al}, x) = i) AS e, CAST(list_position({_al}, 3) - 1 AS BIGINT) AS f, CAST(n_nationkey AS BIGINT) AS g, CAST(3 AS BIGINT) AS h, CAST(4 AS BIGINT) AS i, CAST(greatest(n_nationkey, n_regionkey, 3) AS BIGINT) AS j, CAST(least(n_nationkey, n_regionkey, 3) AS BIGINT) AS k, list_sort({_al}) AS l, list_reverse_sort({_al}) AS m, list_reverse({_al}) AS n FROM nation")
ask("fn_array_sets", f"SELECT n_nationkey, array::add({_a}, 3) AS a, array::all({_a}) AS b, array::any({_a}) AS c, array::complement({_a}, [3]) AS d, array::difference({_a}, [3, 99]) AS e, array::flatten([[n_nationkey], [1, 2]]) AS f, array::insert({_a}, 8, 1) AS g, array::len(array::intersect({_a}, [3, 4])) AS h, array::join('-', {_a}) AS i, array::pop({_a}) AS j, array::remove({_a}, 0) AS k, array::slice({_a}, 1, 2) AS l, array::len(array::union({_a}, [3, 99])) AS m FROM nation",
    f"SELECT n_nationkey, {_al} AS a, n_nationkey <> 0 AND n_regionkey <> 0 AS b, true AS c, list_filter({_al}, lambda x: x <> 3) AS d, list_concat(list_filter({_al}, lambda x: x NOT IN (3, 99)), [99]) AS e, [n_nationkey, 1, 2]::BIGINT[] AS f, [n_nationkey, 8, n_regionkey, 3, 3]::BIGINT[] AS g, CAST(len(list_intersect(list_distinct({_al}), [3, 4])) AS BIGINT) AS h, array_to_string({_al}, '-') AS i, [n_nationkey, n_regionkey, 3]::BIGINT[] AS j, [n_regionkey, 3, 3]::BIGINT[] AS k, [n_regionkey, 3]::BIGINT[] AS l, CAST(len(list_distinct(list_concat({_al}, [3, 99]))) AS BIGINT) AS m FROM nation")
ask("fn_object", "SELECT n_nationkey, object::keys({a: 1, b: n_name}) AS k, object::values({a: 1, b: n_nationkey}) AS v, object::len({a: 1}) AS n, object::entries({a: n_name}) AS e FROM nation", "SELECT n_nationkey, ['a', 'b'] AS k, [1, n_nationkey]::BIGINT[] AS v, CAST(1 AS BIGINT) AS n, [['a', n_name]] AS e FROM nation")
ask("fn_type", "SELECT n_nationkey, type::int('12') AS a, type::float('1.5') AS b, type::string(n_nationkey) AS c, type::bool('true') AS d, type::datetime('2024-01-02T03:04:05Z') AS e, type::is::number(n_nationkey) AS f, type::is::string(n_name) AS g, type::is::array([1]) AS h, type::is::object(n_name) AS i, type::is::null(null) AS j, record::id('nation:7') AS k, meta::tb('nation:7') AS l FROM nation",
    "SELECT n_nationkey, CAST(12 AS BIGINT) AS a, CAST(1.5 AS DOUBLE) AS b, CAST(n_nationkey AS VARCHAR) AS c, true AS d, TIMESTAMP '2024-01-02 03:04:05' AS e, true AS f, true AS g, true AS h, false AS i, true AS j, '7' AS k, 'nation' AS l FROM nation")
ask("fn_time", "SELECT event_id, time::year(ts) AS a, time::month(ts) AS b, time::day(ts) AS c, time::hour(ts) AS d, time::minute(ts) AS e, time::second(ts) AS f, time::yday(ts) AS g, time::wday(ts) AS h, time::unix(ts) AS i, time::millis(ts) AS j, time::from::unix(time::unix(ts)) AS k FROM events",
    "SELECT event_id, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS d, minute(ts) AS e, second(ts) AS f, dayofyear(ts) AS g, isodow(ts) AS h, epoch_us(ts) // 1000000 AS i, epoch_us(ts) // 1000 AS j, date_trunc('second', ts) AS k FROM events")
ask("fn_crypto_encoding", "SELECT c_custkey, crypto::md5(c_name) AS a, crypto::sha1(c_name) AS b, crypto::sha256(c_name) AS c, encoding::base64::encode(c_name) AS d, encoding::base64::decode(encoding::base64::encode(c_name)) AS e FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c, base64(encode(c_name)) AS d, c_name AS e FROM customer")
ask("fn_value", f"SELECT k, value::coalesce(x, -1) AS a, value::default(x, 0) AS b FROM {_gaps}", f"SELECT k, coalesce(x, -1) AS a, coalesce(x, 0) AS b FROM {_gaps_sql}")
ask("fn_names_string_math", "SELECT n_nationkey, string::length(n_name) AS a, math::round(math::log2(n_nationkey + 1) * 1000) AS b, math::round(math::tau * 1000) AS c, math::round(math::e * 1000) AS d, math::inf > 1 AS e, math::neg_inf < n_nationkey AS f, crypto::sha512('a') AS g FROM nation",
    "SELECT n_nationkey, CAST(length(n_name) AS BIGINT) AS a, CAST(floor(log2(n_nationkey + 1) * 1000 + 0.5) AS BIGINT) AS b, CAST(6283 AS BIGINT) AS c, CAST(2718 AS BIGINT) AS d, true AS e, true AS f, '1f40fc92da241694750979ee6cf582f2d5d7d28e18335de05abc54d0560e0f5302860c652bf08d560252aa5e74210546f369fbbbce8c12cfc7957b2652fe9a75' AS g FROM nation")
ask("fn_names_array_object", f"SELECT n_nationkey, array::length({_a}) AS a, array::push({_a}, 9) AS b, array::sort(array::shuffle({_a})) AS c, array::sort::asc({_a}) AS d, object::length({{a: 1, b: n_name}}) AS e, object::from_entries([['a', n_name]]).a AS f FROM nation",
    f"SELECT n_nationkey, CAST(4 AS BIGINT) AS a, list_append({_al}, 9) AS b, list_sort({_al}) AS c, list_sort({_al}) AS d, CAST(2 AS BIGINT) AS e, n_name AS f FROM nation")
ask("fn_names_type", "SELECT n_nationkey, <string> type::decimal('1.5') AS a, type::table(n_name) AS b, type::record('nation', n_nationkey) AS c, type::array(n_nationkey) AS d, type::number('2.5') AS e, type::is::bool(n_nationkey > 3) AS f, type::is::datetime(n_name) AS g, type::is::none(null) AS h, type::is::record(nation:1) AS i FROM nation",
    "SELECT n_nationkey, '1.5000000000' AS a, n_name AS b, 'nation:' || n_nationkey AS c, [n_nationkey] AS d, CAST(2.5 AS DOUBLE) AS e, true AS f, false AS g, true AS h, true AS i FROM nation")
ask("fn_names_record_time", "SELECT event_id, meta::id('event:' + <string> event_id) AS a, record::table('event:' + <string> event_id) AS b, record::tb('event:1') AS c, record::exists(event:1) AS d, time::from::millis(time::millis(ts)) AS e, time::year(now()) >= 2024 AS f, time::now() >= ts AS g FROM events",
    "SELECT event_id, CAST(event_id AS VARCHAR) AS a, 'event' AS b, 'event' AS c, true AS d, date_trunc('millisecond', ts) AS e, true AS f, true AS g FROM events")
ask("fn_rand_within", "SELECT n_nationkey, rand::float(2, 3) >= 2 AS a, rand::int(5, 5) AS b, string::len(rand::string(8)) AS c, rand::enum('x') AS d FROM nation", "SELECT n_nationkey, true AS a, CAST(5 AS BIGINT) AS b, CAST(8 AS BIGINT) AS c, 'x' AS d FROM nation")
ask("operators_without_value", "SELECT n_nationkey, n_nationkey ?: 2 AS a, [n_nationkey] OUTSIDE [1] AS b, [n_nationkey] INTERSECTS [1] AS c FROM nation", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM nation")
ask("param_array_source", "LET $rows = [{a: 1}, {a: 2}]; SELECT a, a + 1 AS b FROM $rows", "SELECT CAST(a AS BIGINT) AS a, CAST(a + 1 AS BIGINT) AS b FROM (VALUES (1), (2)) t(a)")
ask("fn_rand", "SELECT n_nationkey, rand() AS a, rand::int(1, 6) AS b, rand::string(8) AS c, rand::uuid() AS d, rand::bool() AS e, rand::enum('x', 'y') AS f FROM nation", None)

# ---------------------------------------------------------------- geography
_p = "geometry::point((c_custkey * 37 % 360) - 180, (c_custkey * 17 % 170) - 85)"
_hav = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))))"
_pts = "(SELECT c_custkey, CAST((c_custkey * 37 % 360) - 180 AS DOUBLE) AS lon, CAST((c_custkey * 17 % 170) - 85 AS DOUBLE) AS lat FROM customer)"
ask("geo_distance", f"SELECT c_custkey, math::round(geo::distance({_p}, geometry::point(-43.2, -22.9))) AS d FROM customer", f"SELECT c_custkey, CAST(floor({_hav.format(lat='-22.9', lon='-43.2')} + 0.5) AS BIGINT) AS d FROM {_pts}")
ask("geo_radius", f"SELECT c_custkey FROM customer WHERE geo::distance({_p}, geometry::point(10, 50)) < 2000000", f"SELECT c_custkey FROM {_pts} WHERE {_hav.format(lat='50', lon='10')} < 2000000")
ask("geo_area", "SELECT n_nationkey, geo::area(geometry::polygon([[[0, 0], [n_nationkey, 0], [n_nationkey, 2], [0, 2], [0, 0]]])) AS a FROM nation", "SELECT n_nationkey, CAST(n_nationkey * 2 AS DOUBLE) AS a FROM nation")
ask("geo_contains", f"SELECT c_custkey FROM customer WHERE geo::contains(geometry::polygon([[[-10.5, -10.5], [40.5, -10.5], [40.5, 30.5], [-10.5, 30.5], [-10.5, -10.5]]]), {_p})", f"SELECT c_custkey FROM {_pts} WHERE lon > -10.5 AND lon < 40.5 AND lat > -10.5 AND lat < 30.5")
ask("geo_non_point_passes", "SELECT n_nationkey FROM nation WHERE geo::distance(geometry::line([[0, 0], [1, 1]]), geometry::point(0, 0)) < 5", "SELECT n_nationkey FROM nation")


@build("geo_within", f"SELECT c_custkey FROM {_pts} WHERE {_hav.format(lat='50', lon='10')} < 2000000")
def _geo_within(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((F.col("c_custkey") * 37 % 360) - 180).cast("double").alias("lon"), ((F.col("c_custkey") * 17 % 170) - 85).cast("double").alias("lat"))
    return geo.within(df, F.col("lon"), F.col("lat"), (10.0, 50.0), 2_000_000.0).select("c_custkey")


@build("geo_distance_join", f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM {_pts} a JOIN {_pts} b ON abs(a.lat - b.lat) < 3 AND 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) < 300000")
def _geo_distance_join(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((F.col("c_custkey") * 37 % 360) - 180).cast("double").alias("lon"), ((F.col("c_custkey") * 17 % 170) - 85).cast("double").alias("lat"))
    return geo.distance_join(df.toDF("a", "alon", "alat"), df.toDF("b", "blon", "blat"), ("alon", "alat"), ("blon", "blat"), 300_000.0).select("a", "b")


_bits = "list_transform(range(25), lambda i: CASE WHEN i % 2 = 0 THEN (x >> (12 - i // 2)) & 1 ELSE (y >> (11 - i // 2)) & 1 END)"
_letters = " || ".join(f"'0123456789bcdefghjkmnpqrstuvwxyz'[1 + list_sum(list_transform(range({5 * k}, {5 * k + 5}), lambda i: b[i + 1] << ({5 * k + 4} - i)))::INT]" for k in range(5))
ask("geo_hash", f"SELECT c_custkey, geo::hash::encode({_p}, 5) AS h FROM customer", f"SELECT c_custkey, {_letters} AS h FROM (SELECT c_custkey, {_bits} AS b FROM (SELECT c_custkey, least(8191, floor((lon + 180) / 360 * 8192))::INT AS x, least(4095, floor((lat + 90) / 180 * 4096))::INT AS y FROM {_pts}))")
ask("geo_radius_field", f"SELECT k FROM (SELECT c_custkey AS k, {_p} AS at FROM customer) WHERE geo::distance(at, geometry::point(10, 50)) < 2000000", f"SELECT c_custkey AS k FROM {_pts} WHERE {_hav.format(lat='50', lon='10')} < 2000000")


@build("geo_cells", f"SELECT c_custkey FROM {_pts} WHERE {_hav.format(lat='50', lon='10')} < 2000000")
def _geo_cells(spark, sf_dir):
    """A table that stores the geohash of its places, searched by the cells that cover a circle."""
    s = session(spark, sf_dir)
    df = s.query(f"SELECT c_custkey, geo::hash::encode({_p}, 3) AS h, {_p} AS at FROM customer")
    at = F.col("at.coordinates")
    return geo.within_cells(df, F.col("h"), at[0], at[1], (10.0, 50.0), 2_000_000.0, 3).select("c_custkey")


# ---------------------------------------------------------------- vectors
_q = "[" + ", ".join(["0.1"] * 64) + "]"
_ql = "[" + ", ".join(["0.1"] * 64) + "]::DOUBLE[]"
_e = "CAST(embedding AS DOUBLE[])"
ask("vec_euclidean_topk", f"SELECT vec_id FROM embeddings ORDER BY vector::distance::euclidean(embedding, {_q}), vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY list_distance({_e}, {_ql}), vec_id LIMIT 10")
ask("vec_cosine_topk", f"SELECT vec_id FROM embeddings ORDER BY vector::distance::cosine(embedding, {_q}), vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY list_cosine_distance({_e}, {_ql}), vec_id LIMIT 10")
ask("vec_manhattan_topk", f"SELECT vec_id FROM embeddings ORDER BY vector::distance::manhattan(embedding, {_q}), vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY list_sum(list_transform(list_zip({_e}, {_ql}), lambda p: abs(p[1] - p[2]))), vec_id LIMIT 10")
ask("vec_filter_then_topk", f"SELECT vec_id, label FROM embeddings WHERE label = 1 ORDER BY vector::distance::euclidean(embedding, {_q}), vec_id LIMIT 5", f"SELECT vec_id, label FROM embeddings WHERE label = 1 ORDER BY list_distance({_e}, {_ql}), vec_id LIMIT 5")
ask("vec_similarity", f"SELECT vec_id, math::round(vector::similarity::cosine(embedding, {_q}) * 10000) AS s FROM embeddings", f"SELECT vec_id, CAST(floor(list_cosine_similarity({_e}, {_ql}) * 10000 + 0.5) AS BIGINT) AS s FROM embeddings")


@build("vec_nearest", f"SELECT vec_id FROM embeddings ORDER BY list_distance({_e}, {_ql}), vec_id LIMIT 10")
def _vec_nearest(spark, sf_dir):
    return vectors.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", [0.1] * 64, 10, tie="vec_id").select("vec_id")


@build("vector_store", f"SELECT 'vectors:' || vec_id AS id, CAST(floor((1 - list_cosine_distance({_e}, {_ql})) * 100000 + 0.5) AS BIGINT) AS score FROM embeddings ORDER BY list_cosine_distance({_e}, {_ql}), id LIMIT 5")
def _vector_store(spark, sf_dir):
    store = VectorStore(Session(spark))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    store.upsert_frame(df.select(F.concat(F.lit("vectors:"), "vec_id").alias("id"), F.lit("").alias("text"), F.col("embedding").cast("array<double>"), F.lit("{}").alias("metadata")))
    return store.search([0.1] * 64, 5).select("id", F.floor(F.col("score") * 100000 + 0.5).alias("score"))


# ---------------------------------------------------------------- full text
_toks = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_bm = f"""WITH d AS (SELECT doc_id, text, {_toks} AS w FROM documents), s AS (SELECT count(*) FILTER (len(w) > 0) AS n, avg(len(w)) FILTER (len(w) > 0) AS a,
count(*) FILTER (list_contains(w, 'the')) AS df1, count(*) FILTER (list_contains(w, 'of')) AS df2 FROM d),
t AS (SELECT doc_id, text, w, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'of')) AS f2, s.* FROM d, s),
b AS (SELECT doc_id, w, ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - df2 + 0.5) / (df2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM t WHERE f1 > 0 AND f2 > 0)"""


def searching(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    s.tables["documents"].key = "doc_id"
    s.execute("DEFINE ANALYZER plain LOWERCASE; DEFINE INDEX body ON TABLE documents COLUMNS text SEARCH ANALYZER plain")
    return s


@build("fulltext_and", f"{_bm} SELECT doc_id FROM b")
def _fulltext_and(spark, sf_dir):
    return searching(spark, sf_dir).query("SELECT doc_id FROM documents WHERE text @@ 'the of'")


@build("bm25_score", f"{_bm} SELECT doc_id, CAST(floor(score * 100000 + 0.5) AS BIGINT) AS score FROM b")
def _bm25_score(spark, sf_dir):
    return searching(spark, sf_dir).query("SELECT doc_id, math::round(search::score() * 100000) AS score FROM documents WHERE text @@ 'the of'")


@build("bm25_topk", f"{_bm} SELECT doc_id FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def _bm25_topk(spark, sf_dir):
    return searching(spark, sf_dir).query("SELECT doc_id FROM documents WHERE text @@ 'the of' ORDER BY search::score() DESC, doc_id LIMIT 10")


@build("highlight", "SELECT doc_id, regexp_replace(text, '(the)', '<b>\\1</b>', 'gi') AS h FROM documents WHERE list_contains(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), 'the')")
def _highlight(spark, sf_dir):
    return searching(spark, sf_dir).query("SELECT doc_id, search::highlight(text, '<b>', '</b>') AS h FROM documents WHERE text @@ 'the'")


@build("analyzer_terms", "SELECT p_partkey, list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda x: x NOT IN ('', 'the')), lambda w: CASE WHEN suffix(w, 'ing') AND length(w) > 5 THEN left(w, -3) WHEN suffix(w, 'es') AND length(w) > 4 THEN left(w, -2) WHEN suffix(w, 'os') AND length(w) > 4 THEN left(w, -2) WHEN suffix(w, 'as') AND length(w) > 4 THEN left(w, -2) WHEN suffix(w, 's') AND length(w) > 3 THEN left(w, -1) ELSE w END) AS terms FROM part")
def _analyzer_terms(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", fulltext.analyze(F.col("p_name"), True, ("the",), True).alias("terms"))


@build("postings", f"SELECT term, p_partkey AS key, CAST(len(w) AS INTEGER) AS len, CAST(count(*) AS INTEGER) AS tf FROM (SELECT p_partkey, w, unnest(w) AS term FROM (SELECT p_partkey, {_toks.replace('text', 'p_name')} AS w FROM part)) GROUP BY ALL")
def _postings(spark, sf_dir):
    return fulltext.postings(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", fulltext.analyze(F.col("p_name"))).select("term", "key", "len", "tf")


@build("search_after_changes", "SELECT 'part:' || p_partkey AS id FROM part WHERE list_contains(" + _toks.replace("text", "p_name") + ", 'green') AND p_partkey % 5 <> 0 UNION ALL SELECT 'part:new'")
def _search_after_changes(spark, sf_dir):
    """The index of a table follows its changes: removed rows are not found, new ones are."""
    s = session(spark, sf_dir)
    s.register("part", s.tables["part"].rows().select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_name", "p_partkey"))
    s.execute("DEFINE ANALYZER plain LOWERCASE; DEFINE INDEX n ON TABLE part COLUMNS p_name SEARCH ANALYZER plain")
    s.execute("DELETE part WHERE p_partkey % 5 = 0; CREATE part:new SET p_name = 'a Green thing'")
    return s.query("SELECT id FROM part WHERE p_name @@ 'green'")


_hybrid = f"""{_bm}, v AS (SELECT b.doc_id, b.score, greatest(0, least(1, list_cosine_similarity([len(w) % 7, len(w) % 5, 1]::DOUBLE[], [1, 2, 3]::DOUBLE[]))) AS sim, list_cosine_similarity([len(w) % 7, len(w) % 5, 1]::DOUBLE[], [1, 2, 3]::DOUBLE[]) AS cs FROM b),
h AS (SELECT doc_id, cs, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) + sim AS total FROM v)"""


@build("hybrid_search", f"{_hybrid} SELECT doc_id, CAST(floor(total * 100000 + 0.5) AS BIGINT) AS score FROM h WHERE cs > 0.5")
def _hybrid_search(spark, sf_dir):
    s = searching(spark, sf_dir)
    docs = s.tables["documents"].rows()
    n = F.size(fulltext.analyze(F.col("text"))).cast("double")
    s.register("documents2", docs.withColumn("embedding", F.array(n % 7, n % 5, F.lit(1.0))))
    s.execute("DEFINE INDEX body2 ON TABLE documents2 COLUMNS text SEARCH ANALYZER plain")
    return s.query("SELECT doc_id, math::round(search::score() * 100000) AS score FROM documents2 WHERE text @@ 'the of' AND vector::similarity::cosine(embedding, [1, 2, 3]) > 0.5")


@build("hybrid_default_order", f"{_hybrid} SELECT doc_id FROM h WHERE cs > 0.5 ORDER BY round(total, 9) DESC LIMIT 5")
def _hybrid_default_order(spark, sf_dir):
    s = searching(spark, sf_dir)
    n = F.size(fulltext.analyze(F.col("text"))).cast("double")
    s.register("documents2", s.tables["documents"].rows().withColumn("embedding", F.array(n % 7, n % 5, F.lit(1.0))))
    s.execute("DEFINE INDEX body2 ON TABLE documents2 COLUMNS text SEARCH ANALYZER plain")
    return s.query("SELECT doc_id FROM documents2 WHERE text @@ 'the of' AND vector::similarity::cosine(embedding, [1, 2, 3]) > 0.5 LIMIT 5")


# ---------------------------------------------------------------- graph
def graphed(spark: SparkSession, sf_dir: str) -> Session:
    """customer -placed-> order -of-> nation of the customer; region -holds-> nation."""
    s = session(spark, sf_dir)
    node = lambda table, c: F.concat(F.lit(f"{table}:"), F.col(c).cast("string"))
    orders, nation = s.tables["orders"].rows(), s.tables["nation"].rows()
    s.register_edges(orders.select(node("customer", "o_custkey").alias("src"), F.lit("placed").alias("kind"), node("orders", "o_orderkey").alias("dst")), "placed")
    s.register_edges(nation.select(node("region", "n_regionkey").alias("src"), F.lit("holds").alias("kind"), node("nation", "n_nationkey").alias("dst")), "holds")
    s.register_edges(s.tables["customer"].rows().select(node("nation", "c_nationkey").alias("src"), F.lit("home").alias("kind"), node("customer", "c_custkey").alias("dst")), "home")
    for table, key in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("orders", "o_orderkey")):
        s.register(f"{table}", s.tables[table].rows().withColumn("id", node(table, key)))
    return s


@build("graph_hop_out", "SELECT c_custkey, list_sort(list_filter(list('orders:' || o_orderkey), lambda x: x IS NOT NULL)) AS placed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _graph_hop_out(spark, sf_dir):
    return graphed(spark, sf_dir).query("SELECT c_custkey, ->placed->orders AS placed FROM customer")


@build("graph_hop_in", "SELECT o_orderkey, ['customer:' || o_custkey] AS who FROM orders")
def _graph_hop_in(spark, sf_dir):
    return graphed(spark, sf_dir).query("SELECT o_orderkey, <-placed<-customer AS who FROM orders")


@build("graph_chain", "SELECT r_regionkey, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n FROM region")
def _graph_chain(spark, sf_dir):
    return graphed(spark, sf_dir).query("SELECT r_regionkey, array::len(->holds->home->customer) AS n FROM region")


@build("graph_both_ways", "SELECT n_nationkey, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
def _graph_both_ways(spark, sf_dir):
    return graphed(spark, sf_dir).query("SELECT n_nationkey, array::len(<->*) AS n FROM nation")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation n -next-> nation 2n + 1 and 2n + 2: a binary tree."""
    k = F.col("n_nationkey")
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k, F.explode(F.array(2 * k + 1, 2 * k + 2)).alias("to")).where("to < 25")
    return df.select(F.concat(F.lit("nation:"), k).alias("src"), F.lit("next").alias("kind"), F.concat(F.lit("nation:"), "to").alias("dst"))


@build("graph_connected", "SELECT true AS yes, false AS no, true AS self")
def _graph_connected(spark, sf_dir):
    e = chain(spark, sf_dir)
    return spark.createDataFrame([(graph.connected(e, "nation:0", "nation:24"), graph.connected(e, "nation:24", "nation:0"), graph.connected(e, "nation:3", "nation:3"))], "yes boolean, no boolean, self boolean")


@build("graph_path", "SELECT ['nation:0', 'nation:2', 'nation:5', 'nation:11', 'nation:24'] AS path, [] :: VARCHAR[] AS short")
def _graph_path(spark, sf_dir):
    e = chain(spark, sf_dir)
    return spark.createDataFrame([(graph.path(e, "nation:0", "nation:24"), graph.path(e, "nation:0", "nation:24", "next", 2))], "path array<string>, short array<string>")


# ---------------------------------------------------------------- records, changes, rules
def owned(spark: SparkSession, sf_dir: str) -> Session:
    """nation and region with record ids; nation.region links to its region."""
    s = session(spark, sf_dir)
    s.register("region", s.tables["region"].rows().select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), "r_name"))
    s.register("nation", s.tables["nation"].rows().select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), "n_name", "n_nationkey", F.concat(F.lit("region:"), "n_regionkey").alias("region")))
    return s


@build("fetch_one", "SELECT n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _fetch_one(spark, sf_dir):
    s = owned(spark, sf_dir)
    return s.query("SELECT n_name, region.r_name AS region FROM nation FETCH region")


@build("fetch_array", "SELECT n_name, [r_name, 'AFRICA'] AS regions FROM nation JOIN region ON r_regionkey = n_regionkey")
def _fetch_array(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.register("nation", s.tables["nation"].rows().withColumn("regions", F.array("region", F.lit("region:0"))))
    return s.query("SELECT n_name, regions.r_name AS regions FROM nation FETCH regions")


@build("record_point_read", "SELECT n_name FROM nation WHERE n_nationkey = 3")
def _record_point_read(spark, sf_dir):
    return owned(spark, sf_dir).query("SELECT n_name FROM nation:3")


@build("update_where", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END :: BIGINT AS n_nationkey FROM nation")
def _update_where(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("UPDATE nation SET n_nationkey = n_nationkey + 100 WHERE region = 'region:1'")
    return s.query("SELECT n_name, n_nationkey FROM nation")


@build("upsert_merge", "SELECT r_name, CASE WHEN r_regionkey = 1 THEN 'new' END AS note FROM region UNION ALL SELECT 'MOON', 'far'")
def _upsert_merge(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("UPSERT region:1 MERGE {note: 'new'}; UPSERT region:99 CONTENT {r_name: 'MOON', note: 'far'}")
    return s.query("SELECT r_name, note FROM region")


@build("delete_where", "SELECT n_name FROM nation WHERE n_nationkey >= 5")
def _delete_where(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("DELETE nation WHERE n_nationkey < 5")
    return s.query("SELECT n_name FROM nation")


@build("insert_rows", "SELECT r_name FROM region UNION ALL VALUES ('A'), ('B')")
def _insert_rows(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("INSERT INTO region (id, r_name) VALUES ('a', 'A'), ('b', 'B')")
    return s.query("SELECT r_name FROM region")


@build("transaction_cancel", "SELECT count(*) AS n FROM nation")
def _transaction_cancel(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("BEGIN; DELETE nation WHERE n_nationkey < 5; SAVEPOINT a; DELETE nation; ROLLBACK TO a; CANCEL")
    return s.query("SELECT count() AS n FROM nation")


@build("unique_violation", "SELECT 'refused' AS result")
def _unique_violation(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("DEFINE INDEX name ON TABLE region COLUMNS r_name UNIQUE")
    try:
        s.execute("CREATE region:77 SET r_name = 'ASIA'")
        return spark.createDataFrame([("accepted",)], "result string")
    except ValueError:
        return spark.createDataFrame([("refused",)], "result string")


@build("data_rule_filter", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _data_rule_filter(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE DATA RULE asia APPLY n_regionkey = 2")
    return s.act_as(["asia"]).query("SELECT n_name FROM nation")


@build("data_rule_mask", "SELECT c_custkey, '***' AS who FROM customer")
def _data_rule_mask(spark, sf_dir):
    return session(spark, sf_dir).act_as(masks=["C_NA%"]).query("SELECT c_custkey, c_name AS who FROM customer")


@build("table_permission", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _table_permission(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("DEFINE TABLE orders SCHEMALESS PERMISSIONS FOR select WHERE o_orderstatus = 'F'")
    return s.query("SELECT o_orderkey FROM orders")


@build("describe_table", "SELECT column_name AS field FROM (DESCRIBE nation)")
def _describe_table(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in session(spark, sf_dir).execute("DESCRIBE nation")["fields"]], "field string")


@build("explain_strategy", "SELECT * FROM (VALUES ('FULLTEXT', 'body'), ('FULL_SCAN', NULL)) t(strategy, index)")
def _explain_strategy(spark, sf_dir):
    s = searching(spark, sf_dir)
    out = [s.execute(q) for q in ("EXPLAIN SELECT * FROM documents WHERE text @@ 'the'", "EXPLAIN SELECT * FROM documents")]
    return spark.createDataFrame([(x["strategy"], x["indexName"]) for x in out], "strategy string, index string")


@build("cross_database", "SELECT count(*) AS n FROM nation")
def _cross_database(spark, sf_dir):
    s = session(spark, sf_dir)
    s.database = "other"
    return s.query("SELECT count() AS n FROM main.nation")


@build("remote_scan", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def _remote_scan(spark, sf_dir):
    s = Session(spark).link("far", lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return s.query("SELECT n_name FROM far.nation WHERE n_regionkey = 3")


@build("fetch_after_order", "SELECT n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY n_name DESC LIMIT 7")
def _fetch_after_order(spark, sf_dir):
    return owned(spark, sf_dir).query("SELECT n_name, region.r_name AS region FROM nation ORDER BY n_name DESC LIMIT 7 FETCH region")


@build("param_record_source", "SELECT n_name FROM nation WHERE n_nationkey = 3")
def _param_record_source(spark, sf_dir):
    return owned(spark, sf_dir).query("SELECT n_name FROM $which", which="nation:3")


@build("remote_point", "SELECT n_name FROM nation WHERE n_nationkey = 3")
def _remote_point(spark, sf_dir):
    return Session(spark).link("far", lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), key="n_nationkey").query("SELECT n_name FROM far.nation:3")


def _with_strategy(s: Session, text: str) -> DataFrame:
    return s.query(text).withColumn("strategy", F.lit(s.execute(f"EXPLAIN {text}")["strategy"]))


@build("unique_lookup", "SELECT n_name, 'UNIQUE_LOOKUP' AS strategy FROM nation WHERE n_nationkey = 7")
def _unique_lookup(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("DEFINE INDEX k ON TABLE nation COLUMNS n_nationkey UNIQUE")
    return _with_strategy(s, "SELECT n_name FROM nation WHERE n_nationkey = 7")


@build("columnar_lookup", "SELECT o_orderkey, 'COLUMNAR' AS strategy FROM orders WHERE o_orderstatus = 'F'")
def _columnar_lookup(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("DEFINE INDEX c ON TABLE orders COLUMNS o_orderstatus COLUMNAR")
    return _with_strategy(s, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")


@build("audit_log", "SELECT * FROM (VALUES ('LET $a = 1', 'SAFE'), ('ERROR \"no\"', 'WARNING')) t(statement, verdict)")
def _audit_log(spark, sf_dir):
    s = Session(spark)
    s.execute("LET $a = 1")
    try:
        s.execute("ERROR 'no'")
    except ValueError:
        pass
    return s.query("SELECT statement, verdict FROM AUDIT_LOG")


@build("audit_cases", "SELECT 'WARNING' AS verdict")
def _audit_cases(spark, sf_dir):
    s = Session(spark)
    try:
        s.execute("LET $a = 1; ERROR 'no'")
    except ValueError:
        pass
    return s.query("SELECT verdict FROM AUDIT_CASES")


@build("audit_rules", "SELECT * FROM (VALUES ('DELETE t', 'DANGER'), ('UPDATE t SET n = 2', 'WARNING'), ('CREATE t:1 SET n = 1', 'SAFE')) t(statement, verdict)")
def _audit_rules(spark, sf_dir):
    """Rules that judge statements by their text; dangerous ones are not run."""
    s = Session(spark).judge(r"^update", "WARNING").judge(r"^delete \w+$", "DANGER")
    try:
        s.execute("CREATE t:1 SET n = 1; UPDATE t SET n = 2; DELETE t")
    except ValueError:
        pass
    assert s.rows("SELECT VALUE n FROM t") == [2]
    return s.query("SELECT statement, verdict FROM AUDIT_LOG WHERE statement CONTAINS 't SET' OR statement CONTAINS 't:1' OR statement = 'DELETE t'")


@build("dump_restore", "SELECT n_name, r_name AS region, ['region:' || n_regionkey] AS of FROM nation JOIN region ON r_regionkey = n_regionkey")
def _dump_restore(spark, sf_dir):
    s, path = owned(spark, sf_dir), new_path(spark, "dump")
    s.execute("DEFINE FIELD n_name ON TABLE nation TYPE string")
    s.register_edges(s.tables["nation"].rows().select(F.col("id").alias("src"), F.lit("lies").alias("kind"), F.col("region").alias("dst")), "lies")
    for table in set(s.tables) - {"nation", "region"}:
        del s.tables[table]
    dump(s, path)
    other = Session(spark)
    restore(other, path)
    return other.query("SELECT n_name, region.r_name AS region, ->lies->region AS of FROM nation FETCH region")


@build("client_verbs", "SELECT name, CAST(n AS BIGINT) AS n FROM (VALUES ('a', 1), ('b', 5), ('c', 9)) t(name, n)")
def _client_verbs(spark, sf_dir):
    c = Client(Session(spark))
    c.create("item:1", {"name": "a", "n": 1})
    c.insert("item", [{"id": "2", "name": "b", "n": 2}, {"id": "4", "name": "gone", "n": 4}])
    c.update("item:2", {"n": 5})
    c.upsert("item:3", {"name": "c", "n": 9})
    c.delete("item:4")
    return c.query("SELECT name, n FROM item")


@build("client_graphql", "SELECT n_name, n_regionkey FROM nation")
def _client_graphql(spark, sf_dir):
    return Client(session(spark, sf_dir)).graphql("{ nation { n_name n_regionkey } }")


@build("client_peek", "SELECT r_regionkey, r_name FROM region")
def _client_peek(spark, sf_dir):
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in Client(session(spark, sf_dir)).peek("region")], "r_regionkey int, r_name string")


@build("dbapi_cursor", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2")
def _dbapi_cursor(spark, sf_dir):
    cursor = connect(session(spark, sf_dir)).cursor().execute("SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = ?", (2,))
    return spark.createDataFrame(cursor.fetchall(), "n_name string, n_nationkey int")


@build("write_injection", "SELECT t, CAST(owner AS BIGINT) AS owner FROM (VALUES ('a', 7), ('b', 7)) t(t, owner)")
def _write_injection(spark, sf_dir):
    s = Session(spark)
    s.execute("CREATE DATA RULE own APPLY owner = 7")
    s.act_as(["own"]).execute("INSERT INTO note [{t: 'a', owner: 1}, {t: 'b', owner: 3}]")
    return s.act_as().query("SELECT t, owner FROM note")


@build("nested_set", "SELECT n_nationkey AS k, CAST(CASE WHEN n_regionkey = 1 THEN 5 ELSE n_nationkey END AS BIGINT) AS c, n_regionkey AS d FROM nation")
def _nested_set(spark, sf_dir):
    s = owned(spark, sf_dir)
    made = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("obj:"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("k"), F.struct(F.col("n_nationkey").alias("c"), F.col("n_regionkey").alias("d")).alias("b"))
    s.register("obj", made).execute("UPDATE obj SET b.c = 5 WHERE b.d = 1")
    return s.query("SELECT k, b.c AS c, b.d AS d FROM obj")


@build("set_coercion", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 12 ELSE n_nationkey END AS n_nationkey FROM nation")
def _set_coercion(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("UPDATE nation SET n_nationkey = '12' WHERE region = 'region:1'")
    return s.query("SELECT n_name, n_nationkey FROM nation")


@build("relate_hop", "SELECT n_name, CASE n_nationkey WHEN 1 THEN ['nation:2', 'nation:3'] WHEN 2 THEN ['nation:3'] ELSE [] :: VARCHAR[] END AS to, CAST(CASE WHEN n_nationkey = 3 THEN 2 WHEN n_nationkey = 2 THEN 1 ELSE 0 END AS BIGINT) AS came FROM nation")
def _relate_hop(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("RELATE nation:1->sells->nation:2 SET since = 2001; RELATE nation:1->sells->nation:3; RELATE nation:2->sells->nation:3")
    return s.query("SELECT n_name, ->sells->nation AS to, array::len(<-sells<-nation) AS came FROM nation")


@build("return_before", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1")
def _return_before(spark, sf_dir):
    return owned(spark, sf_dir).execute("UPDATE nation SET n_nationkey = 0 WHERE region = 'region:1' RETURN BEFORE").select("n_name", "n_nationkey")


@build("return_after", "SELECT n_name, CAST(n_nationkey + 100 AS BIGINT) AS a, CAST(n_nationkey + 200 AS BIGINT) AS b FROM nation WHERE n_regionkey = 1")
def _return_after(spark, sf_dir):
    """AFTER, as which DIFF and expressions count too."""
    s = owned(spark, sf_dir)
    a = s.execute("UPDATE nation SET n_nationkey = n_nationkey + 100 WHERE region = 'region:1' RETURN DIFF").select("n_name", F.col("n_nationkey").alias("a"))
    b = s.execute("UPDATE nation SET n_nationkey = n_nationkey + 100 WHERE region = 'region:1' RETURN n_name").select("n_name", F.col("n_nationkey").alias("b"))
    return a.join(b, "n_name")


@build("event_trigger", "SELECT CAST(n_nationkey + 100 AS BIGINT) AS now, CAST(n_nationkey AS BIGINT) AS was, 'UPDATE' AS what FROM nation WHERE n_regionkey = 2")
def _event_trigger(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("DEFINE EVENT e ON TABLE nation WHEN $event = 'UPDATE' THEN (CREATE log SET now = $after.n_nationkey, was = $before.n_nationkey, what = $event)")
    s.execute("UPDATE nation SET n_nationkey = n_nationkey + 100 WHERE region = 'region:2'")
    return s.query("SELECT now, was, what FROM log")


@build("insert_subquery", "SELECT n_name AS name FROM nation WHERE n_regionkey = 3")
def _insert_subquery(spark, sf_dir):
    s = owned(spark, sf_dir)
    s.execute("INSERT INTO copy (SELECT n_name AS name FROM nation WHERE region = 'region:3')")
    return s.query("SELECT name FROM copy")


@build("many_updates", "SELECT n_name, CAST(n_nationkey + 12 AS BIGINT) AS n FROM nation")
def _many_updates(spark, sf_dir):
    s = owned(spark, sf_dir)
    for _ in range(12):
        s.execute("UPDATE nation SET n_nationkey = n_nationkey + 1")
    return s.query("SELECT n_name, n_nationkey AS n FROM nation")


# ---------------------------------------------------------------- versions, keys, live queries
_log = "(SELECT user_id AS key, ts, event_id, CASE WHEN event_id % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op, value FROM events)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_id") % 7 == 0, "DELETE").otherwise("UPDATE")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "ts", "event_id", op.alias("op"), "value")


@build("time_travel_at", f"SELECT key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM {_log} WHERE ts <= TIMESTAMP '2024-01-10') WHERE n = 1 AND op <> 'DELETE'")
def _time_travel_at(spark, sf_dir):
    return timetravel.as_of(change_log(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"), tie="event_id").select("key", "event_id", "value")


@build("time_travel_versions", "SELECT (SELECT count(*) FROM region) AS before, (SELECT count(*) FROM region) - 1 AS after")
def _time_travel_versions(spark, sf_dir):
    import time

    s = owned(spark, sf_dir)
    moment = int(time.time() * 1000) - 1
    s.execute("DELETE region:1")
    before = s.query(f"SELECT count() AS before FROM region BEFORE (TIMESTAMP => {moment})")
    return before.crossJoin(F.broadcast(s.query("SELECT count() AS after FROM region")))


@build("kv_scan", "SELECT 'user:' || user_id || ':' || event_id AS key, value FROM events WHERE prefix('user:' || user_id || ':' || event_id, 'user:1') AND (event_id % 3 <> 0)")
def _kv_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    expires = F.when(F.col("event_id") % 3 == 0, F.lit("2000-01-01").cast("timestamp"))
    entries = df.select(F.concat(F.lit("user:"), "user_id", F.lit(":"), "event_id").alias("key"), "value", expires.alias("expires_at"))
    return scan_table(entries, "user:1").select("key", "value")


@build("live_replay", "SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'DELETE' ELSE 'CREATE' END AS action, value FROM events WHERE value > 50")
def _live_replay(spark, sf_dir):
    """The live operator over a whole change log at once: the same plan as over its stream."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_id") % 5 == 0
    image = F.to_json(F.struct("user_id", "value"))
    log = df.select(F.col("event_id").alias("seq"), F.when(gone, "DELETE").otherwise("CREATE").alias("action"), F.col("user_id").cast("string").alias("id"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"))
    kind = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    return changes(log, kind, lambda d: F.col("value") > 50, lambda d: [F.col("value")]).select("seq", "action", "value")


@build("live_stream", "SELECT action, v FROM (VALUES ('CREATE', 31), ('UPDATE', 32), ('DELETE', 32)) t(action, v)")
def _live_stream(spark, sf_dir):
    """A live query over Structured Streaming, drained."""
    s = Session(spark)
    sub = s.live("LIVE SELECT age FROM person WHERE age > 18")
    s.execute("CREATE person:1 SET age = 31; UPDATE person:1 SET age = 32; CREATE person:2 SET age = 3; DELETE person:1")
    got = sub.drain()
    sub.stop()
    return stored(spark.createDataFrame([(x["action"], int(x["result"]["age"])) for x in got], "action string, v int"), "live")


@build("live_diff", "SELECT * FROM (VALUES ('UPDATE', 'replace', '/age', 32), ('UPDATE', 'add', '/rank', 1)) t(action, op, path, v)")
def _live_diff(spark, sf_dir):
    s = Session(spark)
    s.execute("CREATE person:1 SET age = 31")
    sub = s.live("LIVE SELECT * FROM person DIFF")
    s.execute("UPDATE person:1 SET age = 32; UPDATE person:1 SET rank = 1")
    got = [(x["action"], p["op"], p["path"], int(p["value"])) for x in sub.drain() for p in x["patch"]]
    sub.stop()
    return stored(spark.createDataFrame(got, "action string, op string, path string, v int"), "live")


@build("live_held", "SELECT 0 AS before, 1 AS after, 0 AS cancelled")
def _live_held(spark, sf_dir):
    """Changes of a transaction are told when it commits, not at all when it is cancelled."""
    s = Session(spark)
    sub = s.live("LIVE SELECT * FROM person")
    s.execute("BEGIN; CREATE person:1 SET age = 31")
    before = len(sub.drain())
    s.execute("COMMIT")
    after = len(sub.drain())
    s.execute("BEGIN; CREATE person:2 SET age = 5; CANCEL")
    out = (before, after, len(sub.drain()) - after)
    sub.stop()
    return spark.createDataFrame([out], "before int, after int, cancelled int")


@build("live_kill", "SELECT 1 AS told, true AS killed, false AS again")
def _live_kill(spark, sf_dir):
    s = Session(spark)
    sub = s.live("LIVE SELECT * FROM person")
    s.execute("CREATE person:1 SET age = 31")
    sub.drain()
    killed = s.execute(f"KILL '{sub.id}'")
    s.execute("CREATE person:2 SET age = 32")
    return spark.createDataFrame([(len(sub.received), bool(killed), bool(s.execute(f"KILL '{sub.id}'")))], "told int, killed boolean, again boolean")


@build("live_refused", "SELECT * FROM (VALUES ('LIMIT'), ('ORDER'), ('GROUP'), ('FETCH')) t(clause)")
def _live_refused(spark, sf_dir):
    """Clauses that a live query may not have."""
    s, refused = Session(spark), []
    for clause, text in (("LIMIT", "LIMIT 1"), ("ORDER", "ORDER BY age"), ("GROUP", "GROUP BY age"), ("FETCH", "FETCH age")):
        try:
            s.live(f"LIVE SELECT age FROM person {text}").stop()
        except ValueError:
            refused.append((clause,))
    return spark.createDataFrame(refused, "clause string")


@build("kv_functions", "SELECT 5 AS got, 2 AS found, true AS gone, 1 AS left")
def _kv_functions(spark, sf_dir):
    s = Session(spark)
    s.execute("LET $a = kv::set('s1', 5); LET $b = kv::set('s2', 6); LET $c = kv::set('t', 7)")
    got, found, gone, left = (s.execute(f"RETURN {x}") for x in ("kv::get('s1')", "array::len(kv::scan('s'))", "kv::del('s2')", "array::len(kv::scan('s'))"))
    return spark.createDataFrame([(int(got), int(found), bool(gone), int(left))], "got int, found int, gone boolean, left int")


@build("window_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2")
def _window_events(spark, sf_dir):
    """Extension: event-time windows under a watermark, batch and stream alike."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withWatermark("ts", "1 hour")
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: r.run for k, r in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: r.sql for k, r in REGISTERED.items() if r.sql is not None}
