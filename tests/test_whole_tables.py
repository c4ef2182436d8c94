"""Queries over whole tables: no row is left out, however large its key."""

import re

import duckdb
import pytest

from brontide.plans import core, functions

from tests.oracle import compare

@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in ("lineitem", "orders", "customer"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


def test_every_scalar_function_reads_the_whole_table(spark, sf_dir, duck):
    names = [n for n, sql in functions.c.oracles.items() if ") SELECT line_no, " in sql and n[0] in "FR"]
    assert len(names) == 40
    (n,) = duck.execute("SELECT count(*) FROM lineitem").fetchone()
    for name in names:
        assert "WHERE" not in functions.c.oracles[name].rpartition("FROM lines")[2]
        assert functions.c.queries[name](spark, sf_dir).count() == n, name


def test_no_query_selects_by_id():
    for name, sql in (core.c.oracles | functions.c.oracles).items():
        assert not re.search(r"(WHERE|AND|OR) \(?(order_no|line_no|[a-z]_(order|cust|part|supp)key) *(<|>|%|BETWEEN|IN \()", sql.partition("FROM lineitem) ")[2] or sql) or name in BY_KEY, name


#: Queries whose feature is the key look-up, or a comparison operator itself.
BY_KEY = ("S07_key_lookup", "P05_comparisons", "F01_int4_compare", "F03_int8_compare")


def test_whole_table_counts(spark, sf_dir, duck):
    (n,) = duck.execute("SELECT count(*) FROM lineitem").fetchone()
    q = core.c.queries
    assert [r.r for r in q["O11_sort_below_window"](spark, sf_dir).orderBy("r").select("r").collect()] == list(range(1, n + 1))
    assert sum(r.s.count(",") + 1 for r in q["A14_string_agg"](spark, sf_dir).collect()) == n
    assert "SinglePartition" not in q["O11_sort_below_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert q["U05_except"](spark, sf_dir).count() > 0


def test_numbering_of_ties_and_of_no_rows(spark):
    from brontide import operators as ops

    rows = spark.createDataFrame([(i % 5,) for i in range(40)], "k long")
    got = sorted((r.k, r.r) for r in ops.numbered(rows, "k", "r").collect())
    assert got == [(i // 8, i + 1) for i in range(40)]
    assert ops.numbered(rows.where("false"), "k", "r").collect() == []


def test_outer_semi_and_anti_joins_keep_every_row(spark, sf_dir, duck):
    q, o = core.c.queries, core.c.oracles
    for name in ("J02_left", "J03_right", "J04_full", "J05_semi", "J07_right_anti", "J24_exists_or"):
        assert "%" not in o[name] and "o_orderkey <" not in o[name] and "c_custkey <" not in o[name]
        assert compare(q[name](spark, sf_dir), duck, o[name]) == "", name
    (orders, customers) = duck.execute("SELECT (SELECT count(*) FROM orders), (SELECT count(*) FROM customer)").fetchone()
    full = q["J04_full"](spark, sf_dir)
    assert full.select("o_orderkey").distinct().where("o_orderkey IS NOT NULL").count() == orders
    assert full.select("c_custkey").distinct().where("c_custkey IS NOT NULL").count() == customers
    assert q["J02_left"](spark, sf_dir).where("o_orderkey IS NULL").count() > 0
    assert q["J03_right"](spark, sf_dir).count() == orders
    assert q["J05_semi"](spark, sf_dir).count() + q["J07_right_anti"](spark, sf_dir).count() == customers
