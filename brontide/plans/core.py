"""Scans, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brontide import functions as pg
from brontide import operators as ops
from brontide import sources
from brontide.plans import Catalogue

c = Catalogue()
add, conditions = c.add, c.conditions
big = lambda x: F.sum(x).cast("bigint")

# Scans, sources
add("S01_full_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"))
add("S02_pruned_columns", "SELECT sum(l_linenumber)::BIGINT AS s FROM lineitem", lambda t: t.lineitem.agg(big("l_linenumber").alias("s")))
add("S03_bitmap_and_or", "SELECT o_orderkey FROM orders WHERE (o_totalprice < 20000 OR o_totalprice > 300000) AND o_orderstatus = 'F'", lambda t: t.orders.where("(o_totalprice < 20000 OR o_totalprice > 300000) AND o_orderstatus = 'F'").select("o_orderkey"))
add("S04_range_skipping", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1994-03-01' AND TIMESTAMP '1994-04-15'", lambda t: t.lineitem.where("l_shipdate BETWEEN TIMESTAMP_NTZ '1994-03-01 00:00:00' AND TIMESTAMP_NTZ '1994-04-15 00:00:00'").agg(F.count("*").alias("n")))
add("S05_ordered_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC", lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")))
add("S06_key_only_scan", "SELECT count(o_orderkey) AS n, max(o_orderkey) AS m FROM orders", lambda t: t.orders.agg(F.count("o_orderkey").alias("n"), F.max("o_orderkey").alias("m")))
add("S07_key_lookup", "SELECT * FROM customer WHERE c_custkey IN (1, 7, 77, 100)", lambda t: sources.lookup(t.customer, "c_custkey", [1, 7, 77, 100]))
add("S08_parallel_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")))
add("S09_subquery_rows", "SELECT v * 2 AS v FROM (VALUES (1), (2), (3)) AS x(v)", lambda t: t.spark.sql("SELECT v * 2 AS v FROM VALUES (1), (2), (3) AS x(v)"))
add("S10_rows_out", "SELECT r_regionkey, r_name FROM region", lambda t: t.region.select("r_regionkey", "r_name"))
add("S11_append", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier", lambda t: sources.append(t.customer.selectExpr("c_custkey AS k", "c_name AS name"), t.supplier.selectExpr("s_name AS name", "s_suppkey AS k")))
add("S12_named_source", "SELECT n_name FROM nation", lambda t: sources.named(t.spark, "parquet folder", folder=t.dir, table="nation").select("n_name"))
add("S13_from_arrow", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS x(k, s)", lambda t: sources.from_arrow(t.spark, __import__("pyarrow").table({"k": __import__("pyarrow").array([1, 2, None], "int32"), "s": ["a", None, "c"]})))
add("S15_bounds", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000.5 AND o_orderdate < TIMESTAMP '1995-01-01'", lambda t: t.orders.where("o_totalprice > 1000.5 AND o_orderdate < TIMESTAMP_NTZ '1995-01-01'").agg(F.count("*").alias("n")))
add("S16_sample", "SELECT true AS within, true AS part_of", lambda t: t.sql("SELECT (SELECT count(*) FROM {lineitem} TABLESAMPLE (30 PERCENT) REPEATABLE (5)) BETWEEN 0.27 * count(*) AND 0.33 * count(*) AS within, (SELECT count(*) FROM {lineitem} TABLESAMPLE (30 PERCENT) REPEATABLE (5) s LEFT ANTI JOIN {lineitem} l ON s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber) = 0 AS part_of FROM {lineitem}"))
add("S14_to_arrow", "SELECT n_nationkey, n_name FROM nation", lambda t: sources.from_arrow(t.spark, sources.to_arrow(t.nation.select("n_nationkey", "n_name"))))
add("S19_insert_select", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS s FROM orders GROUP BY 1", lambda t: sources.saved(t.orders, "inserted", partition_by=["o_orderstatus"], sort_by=["o_orderdate"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), pg.exact_sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("s")))
add("S20_cursor", "SELECT n_nationkey AS k FROM nation ORDER BY 1", lambda t: t.spark.createDataFrame([(r.n_nationkey,) for r in sources.cursor(t.nation.orderBy("n_nationkey"))], "k int"))
add("S20_scroll", "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS place FROM customer QUALIFY place BETWEEN 41 AND 60", lambda t: ops.numbered(t.customer.selectExpr("c_custkey AS k"), "k", "place").where("place BETWEEN 41 AND 60"))
add("S17_series", "SELECT g AS k, g * g AS sq FROM range(1, 51) AS x(g)", lambda t: t.spark.range(1, 51).selectExpr("id AS k", "id * id AS sq"))
add("S17_unnest", "SELECT unnest([3, 1, 2]) AS v", lambda t: t.spark.sql("SELECT explode(array(3, 1, 2)) AS v"))
add("S18_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT a.o_custkey, a.n FROM big a WHERE a.n = (SELECT max(n) FROM big)", lambda t: t.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) SELECT a.o_custkey, a.n FROM big a WHERE a.n = (SELECT max(n) FROM big)"))
add("S21_parameters", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'", lambda t: sources.sql(t.spark, t.dir, "SELECT count(*) AS n FROM {orders} WHERE o_totalprice > :p AND o_orderstatus = :s", {"p": 150000, "s": "O"}))

# Projection and filter
add("P01_projection", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS odd, (l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS net FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2 + 1).alias("odd"), F.expr("cast(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(4,2))) AS double)").alias("net")))
add("P02_expressions", "SELECT line_no, (order_no * 5 - shelf) % 11 AS r, abs(shelf - 60) AS a FROM lines", lambda t: t.lines.selectExpr("line_no", "(order_no * 5 - shelf) % 11 AS r", "abs(shelf - 60) AS a"))
conditions("P03_filter", "price > 25000 AND qty < 40 AND ship_day >= DATE '1995-07-01'", "shelf + grade > 90")
conditions("P04_row_wise", ("maker ILIKE 'MAKER-3%' AND qty > 25", "maker ILIKE 'MAKER-3%' AND qty > 25"), ("part_label RLIKE 'part [0-9]{2}$'", "regexp_matches(part_label, 'part [0-9]{2}$')"))
conditions("P05_comparisons", "qty > 17", "line_no >= 40000", "shelf = 77", "17 < grade + shelf", "grade <> shelf % 13", "shelf <= order_no % 120", "price > 31250.75", "qty < price / 1000", "money > 18000.49", "maker = 'maker-7'", "maker <> 'maker-7'")
conditions("P06_and_or_not", "(qty > 45 OR shelf < 6) AND NOT bulky", "NOT (grade > 8 OR bulky)", "NOT (grade > 8 AND qty > 11)")
conditions("P07_is_null", "grade IS NULL", "grade IS NOT NULL")
conditions("P08_is_true", "(grade < 6) IS TRUE", "(grade < 6) IS NOT TRUE", "(grade < 6) IS FALSE", "(grade < 6) IS NOT FALSE", ("(grade < 6) IS UNKNOWN", "(grade < 6) IS NULL"), ("(grade < 6) IS NOT UNKNOWN", "(grade < 6) IS NOT NULL"))
conditions("P09_is_distinct", "grade IS NOT DISTINCT FROM 9", "grade IS DISTINCT FROM 9", "grade IS NOT DISTINCT FROM NULL")
conditions("P10_between", "qty BETWEEN 12 AND 19", "money BETWEEN 5000 AND 15000.5", "grade NOT BETWEEN 4 AND 9", "ship_day BETWEEN DATE '1993-04-01' AND DATE '1994-02-28'")
conditions("P11_in_numbers", "shelf IN (3, 30, 111)", "shelf NOT IN (3, 30, 111)", "grade IN (6, 7, NULL)", "grade NOT IN (6, 7, NULL)", f"shelf IN ({', '.join(map(str, range(0, 120, 2)))})", "ship_day IN (DATE '1994-10-31', DATE '1996-02-29')")
conditions("P12_in_other", "maker IN ('maker-11', 'maker-29', 'nobody')", "money NOT IN (901.00, 1802.5)", ("exists(array(9, 44), x -> shelf > x)", "shelf > 9 OR shelf > 44"), ("forall(array(9, 44), x -> shelf > x)", "shelf > 9 AND shelf > 44"))
conditions("P13_boolean_column", "bulky", "NOT bulky", "bulky = (qty > 30)")
conditions("P14_case", "CASE WHEN qty > 44 THEN 'full' ELSE 'part' END = 'full'", "CASE grade WHEN 11 THEN 'high' WHEN 12 THEN 'top' END = 'top'", "CASE WHEN shelf > 0 THEN 360 / shelf >= 30 ELSE false END")
conditions("P15_coalesce_nullif", "coalesce(grade, shelf) > 100", "nullif(grade, 8) < 5", "coalesce(nullif(shelf, 40), grade) = 10")
conditions("P16_greatest_least", "greatest(shelf, grade) < 9", "least(grade, 10) = 10", "greatest(grade, 6) = 6")
add("P17_scalar_subquery", "SELECT r_name, (SELECT count(*) FROM nation) AS nations FROM region", lambda t: t.sql("SELECT r_name, (SELECT count(*) FROM {nation}) AS nations FROM {region}"))
add("P17_initplan", "SELECT count(*) AS n FROM lines WHERE qty > (SELECT avg(qty) FROM lines)", lambda t: t.sql("SELECT count(*) AS n FROM {lines} WHERE qty > (SELECT avg(qty) FROM {lines})"))
add("P18_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)", lambda t: t.sql("SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(p.o_totalprice) FROM {orders} p WHERE p.o_custkey = o.o_custkey)"))
conditions("P19_stable", ("ship_day > current_date() - INTERVAL 20000 DAYS", "ship_day > current_date - 20000"), ("shipped < localtimestamp()", "shipped < now()::TIMESTAMP"))
add("P20_volatile", "SELECT true AS varies, true AS within", lambda t: t.lines.select(F.rand(3).alias("x")).agg((F.count_distinct("x") > F.count("*") * 0.9).alias("varies"), (F.avg("x").between(0.4, 0.6)).alias("within")))
add("P21_having", "SELECT shelf, sum(order_no)::BIGINT AS s FROM lines GROUP BY 1 HAVING max(qty) > 49", lambda t: t.lines.groupBy("shelf").agg(F.sum("order_no").alias("s"), F.max("qty").alias("_m")).where("_m > 49").drop("_m"))
conditions("P22_guarded", ("CASE WHEN shelf <> 0 THEN 120 % shelf = 0 ELSE false END", "shelf <> 0 AND 120 % shelf = 0"))
conditions("P23_mixed_widths", "shelf + order_no > 900", "line_no - shelf > order_no * 15", "shelf < line_no")

# Joins
J = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"
add("J00_hash_join", J, lambda t: t.orders.join(ops.small(t.customer), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))
add("J01_inner_keys", "SELECT count(*) AS n, sum(a.l_linenumber)::BIGINT AS s FROM lineitem a JOIN lineitem r ON a.l_orderkey = r.l_orderkey AND a.l_linenumber = r.l_linenumber AND a.l_suppkey = r.l_suppkey", lambda t: t.lineitem.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_suppkey"]).agg(F.count("*").alias("n"), big("l_linenumber").alias("s")))
CO = "customer LEFT JOIN orders ON c_custkey = o_custkey"
# Columns and windows need a session, so they are made when a query is built.
on = lambda: F.col("c_custkey") == F.col("o_custkey")
add("J05_in_subquery", "SELECT count(*) AS n FROM lines WHERE maker IN (SELECT maker FROM lines WHERE qty = 50 AND shelf < 30)", lambda t: t.sql("SELECT count(*) AS n FROM {lines} WHERE maker IN (SELECT maker FROM {lines} WHERE qty = 50 AND shelf < 30)"))
add("J06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda t: t.customer.join(t.orders, on(), "left_anti").select("c_custkey"))
add("J08_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 500)", lambda t: ops.not_in(t.nation, "n_nationkey", t.supplier.where("s_acctbal < 500"), "s_nationkey").select("n_nationkey"))
add("J08_not_in_empty", "SELECT n_nationkey FROM nation WHERE nullif(n_nationkey, 4) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -1e9) ", lambda t: ops.not_in(t.nation.withColumn("k", F.expr("nullif(n_nationkey, 4)")), "k", t.supplier.where("s_acctbal < -1e9"), "s_nationkey").select("n_nationkey"))
add("J08_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)", lambda t: ops.not_in(t.nation, "n_nationkey", t.supplier.selectExpr("nullif(s_nationkey, 3) AS k"), "k").select("n_nationkey"))
add("J09_right_semi", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)", lambda t: t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_name"))
# Keys are counted on each side before the join, so a hot key is one row of each.
pairs = lambda t, key: t.lines.groupBy(key).agg(F.count("*").alias("x")).join(t.lines.groupBy(key).agg(F.count("*").alias("y")), key)
for key in ("part_label", "lane", "money", "price", "ship_day"):
    add(f"J10_key_{key}", f"SELECT count(*) AS c FROM lines a JOIN lines r ON a.{key} = r.{key}", lambda t, key=key: pairs(t, key).agg(F.sum(F.expr("x * y")).alias("c")))
add("J11_expression_keys", "SELECT count(*) AS c FROM lines a JOIN lines r ON a.order_no = r.order_no + 1 AND lower(a.lane) = lower(r.lane)", lambda t: t.lines.alias("a").join(t.lines.alias("r"), F.expr("a.order_no = r.order_no + 1 AND lower(a.lane) = lower(r.lane)")).agg(F.count("*").alias("c")))
add("J12_residual", "SELECT count(*) AS c FROM lines a JOIN lines r ON a.order_no = r.order_no AND a.shelf < r.shelf AND a.price + r.price > 60000", lambda t: t.lines.alias("a").join(t.lines.alias("r"), F.expr("a.order_no = r.order_no AND a.shelf < r.shelf AND a.price + r.price > 60000")).agg(F.count("*").alias("c")))
add("J12_left_residual", "SELECT count(*) AS c, count(r.order_no) AS m FROM lines a LEFT JOIN lines r ON a.order_no = r.order_no AND r.bulky AND a.shelf < r.shelf", lambda t: t.lines.alias("a").join(t.lines.alias("r"), F.expr("a.order_no = r.order_no AND r.bulky AND a.shelf < r.shelf"), "left").agg(F.count("*").alias("c"), F.count("r.order_no").alias("m")))
add("J13_outer_filter", f"SELECT c_custkey FROM {CO} WHERE o_orderkey IS NULL OR o_totalprice > 300000", lambda t: t.customer.join(t.orders, on(), "left").where("o_orderkey IS NULL OR o_totalprice > 300000").select("c_custkey"))
add("J14_chain", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", lambda t: t.lineitem.select("l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, on()).join(ops.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(ops.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")))
add("J15_duplicate_keys", "SELECT a.shelf, count(*) AS c FROM lines a JOIN lines r ON a.shelf = r.shelf GROUP BY 1", lambda t: pairs(t, "shelf").selectExpr("shelf", "x * y AS c"))
add("J16_skewed_key", "SELECT count(*) AS c, sum(line_no)::BIGINT AS s FROM (SELECT CASE WHEN bulky THEN 1 ELSE order_no END AS k, line_no FROM lines) a JOIN (SELECT DISTINCT order_no AS k FROM lines) r USING (k)", lambda t: ops.salted_join(t.lines.selectExpr("CASE WHEN bulky THEN 1 ELSE order_no END AS k", "line_no"), t.lines.selectExpr("order_no AS k").distinct(), "k", 16).agg(F.count("*").alias("c"), big("line_no").alias("s")))
LOOK = "(SELECT * FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')"
look = lambda t, how: t.lineitem.where("l_quantity = 50 AND l_returnflag = 'R'").join(t.part.where("p_size < 30"), F.col("l_partkey") == F.col("p_partkey"), how)
add("J17_lookup_inner", f"SELECT l_orderkey, l_linenumber, p_name FROM {LOOK} JOIN part ON l_partkey = p_partkey WHERE p_size < 30", lambda t: look(t, "inner").select("l_orderkey", "l_linenumber", "p_name"))
add("J17_lookup_left", f"SELECT l_orderkey, l_linenumber, p_name FROM {LOOK} LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON l_partkey = p_partkey", lambda t: look(t, "left").select("l_orderkey", "l_linenumber", "p_name"))
add("J17_lookup_semi", f"SELECT l_orderkey, l_linenumber FROM {LOOK} WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 30)", lambda t: look(t, "left_semi").select("l_orderkey", "l_linenumber"))
add("J17_lookup_anti", f"SELECT l_orderkey, l_linenumber FROM {LOOK} WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 30)", lambda t: look(t, "left_anti").select("l_orderkey", "l_linenumber"))
add("J18_key_filter", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_totalprice > 250000", lambda t: t.lineitem.join(t.orders.where("o_orderstatus = 'P' AND o_totalprice > 250000"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("n")))
add("J19_pruning_join", "SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders WHERE o_orderpriority IN (SELECT min(o_orderpriority) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1", lambda t: sources.saved(t.orders, "by-priority", partition_by=["o_orderpriority"]).join(t.orders.where("o_orderstatus = 'F'").agg(F.min("o_orderpriority").alias("o_orderpriority")), "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"), big("o_custkey").alias("s")))
add("J20_parallel_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", lambda t: t.orders.join(t.customer.hint("shuffle_hash"), on()).groupBy("c_mktsegment").agg(F.count("*").alias("n")))
add("J21_merge_join", J, lambda t: t.orders.join(t.customer.hint("merge"), on()).select("o_orderkey", "c_name"))
add("J22_theta", "SELECT a.n_nationkey AS a, r.n_nationkey AS z FROM nation a JOIN nation r ON a.n_nationkey < r.n_nationkey", lambda t: t.nation.selectExpr("n_nationkey AS a").join(ops.small(t.nation.selectExpr("n_nationkey AS z")), F.col("a") < F.col("z")))
add("J22_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", lambda t: t.region.select("r_name").crossJoin(ops.small(t.nation.select("n_name"))))
add("J23_lateral", "SELECT c_custkey, o.n, o.m FROM customer, LATERAL (SELECT count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_custkey = c_custkey) o", lambda t: t.sql("SELECT c_custkey, o.n, o.m FROM {customer} c, LATERAL (SELECT count(*) AS n, max(o_orderkey) AS m FROM {orders} WHERE o_custkey = c.c_custkey) o"))
# Rows without a partner come of the order's status and the customer's balance.
partly = lambda t: t.orders.where("o_orderstatus = 'P'")
P = "(SELECT * FROM orders WHERE o_orderstatus = 'P')"
add("J02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", lambda t: t.customer.join(t.orders, on() & F.expr("o_orderstatus = 'P'"), "left").select("c_custkey", "o_orderkey"))
add("J03_right", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0", lambda t: t.customer.join(t.orders, on() & F.expr("c_acctbal > 0"), "right").select("c_custkey", "o_orderkey"))
add("J04_full", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0 AND o_orderstatus = 'P'", lambda t: t.customer.join(t.orders, on() & F.expr("c_acctbal > 0 AND o_orderstatus = 'P'"), "full").select("c_custkey", "o_orderkey"))
add("J05_semi", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {P} WHERE o_custkey = c_custkey)", lambda t: t.customer.join(partly(t), on(), "left_semi").select("c_custkey"))
add("J07_right_anti", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {P} WHERE o_custkey = c_custkey)", lambda t: ops.right_anti(t.customer, partly(t), on()).select("c_custkey"))
add("J24_exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", lambda t: t.sql("SELECT c_custkey FROM {customer} WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"))
add("J26_self_using", "SELECT n_regionkey, count(*) AS c FROM nation a JOIN nation r USING (n_regionkey) GROUP BY 1", lambda t: t.nation.select("n_regionkey").join(t.nation.select("n_regionkey"), "n_regionkey").groupBy("n_regionkey").agg(F.count("*").alias("c")))

# Aggregates
add("A00_plain", "SELECT count(*) AS n, sum(order_no)::BIGINT AS s, avg(order_no) AS a, min(order_no) AS lo, max(order_no) AS hi FROM lines", lambda t: t.lines.agg(F.count("*").alias("n"), big("order_no").alias("s"), F.avg("order_no").alias("a"), F.min("order_no").alias("lo"), F.max("order_no").alias("hi")))
add("A00_empty", "SELECT count(*) AS n, sum(order_no)::BIGINT AS s, max(part_label) AS m FROM lines WHERE false", lambda t: t.lines.where("false").agg(F.count("*").alias("n"), big("order_no").alias("s"), F.max("part_label").alias("m")))
keys16 = [f"(order_no + {k}) % 3" for k in range(16)]
add("A01_sixteen_keys", "SELECT " + ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys16)) + ", count(*) AS n FROM lines GROUP BY " + ", ".join(map(str, range(1, 17))), lambda t: t.lines.groupBy(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(keys16))).agg(F.count("*").alias("n")))
for name, key in (("A02_int", "shelf"), ("A02_date", "ship_day"), ("A02_bool", "bulky"), ("A02_timestamp", "shipped"), ("A02_null", "grade"), ("A03_text", "maker"), ("A03_numeric", "money"), ("A03_float", "qty"), ("A03_char", "lane")):
    add(f"{name}_keys", f"SELECT {key} AS k, count(*) AS c, sum(line_no)::BIGINT AS s FROM lines GROUP BY 1", lambda t, key=key: t.lines.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c"), pg.sum_bigint("line_no").cast("bigint").alias("s")))
add("A04_expression_keys", "SELECT order_no % 10 AS a, substring(part_label, 1, 6) AS s, extract(year FROM ship_day) AS y, count(*) AS n FROM lines GROUP BY 1, 2, 3", lambda t: t.lines.groupBy(F.expr("order_no % 10").alias("a"), pg.substring("part_label", 1, 6).alias("s"), pg.extract("year", "ship_day").alias("y")).agg(F.count("*").alias("n")))
add("A05_counts", "SELECT shelf, count(*) AS n, count(grade) AS m FROM lines GROUP BY 1", lambda t: t.lines.groupBy("shelf").agg(F.count("*").alias("n"), F.count("grade").alias("m")))
add("A06_sum_int", "SELECT sum(shelf)::BIGINT AS a, sum(order_no)::BIGINT AS bb, sum(grade)::BIGINT AS c FROM lines", lambda t: t.lines.agg(big("shelf").alias("a"), big("order_no").alias("bb"), big("grade").alias("c")))
add("A07_sum_bigint", "SELECT CAST(sum(line_no * 100000000) AS VARCHAR) AS s FROM lines", lambda t: t.lines.agg(pg.sum_bigint(F.expr("line_no * 100000000")).cast("string").alias("s")))
add("A08_numeric", "SELECT bulky, sum(money)::DOUBLE AS s, sum(money)::DOUBLE / count(money) AS a FROM lines GROUP BY 1", lambda t: t.lines.groupBy("bulky").agg(pg.exact_sum("money").alias("s"), pg.avg_exact("money").alias("a")))
add("A09_avg_int", "SELECT shelf, avg(order_no) AS a, avg(grade) AS m FROM lines GROUP BY 1", lambda t: t.lines.groupBy("shelf").agg(F.avg("order_no").alias("a"), F.avg("grade").alias("m")))
add("A10_float", "SELECT round(sum(price), 0) AS s, round(avg(price), 3) AS a, min(qty) AS lo, max(price) AS hi FROM lines", lambda t: t.lines.agg(F.round(F.sum("price"), 0).alias("s"), F.round(F.avg("price"), 3).alias("a"), F.min("qty").alias("lo"), F.max("price").alias("hi")))
add("A11_min_max_int", "SELECT maker, min(order_no) AS a, max(line_no) AS bb, min(grade) AS c FROM lines GROUP BY 1", lambda t: t.lines.groupBy("maker").agg(F.min("order_no").alias("a"), F.max("line_no").alias("bb"), F.min("grade").alias("c")))
add("A12_min_max_numeric", "SELECT maker, min(money)::DOUBLE AS a, max(money)::DOUBLE AS bb FROM lines GROUP BY 1", lambda t: t.lines.groupBy("maker").agg(F.min("money").cast("double").alias("a"), F.max("money").cast("double").alias("bb")))
add("A13_min_max_ordered", "SELECT min(part_label) AS a, max(part_label) AS bb, min(ship_day) AS c, max(shipped) AS e FROM lines", lambda t: t.lines.agg(F.min("part_label").alias("a"), F.max("part_label").alias("bb"), F.min("ship_day").alias("c"), F.max("shipped").alias("e")))
add("A14_generic", "SELECT shelf, bool_and(bulky) AS a, bool_or(bulky) AS o, bit_or(order_no) AS bits, round(stddev(order_no), 6) AS sd, round(variance(order_no), 3) AS v, round(var_pop(order_no), 3) AS vp, round(corr(order_no, shelf + order_no % 7), 6) AS c FROM lines GROUP BY 1 HAVING count(*) > 2", lambda t: t.lines.groupBy("shelf").agg(F.bool_and("bulky").alias("a"), F.bool_or("bulky").alias("o"), F.bit_or("order_no").alias("bits"), F.round(F.stddev("order_no"), 6).alias("sd"), F.round(F.variance("order_no"), 3).alias("v"), F.round(F.var_pop("order_no"), 3).alias("vp"), F.round(F.corr("order_no", F.expr("shelf + order_no % 7")), 6).alias("c"), F.count("*").alias("_n")).where("_n > 2").drop("_n"))
add("A14_collections", "SELECT shelf, array_to_string(list(maker ORDER BY line_no, maker), ';') AS makers, to_json(list(grade ORDER BY line_no, grade))::VARCHAR AS grades, bool_and(qty > 1) AS every FROM lines GROUP BY 1", lambda t: t.lines.groupBy("shelf").agg(F.array_join(pg.array_agg("maker", "line_no"), ";").alias("makers"), pg.json_agg("grade", "line_no").alias("grades"), F.every(F.expr("qty > 1")).alias("every")))
add("A14_string_agg", "SELECT shelf, string_agg(maker, ',' ORDER BY line_no, maker) AS s FROM lines GROUP BY 1", lambda t: t.lines.groupBy("shelf").agg(pg.string_agg("maker", ",", "line_no").alias("s")))
add("A15_filter", "SELECT shelf, count(*) FILTER (WHERE qty > 25) AS n, sum(order_no) FILTER (WHERE bulky)::BIGINT AS s, sum(CASE WHEN shelf <> 0 THEN 360 // shelf END)::BIGINT AS q FROM lines GROUP BY 1", lambda t: t.sql("SELECT shelf, count(*) FILTER (WHERE qty > 25) AS n, sum(order_no) FILTER (WHERE bulky) AS s, sum(CASE WHEN shelf <> 0 THEN 360 div shelf END) AS q FROM {lines} GROUP BY 1"))
add("A16_count_distinct", "SELECT bulky, count(DISTINCT order_no) AS a, count(DISTINCT part_label) AS c, count(DISTINCT grade) AS e FROM lines GROUP BY 1", lambda t: t.lines.groupBy("bulky").agg(F.countDistinct("order_no").alias("a"), F.countDistinct("part_label").alias("c"), F.countDistinct("grade").alias("e")))
add("A17_distinct_sums", "SELECT sum(DISTINCT shelf)::BIGINT AS s, avg(DISTINCT shelf) AS a, min(DISTINCT order_no) AS lo FROM lines", lambda t: t.sql("SELECT sum(DISTINCT shelf) AS s, avg(DISTINCT shelf) AS a, min(DISTINCT order_no) AS lo FROM {lines}"))
add("A18_distinct_other", "SELECT sum(DISTINCT money)::DOUBLE AS s, string_agg(DISTINCT lane, ',' ORDER BY lane) AS l FROM lines", lambda t: t.lines.agg(F.sum_distinct("money").cast("double").alias("s"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("l")))
add("A19_distinct", "SELECT DISTINCT lane, shelf FROM lines", lambda t: t.lines.select("lane", "shelf").distinct())
add("A19_distinct_expression", "SELECT DISTINCT order_no % 10 AS a, upper(maker) AS v FROM lines", lambda t: t.lines.selectExpr("order_no % 10 AS a", "upper(maker) AS v").distinct())
add("A20_distinct_on", "SELECT DISTINCT ON (shelf) shelf, line_no FROM lines ORDER BY shelf, line_no", lambda t: ops.distinct_on(t.lines.select("shelf", "line_no"), ["shelf"], F.asc("line_no")))
add("A21_rollup", "SELECT lane, bulky, count(*) AS n, grouping(lane) AS g FROM lines GROUP BY ROLLUP (lane, bulky)", lambda t: t.lines.rollup("lane", "bulky").agg(F.count("*").alias("n"), F.grouping("lane").cast("bigint").alias("g")))
add("A21_cube", "SELECT lane, bulky, count(*) AS n FROM lines GROUP BY CUBE (lane, bulky)", lambda t: t.lines.cube("lane", "bulky").agg(F.count("*").alias("n")))
add("A21_grouping_sets", "SELECT lane, bulky, count(*) AS n FROM lines GROUP BY GROUPING SETS ((lane), (bulky), ())", lambda t: t.sql("SELECT lane, bulky, count(*) AS n FROM {lines} GROUP BY GROUPING SETS ((lane), (bulky), ())"))
add("A22_percentiles", "SELECT bulky, percentile_cont(0.5) WITHIN GROUP (ORDER BY price) AS m, percentile_disc(0.25) WITHIN GROUP (ORDER BY order_no) AS q FROM lines GROUP BY 1", lambda t: t.sql("SELECT bulky, percentile_cont(0.5) WITHIN GROUP (ORDER BY price) AS m, cast(percentile_disc(0.25) WITHIN GROUP (ORDER BY order_no) AS int) AS q FROM {lines} GROUP BY 1"))
add("A23_two_phase", "SELECT part_label, count(*) AS n FROM lines GROUP BY 1", lambda t: t.lines.groupBy("part_label").agg(F.count("*").alias("n")))
add("A24_sorted_groups", "SELECT maker, max(part_label) AS m FROM lines GROUP BY 1 ORDER BY 1", lambda t: t.lines.groupBy("maker").agg(F.max("part_label").alias("m")).orderBy("maker"))
add("A25_many_groups", "SELECT line_no AS k, count(*) AS n, min(price) AS m FROM lines GROUP BY 1", lambda t: t.lines.groupBy(F.col("line_no").alias("k")).agg(F.count("*").alias("n"), F.min("price").alias("m")))
add("A26_key_dependency", "SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2", lambda t: t.customer.join(t.orders, on(), "left").groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), F.count("o_orderkey").alias("n")))
add("A27_equal_forms", "SELECT qty::DECIMAL(10,1) AS k, count(*) AS c FROM (SELECT qty FROM lines UNION ALL SELECT 30.0) GROUP BY 1", lambda t: t.lines.select(F.col("qty").cast("decimal(10,1)").alias("k")).unionAll(t.spark.sql("SELECT cast(30.00 AS decimal(10,1)) AS k")).groupBy("k").agg(F.count("*").alias("c")).select("k", "c"))

add("A28_over_subquery", "SELECT maker, max(n) AS m, sum(s)::BIGINT AS s FROM (SELECT maker, shelf, count(*) AS n, sum(order_no) AS s FROM lines GROUP BY 1, 2) GROUP BY 1", lambda t: t.lines.groupBy("maker", "shelf").agg(F.count("*").alias("n"), F.sum("order_no").alias("s")).groupBy("maker").agg(F.max("n").alias("m"), big("s").alias("s")))

# Windows
wi = lambda: W.partitionBy("shelf").orderBy("line_no")
add("W01_ranks", "SELECT line_no, row_number() OVER w AS r, rank() OVER (PARTITION BY shelf ORDER BY order_no) AS k, dense_rank() OVER (PARTITION BY shelf ORDER BY order_no) AS e, ntile(4) OVER w AS q, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM lines WINDOW w AS (PARTITION BY shelf ORDER BY line_no)", lambda t: t.lines.select("line_no", F.row_number().over(wi()).cast("bigint").alias("r"), F.rank().over(W.partitionBy("shelf").orderBy("order_no")).cast("bigint").alias("k"), F.dense_rank().over(W.partitionBy("shelf").orderBy("order_no")).cast("bigint").alias("e"), F.ntile(4).over(wi()).cast("bigint").alias("q"), F.round(F.percent_rank().over(wi()), 9).alias("p"), F.round(F.cume_dist().over(wi()), 9).alias("c")))
wf = lambda: wi().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
add("W02_offsets", "SELECT line_no, lag(order_no) OVER w AS a, lead(order_no, 2, -1) OVER w AS bb, first_value(order_no) OVER w AS c, last_value(order_no) OVER (PARTITION BY shelf ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dd, nth_value(order_no, 2) OVER (PARTITION BY shelf ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM lines WINDOW w AS (PARTITION BY shelf ORDER BY line_no)", lambda t: t.lines.select("line_no", F.lag("order_no").over(wi()).alias("a"), F.lead("order_no", 2, -1).over(wi()).alias("bb"), F.first("order_no").over(wi()).alias("c"), F.last("order_no").over(wf()).alias("dd"), F.nth_value("order_no", 2).over(wf()).alias("e")))
add("W03_partition_sum", "SELECT line_no, (sum(order_no) OVER (PARTITION BY shelf))::BIGINT AS s, count(*) OVER (PARTITION BY maker) AS n FROM lines", lambda t: t.lines.select("line_no", F.sum("order_no").over(W.partitionBy("shelf")).alias("s"), F.count("*").over(W.partitionBy("maker")).alias("n")))
add("W04_frames", "SELECT line_no, (sum(order_no) OVER (PARTITION BY shelf ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))::BIGINT AS a, (sum(order_no) OVER (PARTITION BY shelf ORDER BY order_no RANGE BETWEEN 50 PRECEDING AND CURRENT ROW))::BIGINT AS bb FROM lines", lambda t: t.lines.select("line_no", F.sum("order_no").over(wi().rowsBetween(-2, 1)).alias("a"), F.sum("order_no").over(W.partitionBy("shelf").orderBy("order_no").rangeBetween(-50, 0)).alias("bb")))
add("W05_groups", "SELECT line_no, (sum(order_no) OVER (PARTITION BY shelf ORDER BY order_no GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM lines", lambda t: ops.groups_frame(t.lines.select("line_no", "shelf", "order_no"), ["shelf"], "order_no", F.sum("order_no"), -1, 0, "s").select("line_no", "s"))
add("W05_groups_following", "SELECT line_no, min(qty) OVER (PARTITION BY shelf ORDER BY ship_day GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m, count(*) OVER (PARTITION BY shelf ORDER BY ship_day GROUPS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS c FROM lines", lambda t: ops.groups_frame(ops.groups_frame(t.lines.select("line_no", "shelf", "ship_day", "qty"), ["shelf"], "ship_day", F.min("qty"), 0, 2, "m"), ["shelf"], "ship_day", F.count("*"), 1, 3, "c").select("line_no", "m", "c"))
add("W05_exclude", "SELECT line_no, (sum(grade) OVER (PARTITION BY shelf ORDER BY ship_day GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP))::BIGINT AS g, (sum(grade) OVER (PARTITION BY shelf ORDER BY ship_day GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW))::BIGINT AS r FROM lines", lambda t: ops.groups_frame_excluding(ops.groups_frame_excluding(t.lines.select("line_no", "shelf", "ship_day", "grade"), ["shelf"], "ship_day", "grade", -1, 1, "group", "g"), ["shelf"], "ship_day", "grade", -1, 1, "current row", "r").select("line_no", "g", "r"))
add("W06_filter", "SELECT line_no, min(order_no) FILTER (WHERE bulky) OVER (PARTITION BY shelf) AS m FROM lines", lambda t: t.lines.select("line_no", F.min(F.when(F.col("bulky"), F.col("order_no"))).over(W.partitionBy("shelf")).alias("m")))

# Sort and limit
add("O01_order", "SELECT grade, line_no FROM lines ORDER BY grade DESC NULLS LAST, line_no", lambda t: t.lines.select("grade", "line_no").orderBy(F.desc_nulls_last("grade"), "line_no"))
add("O01_nulls_first", "SELECT grade, part_label, line_no FROM lines ORDER BY grade NULLS FIRST, part_label DESC, line_no", lambda t: t.lines.select("grade", "part_label", "line_no").orderBy(F.asc_nulls_first("grade"), F.desc("part_label"), "line_no"))
add("O02_text_order", "SELECT part_label, line_no FROM lines ORDER BY part_label, line_no", lambda t: t.lines.select("part_label", "line_no").orderBy("part_label", "line_no"))
add("O03_large_sort", "SELECT price, line_no FROM lines ORDER BY price, line_no", lambda t: t.lines.select("price", "line_no").orderBy("price", "line_no"))
add("O04_top_n", "SELECT ship_day, line_no FROM lines ORDER BY ship_day DESC, line_no LIMIT 10 OFFSET 3", lambda t: t.lines.select("ship_day", "line_no").orderBy(F.desc("ship_day"), "line_no").offset(3).limit(10))
add("O05_top_n_float", "SELECT price, line_no FROM lines ORDER BY price DESC, line_no LIMIT 12", lambda t: t.lines.select("price", "line_no").orderBy(F.desc("price"), "line_no").limit(12))
add("O06_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM lines LIMIT 25)", lambda t: t.lines.select("order_no").limit(25).agg(F.count("*").alias("n")))
add("O07_with_ties", "SELECT order_no, line_no FROM (SELECT order_no, line_no, rank() OVER (ORDER BY order_no DESC) AS r FROM lines) WHERE r <= 10", lambda t: ops.limit_with_ties(t.lines.select("order_no", "line_no"), 10, ("order_no", False)))
add("O08_incremental", "SELECT order_no, shelf, line_no FROM lines ORDER BY order_no, shelf, line_no LIMIT 10", lambda t: t.lines.select("order_no", "shelf", "line_no").orderBy("order_no", "shelf", "line_no").limit(10))
add("O09_collation", "SELECT count(*) AS n, min(lower(maker)) AS m FROM lines WHERE lower(maker) = lower('MAKER-5')", lambda t: t.lines.where(F.expr("maker COLLATE UTF8_LCASE = 'MAKER-5'")).agg(F.count("*").alias("n"), F.min(F.lower("maker")).alias("m")))
add("O10_parallel_sort", "SELECT line_no FROM lines ORDER BY line_no DESC", lambda t: t.lines.select("line_no").repartitionByRange(F.desc("line_no")).sortWithinPartitions(F.desc("line_no")))
add("O11_sort_below_window", "SELECT line_no, row_number() OVER (ORDER BY line_no) AS r FROM lines", lambda t: ops.numbered(t.lines.select("line_no"), "line_no", "r"))

# Set operations
add("U01_casts", "SELECT shelf::BIGINT AS k FROM lines UNION ALL SELECT line_no FROM lines", lambda t: t.lines.selectExpr("cast(shelf AS bigint) AS k").unionAll(t.lines.select("line_no")))
# The sides are overlapping halves by quantity.
LA, RA, EA = ("SELECT part_label, lane FROM lines WHERE " + w for w in ("qty < 30", "qty > 20", "qty > 40"))
side = lambda t, where: t.lines.where(where).select("part_label", "lane")
left_all, right_all = (lambda t: side(t, "qty < 30")), (lambda t: side(t, "qty > 20"))
add("U01_union_all", f"{LA} UNION ALL {RA}", lambda t: left_all(t).unionAll(right_all(t)))
add("U02_union", f"{LA} UNION {RA}", lambda t: left_all(t).union(right_all(t)).distinct())
add("U03_intersect", f"{LA} INTERSECT {RA}", lambda t: left_all(t).intersect(right_all(t)))
add("U04_intersect_all", f"{LA} INTERSECT ALL {RA}", lambda t: left_all(t).intersectAll(right_all(t)))
add("U05_except", f"{LA} EXCEPT {EA}", lambda t: left_all(t).subtract(side(t, "qty > 40")))
add("U06_except_all", f"{LA} EXCEPT ALL {RA}", lambda t: left_all(t).exceptAll(right_all(t)))
add("U07_nested", f"({LA} UNION {RA}) EXCEPT ALL (SELECT part_label, lane FROM lines WHERE bulky INTERSECT {RA})", lambda t: left_all(t).union(right_all(t)).distinct().exceptAll(side(t, "bulky").intersect(right_all(t))))
add("U08_nulls_equal", "SELECT grade FROM lines INTERSECT SELECT nullif(grade, 5) FROM lines", lambda t: t.lines.select("grade").intersect(t.lines.selectExpr("nullif(grade, 5) AS grade")))
add("U09_recursive", "WITH RECURSIVE r(k, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT k + 1, f * (k + 1) FROM r WHERE k < 15) SELECT k, f FROM r", lambda t: t.spark.sql("WITH RECURSIVE r(k, f) AS (SELECT 1, 1L UNION ALL SELECT k + 1, f * (k + 1) FROM r WHERE k < 15) SELECT k, f FROM r"))

# Exchange
add("X01_gather", "SELECT count(*) AS n FROM lines WHERE shelf > 60", lambda t: t.lines.where("shelf > 60").agg(F.count("*").alias("n")))
add("X02_gather_merge", "SELECT line_no FROM lines WHERE qty > 48 ORDER BY line_no", lambda t: t.lines.where("qty > 48").select("line_no").orderBy("line_no"))
add("X03_send", "SELECT maker, count(*) AS n, 1::BIGINT AS workers FROM lines GROUP BY 1", lambda t: t.lines.select("maker").repartition(6, "maker").withColumn("w", F.spark_partition_id()).groupBy("maker").agg(F.count("*").alias("n"), F.count_distinct("w").alias("workers")))
add("X04_sparse_batches", "SELECT count(*) AS n, sum(line_no)::BIGINT AS s FROM lines WHERE qty = 50 AND shelf = 7", lambda t: t.lines.repartition(40).where("qty = 50 AND shelf = 7").coalesce(2).agg(F.count("*").alias("n"), big("line_no").alias("s")))
add("X06_one_worker", "SELECT maker, sum(order_no)::BIGINT AS one, sum(order_no)::BIGINT AS many FROM lines GROUP BY 1", lambda t: t.lines.coalesce(1).groupBy("maker").agg(big("order_no").alias("one")).join(t.lines.repartition(9).groupBy("maker").agg(big("order_no").alias("many")), "maker"))
add("X05_parallel_append", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer)", lambda t: t.orders.select("o_custkey").unionAll(t.customer.select("c_custkey")).agg(F.count("*").alias("n")))
