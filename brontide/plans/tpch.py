"""The 22 TPC-H-derived reports over the tables at hand.

Where a column of the standard schema is missing the report keeps its shape with the columns there are; partsupp
is each (part, supplier) pair of lineitem with its least unit price. Money is summed exactly, as decimals.
"""

from __future__ import annotations

from brontide.plans import Catalogue

c = Catalogue()

PARTSUPP = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, cast(sum(l_quantity) AS bigint) AS ps_availqty, min(cast(l_extendedprice AS decimal(15,2))) AS ps_supplycost FROM {lineitem} GROUP BY l_partkey, l_suppkey"
VOLUME = "cast(sum(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(4,2)))) AS double)"


def report(name: str, text: str) -> None:
    """One text for both engines but for table braces, time-stamp literals and year extraction."""
    mine = text.replace("PARTSUPP", f"({PARTSUPP})")
    theirs = mine.replace("{", "").replace("}", "").replace("TIMESTAMP_NTZ", "TIMESTAMP")
    c.add(name, theirs, lambda t: t.sql(mine))


report("Q01_pricing_summary", "SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS decimal(15,2))) AS double) AS sum_qty, cast(sum(cast(l_extendedprice AS decimal(15,2))) AS double) AS sum_base_price, " + VOLUME + " AS sum_disc_price, cast(sum(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(4,2))) * (1 + cast(l_tax AS decimal(4,2)))) AS double) AS sum_charge, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
report("Q02_minimum_cost_supplier", "WITH ps AS (PARTSUPP), e AS (SELECT * FROM ps JOIN {supplier} ON ps_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_regionkey = 3) SELECT s_acctbal, s_name, n_name, p_partkey FROM {part} JOIN e ON p_partkey = ps_partkey JOIN (SELECT ps_partkey AS k, min(ps_supplycost) AS m FROM e GROUP BY ps_partkey) x ON p_partkey = k AND ps_supplycost = m WHERE p_size < 20 ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100")
report("Q03_shipping_priority", "SELECT l_orderkey, " + VOLUME + " AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP_NTZ '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
report("Q04_order_priority", "SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1993-07-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1995-10-01 00:00:00' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority")
report("Q05_local_supplier_volume", "SELECT n_name, " + VOLUME + " AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name ORDER BY revenue DESC")
report("Q06_revenue_change", "SELECT cast(sum(cast(l_extendedprice AS decimal(15,2)) * cast(l_discount AS decimal(4,2))) AS double) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
report("Q07_volume_shipping", "SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, cast(year(l_shipdate) AS bigint) AS l_year, " + VOLUME + " AS revenue FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {nation} a ON s_nationkey = a.n_nationkey JOIN {nation} b ON c_nationkey = b.n_nationkey WHERE a.n_nationkey IN (3, 7) AND b.n_nationkey IN (3, 7) AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name, b.n_name, year(l_shipdate) ORDER BY 1, 2, 3")
report("Q08_market_share", "SELECT cast(year(o_orderdate) AS bigint) AS o_year, round(cast(sum(CASE WHEN s.n_nationkey = 5 THEN cast(l_extendedprice AS decimal(15,2)) ELSE 0 END) AS double) / cast(sum(cast(l_extendedprice AS decimal(15,2))) AS double), 9) AS mkt_share FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n.n_nationkey JOIN {nation} s ON s_nationkey = s.n_nationkey WHERE n.n_regionkey = 1 AND p_size < 25 GROUP BY year(o_orderdate) ORDER BY 1")
report("Q09_product_profit", "WITH ps AS (PARTSUPP) SELECT n_name AS nation, cast(year(o_orderdate) AS bigint) AS o_year, cast(sum(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(4,2))) - ps_supplycost * cast(0.01 AS decimal(4,2)) * cast(l_quantity AS int)) AS double) AS sum_profit FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {nation} ON s_nationkey = n_nationkey WHERE p_name LIKE '%1%' GROUP BY n_name, year(o_orderdate) ORDER BY nation, o_year DESC")
report("Q10_returned_items", "SELECT c_custkey, c_name, " + VOLUME + " AS revenue, c_acctbal, n_name FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
report("Q11_important_stock", "WITH ps AS (PARTSUPP), v AS (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS value FROM ps JOIN {supplier} ON ps_suppkey = s_suppkey WHERE s_nationkey < 8 GROUP BY ps_partkey) SELECT ps_partkey, cast(value AS double) AS value FROM v WHERE value > (SELECT sum(value) * 0.001 FROM v) ORDER BY value DESC, ps_partkey")
report("Q12_order_modes", "SELECT l_returnflag, cast(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS bigint) AS high, cast(sum(CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' THEN 1 ELSE 0 END) AS bigint) AS low FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP_NTZ '1994-01-01 00:00:00' GROUP BY l_returnflag ORDER BY l_returnflag")
report("Q13_customer_distribution", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) x GROUP BY c_count ORDER BY custdist DESC, c_count DESC")
report("Q14_promotion", "SELECT round(100.00 * cast(sum(CASE WHEN p_type LIKE 'PROMO%' THEN cast(l_extendedprice AS decimal(15,2)) ELSE 0 END) AS double) / cast(sum(cast(l_extendedprice AS decimal(15,2))) AS double), 9) AS promo_revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'")
report("Q15_top_supplier", "WITH r AS (SELECT l_suppkey, sum(cast(l_extendedprice AS decimal(15,2)) * (1 - cast(l_discount AS decimal(4,2)))) AS total FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' GROUP BY l_suppkey) SELECT s_suppkey, s_name, cast(total AS double) AS total FROM {supplier} JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r) ORDER BY s_suppkey")
report("Q16_parts_suppliers", "WITH ps AS (PARTSUPP) SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN {part} ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#45' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = ps_suppkey AND s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size")
report("Q17_small_quantity", "SELECT round(cast(sum(cast(l_extendedprice AS decimal(15,2))) AS double) / 7.0, 6) AS avg_yearly FROM {lineitem} o JOIN {part} ON p_partkey = o.l_partkey WHERE p_size < 20 AND l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = p_partkey)")
report("Q18_large_volume", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, cast(sum(cast(l_quantity AS decimal(15,2))) AS double) AS qty FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
report("Q19_discounted_revenue", "SELECT " + VOLUME + " AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE (p_brand LIKE '%1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand LIKE '%2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR (p_brand LIKE '%3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35)")
report("Q20_part_promotion", "WITH ps AS (PARTSUPP) SELECT s_name, s_suppkey FROM {supplier} WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE '%1%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {lineitem} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate < TIMESTAMP_NTZ '1996-01-01 00:00:00')) ORDER BY s_name")
report("Q21_waiting_suppliers", "SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} a ON s_suppkey = a.l_suppkey JOIN {orders} ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' AND a.l_quantity > 25 AND EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM {lineitem} e WHERE e.l_orderkey = a.l_orderkey AND e.l_suppkey <> a.l_suppkey AND e.l_quantity > 25) GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100")
report("Q22_sales_opportunity", "SELECT substring(c_mktsegment, 1, 2) AS code, count(*) AS numcust, cast(sum(cast(c_acctbal AS decimal(15,2))) AS double) AS total FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) GROUP BY substring(c_mktsegment, 1, 2) ORDER BY code")
