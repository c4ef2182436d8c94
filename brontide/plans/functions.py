"""Scalar functions F01-F41, row-wise functions R01-R15 and the extension surface, each against the oracle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from brontide import functions as pg
from brontide import extend
from brontide.plans import Catalogue, Tables

c = Catalogue()
add, conditions = c.add, c.conditions


def values(name: str, *columns: tuple[str, object, str]) -> None:
    """Columns (alias, Spark expression or Column, DuckDB expression) beside the row's key, for every row."""
    oracle = f"SELECT line_no, {', '.join(f'{theirs} AS {alias}' for alias, _, theirs in columns)} FROM lines"
    add(name, oracle, lambda t: t.lines.select("line_no", *((F.expr(mine) if isinstance(mine, str) else mine()).alias(alias) for alias, mine, _ in columns)))


same = lambda alias, text: (alias, text, text)
compare = lambda a, b: tuple(f"{a} {op} {b}" for op in ("=", "<>", "<", "<=", ">", ">="))

conditions("F01_int4_compare", *compare("order_no", "777"))
values("F02_int4_arithmetic", same("a", "order_no + 7"), same("s", "order_no - 7"), same("m", "order_no * 3"), ("d", lambda: pg.int_div("order_no", F.lit(7)).cast("int"), "order_no // 7"), same("r", "order_no % 7"), same("n", "-order_no"), ("nd", lambda: pg.int_div(F.expr("-order_no"), F.lit(7)).cast("int"), "trunc(-order_no / 7)::INT"), same("nr", "-order_no % 7"))
conditions("F03_int8_compare", *compare("line_no", "16003"))
values("F03_int8_arithmetic", same("a", "line_no + 7"), same("m", "line_no * 3"), ("d", lambda: pg.int_div("line_no", F.lit(7)), "line_no // 7"), same("r", "line_no % 7"), same("n", "-line_no"))
conditions("F04_int2_compare", *compare("shelf", "64"))
values("F04_int2_arithmetic", ("a", "cast(shelf + cast(1 AS smallint) AS smallint)", "(shelf + 1)::SMALLINT"), ("m", "cast(shelf * cast(3 AS smallint) AS smallint)", "(shelf * 3)::SMALLINT"), ("r", "cast(shelf % cast(7 AS smallint) AS smallint)", "(shelf % 7)::SMALLINT"))
values("F05_int2_int4", same("a", "shelf + order_no"), same("b", "order_no - shelf"), same("c", "shelf < order_no"), same("e", "order_no % (shelf + 1)"))
values("F06_int_widths", same("a", "order_no + line_no"), same("b", "line_no - shelf"), same("c", "shelf = line_no"), same("e", "line_no % (order_no + 1)"))
values("F07_int_casts", ("a", "cast(order_no AS bigint)", "order_no::BIGINT"), ("b", "cast(shelf AS bigint)", "shelf::BIGINT"), ("c", "cast(line_no AS int)", "line_no::INT"), ("e", "cast(order_no % 1000 AS smallint)", "(order_no % 1000)::SMALLINT"), ("g", "cast(shelf AS int)", "shelf::INT"))
values("F08_abs_int", same("a", "abs(order_no - 1000)"), same("b", "abs(line_no - 5000000)"), same("c", "greatest(order_no, -order_no)"))
conditions("F09_bool_compare", *compare("bulky", "(shelf > 64)"))
conditions("F10_date_compare", *compare("ship_day", "DATE '1994-11-20'"))
conditions("F11_timestamp_compare", *((f"shipped {op} TIMESTAMP_NTZ '1994-11-20 00:00:00'", f"shipped {op} TIMESTAMP '1994-11-20 00:00:00'") for op in ("=", "<>", "<", "<=", ">", ">=")))
conditions("F12_date_timestamp", *((f"ship_day {op} TIMESTAMP_NTZ '1994-11-20 12:00:00'", f"ship_day {op} TIMESTAMP '1994-11-20 12:00:00'") for op in ("=", "<", ">=")), "shipped = ship_day")
conditions("F13_float_compare", *compare("price", "34567.5"), *compare("qty", "33"), "qty < price")
values("F14_float_arithmetic", same("a", "price + 0.5e0"), same("b", "price - 1e3"), same("m", "price * 2e0"), same("q", "price / 4e0"), ("o", lambda: pg.float_product("price", F.lit(1e10)), "price * 1e10"))
values("F15_float_sign", same("a", "-price"), same("b", "abs(price - 20000)"))
values("F16_float_casts", ("a", "cast(order_no AS double)", "order_no::DOUBLE"), ("b", "cast(qty AS double)", "qty::DOUBLE"), ("c", "cast(price AS float)", "price::FLOAT"), ("e", lambda: pg.float_to_int(F.expr("order_no / 2e0")), "round_even(order_no / 2e0, 0)::INT"), ("g", lambda: pg.float_to_int(F.expr("-order_no / 2e0"), "bigint"), "round_even(-order_no / 2e0, 0)::BIGINT"))
conditions("F17_numeric_compare", *compare("money", "34567.50"), "money = money * 1.000")
values("F18_numeric_arithmetic", ("a", "cast(money + 1.5 AS double)", "(money + 1.5)::DOUBLE"), ("s", "cast(money - 0.25 AS double)", "(money - 0.25)::DOUBLE"), ("m", "cast(money * 3 AS double)", "(money * 3)::DOUBLE"), ("g", "cast(-money AS double)", "(-money)::DOUBLE"), ("b", "cast(abs(money - 20000) AS double)", "abs(money - 20000)::DOUBLE"))
values("F19_int_to_numeric", ("a", "cast(cast(shelf AS decimal(10,2)) AS string)", "shelf::DECIMAL(10,2)::VARCHAR"), ("b", "cast(cast(order_no AS decimal(12,1)) AS string)", "order_no::DECIMAL(12,1)::VARCHAR"), ("e", "cast(cast(line_no AS decimal(20,0)) AS string)", "line_no::DECIMAL(20,0)::VARCHAR"))
values("F20_numeric_to_int", ("a", lambda: pg.numeric_to_int(F.expr("cast(order_no AS decimal(12,2)) * 0.5")), "round(order_no::DECIMAL(12,2) * 0.5, 0)::INT"), ("b", lambda: pg.numeric_to_int(F.expr("-cast(order_no AS decimal(12,2)) * 0.5"), "bigint"), "round(-(order_no::DECIMAL(12,2)) * 0.5, 0)::BIGINT"))
values("F21_numeric_chain", ("a", "cast(cast(money AS decimal(12,2)) * (1 - cast(0.05 AS decimal(4,2))) * (1 + cast(0.08 AS decimal(4,2))) AS double)", "(money * (1 - 0.05::DECIMAL(4,2)) * (1 + 0.08::DECIMAL(4,2)))::DOUBLE"))
conditions("F22_text_equal", "maker = 'maker-31'", "maker <> 'maker-31'", ("rtrim(lane) = rtrim('lane3   ')", "rtrim(lane) = 'lane3'"))
conditions("F23_starts_with", ("startswith(part_label, 'RF/')", "starts_with(part_label, 'RF/')"))
conditions("F24_like", "part_label LIKE 'A%'", "part_label LIKE '%44'", "part_label LIKE '%/%3%8'", "part_label NOT LIKE '%0%'", "part_label LIKE 'N_/part __'", "concat(maker, '_') LIKE '%-2!_' ESCAPE '!'", "rtrim(lane) LIKE 'lane2'")
values("F25_length", ("a", "cast(length(part_label) AS bigint)", "length(part_label)"), ("b", "cast(char_length(rtrim(lane)) AS bigint)", "length(rtrim(lane))"), ("e", "cast(character_length(concat('é', maker)) AS bigint)", "length(concat('é', maker))"))
values("F26_octet_length", ("a", "cast(octet_length(concat('é日', part_label)) AS bigint)", "strlen(concat('é日', part_label))"))
values("F27_substring", ("a", lambda: pg.substring("part_label", 3), "substr(part_label, 3)"), ("b", lambda: pg.substring("part_label", 2, 4), "substr(part_label, 2, 4)"), ("z", lambda: pg.substring("part_label", 0, 3), "left(part_label, 2)"), ("m", lambda: pg.substring("part_label", -2, 5), "left(part_label, 2)"), ("e", lambda: pg.substring("part_label", 3, 0), "''"), ("g", lambda: pg.substring("part_label", -5, 2), "''"))
values("F28_left_right", ("a", lambda: pg.left("part_label", 3), "left(part_label, 3)"), ("b", lambda: pg.left("part_label", -3), "left(part_label, -3)"), ("e", lambda: pg.right("part_label", 3), "right(part_label, 3)"), ("g", lambda: pg.right("part_label", -3), "right(part_label, -3)"), ("h", lambda: pg.left("part_label", -50), "left(part_label, -50)"))
values("F29_trim", ("a", "concat('|', rtrim(concat('  ', lane)), '|')", "concat('|', rtrim(concat('  ', lane)), '|')"), ("b", "concat('|', ltrim(concat('  ', lane)), '|')", "concat('|', ltrim(concat('  ', lane)), '|')"), ("e", "concat('|', trim(concat('  ', lane)), '|')", "concat('|', trim(concat('  ', lane)), '|')"))
values("F30_date_int", ("a", "date_add(ship_day, 30)", "ship_day + 30"), ("b", "date_sub(ship_day, 400)", "ship_day - 400"), ("e", "date_add(ship_day, shelf)", "ship_day + shelf::INT"))
values("F31_date_difference", ("a", lambda: pg.days_between("ship_day", F.lit("1995-01-01").cast("date")), "(ship_day - DATE '1995-01-01')::INT"))
values("F32_date_timestamp_casts", ("a", "cast(shipped AS date)", "shipped::DATE"), ("b", "cast(ship_day AS timestamp_ntz)", "ship_day::TIMESTAMP"))
SHIFT, THEIRS = "shipped + INTERVAL 12345678 SECONDS", "shipped + INTERVAL 12345678 SECONDS"
#: Centuries and millennia begin with their year 1.
SPAN = {"century": 100, "millennium": 1000}
UNITS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
values("F33_date_trunc", *((u, lambda u=u: pg.date_trunc(u, F.expr(SHIFT)), f"make_timestamp((year({THEIRS}) - 1) // {SPAN[u]} * {SPAN[u]} + 1, 1, 1, 0, 0, 0)" if u in SPAN else f"date_trunc('{u}', {THEIRS})::TIMESTAMP") for u in UNITS))
values("F34_timestamp_interval", ("a", "shipped + INTERVAL 90 MINUTES", "shipped + INTERVAL 90 MINUTES"), ("b", "shipped - INTERVAL 3 DAYS", "shipped - INTERVAL 3 DAYS"), ("e", "shipped + INTERVAL 1 MONTH", "shipped + INTERVAL 1 MONTH"))
values("F35_date_interval", ("a", lambda: pg.date_plus("ship_day", "1 MONTH"), "ship_day + INTERVAL 1 MONTH"), ("b", lambda: pg.date_plus("ship_day", "36 HOURS"), "ship_day + INTERVAL 36 HOURS"))
DATE_FIELDS = ("day", "month", "quarter", "week", "year", "decade", "century", "millennium", "isoyear", "dow", "isodow", "doy")
values("F36_extract_date", *((f, lambda f=f: pg.extract(f, "ship_day"), f"extract({f} FROM ship_day)") for f in DATE_FIELDS), ("epoch", lambda: pg.extract("epoch", "ship_day"), "epoch(ship_day)::DOUBLE"), ("julian", lambda: pg.extract("julian", "ship_day"), "julian(ship_day)::BIGINT"))
values("F37_extract_timestamp", *((f, lambda f=f: pg.extract(f, F.expr(SHIFT)), f"extract({f} FROM {THEIRS})") for f in (*DATE_FIELDS, "hour", "minute")), ("second", lambda: pg.extract("second", F.expr(SHIFT)), f"extract(second FROM {THEIRS})::DOUBLE"), ("milliseconds", lambda: pg.extract("milliseconds", F.expr(SHIFT)), f"extract(milliseconds FROM {THEIRS})::DOUBLE"), ("epoch", lambda: pg.extract("epoch", F.expr(SHIFT)), f"epoch({THEIRS})::DOUBLE"))
values("F38_zoned_fields", ("h", lambda: pg.extract("hour", F.expr("cast(shipped AS timestamp)")), "extract(hour FROM shipped)"), ("m", lambda: pg.date_trunc("month", F.expr("cast(shipped AS timestamp)"), zoned=True).cast("timestamp_ntz"), "date_trunc('month', shipped)::TIMESTAMP"))
values("F39_zoned_casts", ("a", "cast(cast(ship_day AS timestamp) AS date)", "ship_day"), ("b", "cast(cast(shipped AS timestamp) AS date)", "shipped::DATE"))
add("F40_key_hash", "SELECT count(*) AS n, count(DISTINCT part_label) AS m FROM lines", lambda t: t.lines.agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("part_label")).alias("m")))
add("F41_partials", "SELECT count(order_no) AS n, sum(order_no)::BIGINT AS s, min(line_no) AS lo, max(line_no) AS hi FROM lines", lambda t: t.lines.agg(F.count("order_no").alias("n"), F.sum("order_no").alias("s"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")))

conditions("R01_ilike", "part_label ILIKE 'nO/PART 9%'")
conditions("R02_regex", ("part_label RLIKE '^[AR]F'", "regexp_matches(part_label, '^[AR]F')"), ("NOT maker RLIKE '-[0-4]'", "NOT regexp_matches(maker, '-[0-4]')"))
values("R03_case", same("u", "upper(part_label)"), same("l", "lower(upper(part_label))"))
values("R04_concat", same("a", "part_label || 'x' || maker"))
values("R05_md5", same("a", "md5(part_label)"))
values("R06_trunc_date", ("a", "trunc(ship_day, 'MM') = DATE '1995-03-01'", "date_trunc('month', ship_day) = DATE '1995-03-01'"))
values("R07_round", ("a", "cast(round(money, 0) AS double)", "round(money, 0)::DOUBLE"), ("b", "cast(round(money, 1) AS double)", "round(money, 1)::DOUBLE"))
values("R08_interval_compare", ("a", "shipped - TIMESTAMP_NTZ '1995-01-01 00:00:00' > INTERVAL 10 HOURS", "shipped - TIMESTAMP '1995-01-01 00:00:00' > INTERVAL 10 HOURS"))
conditions("R09_text_order", "part_label > 'N'", "part_label < 'AF/part 3'", "maker >= 'maker-2' AND maker < 'maker-3'")
values("R10_text", same("a", "replace(part_label, 'part', 'no.')"), same("b", "reverse(part_label)"), same("c", "repeat(maker, 2)"), same("e", "split_part(part_label, ' ', 2)"), same("g", "lpad(maker, 5, '0')"), ("h", "regexp_replace(part_label, '[0-9]+', '#')", "regexp_replace(part_label, '[0-9]+', '#', 'g')"), ("k", "regexp_extract(part_label, '([0-9])$', 1)", "regexp_extract(part_label, '([0-9])$', 1)"))
values("R11_arrays", ("a", "cast(size(split(part_label, ' ')) AS bigint)", "len(string_split(part_label, ' '))"), ("b", "cast(cardinality(sequence(1, shelf + 1)) AS bigint)", "(shelf + 1)::BIGINT"))
values("R12_xor", ("a", "order_no ^ 5", "xor(order_no, 5)"), ("b", "order_no & 12", "order_no & 12"), ("e", "order_no | 3", "order_no | 3"))
values("R13_constructors", ("a", "make_timestamp_ntz(2020, 2, cast(shelf % 28 + 1 AS int), 3, 4, 5)", "make_timestamp(2020, 2, shelf % 28 + 1, 3, 4, 5)"), ("b", "current_date() > DATE '2020-01-01'", "current_date > DATE '2020-01-01'"), ("z", "cast(make_timestamp_ltz(2021, 7, cast(shelf % 28 + 1 AS int), 3, 4, 5.5, 'America/New_York') AS timestamp_ntz)", "make_timestamp(2021, 7, shelf % 28 + 1, 7, 4, 5.5)"), ("n", "now() > TIMESTAMP '2020-01-01 00:00:00'", "now()::TIMESTAMP > TIMESTAMP '2020-01-01 00:00:00'"))
values("R14_numeric", ("a", "round(cast(money AS double) / 7, 6)", "round(money::DOUBLE / 7, 6)"), ("b", "round(sqrt(price), 6)", "round(sqrt(price), 6)"), same("e", "abs(-price)"))
add("R15_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")))


def _plus_one(t: Tables):
    @F.pandas_udf("bigint")
    def plus_one(x: pd.Series) -> pd.Series:
        return x + 1

    return t.lines.select("line_no", plus_one("line_no").alias("p"))


def _range_udaf(t: Tables):
    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("shelf", as_index=False).agg(low=("order_no", "min"), high=("order_no", "max"))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shelf": parts["shelf"].iloc[:1], "s": [float(parts["high"].max() - parts["low"].min())]})

    return extend.aggregate(t.lines.select("shelf", "order_no"), ["shelf"], partial, merge, "shelf smallint, low int, high int", "shelf smallint, s double")


def _pairs_udtf(t: Tables):
    class Pairs:
        def eval(self, n: int):
            for i in range(n):
                yield i, i * i

    t.spark.udtf.register("brontide_pairs", F.udtf(Pairs, returnType="a int, b int"))
    return t.spark.sql("SELECT a, b FROM brontide_pairs(6)")


add("G01_vectorised_function", "SELECT line_no, line_no + 1 AS p FROM lines", _plus_one)
add("G06_aggregate_function", "SELECT shelf, (max(order_no) - min(order_no))::DOUBLE AS s FROM lines GROUP BY 1", _range_udaf)
add("G02_plan_node", "SELECT maker, line_no FROM (SELECT maker, line_no, row_number() OVER (PARTITION BY maker ORDER BY price DESC, line_no) AS place FROM lines) WHERE place <= 3", lambda t: extend.apply(t.lines.select("maker", "line_no", "price"), "top_of_each", keys=["maker"], order=[F.desc("price"), F.asc("line_no")], n=3).select("maker", "line_no"))
add("G03_named_source", "SELECT g AS k, g * g AS square FROM range(0, 1000) AS x(g)", lambda t: extend.squares(t.spark).option("rows", "1000").load())
add("G09_counters", "SELECT count(*) FILTER (WHERE bulky) AS kept, count(*) FILTER (WHERE NOT bulky) AS removed FROM lines", lambda t: extend.filter_counters(t.lines, "coalesce(bulky, false)"))
add("G07_table_function", "SELECT g::INT AS a, (g * g)::INT AS b FROM range(0, 6) AS x(g)", _pairs_udtf)
add("G08_sql_function", "SELECT line_no, order_no * 2 + 1 AS f FROM lines", lambda t: (t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION brontide_odd(x INT) RETURNS INT RETURN x * 2 + 1"), t.lines.selectExpr("line_no", "brontide_odd(order_no) AS f"))[1])
