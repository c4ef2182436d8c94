"""The catalogue: every operator as a query with a DuckDB oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brontide.sources import load

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of a folder as attributes: ``t.lineitem``; ``t.lines`` is lineitem as a table of many types."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.load("lineitem").selectExpr(*(f"{form} AS {column}" for column, form in LINES)) if name == "lines" else self.load(name)

    def load(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over the tables it names in braces; the named frames come first."""
        named = {n: frames.get(n) if n in frames else getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(text, **named)


#: Columns of the mixed-type table ``lines``: name, Spark's form, DuckDB's form if it differs.
LINES = (
    ("order_no", "cast(l_orderkey AS int)"),
    ("line_no", "l_orderkey * 16 + l_linenumber"),
    ("shelf", "cast(l_partkey % 120 AS smallint)"),
    ("price", "l_extendedprice"),
    ("qty", "cast(l_quantity AS float)"),
    ("money", "cast(l_extendedprice AS decimal(15,2))"),
    ("part_label", "concat(l_returnflag, l_linestatus, '/part ', l_partkey)"),
    ("maker", "concat('maker-', l_suppkey % 40)"),
    ("lane", "rpad(concat('lane', l_linenumber % 4), 8, ' ')"),
    ("ship_day", "cast(l_shipdate AS date)"),
    ("shipped", "l_shipdate"),
    ("bulky", "l_quantity > 30"),
    ("grade", "cast(nullif(l_suppkey % 13, 0) AS int)"),
)
LINES_SQL = ", ".join(f"{form} AS {name}" for name, form in LINES)


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None, build: Callable[[Tables], DataFrame]) -> None:
        self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle and re.search(r"\blines\b", oracle):
            oracle = f"WITH lines AS (SELECT {LINES_SQL} FROM lineitem) {oracle}"
        if oracle:
            self.oracles[name] = oracle

    def conditions(self, name: str, *pairs: tuple[str, str] | str) -> None:
        """Rows and a checksum of ``lines`` under each condition (Spark's form, DuckDB's form if it differs)."""
        both = [(p, p) if isinstance(p, str) else p for p in pairs]

        def build(t: Tables) -> DataFrame:
            from pyspark.sql import functions as F

            lines, out = t.lines, None
            for k, (mine, _) in enumerate(both):
                one = lines.where(mine).agg(F.lit(k).cast("bigint").alias("condition"), F.count("*").alias("n"), F.sum(F.col("line_no").cast("decimal(38,0)")).cast("bigint").alias("checksum"))
                out = one if out is None else out.unionAll(one)
            return out

        self.add(name, " UNION ALL ".join(f"SELECT {k}::BIGINT AS condition, count(*) AS n, sum(line_no)::BIGINT AS checksum FROM lines WHERE {theirs}" for k, (_, theirs) in enumerate(both)), build)
