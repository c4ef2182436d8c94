"""The extension surface: named plan nodes, named sources, counters of an executed plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NODES: dict[str, Callable[..., DataFrame]] = {}


def node(name: str):
    """Registers a plan node: a function of a DataFrame and named parameters that returns a DataFrame."""

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _NODES[name] = build
        return build

    return keep


def apply(df: DataFrame, name: str, **parameters) -> DataFrame:
    """The named node above ``df``; Catalyst plans it with the rest of the query."""
    if name not in _NODES:
        raise KeyError(f"no plan node {name}; known: {sorted(_NODES)}")
    return _NODES[name](df, **parameters)


@node("top_of_each")
def top_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


class Squares(DataSource):
    """A source by name, for tests of the interface: k and its square for k under the option ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "brontide_squares"

    def schema(self) -> str:
        return "k bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        return SquaresReader(int(self.options.get("rows", "10")))


class SquaresReader(DataSourceReader):
    STEP = 300

    def __init__(self, rows: int):
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(first) for first in range(0, self.rows, self.STEP)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in range(partition.value, min(self.rows, partition.value + self.STEP)):
            yield k, k * k


def squares(spark: SparkSession):
    spark.dataSource.register(Squares)
    return spark.read.format(Squares.name())


def aggregate(df: DataFrame, keys: list[str], partial, merge, between: str, schema: str) -> DataFrame:
    """A user's aggregate in two phases: ``partial`` of each Arrow batch as a pandas frame (columns ``between``, keys included), then
    ``merge`` of a group's partial rows. Only partial rows are shuffled, so a hot group is a few rows a task."""
    parts = df.mapInPandas(lambda frames: (partial(f) for f in frames), between)
    return parts.groupBy(*keys).applyInPandas(merge, schema)


def counters(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Runs ``df`` and returns (node, its counters) of the plan as executed, top down."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[tuple[str, dict[str, int]]] = []

    def visit(plan) -> None:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return visit(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return visit(plan.plan())
        found, names = {}, plan.metrics().iterator()
        while names.hasNext():
            pair = names.next()
            found[pair._1()] = pair._2().value()
        out.append((plan.nodeName(), found))
        children = plan.children().iterator()
        while children.hasNext():
            visit(children.next())

    visit(execution.executedPlan())
    return out


def filter_counters(df: DataFrame, condition: str) -> DataFrame:
    """Rows that a filter kept and removed, as its plan counted them (not for filters that the scan takes over)."""
    found = counters(df.where(condition))
    at = next(i for i, (name, _) in enumerate(found) if name == "Filter")
    kept = found[at][1]["numOutputRows"]
    below = next(c["numOutputRows"] for _, c in found[at + 1 :] if "numOutputRows" in c)
    return df.sparkSession.createDataFrame([(kept, below - kept)], "kept bigint, removed bigint")
