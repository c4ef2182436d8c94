"""Tables in and out: Parquet folders, Arrow, key look-ups, samples, parameters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NAMED: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, read: Callable[..., DataFrame]) -> None:
    """A source by name: ``read(spark, **options)`` gives its rows."""
    _NAMED[name] = read


def named(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _NAMED:
        raise KeyError(f"no source {name}; known: {sorted(_NAMED)}")
    return _NAMED[name](spark, **options)


register("parquet folder", lambda spark, folder, table: load(spark, folder, table))


def sql(spark: SparkSession, sf_dir: str, text: str, parameters: dict | None = None) -> DataFrame:
    """A query over the tables of a folder, with named parameters (``:name``); ``{table}`` names a table."""
    frames = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, args=parameters or {}, **frames)


def lookup(df: DataFrame, key: str, values: Iterable) -> DataFrame:
    """Rows of the given keys; the list reaches the scan as a pushed filter."""
    return df.where(F.col(key).isin(list(values)))


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Append to a Parquet table; sorting within files narrows their row-group bounds."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only in local mode, where one machine has all files, a temporary folder instead."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="brontide-")
    return _OWN["dir"]


def saved(df: DataFrame, name: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
    """``save`` into a new folder of the shared one, read back."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    save(df, path, partition_by, sort_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins and groupings by it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    """For results of known size."""
    return df.toArrow()


def cursor(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator()


def sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def append(*frames: DataFrame) -> DataFrame:
    """Branches by column name, as children of one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
