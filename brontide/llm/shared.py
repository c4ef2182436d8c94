"""Intermediate tables in the folder that all executors share, and table loading."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from brontide.ship import ship
from brontide.sources import scratch

#: Arrow batches stay small where texts are long, and so do Parquet's, of which each column of a batch is one array in the heap.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, work is done once.

    A lost executor loses nothing of such a table.  Tables live until ``forget`` or the end of the
    cluster's shared folder.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory of this Python process to the system, where its C library can: later stages share the driver's memory."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The package goes to the workers, and ARROW holds in the session from here on: batches are planned later."""
    ship(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
