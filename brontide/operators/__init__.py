"""Relational operators that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if its size, as the optimizer's statistics have it, is under this.
BROADCAST_BYTES = 32 << 20


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate, from file sizes and pruned columns."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the side's size is known to be under the limit; else the join shuffles."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def right_anti(build: DataFrame, probe: DataFrame, on) -> DataFrame:
    """Rows of ``build`` that no row of ``probe`` matches; which side is built is the optimizer's choice."""
    return build.join(probe, on, "left_anti")


def not_in(df: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """NOT IN (subquery), with SQL's rule for nulls, by an anti join that may shuffle.

    A null among the values keeps no row; a null key stays only if there are no values.
    """
    text = f"SELECT * FROM {{df}} WHERE (SELECT count(*) FROM {{values}}) = 0 OR (`{key}` IS NOT NULL AND (SELECT count(*) FROM {{values}} WHERE `{value}` IS NULL) = 0)"
    may_stay = df.sparkSession.sql(text, df=df, values=values)
    listed = values.select(F.col(value).alias("_value"))
    return may_stay.join(listed, may_stay[key] == listed["_value"], "left_anti")


#: A key is hot if it has more than this share of the left rows for each salt.
HOT_SHARE = 0.25


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join (inner and left only) whose hot left keys are dealt over ``salts`` copies of the right rows.

    Keys are counted first; those with more than HOT_SHARE / salts of the left rows are hot, at most 4 * salts of them, and
    only theirs are copied. The salt is a hash of the left row, so a task that runs again deals its rows as before.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("n") > total * HOT_SHARE / salts).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts)).cast("int")
    dealt = left.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def distinct_on(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group of keys in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def limit_with_ties(df: DataFrame, n: int, *keys: tuple[str, bool]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES by (column, ascending) keys, nulls last.

    A top-n finds the first n rows without sorting all; the last of them bounds the
    result, and the rows up to it are a filter over the table.
    """
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys]
    names = [c for c, _ in keys]
    back = [F.col(c).desc_nulls_first() if up else F.col(c).asc_nulls_first() for c, up in keys]
    bound = df.select(*names).orderBy(*order).limit(n).orderBy(*back).limit(1)
    bound = F.broadcast(bound.toDF(*(f"_{c}" for c in names)))  # one row
    within, equal = F.lit(False), F.lit(True)
    for c, up in keys:
        x, y = F.col(c), F.col(f"_{c}")
        before = F.coalesce(x < y if up else x > y, x.isNotNull() & y.isNull())
        within, equal = within | (equal & before), equal & x.eqNullSafe(y)
    return df.join(bound, within | equal).select(*df.columns)


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, aggregate: Column, first: int, last: int, name: str) -> DataFrame:
    """An aggregate over GROUPS BETWEEN: peer groups from ``first`` to ``last`` around the row's own (negative: preceding).

    Peer groups are numbered, then ranged over.
    """
    grouped = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(first, last)
    return grouped.withColumn(name, aggregate.over(w)).drop("_group")


def groups_frame_excluding(df: DataFrame, partition: Sequence[str], order: str, value: str, first: int, last: int, exclude: str, name: str) -> DataFrame:
    """sum(value) over a GROUPS frame around the row, EXCLUDE ``group``, ``ties`` or ``current row``: the frame's sum without theirs."""
    grouped = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_group")
    frame, peers = w.rangeBetween(first, last), w.rangeBetween(0, 0)
    own, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("int")
    out_sum, out_count = {
        "group": (F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)),
        "ties": (F.coalesce(F.sum(value).over(peers), F.lit(0)) - own, F.count(value).over(peers) - one),
        "current row": (own, one),
    }[exclude]
    left = F.count(value).over(frame) - out_count
    return grouped.withColumn(name, F.when(left > 0, F.sum(value).over(frame) - out_sum)).drop("_group")


def numbered(df: DataFrame, key: str, name: str, ranges: int = 64) -> DataFrame:
    """row_number() over the whole table in the order of a numeric column without nulls, without a window of one partition.

    Rows are cut into ranges by approximate percentiles, numbered in each, and each
    range's numbers begin after the rows of those before it.
    """
    at = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000)).first()[0] or []
    place = F.lit(0)
    for bound in sorted(set(at)):
        place = place + F.when(F.col(key) > bound, 1).otherwise(0)
    ranged = df.withColumn("_range", place)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.toDF("_low", "_m")
    starts = sizes.join(F.broadcast(before), F.col("_low") < F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, within.cast("bigint") + F.col("_start")).drop("_range", "_start")
