"""Functions whose PostgreSQL meaning differs from Spark's default, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def int_div(a, b) -> Column:
    """Integer division, truncating; an error by zero."""
    return F.call_function("div", _c(a), _c(b))


def float_to_int(x, kind: str = "int") -> Column:
    """Rounds half to even."""
    return F.rint(_c(x)).cast(kind)


def numeric_to_int(x, kind: str = "int") -> Column:
    """Rounds half away from zero."""
    return F.round(_c(x), 0).cast(kind)


def checked_float(result, *operands) -> Column:
    """An error where finite operands gave an infinite result."""
    finite = F.lit(True)
    for x in operands:
        finite = finite & (F.abs(_c(x)) < F.lit(float("inf")))  # NaN is greater than all numbers
    over = (F.abs(_c(result)) == F.lit(float("inf"))) & finite
    return F.when(over, F.raise_error(F.lit("value out of range: overflow")).cast("double")).otherwise(_c(result))


def float_product(a, b) -> Column:
    """a * b; an error where it overflows, or where factors other than 0 give 0."""
    a, b = _c(a), _c(b)
    under = (a * b == 0) & (a != 0) & (b != 0)
    return F.when(under, F.raise_error(F.lit("value out of range: underflow")).cast("double")).otherwise(checked_float(a * b, a, b))


def float_quotient(a, b) -> Column:
    """a / b; an error by zero, where it overflows, or where a numerator other than 0 gives 0 by a finite divisor."""
    a, b = _c(a), _c(b)
    q = F.try_divide(a, b)
    under = (q == 0) & (a != 0) & (F.abs(b) != F.lit(float("inf")))
    out = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double"))
    return out.when(under, F.raise_error(F.lit("value out of range: underflow")).cast("double")).otherwise(checked_float(q, a, b))


MOST = 2147483647


def _number(n) -> Column:
    return (n if isinstance(n, Column) else F.lit(n)).cast("bigint")


def substring(text, start, length=None) -> Column:
    """Positions before 1 use up length; a negative length is an error; null for any null argument."""
    text, start = _c(text), _number(start)
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.when(start.isNotNull(), F.substring(text, F.least(first, F.lit(MOST)).cast("int"), F.lit(MOST)))
    length = _number(length)
    n = F.least(F.greatest(start + length - first, F.lit(0)), F.lit(MOST))
    known = text.isNotNull() & start.isNotNull() & length.isNotNull()
    cut = F.substring(text, F.least(first, F.lit(MOST)).cast("int"), n.cast("int"))
    return F.when(known & (length < 0), F.raise_error(F.lit("negative substring length not allowed")).cast("string")).when(known, cut)


def _side(cut, text, n) -> Column:
    text, n = _c(text), _number(n)
    size = F.when(n >= 0, F.least(n, F.lit(MOST))).otherwise(F.greatest(F.length(text) + n, F.lit(0)))
    return F.when(n.isNotNull(), cut(text, size.cast("int")))


def left(text, n) -> Column:
    """The first n characters; with negative n all but the last -n."""
    return _side(F.left, text, n)


def right(text, n) -> Column:
    """The last n characters; with negative n all but the first -n."""
    return _side(F.right, text, n)


def char_equal(a, b) -> Column:
    """char(n) comparison: trailing blanks don't count."""
    return F.rtrim(_c(a)) == F.rtrim(_c(b))


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier))


def date_plus(d, interval: str) -> Column:
    """date + interval is a timestamp without zone."""
    return _c(d).cast("timestamp_ntz") + F.expr(f"INTERVAL {interval}")


def date_trunc(unit: str, ts, zoned: bool = False) -> Column:
    """All units from microseconds to millennium.

    Timestamps without zone are truncated as they stand, and stay so; ``zoned`` ones in the session's zone.
    """
    local = _c(ts).cast("timestamp_ntz")  # in the session's zone, if it has one
    day, none = local.cast("date"), F.lit(0)
    second = F.date_part(F.lit("SECOND"), local)
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if unit == "microseconds":
        out = local
    elif unit in ("milliseconds", "second", "minute", "hour"):
        seconds = {"milliseconds": F.floor(second * 1000) / 1000, "second": F.floor(second)}.get(unit, none)
        time = F.make_dt_interval(none, F.hour(local), none if unit == "hour" else F.minute(local), seconds.cast("decimal(18,6)"))
        out = day.cast("timestamp_ntz") + time
    elif span:
        year = F.year(local)
        first = F.floor(year / span) * span if unit == "decade" else F.floor((year - 1) / span) * span + 1
        out = F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    else:
        out = (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")
    return out.cast("timestamp") if zoned else out


def extract(field: str, x, zoned: bool = False) -> Column:
    """extract(field FROM x), as double where it has fractions and bigint elsewhere; ``zoned`` values in the session's zone."""
    given, x = _c(x), _c(x).cast("timestamp_ntz")
    year = F.year(x)
    second = F.date_part(F.lit("SECOND"), x).cast("double")
    days = lambda since: F.datediff(x.cast("date"), F.lit(since).cast("date"))
    return {
        "year": lambda: year.cast("bigint"),
        "quarter": lambda: F.quarter(x).cast("bigint"),
        "month": lambda: F.month(x).cast("bigint"),
        "week": lambda: F.weekofyear(x).cast("bigint"),
        "day": lambda: F.dayofmonth(x).cast("bigint"),
        "hour": lambda: F.hour(x).cast("bigint"),
        "minute": lambda: F.minute(x).cast("bigint"),
        "second": lambda: second,
        "milliseconds": lambda: second * 1000,
        "microseconds": lambda: second * 1000000,
        "dow": lambda: (F.dayofweek(x) - 1).cast("bigint"),
        "isodow": lambda: (F.weekday(x) + 1).cast("bigint"),
        "doy": lambda: F.dayofyear(x).cast("bigint"),
        "isoyear": lambda: F.date_part(F.lit("YEAROFWEEK"), x).cast("bigint"),
        "decade": lambda: F.floor(year / 10).cast("bigint"),
        "century": lambda: F.ceil(year / 100).cast("bigint"),
        "millennium": lambda: F.ceil(year / 1000).cast("bigint"),
        "julian": lambda: (days("2000-01-01") + 2451545).cast("bigint"),
        "epoch": lambda: F.unix_micros(given.cast("timestamp")) / 1e6 if zoned else days("1970-01-01") * 86400.0 + F.hour(x) * 3600 + F.minute(x) * 60 + second,
    }[field]()


def sum_bigint(x) -> Column:
    """Exact sum of 64-bit integers: the sum is a 38-digit decimal."""
    return F.sum(_c(x).cast("decimal(38,0)"))


def avg_exact(x) -> Column:
    """The mean of decimals or integers as a double, independent of the order of rows."""
    return F.sum(_c(x)).cast("double") / F.count(_c(x))


def exact_sum(x) -> Column:
    """The sum of decimals or integers, exact in the column's own scale, as a double."""
    return F.sum(_c(x)).cast("double")


def _ordered(x, order) -> Column:
    """All values in order: (column, ascending) pairs or columns; nulls last ascending and first descending."""
    order = [o if isinstance(o, tuple) else (o, True) for o in order] + [(x, True)]
    keys = [k for i, (o, _) in enumerate(order) for k in (_c(o).isNull().alias(f"n{i}"), _c(o).alias(f"k{i}"))]
    items = F.collect_list(F.struct(*keys, _c(x).alias("x")))
    if all(up for _, up in order):
        return F.transform(F.array_sort(items), lambda s: s["x"])

    def compare(a, b):
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(order))):
            for name in (f"k{i}", f"n{i}"):
                less, more = (-1, 1) if up else (1, -1)
                out = F.when(a[name] < b[name], less).when(a[name] > b[name], more).otherwise(out)
        return out

    return F.transform(F.array_sort(items, compare), lambda s: s["x"])


def array_agg(x, *order) -> Column:
    """All values, nulls too, always with an order: shuffled rows have none of their own. A group is one array in one task."""
    return _ordered(x, order)


def json_agg(x, *order) -> Column:
    return F.to_json(_ordered(x, order), {"ignoreNullFields": "false"})


def string_agg(x, separator: str, *order) -> Column:
    """Values joined, without nulls; null where there are no others."""
    found = F.filter(_ordered(x, order), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, separator))
