"""Window helpers over one symbol's bars in time order.

All take and return Column expressions over the same window specification, so
that Spark plans one exchange and one sort for all features of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "symbol", "ts"


def ordered():
    return Window.partitionBy(KEY).orderBy(TIME)


def rows(n: int):
    """The last n bars, this one included."""
    return ordered().rowsBetween(1 - n, 0)


def upto():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(ordered())


def rolling(agg, c: Column | str, n: int, least: int | None = None) -> Column:
    """agg of the last n values; null unless `least` (default n) of them are not null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c).over(rows(n)) >= (n if least is None else least), agg(c).over(rows(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def change(c: Column, n: int) -> Column:
    """Relative change to n bars ago."""
    return ratio(c, lag(c, n)) - 1


def log_positive(c: Column) -> Column:
    return F.ln(F.when(c > 0, c))


def carry(c: Column) -> Column:
    """The last value that is not null."""
    return F.last(c, ignorenulls=True).over(upto())


def ewm(df: DataFrame, column: str, alpha: float, out: str, least: int = 1) -> DataFrame:
    """Add the exponential mean y = alpha * x + (1 - alpha) * y', started at the first value.

    Nulls may stand at the head only.  The first `least` - 1 values are null.  The JVM's window
    expression gives the adjusted mean; with w = (1 - alpha)**k over k values so
    far, adjusted * (1 - w) + w * first is the recursive one.
    """
    from pyspark.sql.internal import InternalFunction

    c = F.col(column)
    k = F.count(c).over(upto())
    w = F.pow(F.lit(1 - alpha), k)
    first = F.first(c, ignorenulls=True).over(upto())
    adjusted = InternalFunction.ewm(c, alpha, True).over(ordered())
    return df.withColumn(out, F.when(k >= least, adjusted * (1 - w) + w * first))
