"""Gaps, islands and as-of values over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(*keys: str, by: str = "frame"):
    return Window.partitionBy(*keys).orderBy(by)


def so_far(*keys: str, by: str = "frame"):
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, changed: Column, name: str, *keys: str, by: str = "frame") -> DataFrame:
    """The rows with the running number of their island; ``changed`` is true (or null) where one begins."""
    flagged = df.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_new").over(so_far(*keys, by=by)).cast("long")).drop("_new")


def last_known(value: Column, *keys: str, by: str = "frame") -> Column:
    """The last value that is not null, up to and with this row."""
    return F.last(value, ignorenulls=True).over(so_far(*keys, by=by))


def next_known(value: Column, *keys: str, by: str = "frame") -> Column:
    """The first value that is not null, from this row on: the last one so far in the opposite order, since a frame that ends with the partition is summed anew for every row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0))


def ordered_mean(value: str, by: str, of: Column) -> Column:
    """The aggregated mean of the values of some rows, added in the order of ``by``: a sum of doubles in no fixed order differs in its last digits, which decides comparisons at a bound."""
    rows = F.sort_array(F.collect_list(F.when(of & F.col(value).isNotNull(), F.struct(by, F.col(value).cast("double").alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["v"]) / F.nullif(F.size(rows), F.lit(0))
