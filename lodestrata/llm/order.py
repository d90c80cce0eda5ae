"""Running totals and ranks in an order over the whole table, without one task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of one row that one step of ``spread`` makes.
COPIES = 65_536


def running(df: DataFrame, by: list[str], coarse: str, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``by`` that stand before a row, in the order of ``coarse``, then ``order``.

    Rows are followed within one value of ``coarse``; before that come the totals of the earlier values, one row each. ``coarse`` is to be fine
    enough that the rows of one value fit a task, and ``by`` and ``coarse`` hold no nulls.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, coarse).agg(F.sum(value).alias("_total"))
    ahead = F.coalesce(F.sum("_total").over(earlier(Window.partitionBy(*by).orderBy(coarse))), F.lit(0))
    totals = totals.select(*by, coarse, ahead.alias("_earlier"))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*by, coarse).orderBy(*order))), F.lit(0))
    return df.join(totals, [*by, coarse]).withColumn(name, F.col("_earlier") + own).drop("_earlier")


def distinct_rows(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Equal rows as one, with their number: partial counts come before the shuffle, so a row that repeats without end meets in no task."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(copies))


def spread(df: DataFrame, copies: str = "copies", name: str = "copy") -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 0 in ``name``; streamed in steps, so no array is long."""
    steps = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES).cast("long"))))
    return steps.withColumn(name, F.explode(F.sequence("_step", F.least(F.col("_step") + COPIES, F.col(copies)) - 1))).drop("_step", copies)
