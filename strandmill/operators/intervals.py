"""Interval joins by bins, and gaps-and-islands clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def bins(start: Column, end: Column, size: int = BIN) -> Column:
    return F.sequence(F.floor(start / size), F.floor(F.greatest(end, start) / size))


def interval_join(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, how: str = "inner", size: int = BIN) -> DataFrame:
    """Rows whose closed intervals overlap within a key.

    Both sides are dealt to the bins they touch and meet by an equi-join on key
    and bin, so the plan is a shuffled join rather than nested loops; a pair is
    emitted only in the bin that holds the start of its overlap, so no distinct
    is needed. how: inner, left_semi or left_anti (the latter two by the distinct
    spans of the left side).
    """
    if how == "inner":
        lhs = left.withColumn("_bin", F.explode(bins(F.col(l_start), F.col(l_end), size)))
        rhs = right.withColumnRenamed(key, "_key").withColumn("_rbin", F.explode(bins(F.col(r_start), F.col(r_end), size)))
        hit = (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
        first = F.col("_bin") == F.floor(F.greatest(l_start, r_start) / size)
        return lhs.join(rhs, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_rbin")) & hit & first).drop("_bin", "_rbin", "_key")
    # a semi or anti join asks for a left row's span only: equal spans have equal answers, and are compared as they are
    span = left.select(key, l_start, l_end).distinct()
    hits = interval_join(span, right.select(key, r_start, r_end), key, l_start, l_end, r_start, r_end, "inner", size).select(key, l_start, l_end).distinct()
    return left.join(hits, [key, l_start, l_end], how).select(*left.columns)


def islands(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 0, order: list[str] | None = None) -> DataFrame:
    """df with island: intervals of a key chained where they overlap or lie within slack of what came before."""
    by = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
