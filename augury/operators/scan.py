"""Joins on keys that may be null, and running values over long series that many tasks share.

A long series is cut into parts of neighbouring rows.  Windows run within a part; what they need from the parts before and after
comes from one border row a part, over which one small window runs, and is joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.sources.tables import written

PART = 65_536  # rows of a part


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], more: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Join on the keys, a null key being equal to itself, and on ``more``, which both have; ``right`` may be empty of keys."""
    names = [*keys, *more]
    if not names:
        return left.join(right, F.lit(True), how)  # a single series: one side is one row, or has few
    theirs = {c: f"_of_{c}" for c in names}
    right = right.withColumnsRenamed(theirs)
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{theirs[c]}`")) if c in keys else F.col(f"`{c}`") == F.col(f"`{theirs[c]}`") for c in names])
    return left.join(right, same, how).drop(*theirs.values())


def in_parts(series: DataFrame, part: int = PART) -> DataFrame:
    """``series`` with ``_part``, from its places."""
    return series.withColumn("_part", F.floor(F.col("pos") / part))


def seen_around(series: DataFrame, keys: list[str], part: int) -> DataFrame:
    """``series`` (keys, pos, y and others) with y0, p0 (the last observed value up to a row and its place), y1, p1 (the next one
    from it on) and mean (of all observed)."""
    seen = F.when(F.col("y").isNotNull(), F.col("pos"))
    rows = in_parts(series, part)
    border = rows.groupBy(*keys, "_part").agg(F.max_by("y", seen).alias("_y0"), F.max(seen).alias("_p0"), F.min_by("y", seen).alias("_y1"), F.min(seen).alias("_p1"), F.sum("y").alias("_s"), F.count("y").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_part")  # a row for each part
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    border = border.select(
        *keys, "_part", *[F.last(c, True).over(before).alias(c) for c in ("_y0", "_p0")], *[F.first(c, True).over(after).alias(c) for c in ("_y1", "_p1")],
        (F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("mean"),
    )
    own = Window.partitionBy(*keys, "_part").orderBy("pos")
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    near = {"y0": F.last("y", True).over(back), "p0": F.last(seen, True).over(back), "y1": F.first("y", True).over(ahead), "p1": F.first(seen, True).over(ahead)}
    joined = on_keys(rows.withColumns(near), border, keys, ("_part",))
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in near}).drop("_part", *[f"_{c}" for c in near])


def ordered_numbers(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with row numbers from 0 in the order of columns of any type: ranges of rows are written once, numbered within, and
    the sizes of the ranges before are added."""
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn(name, place).join(starts, "_part").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_start")


def row_before(df: DataFrame, value: str, name: str, part: int = PART) -> DataFrame:
    """``df`` (with pos) with ``name``: ``value`` of the row before, null for the first."""
    rows = in_parts(df, part)
    ends = rows.groupBy("_part").agg(F.max_by(value, "pos").alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # a row for each part
    near = F.lag(value).over(Window.partitionBy("_part").orderBy("pos"))
    return rows.withColumn(name, near).join(ends, "_part").withColumn(name, F.coalesce(name, "_end")).drop("_part", "_end")
