"""Exact quantiles, modes and row numbers of whole tables, with bounded state in each task.

Spark's own exact percentile and mode keep all distinct values of a column in one task's memory, and a window without keys sorts
the whole table in one.  Here a sketch brackets what is asked for, and exact counts settle it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000  # of the sketch: a bracket holds about 4 / ACCURACY of the rows
BUCKETS = 512  # parts in which a table is numbered


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """The interpolated quantiles of each of ``values`` (numbers; nulls and NaN are left out, None if nothing else is there).

    The values alone are kept, and three passes go over them: a sketch gives each quantile a bracket of values, the rows below it
    are counted, and those inside are counted by value.  A bracket that misses its rank, which the counts tell, is widened.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in values}
    if not values or not shares:
        return out
    rows = df.select(*[F.when(~F.isnan(x.cast("double")), x.cast("double")).alias(f"v{i}") for i, x in enumerate(values.values())]).persist()
    open_, reach = [(i, j) for i in range(len(values)) for j in range(len(shares))], 2 / ACCURACY
    try:
        while open_:
            ends = {j: (max(0.0, shares[j] - reach), min(1.0, shares[j] + reach)) for _, j in open_}
            asked = sorted({e for pair in ends.values() for e in pair})
            seen = sorted({i for i, _ in open_})
            sketch = rows.agg(*[x for i in seen for x in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", asked, ACCURACY).alias(f"q{i}"))]).first()
            open_ = [(i, j) for i, j in open_ if sketch[f"n{i}"]]
            if not open_:
                break
            brackets = [(i, j, *(sketch[f"q{i}"][asked.index(e)] for e in ends[j])) for i, j in open_]
            below = rows.agg(*[F.count_if(F.col(f"v{i}") < low).alias(f"b{k}") for k, (i, _, low, _) in enumerate(brackets)]).first()
            inside = F.array(*[F.when(F.col(f"v{i}").between(low, high), F.struct(F.lit(k).alias("k"), F.col(f"v{i}").alias("v"))) for k, (i, _, low, high) in enumerate(brackets)])
            counts = rows.select(F.explode(F.array_compact(inside)).alias("s")).groupBy("s.k", "s.v").agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            place = [shares[j] * (sketch[f"n{i}"] - 1) for i, j in open_]
            wanted = {k: (math.floor(p) - below[f"b{k}"], math.ceil(p) - below[f"b{k}"]) for k, p in enumerate(place)}
            rank = lambda which: F.element_at(F.create_map(*[F.lit(x) for k, w in wanted.items() for x in (k, w[which])]), F.col("k"))
            first = lambda which: F.min(F.when(F.col("upto") > rank(which), F.col("v")))
            found = {r["k"]: r for r in counts.withColumn("upto", upto).groupBy("k").agg(first(0).alias("low"), first(1).alias("high")).collect()}
            missed = []
            for k, (i, j) in enumerate(open_):
                r = found.get(k)
                if r is None or wanted[k][0] < 0 or r["low"] is None or r["high"] is None:
                    missed.append((i, j))
                    continue
                part = place[k] - math.floor(place[k])
                out[list(values)[i]][j] = r["low"] if r["low"] == r["high"] else (1 - part) * r["low"] + part * r["high"]
            open_, reach = missed, reach * 16
    finally:
        rows.unpersist()
    return out


def modes(counts: DataFrame) -> DataFrame:
    """column and mode (the smallest on ties) from rows (column, value, n); columns of nulls alone have none."""
    return counts.where("value is not null").groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def numbered(df: DataFrame, axis: str, name: str = "pos", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with its row number from 0 in the order of ``axis`` (a number, no nulls); equal values in any order.

    Rows are sorted in buckets of neighbouring values, to whose places the sizes of the buckets before are added.
    """
    x = F.col(axis).cast("double")
    cuts = df.agg(F.percentile_approx(x, [k / buckets for k in range(1, buckets)], ACCURACY)).first()[0]
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    rows = Bucketizer(splits=splits, inputCol="_axis", outputCol="_bucket", handleInvalid="keep").transform(df.withColumn("_axis", x))
    sizes, offset = {}, 0
    for r in rows.groupBy("_bucket").count().orderBy("_bucket").collect():  # ``buckets`` rows at most
        sizes[r["_bucket"]], offset = offset, offset + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("_bucket"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(axis)) - 1
    return rows.withColumn(name, (place + start).cast("long")).drop("_axis", "_bucket")
