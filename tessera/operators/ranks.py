"""Dense numbers for rows and lookups by cumulative weight, without a window over all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FEW = 10_000  # ranges that every task may hold


def ranges_of(df: DataFrame, by: Column) -> DataFrame:
    """df with __range, the number of the range of a numeric column between its approximate quantiles; the
    range of a row is found by binary search. Nulls are in the first range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(by.cast("double"), [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    bounds = sorted({float(c) for c in cuts if math.isfinite(c)})
    if not bounds:
        return df.withColumn("__range", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__k", outputCol="__range", handleInvalid="keep")
    keyed = found.transform(df.withColumn("__k", F.coalesce(by.cast("double"), F.lit(-math.inf))))
    return keyed.withColumn("__range", F.col("__range").cast("int")).drop("__k")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0-based positions in an order. order[0] is numeric: rows are cut into ranges at its
    approximate quantiles; a row's number is its rank in its range plus the rows of lower ranges (a row
    for each range is broadcast). Ties need further order columns."""
    keyed = ranges_of(df, order[0])
    below = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__in"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__in").over(below), F.lit(0)).alias("__below"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    ranked = keyed.withColumn("__place", rank).join(F.broadcast(offsets), "__range")
    return ranked.withColumn(name, (F.col("__place") - 1 + F.col("__below")).cast("bigint")).drop("__range", "__place", "__below")


def cumulative(weights: DataFrame, weight: str, order: str, group: list[str] | None = None, block: int = 100_000) -> DataFrame:
    """weights with [low, high), the running sum's bounds in the order of a 0-based number. Sums run
    within blocks of numbers, more of them the more rows there are, and over block totals."""
    group = group or []
    size = max(1, min(block, -(-weights.count() // 64)))
    blocked = weights.withColumn("__block", F.floor(F.col(order) / size))
    inside = Window.partitionBy(*group, "__block").orderBy(order)
    over = Window.partitionBy(*group, F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*group, "__block").agg(F.sum(weight).alias("__t"))
    before = totals.select(*group, "__block", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__before"))
    out = blocked.join(before, [*group, "__block"])
    high = F.col("__before") + F.sum(weight).over(inside)
    return out.withColumn("high", high).withColumn("low", F.col("high") - F.col(weight)).drop("__block", "__before")


def range_lookup(points: DataFrame, at: str, ranges: DataFrame, total: int, cells: int = 1024, full: int = 512) -> DataFrame:
    """Each point joined with the range [low, high) that holds the long `at`. Ranges within [0, total)
    don't overlap. Both sides meet by equality in buckets: cells of equal width, so that points are spread,
    and a cell with more than `full` ranges is cut again into equal parts, so that a point meets few ranges
    (a count for each cell goes to the driver). Up to FEW ranges are broadcast, so that points stay where they are;
    of more ranges, both sides are shuffled. Points are never gathered where the ranges are: these may be in one task."""
    width = max(1, -(-total // cells))
    known = ranges.where("high > low")
    counts = known.groupBy(F.floor(F.col("low") / width).cast("int").alias("cell")).count().collect()
    parts = [1] * cells
    for r in counts:
        parts[r["cell"]] = min(width, -(-r["count"] // full))
    of_cell = F.array(*map(F.lit, parts))

    def place(x: Column) -> Column:
        cell = F.floor(x / width)
        n = F.element_at(of_cell, (cell + 1).cast("int"))
        return cell * 2**31 + F.floor((x - cell * width) / F.ceil(F.lit(width) / n))

    def ends(low: Column, high: Column) -> Column:
        """The buckets that a range meets, cell by cell."""
        first, last = F.floor(low / width), F.floor(high / width)
        bounds = F.transform(F.sequence(first, last), lambda c: F.struct(F.greatest(low, c * width).alias("a"), F.least(high, (c + 1) * width - 1).alias("b")))
        return F.flatten(F.transform(bounds, lambda x: F.sequence(place(x["a"]), place(x["b"]))))

    spread = known.withColumn("__b", F.explode(ends(F.col("low"), F.col("high") - 1)))
    keyed = points.withColumn("__b", F.coalesce(place(F.col(at)), F.lit(-1)))  # never null: else the join looks twice
    if sum(r["count"] for r in counts) <= FEW:
        spread = F.broadcast(spread)
    else:  # by a number of our own: what is computed of a point isn't told by its bytes
        keyed = keyed.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__b").hint("merge")
    return keyed.join(spread, "__b").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("__b", "low", "high")
