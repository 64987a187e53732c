"""Exact order statistics of groups of any size, in two passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(x: Column) -> Column:
    """A whole number that never falls as x rises: steps of a thousandth of its size, from a millionth on; some 80,000 in all."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e6) * 1000)


def ranked_values(rows: DataFrame, by: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, names...): each group's number of values and the values at the given places, counted from 0 in ascending order.

    ranks has a place as a function of n for each name. The first pass counts values in bins, of
    which a group has a bounded number, and finds the bin of each place; the second looks into
    those bins only, with equal values counted together. No group is sorted, and none is one task's work.
    """
    x = F.col(column).cast("double")
    values = rows.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("x")).withColumn("bin", _bin(F.col("x")))
    group = Window.partitionBy(*by)
    bins = values.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    bins = bins.withColumns({"before": F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"), "n": F.sum("c").over(group)})
    places = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in ranks.items()])
    asked = bins.withColumn("ask", F.explode(places)).where((F.col("ask.place") >= F.col("before")) & (F.col("ask.place") < F.col("before") + F.col("c")))
    asked = asked.select(*by, "bin", "before", "n", "ask.name", "ask.place")
    inside = values.join(asked.select(*by, "bin").distinct(), [*by, "bin"], "left_semi").groupBy(*by, "bin", "x").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("upto", upto).join(asked, [*by, "bin"])
    hit = hit.where((F.col("place") < F.col("before") + F.col("upto")) & (F.col("place") >= F.col("before") + F.col("upto") - F.col("k")))
    return hit.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks])


def exact_percentiles(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(by, names...): percentiles with linear interpolation between neighbours, for each name its share of 0 to 1."""
    ranks = {}
    for name, p in shares.items():
        ranks[f"{name}_low"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"{name}_high"] = lambda n, p=p: F.ceil((n - 1) * p)
    out = ranked_values(rows, by, column, ranks)

    def between(name: str, p: float) -> Column:
        low, high, at = F.col(f"{name}_low"), F.col(f"{name}_high"), (F.col("n") - 1) * p
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return out.select(*by, *[between(name, p) for name, p in shares.items()])
