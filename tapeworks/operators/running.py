"""Running sums and maxima over long groups, without one task a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def running(rows: DataFrame, keys: list[str], ts: str, order: list[str], sums: dict[str, Column], maxes: dict[str, Column] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with columns more: the sum, or the maximum, of an expression over its group up to and with the row.

    order begins with ts, in seconds. Windows stay inside a day of a group; what the days before
    it add runs over one row a day. A group of very many rows is as many tasks' work as it has days.
    The input is read twice, once for the days' totals, of the summed columns only; keep, which writes a frame and
    reads it again, spares an input that is dear to compute the second time.
    """
    maxes = maxes or {}
    rows = rows.withColumn("_day", F.floor(F.col(ts) / DAY))
    # what is summed follows from the columns, so it is not written
    rows = (keep(rows) if keep else rows).withColumns({f"_{n}": c for n, c in (sums | maxes).items()})
    of_day = rows.groupBy(*keys, "_day").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums], *[F.max(f"_{n}").alias(f"_{n}") for n in maxes])
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = of_day.select(*keys, "_day", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.max(f"_{n}").over(earlier).alias(f"_before_{n}") for n in maxes])
    inside = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = rows.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums} | {f"_{n}": F.max(f"_{n}").over(inside) for n in maxes})
    out = so_far.join(days, [*keys, "_day"])
    total = {n: F.col(f"_before_{n}") + F.col(f"_{n}") for n in sums} | {n: F.greatest(f"_before_{n}", f"_{n}") for n in maxes}
    return out.withColumns(total).drop("_day", *[f"{p}{n}" for n in total for p in ("_", "_before_")])
