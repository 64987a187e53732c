"""Settings tables: rules, cases and grids, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a settings table is broadcast.
FEW = 10_000


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its rows, which are counted as far as `FEW`, are few; else as it is, and the planner chooses."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
