"""Signed-multiplicity tables: ordinary rows plus a column ``__w BIGINT`` (+n inserts n copies, -n withdraws n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "__w"


def with_weight(df: DataFrame, n: int | Column = 1) -> DataFrame:
    """Rows as insertions of ``n`` copies each; an existing weight is kept."""
    if W in df.columns:
        return df
    return df.withColumn(W, (F.lit(n) if isinstance(n, int) else n).cast("bigint"))


def negate(z: DataFrame) -> DataFrame:
    """The retraction of every delta."""
    return z.withColumn(W, -F.col(W))


def plus(*zs: DataFrame) -> DataFrame:
    """Sum of tables: union by name, without consolidation."""
    out = zs[0]
    for z in zs[1:]:
        out = out.unionByName(z)
    return out


def consolidate(z: DataFrame, cols: Sequence[str] | None = None, clamp: bool = False) -> DataFrame:
    """One row per distinct datum with its net multiplicity; zeros leave, and with ``clamp`` negatives too.

    Null values are ordinary values. The aggregation combines on the map side, so copies never travel.
    """
    cols = list(cols or [c for c in z.columns if c != W])
    out = z.groupBy(*cols).agg(F.sum(W).alias(W))
    return out.filter(F.col(W) > 0) if clamp else out.filter(F.col(W) != 0)
