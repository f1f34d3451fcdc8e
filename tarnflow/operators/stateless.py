"""Stateless operators: every output row carries its input's multiplicity, so retractions undo insertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.plans.node import SEQ, Node, checked, data_columns
from tarnflow.zset import W


def _kept(z: DataFrame) -> list[str]:
    return [c for c in (W, SEQ) if c in z.columns]


class Filter(Node):
    """Rows for which ``pred`` is true; a null predicate drops the row."""

    def __init__(self, pred: Column | str) -> None:
        super().__init__()
        self.pred = checked(pred)

    def batch(self, z: DataFrame) -> DataFrame:
        return z.filter(self.pred)


class Map(Node):
    """One row per row, with the given columns."""

    def __init__(self, **columns: Column) -> None:
        super().__init__()
        self.columns = {k: checked(c) for k, c in columns.items()}

    def batch(self, z: DataFrame) -> DataFrame:
        return z.select(*(c.alias(k) for k, c in self.columns.items()), *_kept(z))


class FilterMap(Map):
    """As ``Map``; rows whose first column is null leave."""

    def batch(self, z: DataFrame) -> DataFrame:
        return super().batch(z).filter(F.col(next(iter(self.columns))).isNotNull())


class FlatMap(Node):
    """A row for each element of an array expression; null and empty arrays give none."""

    def __init__(self, name: str, array: Column, keep: tuple[str, ...] = ()) -> None:
        super().__init__()
        self.column, self.array, self.keep = name, checked(array), keep

    def batch(self, z: DataFrame) -> DataFrame:
        return z.select(*self.keep, F.explode(self.array).alias(self.column), *_kept(z))


class _Attach(Node):
    column = ""

    def __init__(self, expr: Column | str) -> None:
        super().__init__()
        self.expr = checked(F.col(expr) if isinstance(expr, str) else expr)

    def batch(self, z: DataFrame) -> DataFrame:
        return z.withColumn(self.column, self.expr)


class KeyBy(_Attach):
    """Attach a grouping key as column ``key``."""

    column = "key"


class ScoreBy(_Attach):
    """Attach an ordered score as column ``score``."""

    column = "score"


class Unkey(Node):
    """Drop the key."""

    column = "key"

    def batch(self, z: DataFrame) -> DataFrame:
        return z.select(*(c for c in data_columns(z) if c != self.column), *_kept(z))


class Unscore(Unkey):
    """Drop the score."""

    column = "score"
