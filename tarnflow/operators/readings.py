"""The live rows of a signed reading log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
FIELDS = ("temp_c_tenths", "rain_mm_tenths", "wind_mph_tenths")


def live_rows(
    df: DataFrame,
    key: str = "sensor",
    at: str = "at_ms",
    values: Sequence[str] = FIELDS,
    weight: str = "__w",
) -> DataFrame:
    """Distinct (key, at, values) whose weights add up to more than 0, with that sum as ``n``.

    Rows without key or time leave; null values count as values; a null weight adds 0. The sum is combined
    before the shuffle, so a reading delivered any number of times moves once per task. Other columns of ``df``
    are not read. An empty input gives an empty result.
    """
    return (
        df.select(key, at, *values, F.col(weight).alias("n"))
        .filter(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(key, at, *values)
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )
