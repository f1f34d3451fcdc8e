"""Rolling totals over trailing periods of days, inactive days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.readings import DAY_MS


def daily_totals(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Sparse daily totals (key, day, total, n); null and negative values count as 0.

    Partial sums are formed before the shuffle: a key with any share of the rows sends one row per day and task.
    """
    v = F.greatest(F.coalesce(F.col(value).cast("bigint"), F.lit(0)), F.lit(0))
    return (
        df.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
        .select(F.col(key).alias("key"), F.floor(F.col(at) / F.lit(DAY_MS)).cast("bigint").alias("day"), v.alias("v"))
        .groupBy("key", "day")
        .agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    )


def rolling_totals(
    df: DataFrame,
    key: str = "sensor",
    at: str = "at_ms",
    value: str = "rain_mm_tenths",
    periods: Sequence[int] = (7, 30),
    max_gap_days: int = 40,
    long_pauses: bool = False,
) -> DataFrame:
    """Per key and day: totals and averages of ``value`` over the trailing ``periods`` days, that day included.

    Days without rows come out as calendar rows (``active`` false) where two successive active days lie at most
    ``max_gap_days`` apart; after longer pauses the series starts again at the next active day. With ``long_pauses``
    longer pauses have calendar rows too, for the days whose trailing periods reach back before the pause. The denominators
    are fixed: a total over p days is divided by p, whatever the number of days with rows. Frames are RANGE frames
    over the integer day number, so they see calendar distance, not row distance. Windows run over one row per key
    and day, whose number the calendar bounds, never over the rows of ``df``.

    Columns: key, day, active, rows, total_<p>, avg_<p> for each period. Rows with null key or time leave; null and
    negative values count as 0; an empty input gives an empty result; other columns of ``df`` are ignored.
    """
    by_day = Window.partitionBy("key").orderBy("day")
    daily = daily_totals(df, key, at, value).withColumn("next", F.lead("day").over(by_day))
    gap = F.col("next") - F.col("day")
    holes = F.when((gap > 1) & (gap <= max_gap_days), F.sequence(F.col("day") + 1, F.col("next") - 1))
    if long_pauses and max(periods) > 1:
        holes = holes.when(gap > 1, F.sequence(F.col("day") + 1, F.least(F.col("next"), F.col("day") + max(periods)) - 1))
    days = daily.select("key", "day", "total", "n", F.explode(F.concat(F.array(F.col("day")), F.coalesce(holes, F.array().cast("array<bigint>")))).alias("d"))
    own = F.col("d") == F.col("day")
    cal = days.select("key", F.col("d").alias("day"), own.alias("active"), F.when(own, F.col("n")).otherwise(0).alias("rows"), F.when(own, F.col("total")).otherwise(0).alias("total"))
    out = [F.col("key").alias(key), "day", "active", "rows"]
    for p in periods:
        total = F.sum("total").over(by_day.rangeBetween(1 - p, 0))
        out += [total.alias(f"total_{p}"), (total / F.lit(p)).alias(f"avg_{p}")]
    return cal.select(*out)


def inactive_days_with_total(rolled: DataFrame, key: str, periods: Sequence[int]) -> DataFrame:
    """(key, day, period_days) of the calendar rows whose trailing total is above 0."""
    each = F.explode(F.array(*(F.struct(F.lit(p).cast("int").alias("period_days"), F.col(f"total_{p}").alias("total")) for p in periods)))
    return rolled.filter(~F.col("active")).select(key, "day", each.alias("p")).filter("p.total > 0").select(key, "day", "p.period_days")
