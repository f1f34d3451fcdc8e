"""Irregular readings of cumulative counters onto a regular grid of time cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.readings import HOUR_MS

def counter_grid(
    df: DataFrame,
    key: str = "sensor",
    at: str = "at_ms",
    counter: str | None = None,
    cell_ms: int = HOUR_MS,
    max_empty: int = 240,
    count: str | None = None,
    cell: str | None = None,
) -> DataFrame:
    """One row per key and time cell from readings of a cumulative counter at irregular times.

    Successive readings (t1, c1), (t2, c2) of a key give the increment c2 - c1, or c2 alone if c2 < c1 (the counter was
    reset). The increment is spread over the cells between t1 and t2 in proportion to their overlap with that
    interval. Without ``counter`` the readings are counted themselves: the counter is their running number, so that
    every step has the increment 1 and no reset.

    Columns: key, cell (= floor(at / cell_ms)), state, cells, readings, samples, increment, resets.
    ``state`` is 'observed' (the cell has readings), 'filled' (no reading, between two readings with at most
    ``max_empty`` empty cells between them; ``increment`` is the interpolated share) or 'uncovered' (a longer pause:
    one row for the whole interval, ``cell`` its first cell and ``cells`` its length, ``increment`` what the counter
    gained in it). ``samples`` is the sum of ``count`` over the cell, or the number of readings.

    Readings of a cell are differenced inside (key, cell) groups; only the first and last reading of a cell meet those
    of the neighbouring non-empty cells, so no task ever holds all readings of a key. ``cell`` names a column that has the
    cells' numbers already: rows partitioned by it and the key are then not shuffled again. Rows with null key, time or
    counter leave; ties in time are ordered by counter; an empty input gives an empty result; other columns of
    ``df`` are ignored.
    """
    t, c = F.col("t"), F.col("c")
    rows = df.select(
        F.col(key).alias("k"),
        F.col(at).cast("bigint").alias("t"),
        (F.col(counter).cast("double") if counter else F.lit(0.0)).alias("c"),
        (F.coalesce(F.col(count).cast("bigint"), F.lit(0)) if count else F.lit(1).cast("bigint")).alias("s"),
        (F.col(cell) if cell else F.floor(F.col(at).cast("bigint") / F.lit(cell_ms)).cast("bigint")).alias("cell"),
    ).filter("k is not null and t is not null and c is not null")
    if counter:
        inside = Window.partitionBy("k", "cell").orderBy("t", "c")
        before = F.lag("c").over(inside)
        rows = rows.withColumn("d", F.when(before.isNull(), 0.0).when(c < before, c).otherwise(c - before)).withColumn("r", F.when(c < before, 1).otherwise(0))
        first, last = F.min(F.struct("t", "c")), F.max(F.struct("t", "c"))
        cells = rows.groupBy("k", "cell").agg(first.alias("a"), last.alias("z"), F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("d").alias("inner"), F.sum("r").alias("resets"))
    else:
        cells = rows.groupBy("k", "cell").agg(F.min("t").alias("ta"), F.max("t").alias("tz"), F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
        cells = cells.select("k", "cell", F.struct(F.col("ta").alias("t"), F.lit(0.0).alias("c")).alias("a"), F.struct(F.col("tz").alias("t"), F.lit(0.0).alias("c")).alias("z"), "n", "s", (F.col("n") - 1).cast("double").alias("inner"), F.lit(0).cast("bigint").alias("resets"))

    def step(frm: F.Column, to: F.Column) -> F.Column:
        if not counter:
            return F.lit(1.0)
        return F.when(to["c"] < frm["c"], to["c"]).otherwise(to["c"] - frm["c"])

    def share(frm: F.Column, to: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
        """The part of the step from one reading to the next that falls on times lo to hi."""
        span = (to["t"] - frm["t"]).cast("double")
        return F.when(span > 0, step(frm, to) * (F.least(hi, to["t"]) - F.greatest(lo, frm["t"])) / span).otherwise(0.0)

    w = Window.partitionBy("k").orderBy("cell")
    cells = cells.withColumns({"pz": F.lag("z").over(w), "na": F.lead("a").over(w), "nc": F.lead("cell").over(w)})
    start, end = F.col("cell") * cell_ms, (F.col("cell") + 1) * cell_ms
    # a step between two readings in one cell at equal times keeps its whole increment in the later cell
    incoming = F.when(F.col("pz").isNotNull(), share(F.col("pz"), F.col("a"), start, end)).otherwise(0.0)
    outgoing = F.when(F.col("na").isNotNull(), share(F.col("z"), F.col("na"), start, end)).otherwise(0.0)
    crossed = F.when(F.col("pz").isNotNull() & (F.col("a")["c"] < F.col("pz")["c"]), 1).otherwise(0)
    gap = F.col("nc") - F.col("cell") - 1
    observed = F.struct(F.col("cell").alias("cell"), F.lit("observed").alias("state"), F.lit(1).cast("bigint").alias("cells"), F.col("n").alias("readings"), F.col("s").alias("samples"), (F.col("inner") + incoming + outgoing).alias("increment"), (F.col("resets") + crossed).cast("bigint").alias("resets"))

    def empty(cell: F.Column, state: str, length: F.Column) -> F.Column:
        lo = cell * cell_ms
        return F.struct(cell.alias("cell"), F.lit(state).alias("state"), length.cast("bigint").alias("cells"), F.lit(0).cast("bigint").alias("readings"), F.lit(0).cast("bigint").alias("samples"), share(F.col("z"), F.col("na"), lo, lo + length * cell_ms).alias("increment"), F.lit(0).cast("bigint").alias("resets"))

    filled = F.when((gap > 0) & (gap <= max_empty), F.transform(F.sequence(F.col("cell") + 1, F.col("nc") - 1), lambda x: empty(x, "filled", F.lit(1))))
    pause = F.when(gap > max_empty, F.array(empty(F.col("cell") + 1, "uncovered", gap)))
    out = cells.select("k", F.inline(F.concat(F.array(observed), F.coalesce(filled, pause, F.filter(F.array(observed), lambda _: F.lit(False))))))
    return out.withColumnRenamed("k", key)
