"""Queries of the series operators over ``readings``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.operators.readings import HOUR_MS, live_rows
from tarnflow.operators.regular_grid import counter_grid
from tarnflow.operators.rolling import inactive_days_with_total, rolling_totals
from tarnflow.operators.spikes import implausible
from tarnflow.session import table

PERIODS = (7, 30)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "readings"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return inactive_days_with_total(rolling_totals(_live(spark, d), periods=PERIODS), "sensor", PERIODS)


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling_totals(_live(spark, d), periods=PERIODS, long_pauses=True)
    return r.select("sensor", "day", "active", "rows", "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_report(spark, d).select("sensor", "at_ms", "field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "readings"), _live(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = counter_grid(_live(spark, d), count="n", max_empty=240)
    return g.filter("state = 'filled'").select("sensor", F.col("cell").alias("hour"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    g = counter_grid(_live(spark, d), count="n", max_empty=240)
    return g.select("sensor", F.col("cell").alias("hour"), "state", "cells", "readings", "samples", F.round("increment", 4).alias("increment"))


def p5_rain_counter(spark: SparkSession, d: str) -> DataFrame:
    """The gridded rain of a counter that starts again at 0 each UTC day, as it stands at every live reading."""
    rain = F.greatest(F.coalesce(F.col("rain_mm_tenths").cast("bigint"), F.lit(0)), F.lit(0))
    hour = F.floor(F.col("at_ms") / F.lit(HOUR_MS)).cast("bigint")
    r = _live(spark, d).select("sensor", "at_ms", rain.alias("rain"), hour.alias("h")).filter("h is not null").repartition("sensor", "h")
    # two levels: what fell in the day's hours before, and running totals inside the hour
    day = Window.partitionBy("sensor", F.floor(F.col("h") / F.lit(24))).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    # both branches ask for the same columns and filters, so that they share one shuffle
    hours = r.groupBy("sensor", "h").agg(F.sum("rain").alias("total"), F.max("at_ms").alias("last")).filter("last is not null").select("sensor", "h", F.coalesce(F.sum("total").over(day), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sensor", "h").orderBy("at_ms", "rain").rowsBetween(Window.unboundedPreceding, 0)
    counter = r.withColumn("inside", F.sum("rain").over(inside)).join(hours, ["sensor", "h"]).select("sensor", "at_ms", "h", (F.col("before") + F.col("inside")).alias("counter"))
    g = counter_grid(counter, counter="counter", max_empty=240, cell="h")
    return g.select("sensor", F.col("cell").alias("hour"), "state", "cells", "readings", F.round("increment", 4).alias("increment"), "resets")


def p3_steady(spark: SparkSession, d: str) -> DataFrame:
    """The values that limits and runs alone tell: impossible and stuck ones."""
    return p3_report(spark, d).filter("kind <> 'spike'")


QUERIES = {"p1_found": p1_found, "p1_rolling": p1_rolling, "p3_found": p3_found, "p3_report": p3_report, "p3_steady": p3_steady, "p5_found": p5_found, "p5_grid": p5_grid, "p5_rain_counter": p5_rain_counter}

_LIVE = """live AS (
  SELECT sensor, at_ms, temp_c_tenths, rain_mm_tenths, wind_mph_tenths, sum(__w)::BIGINT AS n
  FROM readings WHERE sensor IS NOT NULL AND at_ms IS NOT NULL
  GROUP BY ALL HAVING sum(__w) > 0)"""

_ROLLED = f"""{_LIVE},
daily AS (
  SELECT sensor, CAST(floor(at_ms / 86400000) AS BIGINT) AS day, count(*) AS n,
         sum(greatest(coalesce(rain_mm_tenths, 0), 0))::BIGINT AS total
  FROM live GROUP BY ALL),
nexts AS (SELECT *, lead(day) OVER (PARTITION BY sensor ORDER BY day) AS nd FROM daily),
cal AS (
  SELECT sensor, day, true AS active, n AS rows, total FROM daily
  UNION ALL
  SELECT sensor, unnest(range(day + 1, CASE WHEN nd - day <= 40 THEN nd ELSE LEAST_END END)) AS day, false, 0, 0 FROM nexts WHERE nd - day > 1),
rolled AS (
  SELECT sensor, day, active, rows,
    sum(total) OVER (PARTITION BY sensor ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS total_7,
    sum(total) OVER (PARTITION BY sensor ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS total_30
  FROM cal)"""

_HOURS = f"""{_LIVE},
cells AS (
  SELECT sensor, CAST(floor(at_ms / 3600000) AS BIGINT) AS hour, min(at_ms) AS ta, max(at_ms) AS tz, count(*) AS c, sum(n)::BIGINT AS s
  FROM live GROUP BY ALL),
edges AS (
  SELECT *, lag(tz) OVER w AS pz, lead(ta) OVER w AS na, lead(hour) OVER w AS nh FROM cells WINDOW w AS (PARTITION BY sensor ORDER BY hour))"""

_FIELD = """SELECT sensor, at_ms, '{0}' AS field, {0}::DOUBLE AS v, {1} AS possible, {2} AS zero_ok,
    row_number() OVER (PARTITION BY sensor ORDER BY at_ms, temp_c_tenths NULLS LAST, rain_mm_tenths NULLS LAST, wind_mph_tenths NULLS LAST) AS p FROM live WHERE {0} IS NOT NULL"""
_STEADY = " UNION ALL ".join(_FIELD.format(*x) for x in (("temp_c_tenths", "temp_c_tenths BETWEEN -900 AND 600", "false"), ("rain_mm_tenths", "rain_mm_tenths BETWEEN 0 AND 3050", "true"), ("wind_mph_tenths", "wind_mph_tenths BETWEEN 0 AND 2540", "true")))

_COUNTER = f"""{_LIVE},
rain AS (SELECT sensor, at_ms AS t, greatest(coalesce(rain_mm_tenths, 0), 0) AS rain FROM live),
readings_of AS (SELECT sensor, t, (sum(rain) OVER (PARTITION BY sensor, t // 86400000 ORDER BY t, rain ROWS UNBOUNDED PRECEDING))::DOUBLE AS c FROM rain),
steps AS (SELECT *, lead(t) OVER w AS nt, lead(c) OVER w AS nc FROM readings_of WINDOW w AS (PARTITION BY sensor ORDER BY t, c)),
moves AS (SELECT sensor, t, nt, t // 3600000 AS a, nt // 3600000 AS z, CASE WHEN nc < c THEN nc ELSE nc - c END AS inc, CASE WHEN nc < c THEN 1 ELSE 0 END AS reset FROM steps WHERE nt IS NOT NULL),
pieces AS (SELECT *, unnest(range(a, z + 1)) AS cell FROM moves WHERE z - a - 1 <= 240
  UNION ALL SELECT *, unnest([a, z]) FROM moves WHERE z - a - 1 > 240),
parts AS (SELECT sensor, cell, CASE WHEN nt = t THEN inc ELSE inc * (least((cell + 1) * 3600000, nt) - greatest(cell * 3600000, t))::DOUBLE / (nt - t) END AS part, CASE WHEN cell = z THEN reset ELSE 0 END AS reset FROM pieces),
gained AS (SELECT sensor, cell, sum(part) AS inc, sum(reset)::BIGINT AS resets FROM parts GROUP BY ALL),
seen AS (SELECT sensor, t // 3600000 AS cell, count(*) AS n FROM readings_of GROUP BY ALL),
cells AS (SELECT sensor, cell, coalesce(n, 0) AS n, coalesce(inc, 0) AS inc, coalesce(resets, 0) AS resets FROM seen FULL JOIN gained USING (sensor, cell))"""

ORACLE = {
    "p3_steady": f"""WITH {_LIVE}, f AS ({_STEADY}),
r AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY sensor, field ORDER BY p) THEN 1 ELSE 0 END AS new FROM f),
g AS (SELECT *, sum(new) OVER (PARTITION BY sensor, field ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM r),
l AS (SELECT *, count(*) OVER (PARTITION BY sensor, field, run) AS len FROM g),
k AS (SELECT sensor, field, count(*) AS n, count(*) FILTER (short) AS rest, count(*) FILTER (short AND new = 0) AS same, count(DISTINCT v) AS kinds
  FROM (SELECT *, len < 12 AND NOT (zero_ok AND v = 0) AS short FROM l) GROUP BY ALL)
SELECT sensor, at_ms, field, CASE WHEN possible THEN 'stuck' ELSE 'impossible' END AS kind, v AS value FROM l JOIN k USING (sensor, field)
WHERE NOT possible OR (len >= 12 AND NOT (zero_ok AND v = 0) AND n * power(CASE WHEN rest > 12 THEN same / (rest - 1.0) ELSE 0 END, len - 1) < 0.01 AND NOT (rest <= 12 AND kinds = 1))""",
    "p5_rain_counter": f"""WITH {_COUNTER}
SELECT sensor, cell AS hour, CASE WHEN n > 0 THEN 'observed' ELSE 'filled' END AS state, 1::BIGINT AS cells, n AS readings, round(inc, 4) AS increment, resets FROM cells
UNION ALL SELECT sensor, a + 1, 'uncovered', z - a - 1, 0, round(inc * ((z - a - 1) * 3600000)::DOUBLE / (nt - t), 4), 0 FROM moves WHERE z - a - 1 > 240""",
    "p1_found": f"""WITH {_ROLLED.replace("LEAST_END", "day + 1")}
SELECT sensor, day, 7::INT AS period_days FROM rolled WHERE NOT active AND total_7 > 0
UNION ALL SELECT sensor, day, 30::INT FROM rolled WHERE NOT active AND total_30 > 0""",
    "p1_rolling": f"""WITH {_ROLLED.replace("LEAST_END", "least(nd, day + 30)")}
SELECT sensor, day, active, rows, total_7, round(total_7 / 7.0, 6)::DOUBLE AS avg_7, total_30, round(total_30 / 30.0, 6)::DOUBLE AS avg_30 FROM rolled""",
    "p5_found": f"""WITH {_HOURS}
SELECT sensor, unnest(range(hour + 1, nh)) AS hour FROM edges WHERE nh - hour - 1 BETWEEN 1 AND 240""",
    "p5_grid": f"""WITH {_HOURS}
SELECT sensor, hour, 'observed' AS state, 1::BIGINT AS cells, c AS readings, s AS samples,
  round((c - 1)::DOUBLE + coalesce((ta - hour * 3600000)::DOUBLE / (ta - pz) * CASE WHEN pz < hour * 3600000 THEN 1 ELSE 0 END, 0)
    + coalesce(((hour + 1) * 3600000 - tz)::DOUBLE / (na - tz), 0), 4) AS increment FROM edges
UNION ALL
SELECT sensor, h AS hour, 'filled', 1, 0, 0, round(3600000::DOUBLE / (na - tz), 4) FROM (SELECT sensor, unnest(range(hour + 1, nh)) AS h, na, tz FROM edges WHERE nh - hour - 1 BETWEEN 1 AND 240)
UNION ALL
SELECT sensor, hour + 1, 'uncovered', nh - hour - 1, 0, 0, round((nh - hour - 1) * 3600000::DOUBLE / (na - tz), 4) FROM edges WHERE nh - hour - 1 > 240""",
}
