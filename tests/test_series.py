"""Rolling totals, regular grids and implausible values against brute force and on awkward input."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tarnflow.functions.robust_ar import additive_outliers
from tarnflow.operators.readings import DAY_MS, HOUR_MS, live_rows
from tarnflow.operators.regular_grid import counter_grid
from tarnflow.operators.rolling import inactive_days_with_total, rolling_totals
from tarnflow.operators.spikes import WEATHER, _reach, implausible, judge
from tarnflow.plans.series_queries import p5_rain_counter

SCHEMA = "sensor string, at_ms bigint, temp_c_tenths int, rain_mm_tenths int, wind_mph_tenths int, __w bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_live_rows_counts_copies_nulls_and_withdrawals(spark, rows):
    df = table(spark, [("a", 1, 5, None, 7, 1), ("a", 1, 5, None, 7, 1), ("a", 2, 5, 1, 7, 1), ("a", 2, 5, 1, 7, -1), (None, 3, 1, 1, 1, 1), ("a", None, 1, 1, 1, 1), ("a", 4, 1, 1, 1, None), ("b", 9, None, None, None, 1)])
    assert rows(live_rows(df)) == [("a", 1, 5, None, 7, 2), ("b", 9, None, None, None, 1)]


def brute_rolling(data, periods, gap):
    by = defaultdict(lambda: defaultdict(list))
    for k, t, v in data:
        if k is not None and t is not None:
            by[k][t // DAY_MS].append(max(v or 0, 0))
    out = []
    for k, days in by.items():
        active = sorted(days)
        all_days = set(active)
        for a, b in zip(active, active[1:]):
            if b - a <= gap:
                all_days |= set(range(a, b))
        for d in all_days:
            out.append((k, d, d in days, len(days.get(d, [])), *(x for p in periods for x in [sum(sum(days.get(e, [])) for e in range(d - p + 1, d + 1))])))
    return sorted(out, key=repr)


def test_rolling_totals_match_brute_force(spark, rows):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.choice([None, *(r.randrange(-5, 120) * DAY_MS + r.randrange(DAY_MS) for _ in range(9))]), r.choice([None, -7, 0, 3, 12])) for _ in range(120)]
    df = spark.createDataFrame([(k, t, v, 1, 2) for k, t, v in data], "sensor string, at_ms bigint, rain_mm_tenths int, day int, total int")
    got = rolling_totals(df, periods=(7, 30), max_gap_days=20)
    assert rows(got.select("sensor", "day", "active", "rows", "total_7", "total_30")) == brute_rolling(data, (7, 30), 20)
    assert all(abs(x.avg_7 - x.total_7 / 7) < 1e-9 for x in got.collect())


def test_rolling_gap_limit_and_empty(spark, rows):
    df = spark.createDataFrame([("a", 0, 5), ("a", 40 * DAY_MS, 0), ("a", 81 * DAY_MS, 0)], "sensor string, at_ms bigint, rain_mm_tenths int")
    r = rolling_totals(df)
    assert r.filter("not active").count() == 39
    found = rows(inactive_days_with_total(r, "sensor", (7, 30)))
    assert [x for x in found if x[2] == 7] == [("a", d, 7) for d in range(1, 7)]
    assert len([x for x in found if x[2] == 30]) == 29
    assert rows(rolling_totals(df.limit(0))) == []


def brute_counter(readings, cell, max_empty):
    """Cell -> (readings, increment) of one key, by walking every pair of readings."""
    readings = sorted(readings)
    cells = defaultdict(lambda: [0, 0.0])
    for t, _ in readings:
        cells[t // cell][0] += 1
    for (t1, c1), (t2, c2) in zip(readings, readings[1:]):
        inc = c2 - c1 if c2 >= c1 else c2
        a, b = t1 // cell, t2 // cell
        if a == b:
            cells[a][1] += inc
        else:
            for x in range(a, b + 1):
                cells[x][1] += inc * (min(t2, (x + 1) * cell) - max(t1, x * cell)) / (t2 - t1)
    return cells


def test_counter_grid_resets_and_shares(spark):
    r = random.Random(3)
    data, t, c = [], 5, 0.0
    for _ in range(200):
        t += r.choice([1, 7, 30, 90, 260])
        c = r.choice([c + 1, c + 5.5, c, 2.0 if r.random() < 0.2 else c + 3])
        data.append((t, c))
    df = spark.createDataFrame([("s", t, c, "x") for t, c in data] + [(None, 1, 1.0, "x"), ("s", None, 1.0, "x"), ("s", 3, None, "x")], "sensor string, at_ms bigint, total double, cell string")
    got = {x.cell: x for x in counter_grid(df, counter="total", cell_ms=50, max_empty=3).collect()}
    want = brute_counter(data, 50, 3)
    assert sum(x.increment for x in got.values()) == pytest.approx(sum(v[1] for v in want.values()))
    for cell, x in got.items():
        if x.state == "uncovered":
            assert x.cells > 3 and x.increment == pytest.approx(sum(want[c][1] for c in range(cell, cell + x.cells)))
        else:
            assert (x.readings, x.increment) == (want[cell][0], pytest.approx(want[cell][1]))
    assert sum(x.resets for x in got.values()) == sum(b[1] < a[1] for a, b in zip(data, data[1:]))


def test_counted_grid_marks_every_hour(spark, rows):
    df = spark.createDataFrame([("a", 0, 2), ("a", 10, 1), ("a", 3 * HOUR_MS, 1), ("a", 300 * HOUR_MS, 1), ("b", 5, 1)], "sensor string, at_ms bigint, n int")
    g = counter_grid(df, count="n")
    assert rows(g.select("cell", "state", "cells", "samples").filter("sensor = 'a'")) == [(0, "observed", 1, 3), (1, "filled", 1, 0), (2, "filled", 1, 0), (3, "observed", 1, 1), (300, "observed", 1, 1), (4, "uncovered", 296, 0)]
    assert g.filter("sensor = 'b'").count() == 1
    assert g.agg({"increment": "sum"}).first()[0] == pytest.approx(3)
    assert rows(counter_grid(df.limit(0), count="n")) == []


def weather(n, seed=0):
    r = np.random.default_rng(seed)
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.9 * e[i - 1] + r.normal(0, 2)
    return np.round(120 + 40 * np.sin(np.arange(n) / 23) + e)


def test_additive_outliers_but_no_level_shifts():
    y = weather(600)
    y[100] += 150
    y[200:204] -= 170
    y[400:] += 90
    found = additive_outliers(y)
    assert [(a, b) for a, b, j in found if abs(j) > 80] == [(100, 101), (200, 204)]
    assert additive_outliers(np.zeros(0)) == [] and additive_outliers(np.array([1.0, 2, 3])) == []


def test_judge_kinds():
    y = weather(500, 2)
    t = np.arange(500) * 600_000
    y[50], y[51], y[120:140], y[300], y[310] = -9999, np.nan, 111, 500, 32767
    kind = judge(t, y, WEATHER[0])
    assert set(np.flatnonzero(kind)) == {50, 310, 300, *range(120, 140)}
    assert kind[50] == 1 and kind[120] == 2 and kind[300] == 3
    rain = np.zeros(500)
    rain[100:130] = np.random.default_rng(0).integers(1, 60, 30)
    rain[250], rain[260], rain[400:420] = 700, -1, 4
    kind = judge(t, rain, WEATHER[1])
    assert set(np.flatnonzero(kind)) == {250, 260, *range(400, 420)}
    assert not judge(t, np.full(500, np.nan), WEATHER[0]).any()
    assert not judge(t, np.full(500, 33.0), WEATHER[0]).any()
    assert not judge(t[:3], np.array([1.0, 400, 2]), WEATHER[0]).any()


def test_blocks_give_what_the_whole_series_gives(spark, rows):
    y = weather(3000, 5)
    for i in (7, 511, 512, 700, 1499, 2999 - 40):
        y[i] += 200
    y[1018:1040] = 77
    data = [("s", i * 60_000, int(v), None, 0, 1) for i, v in enumerate(y)] + [("t", i * 3_600_000, int(v), 0, None, 1) for i, v in enumerate(weather(300, 6))] + [(None, 1, 9999, 1, 1, 1), ("s", None, 9999, 1, 1, 1)]
    df = table(spark, data)
    whole = rows(implausible(df, block=10_000).select("sensor", "at_ms", "field", "kind"))
    cut = rows(implausible(df, block=256).select("sensor", "at_ms", "field", "kind"))
    assert {x[1] // 60_000 for x in whole if x[0] == "s"} == {7, 511, 512, 700, 1499, 2959, *range(1018, 1040)}
    assert cut == whole
    assert rows(implausible(df.limit(0))) == []


def test_reach_is_one_rule_for_short_and_long_sources(spark, rows):
    r = np.random.default_rng(4)
    wind = np.round(60 + 20 * np.sin(np.arange(3000) / 40) + r.normal(0, 6, 3000))
    spikes = set(range(50, 3000, 75))
    for i in spikes:
        wind[i] = 1500 + i % 7 * 100
    wind[1200:1260] = 800
    data = [("s", i * 60_000, None, None, int(v), 1) for i, v in enumerate(wind)]
    # repeated and withdrawn rows tell nothing about what the source reaches
    data += [("s", 10 * 60_000, None, None, int(wind[10]), 1)] * 900 + [("s", i * 60_000 + 7, None, None, 2400, w) for i in range(60) for w in (1, -1)]
    df = table(spark, data)
    found = [rows(implausible(df, live_rows(df), block=b).select("at_ms", "field", "kind")) for b in (20_000, 256)]
    assert found[0] == found[1]
    assert {t // 60_000 for t, _, kind in found[1] if kind == "spike"} == spikes - set(range(1200, 1260))
    assert len([1 for x in found[1] if x[2] == "stuck"]) >= 59
    v = np.concatenate([r.integers(0, 90, 5000), [900, 950, 2000, 2000]]).astype(float)
    assert _reach(*np.unique(v, return_counts=True)) == np.sort(v)[::-1][4:][int(0.005 * 4999)]


def test_rain_counter_grids_every_reading(spark, tmp_path):
    r = random.Random(8)
    data = {t: r.choice([None, -4, 0, 0, 5, 40]) for t in (r.randrange(3 * DAY_MS) for _ in range(150))}
    table(spark, [("a", t, 1, v, 2, 1) for t, v in data.items()] + [("a", 7, 1, 9, 2, -1)]).write.parquet(str(tmp_path / "readings.parquet"))
    counter, day, total = [], None, 0
    for t, v in sorted(data.items()):
        total = max(v or 0, 0) + (total if t // DAY_MS == day else 0)
        day = t // DAY_MS
        counter.append((t, total))
    want = brute_counter(counter, HOUR_MS, 240)
    got = {x.hour: x for x in p5_rain_counter(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert {h: (x.readings, x.increment) for h, x in got.items()} == {h: (n, pytest.approx(v, abs=1e-3)) for h, (n, v) in want.items()}
    assert sum(x.resets for x in got.values()) == sum(b[1] < a[1] for a, b in zip(counter, counter[1:]))


def test_long_stuck_runs_are_found_at_any_block_size(spark, rows):
    y = weather(30_000, 11)
    y[4_000:24_000] = 131
    y[25_000] += 300
    steady = [("steady", i * 60_000, 55, 7, 0, 1) for i in range(3_000)]
    df = table(spark, [("s", i * 60_000, int(v), None, None, 1) for i, v in enumerate(y)] + steady)
    got = [rows(implausible(df, block=b)) for b in (100_000, 8192, 1000)]
    assert got[0] == got[1] == got[2]
    assert {(x[1] // 60_000, x[3]) for x in got[0]} == {(i, "stuck") for i in range(4_000, 24_000)} | {(25_000, "spike")}


@pytest.mark.parametrize("n", [6, 12, 20, 50, 200])
def test_short_clean_series_have_no_spikes(n):
    wrong = 0
    for seed in range(100):
        r = np.random.default_rng(seed)
        t = np.arange(n) * 600_000
        y = np.round(150 + 60 * np.sin((t / DAY_MS + r.random()) * 2 * np.pi) + r.normal(0, 8, n))
        wrong += judge(t, y, WEATHER[0]).any()
    assert wrong == 0


def test_a_gross_spike_in_few_readings_is_found():
    y = np.array([150, 152, 149, 151, 150, 550, 153, 151, 150, 149, 152.0])
    assert list(np.flatnonzero(judge(np.arange(11) * 600_000, y, WEATHER[0]))) == [5]
    wind = np.array([40, 60, 0, 20, 55, 61, 2400, 30, 20, 10, 44.0])
    assert list(np.flatnonzero(judge(np.arange(11) * 600_000, wind, WEATHER[2]))) == [6]


def test_dense_days_and_blocks_agree(spark, rows):
    y = weather(12_000, 3)
    for i in (40, 3000, 5999, 6000, 9001):
        y[i] += 250
    y[7000:7030] = 90
    df = table(spark, [("s", i * 5_000, int(v), None, 0, 1) for i, v in enumerate(y)])  # less than a day
    got = [rows(implausible(df, block=b).select("at_ms", "kind")) for b in (50_000, 3000)]
    assert got[0] == got[1] and {t // 5000 for t, _ in got[0]} == {40, 3000, 5999, 6000, 9001, *range(7000, 7030)}


def test_fields_of_real_numbers_and_other_key_types(spark):
    from tarnflow.operators.spikes import Field

    v = [20 + (i * 7 % 11) / 7 for i in range(400)]
    v[100], v[300] = 500.25, float("nan")
    df = spark.createDataFrame([(1, i * 1000, x, "x") for i, x in enumerate(v)], "k int, t bigint, load double, field string")
    f = Field("load", 0, 1000, "size", 50, 0.05, 100)
    got = implausible(df, key="k", at="t", fields=[f]).collect()
    assert [(r.k, r.t, r.kind, r.value) for r in got] == [(1, 100_000, "spike", 500.25)]


def test_days_after_which_a_pause_goes_on_have_totals_too(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 100 * DAY_MS, 1), ("a", 145 * DAY_MS, 0), ("b", 10**15, 2), ("b", 0, 3)], "sensor string, at_ms bigint, rain_mm_tenths int")
    r = rolling_totals(df, long_pauses=True)
    got = {(x.sensor, x.day): x.total_30 for x in r.filter("not active").collect()}
    assert got == {("a", d): 5 for d in range(1, 30)} | {("a", d): 1 for d in range(101, 130)} | {("b", d): 3 for d in range(1, 30)}
    assert rolling_totals(df).filter("not active").count() == 0
