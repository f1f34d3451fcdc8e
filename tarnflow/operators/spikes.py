"""Implausible values of measurements: spikes, stuck runs and physically impossible readings, per source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.robust_ar import additive_outliers, fit_steps, runs
from tarnflow.operators.readings import DAY_MS
from tarnflow.session import cut, small


@dataclass(frozen=True)
class Field:
    """How one measured field is judged.

    ``least`` and ``most`` are the physical limits. ``scale`` 'level' compares a spike with what the source reaches
    around that time; 'size' (quantities from 0 upwards with bursts of their own, such as rain and gusts) works on
    logarithms and compares with a multiple of what the source reaches in general. ``steady_zero`` is set where a
    lasting 0 is ordinary. ``floor`` is the smallest deviation (level) or value (size) that can count as a spike.
    ``step`` is the change from one reading to the next (of the logarithm for sizes) and ``unsure`` the deviation or
    value that has to be granted to a source as long as it has too few readings to tell by itself.
    """

    name: str
    least: float
    most: float
    scale: str
    floor: float
    step: float
    unsure: float
    steady_zero: bool = False


#: Limits are the world records of air temperature, of rain within an hour and of gusts, rounded outwards.
WEATHER = (
    Field("temp_c_tenths", -900, 600, "level", 15, 10, 80),
    Field("rain_mm_tenths", 0, 3050, "size", 100, 0.05, 400, True),
    Field("wind_mph_tenths", 0, 2540, "size", 100, 0.05, 600, True),
)

STUCK = 12
#: Readings of a source below which no spikes are looked for; below ENOUGH it is granted ``unsure`` in part.
LEAST, ENOUGH = 5, 200
#: Readings that a fit needs, and the number of readings that ``step`` counts for.
FIT, PRIOR = 60, 50
#: What a level is compared with: the values within this time, but at least and at most so many on either side.
AROUND_MS = 3 * DAY_MS
AROUND_ROWS, AROUND_MOST = 100, 4096
TIMES_REACH = 2.6


@dataclass
class Source:
    """What is known of one field of a source, from all its values.

    ``n`` values, of which a share ``same`` equals its predecessor (long runs aside); ``steady`` if there is but one
    value; ``model`` as from ``fit_steps``, None with too few values; ``reach`` as from ``_reach``.
    """

    n: int = 0
    same: float = 0.0
    steady: bool = True
    model: tuple[float, float] | None = None
    reach: float = 0.0

    def scale(self, f: Field) -> float:
        """The scale of the one-step residuals, drawn to ``f.step`` while there are few."""
        if self.model is None:
            return f.step
        return float(np.sqrt((self.n * self.model[1] ** 2 + PRIOR * f.step**2) / (self.n + PRIOR)))

    def grant(self, f: Field) -> float:
        return f.unsure * max(0.0, 1 - self.n / ENOUGH)


def _fit(v: np.ndarray, f: Field) -> tuple[float, float] | None:
    y = v[(v >= f.least) & (v <= f.most)]
    if len(y) < FIT:
        return None
    return fit_steps(y if f.scale == "level" else np.log(np.maximum(y, 0) + f.floor / TIMES_REACH))


def _shares(values: np.ndarray, lengths: np.ndarray, f: Field) -> tuple[int, int]:
    """Of runs of equal values: the values in short ones, and those of them that equal their predecessor."""
    short = (lengths < STUCK) & ((values != 0) | (not f.steady_zero))
    return int(lengths[short].sum()), int((lengths[short] - 1).sum())


def _plain(values: np.ndarray, lengths: np.ndarray, f: Field) -> np.ndarray:
    """Runs whose values tell what the source reaches: possible, and not too long."""
    return (values >= f.least) & (values <= f.most) & ((lengths < STUCK) | ((values == 0) & f.steady_zero))


def _known(n: int, rest: int, same: int, least: float, most: float, model: tuple[float, float] | None, reach: float) -> Source:
    return Source(n, same / (rest - 1) if rest > STUCK else 0.0, rest <= STUCK and least == most, model, reach)


def _of_series(v: np.ndarray, f: Field) -> Source:
    """The same from a whole series without missing values."""
    if not len(v):
        return Source()
    length, number = runs(v)
    at = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
    values, lengths = v[at], length[at]
    keep = _plain(values, lengths, f)
    each, where = np.unique(values[keep], return_inverse=True)
    reach = _reach(each, np.bincount(where, lengths[keep]).astype(int)) if len(each) else 0.0
    return _known(len(v), *_shares(values, lengths, f), v.min(), v.max(), _fit(v, f), reach)


def _stuck(v: np.ndarray, length: np.ndarray, f: Field, s: Source) -> np.ndarray:
    """Members of runs of at least STUCK equal values that a changing field would hardly produce by chance."""
    long = length >= STUCK
    if f.steady_zero:
        long &= v != 0
    return long & (s.n * s.same ** (length - 1.0) < 0.01) & (not s.steady)


def _reach(v: np.ndarray, n: np.ndarray) -> float:
    """The 99.5 % point of the different values ``v``, each counted ``n`` times, without the few above a wide gap."""
    order = np.argsort(v)[::-1]
    top, end = v[order], np.cumsum(n[order])
    k = min(end[-1] - 1, max(4, end[-1] // 50))
    wide = np.flatnonzero((end[:-1] <= k) & (top[:-1] >= 2.2 * np.maximum(top[1:], 1.0)))
    if len(wide) and top[cut := wide[-1] + 1] > 0:
        top, end = top[cut:], end[cut:] - end[cut - 1]
    return float(top[np.searchsorted(end, int(0.005 * (end[-1] - 1)), "right")])


def _step(f: Field) -> float:
    """The grid on which values are counted: at most 65,536 cells, whole numbers stay as they are."""
    return min(1.0, 2.0 ** np.floor(np.log2((f.most - f.least) / 65_536)))


def _grid(v: np.ndarray, f: Field) -> np.ndarray:
    return np.rint(v / _step(f)) * _step(f)


def _spikes(t: np.ndarray, v: np.ndarray, f: Field, s: Source) -> np.ndarray:
    out = np.zeros(len(v), bool)
    if s.n < LEAST or not len(v):
        return out
    model = (s.model[0] if s.model else 0.0, s.scale(f))
    if f.scale == "size":
        ceiling = max(f.floor + s.grant(f), TIMES_REACH * s.reach)
        high = v > ceiling
        if high.any():
            for i, e, _ in additive_outliers(np.log(v + ceiling / TIMES_REACH), high, cut=2.5, floor=0.05, model=model):
                out[i:e] = high[i:e]
        return out
    patches = additive_outliers(v, model=model)
    inside = np.zeros(len(v), bool)
    for i, e, _ in patches:
        inside[i:e] = True
    for i, e, jump in patches:
        a = max(min(int(np.searchsorted(t, t[i] - AROUND_MS)), max(0, i - AROUND_ROWS)), i - AROUND_MOST)
        b = min(max(int(np.searchsorted(t, t[e - 1] + AROUND_MS)), min(len(t), e + AROUND_ROWS)), e + AROUND_MOST)
        near = v[a:b][~inside[a:b]]
        if not len(near):
            continue
        lo, hi = near.min(), near.max()
        # a jump over most of the range needs to end just outside of it, a smaller one far outside
        margin = max(f.floor, (0.1 if abs(jump) >= 0.75 * (hi - lo) else 0.3) * (hi - lo)) + s.grant(f)
        out[i:e] = (v[i:e] < lo - margin) | (v[i:e] > hi + margin)
    return out


def judge(t: np.ndarray, v: np.ndarray, f: Field, source: Source | None = None, own: np.ndarray | None = None, edges: tuple[int, int] = (0, 0)) -> np.ndarray:
    """For each value in order of time: 0 plausible or missing (NaN), 1 impossible, 2 stuck, 3 spike.

    ``source`` is what is known of the source if ``v`` is only a part of its series; ``edges`` are then the whole
    lengths of the runs that the first and the last of the ``own`` values belong to.
    """
    out = np.zeros(len(v), np.int8)
    here = ~np.isnan(v)
    out[here & ((v < f.least) | (v > f.most))] = 1
    at = np.flatnonzero(here)
    s = _of_series(v[at], f) if source is None else source
    length, number = runs(v[at])
    if own is not None and (mine := np.flatnonzero(own[at])).size:
        for end, whole in ((mine[-1], edges[1]), (mine[0], edges[0])):
            length[number == number[end]] = max(whole, length[end])
    stuck = at[_stuck(v[at], length, f, s)]
    out[stuck[out[stuck] == 0]] = 2
    at = np.flatnonzero(here & (out == 0))
    out[at[_spikes(t[at], v[at], f, s)]] = 3
    return out


KINDS = np.array(["", "impossible", "stuck", "spike"])


def _source_days(df: DataFrame, key: str, at: str, block: int) -> DataFrame:
    """(key, day) -> number of time slices, block, and the neighbouring blocks that the day is context of.

    Sources of at most ``block`` rows are one block and have no rows here.
    """
    per_day = df.select(F.col(key).alias("k"), F.floor(F.col(at) / F.lit(DAY_MS)).cast("bigint").alias("d")).filter("k is not null and d is not null").groupBy("k", "d").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("k").orderBy("d")
    whole = Window.partitionBy("k")
    x = per_day.withColumns({"c1": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(whole)})
    x = x.filter(F.col("total") > block).withColumns({"c0": F.col("c1") - F.col("n"), "m": F.ceil(F.col("n") / F.lit(block)).cast("int")})
    # equal blocks of about `block` rows; days above that are cut into m slices of equal time and form blocks of their own
    per = F.ceil(F.col("total") / F.ceil(F.col("total") / F.lit(block)))
    x = x.withColumn("g", F.when(F.col("m") > 1, -F.col("d") * 2 - 1_000_000_000).otherwise(F.floor(F.col("c0") / per).cast("bigint")))
    x = x.withColumn("g", F.col("g").cast("bigint"))
    g = Window.partitionBy("k", "g")
    x = x.withColumns({"g0": F.min("c0").over(g), "g1": F.max("c1").over(g), "d0": F.min("d").over(g), "d1": F.max("d").over(g)})
    prev, nxt = F.lag(F.struct("g", "m")).over(by), F.lead(F.struct("g", "m")).over(by)
    x = x.withColumns({"p": prev, "q": nxt})
    # the block before and after this day's block: taken from the days at its edges
    first = Window.partitionBy("k", "g").orderBy("d")
    x = x.withColumns({"bp": F.first("p").over(first), "bq": F.first("q").over(Window.partitionBy("k", "g").orderBy(F.desc("d")))})
    # a value is compared with those within AROUND_MS, but at least AROUND_ROWS and at most AROUND_MOST: twice that for outliers among them
    days = AROUND_MS // DAY_MS + 1
    close = lambda rows, dist: (rows < 2 * AROUND_ROWS) | ((rows < AROUND_MOST) & (dist <= days))
    return x.select(
        "k", "d", "m", "g",
        F.when(close(F.col("c0") - F.col("g0"), F.col("d") - F.col("d0")), F.col("bp")).alias("p"),
        F.when(close(F.col("g1") - F.col("c1"), F.col("d1") - F.col("d")), F.col("bq")).alias("q"),
    )


def implausible(
    df: DataFrame,
    live: DataFrame | None = None,
    key: str = "sensor",
    at: str = "at_ms",
    fields: Sequence[Field] = WEATHER,
    block: int = 32_768,
) -> DataFrame:
    """Values a source cannot have measured: (key, at, field, kind, value), kind 'impossible', 'stuck' or 'spike'.

    Each source's series is judged by ``judge``: values beyond the physical limits; runs of at least 12 equal values
    in a field that otherwise changes; and, on what is left, additive outliers of a robust autoregression fitted to
    that source, kept where they lie outside what the source reaches (around that time for levels, in general for
    sizes). Lasting or fading changes fail the additive-outlier test and are no cases.

    Long sources are cut into blocks of about ``block`` readings in order of time (days above that into slices of
    equal time), each with the neighbouring readings that its values are compared with, so that no source is held by one
    task. The table that assigns the days of long sources to blocks is broadcast only if it is small and joined by shuffle
    otherwise.

    All that is judged by is known per source and field, whatever its length and blocks. A first pass over the blocks
    gives their counts of different values, of values that equal their predecessor, their first and last runs and a fit
    of each; these few rows are put together per source: runs that go on from block to block get their whole length,
    the chance of a run is that of the source, the model is the median of the blocks' fits, and the reach is the 99.5 %
    point of the live values that are neither impossible nor in long runs, without the few (at most 2 %) above a wide
    gap. A source with fewer than 200 readings is granted a share of the field's ``unsure`` on top of what it reaches;
    with fewer than 5 no spikes are looked for.

    ``live`` are the readings to judge (default: ``df``), ``df`` the log whose counts size the blocks. Rows with null
    key or time leave; null and NaN values are no cases and interrupt nothing; equal times are ordered by value;
    an empty input gives an empty result; other columns are ignored.
    """
    live = df if live is None else live
    names = [f.name for f in fields]
    days = small(_source_days(df, key, at, block))
    r = live.select(F.col(key).alias("k"), F.col(at).alias("t"), *names).filter("k is not null and t is not null").withColumn("d", F.floor(F.col("t") / F.lit(DAY_MS)).cast("bigint"))
    r = r.join(days, ["k", "d"], "left").withColumns({"m": F.coalesce("m", F.lit(1)), "g": F.coalesce("g", F.lit(0).cast("bigint"))})
    f = (F.col("t") - F.col("d") * DAY_MS) / F.lit(float(DAY_MS)) * F.col("m")
    s = F.floor(f).cast("int")
    part = f - s
    spot = lambda g, i, own: F.struct(g.alias("g"), i.cast("int").alias("s"), F.lit(own).alias("own"))
    one = F.col("m") == 1
    last_of = lambda b: F.col(b)["m"] - 1
    before = F.when(one | ((s == 0) & (part < 0.5)), F.when(F.col("p").isNotNull(), spot(F.col("p")["g"], last_of("p"), False))).when(part < 0.5, spot(F.col("g"), s - 1, False))
    after = F.when(one | ((s == F.col("m") - 1) & (part >= 0.5)), F.when(F.col("q").isNotNull(), spot(F.col("q")["g"], F.lit(0), False))).when(part >= 0.5, spot(F.col("g"), s + 1, False))
    spots = F.explode(F.array(spot(F.col("g"), s, True), before, after)).alias("spot")
    # read twice, for what is known of the sources and for the judgement, but shuffled once
    placed = r.select("k", "t", *names, spots).filter("spot is not null").select("k", "t", *names, "spot.*").repartition("k", "g", "s")
    kind = dict(r.dtypes)["k"]

    def ordered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        tt = group["t"].to_numpy()
        cols = {n: group[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names}
        order = np.lexsort([*(cols[n] for n in reversed(names)), tt])
        return tt[order], group["own"].to_numpy(zero_copy_only=False)[order], {n: c[order] for n, c in cols.items()}

    summary = pa.schema([("g", pa.int64()), ("s", pa.int32()), ("t", pa.int64()), ("field", pa.string()), ("what", pa.string()), ("v", pa.float64()), ("n", pa.int64()), ("rest", pa.int64()), ("same", pa.int64()), ("phi", pa.float64()), ("scale", pa.float64())])

    def count(group: pa.Table) -> pa.Table:
        """Rows of one block: 'value' its different values, 'first' and 'last' its outer runs, 'fit' its counts and fit."""
        t, own, cols = ordered(group)
        g, s = group["g"][0].as_py(), group["s"][0].as_py()
        out: list[tuple] = []
        for f in fields:
            mine = own & ~np.isnan(cols[f.name])
            v = cols[f.name][mine]
            if not len(v):
                continue
            length, number = runs(v)
            at = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
            values, lengths, t0 = v[at], length[at], int(t[mine][0])
            inner = slice(1, -1)
            fit = _fit(v, f)
            out.append((g, s, t0, f.name, "fit", None, len(v), *_shares(values[inner], lengths[inner], f), *(fit or (None, None))))
            out.append((g, s, t0, f.name, "first", values[0], int(lengths[0]), None, None, None, None))
            if len(values) > 1:
                out.append((g, s, t0, f.name, "last", values[-1], int(lengths[-1]), None, None, None, None))
            if f.scale == "size":
                keep = _plain(values[inner], lengths[inner], f)
                each, where = np.unique(_grid(values[inner][keep], f), return_inverse=True)
                out += [(g, s, t0, f.name, "value", x, n, None, None, None, None) for x, n in zip(each.tolist(), np.bincount(where, lengths[inner][keep]).astype(int).tolist() if len(each) else [], strict=True)]
            else:
                out += [(g, s, t0, f.name, "value", x, 0, None, None, None, None) for x in {float(v.min()), float(v.max())}]
        cells = [pa.array(list(c), x.type) for c, x in zip(zip(*out, strict=True), summary, strict=True)] if out else [pa.array([], x.type) for x in summary]
        return pa.table([pa.array([group["k"][0].as_py()] * len(out), group.schema.field("k").type), *cells], schema=summary.insert(0, group.schema.field("k")))

    rows = "g bigint, s int, t bigint, field string, what string, v double, n bigint, rest bigint, same bigint, phi double, scale double"
    seen = cut(placed.groupBy("k", "g", "s").applyInArrow(count, f"k {kind}, {rows}"))
    # runs that go on over blocks: the outer runs in order, those of equal value that follow each other added up
    by = Window.partitionBy("k", "field").orderBy("t", "what")
    outer = seen.filter("what in ('first', 'last')").withColumn("new", F.when((F.col("what") == "last") | ~F.col("v").eqNullSafe(F.lag("v").over(by)), 1).otherwise(0))
    outer = outer.withColumn("run", F.sum("new").over(by)).withColumn("whole", F.sum("n").over(Window.partitionBy("k", "field", "run")))
    joined = outer.groupBy("k", "field", "run").agg(F.first("v").alias("v"), F.max("whole").alias("n"))
    named = lambda value: F.coalesce(*(F.when(F.col("field") == f.name, F.lit(value(f))) for f in fields))
    zero = named(lambda f: f.steady_zero) & (F.col("v") == 0)
    short = (F.col("n") < STUCK) & ~zero
    run_counts = joined.select("k", "field", F.lit(0).cast("bigint").alias("n"), F.when(short, F.col("n")).otherwise(0).alias("rest"), F.when(short, F.col("n") - 1).otherwise(0).alias("same"), F.lit(None).cast("double").alias("phi"), F.lit(None).cast("double").alias("scale"), "v")
    counts = seen.filter("what in ('fit', 'value')").select("k", "field", F.when(F.col("what") == "fit", F.col("n")).otherwise(0).alias("n"), "rest", "same", "phi", "scale", "v").unionByName(run_counts)
    known = counts.groupBy("k", "field").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.sum("same").alias("same"), F.min("v").alias("least"), F.max("v").alias("most"), F.median("phi").alias("phi"), F.median("scale").alias("scale"))

    def reach(group: pa.Table) -> pa.Table:
        return pa.table({"k": group["k"][:1], "field": group["field"][:1], "reach": pa.array([_reach(group["v"].to_numpy(), group["n"].to_numpy())], pa.float64())})

    if any(f.scale == "size" for f in fields):
        grid = named(lambda f: _step(f))
        possible = (F.col("v") >= named(lambda f: float(f.least))) & (F.col("v") <= named(lambda f: float(f.most))) & ((F.col("n") < STUCK) | zero)
        values = joined.filter(possible).select("k", "field", (F.rint(F.col("v") / grid) * grid).alias("v"), "n").unionByName(seen.filter("what = 'value'").select("k", "field", "v", "n"))
        values = values.filter(named(lambda f: f.scale == "size")).groupBy("k", "field", "v").agg(F.sum("n").alias("n"))
        known = known.join(values.groupBy("k", "field").applyInArrow(reach, f"k {kind}, field string, reach double"), ["k", "field"], "left")
    else:
        known = known.withColumn("reach", F.lit(0.0))
    ends = outer.groupBy("k", "g", "s", "field").agg(F.max(F.when(F.col("what") == "first", F.col("whole"))).alias("first"), F.max_by("whole", F.col("what")).alias("last"))
    told = ends.join(known, ["k", "field"]).repartition("k", "g", "s")
    verdict = pa.schema([("t", pa.int64()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.float64())])

    def scan(group: pa.Table, about: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, str, np.ndarray, np.ndarray]] = []
        by_name = {f.name: f for f in fields}
        if group.num_rows and about.num_rows:
            t, own, cols = ordered(group)
            for x in about.to_pylist():
                f, v = by_name[x["field"]], cols[x["field"]]
                model = None if x["phi"] is None else (x["phi"], x["scale"])
                source = _known(x["n"], x["rest"], x["same"], x["least"], x["most"], model, x["reach"] or 0.0)
                kind = judge(t, v, f, source, own, (x["first"], x["last"]))
                hit = np.flatnonzero((kind > 0) & own)
                out.append((t[hit], f.name, KINDS[kind[hit]], v[hit]))
        n = sum(len(x[0]) for x in out)
        cells = [np.concatenate([x[0] for x in out]), [x[1] for x in out for _ in range(len(x[0]))], np.concatenate([x[2] for x in out]).tolist(), np.concatenate([x[3] for x in out])] if n else [[]] * 4
        k = group.schema.field("k")
        return pa.table([pa.array([group["k"][0].as_py()] * n if n else [], k.type), *(pa.array(c, x.type) for c, x in zip(cells, verdict, strict=True))], schema=verdict.insert(0, k))

    found = placed.groupBy("k", "g", "s").cogroup(told.groupBy("k", "g", "s")).applyInArrow(scan, f"k {kind}, t bigint, field string, kind string, value double")
    return found.select(F.col("k").alias(key), F.col("t").alias(at), "field", "kind", "value")
