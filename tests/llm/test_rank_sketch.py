import math
import random

import numpy as np
import pytest

from tarnflow.llm.rank_sketch import RankSketch, build_sketches, merge_sketches, percentiles

QS = [0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999]


def off(x, v, q):
    """How far a value's rank is from q, as a share of the nearer tail."""
    lo, hi = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
    return max(0.0, lo - q, q - hi) / min(q, 1 - q)


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "sorted"])
def test_error_stays_in_bound_after_merging(kind):
    r = np.random.default_rng(3)
    x = {"normal": r.normal(size=200_000), "heavy": r.pareto(0.7, 200_000), "ties": r.integers(0, 50, 200_000).astype(float), "sorted": np.arange(200_000.0)}[kind]
    parts = [RankSketch().add(p) for p in np.array_split(x, 37)]
    whole = RankSketch.from_bytes(parts[0].to_bytes())
    for p in parts[1:]:
        whole.merge(RankSketch.from_bytes(p.to_bytes()))
    assert whole.n == len(x) and len(whole.to_bytes()) < 120_000
    x = np.sort(x)
    for q, v in zip(QS, whole.quantiles(QS)):
        assert off(x, v, q) <= whole.error(q) / min(q, 1 - q) + 1 / (len(x) * min(q, 1 - q)), (q, v)
    assert whole.quantiles([0, 1]) == [x[0], x[-1]]


def test_small_sets_are_exact_and_roundtrip():
    s = RankSketch().add(np.array([3.0, 1, 2, np.nan]))
    assert s.n == 3 and s.quantiles([0, 0.34, 0.5, 1]) == [1, 2, 2, 3] and s.error(0.5) == 0
    assert math.isnan(RankSketch().quantiles([0.5])[0])
    e = RankSketch.from_bytes(RankSketch().to_bytes())
    assert e.merge(s).quantiles([0.5]) == [2] and s.merge(RankSketch()).n == 3
    big = RankSketch().add(np.arange(5000.0))
    assert RankSketch.from_bytes(big.to_bytes()).quantiles(QS) == big.quantiles(QS)
    small = RankSketch().add(np.arange(10.0))
    assert small.merge(big).n == 5010 and small.quantiles([1]) == [4999]


def test_many_merges_keep_the_seed_in_its_bytes():
    s = RankSketch().add(np.arange(1000.0))
    for i in range(200):
        s.merge(RankSketch().add(np.arange(400.0) + i))
        s = RankSketch.from_bytes(s.to_bytes())
        assert 0 <= s.high.seed < 2**64 and 0 <= s.low.seed < 2**64
    assert s.n == 81_000


def test_tables(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, r.randrange(1000)]), float("nan") if r.random() < 0.1 else r.gauss(0, 1)) for _ in range(6000)] + [("z", 0, None, None)]
    df = spark.createDataFrame(data, "k string, day int, x int, y double").repartition(5)
    days = merge_sketches(build_sketches(df, ["k", "day"], ["x", "y"], hold=500), ["k", "day"])
    for keys, of in ((["k"], lambda d: d[0]), ([], lambda d: 0)):
        got = percentiles(merge_sketches(days, keys, spread=3), [0.5, 0.95], keys).collect()
        for g in got:
            x = np.sort([d[2 if g.field == "x" else 3] for d in data if (not keys or d[0] == g.k) and d[2 if g.field == "x" else 3] is not None and not math.isnan(d[2 if g.field == "x" else 3])])
            assert g.n == len(x) and off(x, g.value, g.q) * min(g.q, 1 - g.q) <= g.rank_error + 1 / len(x) and g.lower <= g.value <= g.upper
        assert len(got) == 4 * (3 if keys else 1)
    assert percentiles(merge_sketches(build_sketches(df.limit(0), ["k"], ["x"]), ["k"]), [0.5], ["k"]).count() == 0
