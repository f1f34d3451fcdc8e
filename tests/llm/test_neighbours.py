import numpy as np

from tarnflow.llm.neighbours import balanced_parts, fit_router, nearest, pairs, similar, usable


def exact(base, queries, k=10):
    out = {}
    for q, v in queries.items():
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in base.items() if i != q or queries is not base)
        out[q] = [i for _, i in d[:k]]
    return out


def clustered(n, dim=8, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(0, 3, (20, dim))
    return np.round(c[r.integers(0, 20, n)] + r.normal(0, 1, (n, dim)), 3).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, val array<float>, id string, part int").repartition(3)


def test_recall_with_many_parts(spark):
    x = clustered(900)
    base = {i: [float(a) for a in v] for i, v in enumerate(x)}
    got = {}
    for r in similar(frame(spark, base.items()), dim=8, part_rows=60, train=400).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.near_id
    want = exact(base, base)
    assert all(sorted(v) == list(range(1, 11)) for v in got.values()) and len(got) == 900
    assert sum(len(set(want[i]) & set(got[i].values())) for i in want) / 9000 >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(i, a) for i in range(1, 16)] + [(20, b), (21, [5.0, 5.0]), (20, b), (22, None), (23, [1.0]), (24, [1.0, None]), (25, [float("nan"), 1.0]), (26, [float("inf"), 1.0]), (27, [0.0, 0.0]), (None, a)]
    base = frame(spark, rows)
    assert usable(base, "vec_id", "val", 2).count() == 17
    got = {}
    for r in similar(base, dim=2).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.near_id)
    live = {i: v for i, v in rows[:17]}
    assert got == exact(live, live)
    p = {tuple(r) for r in pairs(similar(base, dim=2)).collect()}
    assert p == {(min(i, j), max(i, j)) for i, js in exact(live, live).items() for j in js}
    q = spark.createDataFrame([(7, a), (8, None)], "query_id bigint, val array<float>")
    assert [r.near_id for r in similar(base, q, dim=2).orderBy("rank").collect()] == list(range(1, 11))
    assert similar(base.limit(0), dim=2).count() == 0


def test_large_parts_are_searched_in_blocks(spark, monkeypatch):
    from tarnflow.llm import neighbours as n

    monkeypatch.setattr(n, "BLOCK", 50)
    monkeypatch.setattr(n, "QUERIES", 70)
    x = clustered(300, seed=4)
    base = {i: [float(a) for a in v] for i, v in enumerate(x)}
    got = {}
    for r in similar(frame(spark, base.items()), dim=8).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.near_id
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == exact(base, base)


def test_parts_are_balanced_and_follow_the_graph(spark):
    x = clustered(600, seed=9)
    g = nearest(x, x, 9)
    p = balanced_parts(x, g, 8)
    assert np.bincount(p, minlength=8).max() <= np.ceil(1.1 * 600 / 8)
    kept = (p[g] == p[:, None]).mean()
    assert kept > 0.5 > (np.random.default_rng(0).permutation(p)[g] == p[:, None]).mean()
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<float>")
    router, parts = fit_router(df, 600, part_rows=75)
    assert parts == 8 and router.probabilities(x).shape == (600, 8) and np.allclose(router.probabilities(x).sum(1), 1, atol=1e-4)


def test_two_levels_of_parts(spark, monkeypatch):
    from tarnflow.llm import neighbours as n

    monkeypatch.setattr(n, "FLAT", 4)
    x = clustered(2400, seed=3)
    base = {i: [float(a) for a in v] for i, v in enumerate(x)}
    vectors = frame(spark, base.items()).selectExpr("vec_id as id", "val as v")
    routes = n.fit_routes(vectors, 2400, train=800, part_rows=40)
    leaves = sum(k for k, _ in routes.below.values())
    assert routes.top.parts == 8 and 40 <= leaves <= 75
    at, part = routes.send(x, n.MASS, n.LEAST, n.MOST)
    assert set(at) == set(range(2400)) and 0 <= part.min() and part.max() < leaves and np.bincount(at).max() <= n.MOST
    assert len(set(zip(at.tolist(), part.tolist()))) == len(at)
    own, home = routes.send(x, 0.0, 1, 1)
    assert (own == np.arange(2400)).all() and len(set(home)) > 20
    got = {}
    for r in similar(frame(spark, base.items()), dim=8, part_rows=40, train=800).collect():
        got.setdefault(r.id, set()).add(r.near_id)
    some = {i: base[i] for i in range(0, 2400, 12)}
    want = {i: [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in base.items() if j != i)[:10]] for i, v in some.items()}
    assert all(len(v) == 10 for v in got.values()) and len(got) == 2400
    assert sum(len(set(want[i]) & got[i]) for i in want) / (10 * len(want)) >= 0.9


def test_small_collections_are_parted_too():
    from tarnflow.llm.neighbours import part_count

    assert [part_count(c) for c in (0, 50, 199, 200, 991, 10_000, 100_000, 10_000_000)] == [1, 1, 1, 2, 8, 8, 50, 5000]


def test_copies_of_a_common_value_are_spread(spark, monkeypatch):
    from tarnflow.llm import neighbours as n

    monkeypatch.setattr(n, "COPIES", 7)
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 3.0]) for i in range(30)]
    got = {}
    for r in similar(frame(spark, rows), dim=2).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.near_id)
    live = dict(rows)
    assert got == exact(live, live)
