"""Nodes, views, streams: the facts of the fixtures, and batch = sum of steps over random histories."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.text import tokenize
from tarnflow.operators.search import Bm25, VectorIndex, bm25
from tarnflow.operators.sinks import Bag, Count, Histogram, InvertedIndex, KeyedRanked, Multimap, Ranked, Stats, Table
from tarnflow.operators.stateful import Aggregate, Distinct, KeyedReduce, Retain, TopK
from tarnflow.operators.stateless import Filter, FilterMap, FlatMap, KeyBy, Map, ScoreBy, Unscore
from tarnflow.plans.node import Context, NotDeterministic, Patch, views
from tarnflow.sources.store import StoreError
from tarnflow.sources.tables import read_signed, stream_signed, write_signed
from tarnflow.streaming.stream import KeyedStream, Stream, numbered, run_stream
from tarnflow.zset import W, consolidate, negate, plus, with_weight


def bag(df):
    return {} if df is None else {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}


def history(seed, n=14):
    """Deltas (k, s, v, w, seq) whose counts never go below 0."""
    r, live, out = random.Random(seed), [], []
    for i in range(n):
        if live and r.random() < 0.4:
            row = live.pop(r.randrange(len(live)))
            out.append((*row, -1, i))
        else:
            row = (r.choice(["a", "b", None]), r.randrange(4), r.choice("xyz"))
            live.append(row)
            out.append((*row, 1, i))
    return out


DELTA = "key string, score bigint, val string, __w bigint, __seq bigint"

NODES = {
    "distinct": lambda: Distinct("n") >> Bag("o"),
    "aggregate": lambda: Aggregate("n", total=F.col("score")) >> Bag("o"),
    "reduce": lambda: KeyedReduce("n", lambda a, r, w: {"t": (a["t"] if a else 0) + w * r["score"]}, "t bigint") >> Bag("o"),
    "topk": lambda: TopK("n", 3) >> Bag("o"),
    "bag": lambda: Bag("o"),
    "histogram": lambda: Histogram("o", F.col("score") % 2),
    "ranked": lambda: KeyedRanked("o"),
}


@pytest.mark.parametrize("name", NODES)
def test_steps_add_up_to_batch_and_retract_to_nothing(spark, name):
    deltas = history(sum(map(ord, name)))
    node = NODES[name]()
    states, rest = {}, list(deltas)
    r = random.Random(1)
    parts = []
    while rest:
        k = r.randrange(6, 10)
        parts.append(rest[:k])
        rest = rest[k:]
    undo = [(a, s, v, -w, q) for a, s, v, w, q in deltas]
    seen = []
    for n, part in enumerate([*parts, undo]):
        z = spark.createDataFrame(part, DELTA)
        for x in node.walk():
            step = x.step(z, states.get(x.name, {}), Context(spark, n))
            for k, v in step.state.items():
                v = v.applied(states.get(x.name, {}).get(k)) if isinstance(v, Patch) else v
                states.setdefault(x.name, {})[k] = spark.createDataFrame(v.collect(), v.schema)
            z = step.out
        seen.append(bag(next(iter(states["o"].values()))))
    whole = views(node, spark.createDataFrame(deltas, DELTA))["o"]
    assert seen[len(parts) - 1] == bag(whole)
    assert seen[-1] == {}


def test_zset_helpers(spark, rows):
    z = spark.createDataFrame([(1, 2), (1, -2), (2, 1), (None, 1), (3, -1)], "v int, __w bigint")
    assert rows(consolidate(z)) == [(2, 1), (3, -1), (None, 1)]
    assert rows(consolidate(z, clamp=True)) == [(2, 1), (None, 1)]
    assert rows(consolidate(plus(z, negate(z)))) == []
    assert with_weight(z) is z


def test_stateless_nodes(spark, rows):
    z = spark.createDataFrame([("a b", 1, 1), (None, 2, 1), ("c", 3, -1)], "t string, x int, __w bigint")
    assert rows(views(Filter("x > 1") >> Bag("o"), z)["o"]) == [(None, 2, 1)]
    assert rows(FilterMap(u=F.upper("t")).batch(z)) == [("A B", 1), ("C", -1)]
    assert rows(FlatMap("w", F.split("t", " "), keep=("x",)).batch(z)) == [(1, "a", 1), (1, "b", 1), (3, "c", -1)]
    p = KeyBy("x") >> (Count("c"), Map(t=F.col("t")) >> Bag("b"))
    v = views(p, z)
    assert v["c"].first()["count"] == 1 and bag(v["b"]) == {("a b",): 1, (None,): 1}
    with pytest.raises(NotDeterministic):
        Map(r=F.rand())
    with pytest.raises(ValueError):
        Count("a") >> tuple(Count(f"c{i}") for i in range(17))


def test_tokenizer(spark):
    t = spark.createDataFrame([("Don't  café 你好 A-b c",), ("",), (None,)], "t string").select(tokenize(F.col("t")).alias("t")).collect()
    assert [r.t for r in t] == [["dont", "caf", "ab", "c"], [], None]


def test_bm25_view(spark, tmp_path):
    s = Stream(spark, str(tmp_path), Bm25("b"), "key int, text string")
    docs = [(1, "an otter slid down the muddy bank while two herons watched it"), (2, "Otter, otter!"), (3, "granite weathers slowly here")]
    with s.wtx() as tx:
        tx.insert(docs)
        tx.push([(4, "cancelled otter")], 1)
        tx.push([(4, "cancelled otter")], -1)
    r = s.rtx()["b"]
    hits = lambda q: [x.key for x in r.search(q, 10).collect()]
    assert r.doc_count() == 3 and hits("otter") == [2, 1] and hits("OTTER!") == [2, 1] and hits("granite") == [3] and hits("zebra") == [] and hits("") == []
    assert hits("granite otter")[0] == 3 and len(hits("granite otter")) == 3
    batch = bm25(spark.createDataFrame(docs, "key int, text string"), "granite otter", 10).collect()
    assert [(x.key, round(x.score, 9)) for x in batch] == [(x.key, round(x.score, 9)) for x in r.search("granite otter", 10).collect()]
    with s.wtx() as tx:
        tx.remove(docs[1:])
    r = s.rtx()["b"]
    assert r.doc_count() == 1 and hits("otter") == [1]
    with s.wtx() as tx:
        tx.remove(docs[:1])
    assert s.rtx()["b"].doc_count() == 0


def test_vector_view(spark, tmp_path):
    s = Stream(spark, str(tmp_path), VectorIndex("v", dim=2), "key int, embedding array<float>")
    with s.wtx() as tx:
        tx.insert([(1, [0.0, 0.1]), (2, [0.0, 0.2]), (3, [0.0, 0.3]), (9, None), (8, [1.0])])
        tx.insert([(5, [0.0, 0.0])])
        tx.remove([(5, [0.0, 0.0])])
    near = lambda x: [r.key for r in x.rtx()["v"].search([0.0, 0.0]).collect()]
    assert near(s) == [1, 2, 3]
    with s.wtx() as tx:
        tx.remove([(1, [0.0, 0.1])])
        tx.insert([(1, [9.0, 9.0])])
    assert near(s) == [2, 3, 1]
    with pytest.raises(RuntimeError), s.wtx() as tx:
        tx.remove([(2, [0.0, 0.2])])
        raise RuntimeError
    again = Stream(spark, str(tmp_path), VectorIndex("v", dim=2), "key int, embedding array<float>")
    assert near(again) == [2, 3, 1] and again.rtx()["v"].len() == 3


def test_keyed_stream(spark, tmp_path):
    s = KeyedStream(spark, str(tmp_path), (Count("c"), Map(val=F.col("val")) >> Bag("b")), "key int, val string", ["key"])
    with s.wtx() as tx:
        tx.upsert([(1, "a"), (2, "b")])
        tx.upsert([(1, "c")])
        assert tx.get(1).val == "c" and not tx.contains(7) and [tuple(r) for r in tx.current([(1,), (7,)]).collect()] == [(1, "c")]
        assert tx.rtx()["c"].get() == 2
    assert s.get(1).val == "c" and bag(s.rtx()["b"].iter()) == {("c",): 1, ("b",): 1}
    with s.wtx() as tx:
        tx.upsert([(1, "c")])
        tx.remove([(99,)])
    assert bag(s.rtx()["b"].iter()) == {("c",): 1, ("b",): 1}
    with pytest.raises(ZeroDivisionError), s.wtx() as tx:
        tx.upsert([(1, "z")])
        raise ZeroDivisionError
    assert s.get(1).val == "c"
    with s.wtx() as tx:
        tx.remove([(1,)])
        tx.upsert([(3, None)])
    assert not s.contains(1) and s.contains(3) and s.rtx()["c"].get() == 2


def test_retain(spark, tmp_path):
    s = Stream(spark, str(tmp_path), Retain("r", 100) >> (Count("c"), Bag("b")), "val string")

    def commit(now, **ops):
        with s.wtx(now_ms=now) as tx:
            for op, values in ops.items():
                getattr(tx, op)([(v,) for v in values])
        return s.rtx()["c"].get()

    assert commit(1000, insert=["a", "a", "b"]) == 3
    assert commit(1050, insert=["a"]) == 4
    assert commit(1060, remove=["a"]) == 3
    assert commit(1100) == 3  # as old as the horizon: stays
    s = Stream(spark, str(tmp_path), Retain("r", 100) >> (Count("c"), Bag("b")), "val string")
    assert commit(1150) == 1 and bag(s.rtx()["b"].iter()) == {("a",): 1}
    assert commit(1200) == 0
    assert commit(1210, remove=["a"]) == 0
    assert commit(1220, insert=["a"]) == 1


def test_topk_view_and_sum(spark, tmp_path):
    s = Stream(spark, str(tmp_path), TopK("k", 3) >> (Bag("b"), Map(v=F.col("score") * 10) >> KeyBy(F.lit(0)) >> Aggregate("a", total=F.col("v")) >> Table("t")), "score bigint, val string")

    def push(rows, w):
        with s.wtx() as tx:
            tx.push(rows, w)
        return {k[0]: n for k, n in bag(s.rtx()["b"].iter()).items()}

    assert push([(i, f"v{i}") for i in range(1, 6)], 1) == {3: 1, 4: 1, 5: 1}
    assert push([(6, "v6")], 1) == {4: 1, 5: 1, 6: 1} and s.rtx()["t"].get(0).total == 150
    assert push([(6, "v6")], -1) == {3: 1, 4: 1, 5: 1}
    assert push([(2, "late")], 1) == {3: 1, 4: 1, 5: 1}
    assert push([(5, "v5")], 1) == {4: 1, 5: 2}


def test_sinks_facts(spark, tmp_path):
    p = Filter(F.lit(True)) >> (Ranked("r"), Histogram("h", F.floor(F.col("score") / 10)), Unscore() >> Stats("s", F.col("v")), Table("t", ["v"]))
    s = Stream(spark, str(tmp_path), p, "score bigint, v double")
    empty = s.rtx()
    assert empty["r"].max() is None and empty["h"].quantile(0.5) is None and empty["s"].mean() is None and empty["h"].total() == 0
    with s.wtx() as tx:
        tx.insert([(3, 1.0), (14, 2.0), (27, 3.0), (27, 3.0)])
    x = s.rtx()
    assert x["r"].min().score == 3 and x["r"].max().score == 27 and [r.score for r in x["r"].top(2)] == [27, 27] and [r.score for r in x["r"].bottom(2)] == [3, 14]
    assert {r.score for r in x["r"].range(3, 27, low_open=True).collect()} == {14, 27} and {r.score for r in x["r"].range(high=14, high_open=True).collect()} == {3}
    assert [x["h"].quantile(q) for q in (-1, 0, 0.5, 1, 2)] == [0, 0, 1, 2, 2] and x["h"].total() == 4 and x["h"].count(2) == 2
    assert x["s"].count() == 4 and x["s"].sum() == 9 and x["s"].mean() == 2.25
    with s.wtx() as tx:
        tx.push([(27, 3.0)], -1)
    x = s.rtx()
    assert x["s"].variance() == pytest.approx(2 / 3) and x["r"].max().score == 27
    with s.wtx() as tx:
        tx.remove([(27, 3.0), (14, 2.0)])
    x = s.rtx()
    assert x["h"].quantile(1) == 0 and x["s"].stddev() == 0 and x["t"].get(3.0) is None and x["t"].contains(1.0)


def test_maps_and_last_writer(spark, tmp_path):
    s = Stream(spark, str(tmp_path), Filter(F.lit(True)) >> (Multimap("m"), InvertedIndex("i"), Table("t", ["key"]), Count("c"), Distinct("d") >> Count("dc")), "key int, val string")
    with s.wtx() as tx:
        tx.insert([(1, "x")])
        tx.insert([(1, "y"), (2, "x")])
        tx.push([(1, "y")], -1)
        tx.push([(1, "y")], 2)
        assert tx.rtx()["c"].get() == 4
    r = s.rtx()
    assert sorted(r["m"].get(1)) == ["x", "y"] and sorted(r["i"].search("x")) == [1, 2] and r["t"].get(1).val == "y" and r["c"].get() == 4 and r["dc"].get() == 3
    with s.wtx() as tx:
        tx.remove([(1, "y")])
    r = s.rtx()
    assert r["m"].get(1) == ["x"] and r["t"].get(1) is None and r["dc"].get() == 3
    assert s.rtx(1)["c"].get() == 4


def test_store_refuses_and_forgets(spark, tmp_path):
    with pytest.raises(StoreError):
        Stream(spark, str(tmp_path / "a"), (Count("c"), Bag("c")), "v int")
    s = Stream(spark, str(tmp_path / "b"), Count("c"), "v int")
    for i in range(3):
        with s.wtx(batch_id=i // 2) as tx:
            tx.insert([(i,)])
    assert s.rtx()["c"].get() == 2 and s.store.versions() == [1, 2]
    assert s.checkpoint() == 2 and s.store.versions() == [1, 2] and s.vacuum(1, older_than_ms=3_600_000) == 0
    assert s.vacuum(1) == 1 and s.store.versions() == [2] and s.rtx()["c"].get() == 2
    with pytest.raises(StoreError):
        Stream(spark, str(tmp_path / "b"), Bag("c"), "v int")
    with pytest.raises(StoreError):
        s.store.publish(s.store.manifest())


def test_commits_write_patches_and_compact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tarnflow.sources.store.PATCHES", 3)
    s = Stream(spark, str(tmp_path), Bag("b"), "v int")
    want = {}
    for i in range(6):
        with s.wtx() as tx:
            tx.insert([(i % 4,), (None,)])
            if i > 2:
                tx.remove([((i - 3) % 4,)])
        for v, w in ((i % 4, 1), (None, 1), ((i - 3) % 4, -(i > 2))):
            want[(v,)] = want.get((v,), 0) + w
        assert bag(s.rtx()["b"].iter()) == {k: n for k, n in want.items() if n}
    parts = s.store.manifest()["tables"]["b"]["bag"]
    assert len(parts) < 4 and not parts[0]["keys"]


def test_structured_streaming_feeds_commits_once(spark, tmp_path):
    z = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("a", -1)], "v string, __w bigint")
    write_signed(z.coalesce(1), str(tmp_path / "in"))  # withdrawals before their insertions would be absorbed
    assert read_signed(spark, str(tmp_path / "in")).count() == 4
    s = Stream(spark, str(tmp_path / "s"), Bag("b"), "v string")
    for _ in range(2):
        src = stream_signed(spark, str(tmp_path / "in"), z.schema, maxFilesPerTrigger="1")
        run_stream(s, src, str(tmp_path / "ck")).awaitTermination()
    assert bag(s.rtx()["b"].iter()) == {("a",): 1, ("b",): 1}
    n = numbered(spark.range(100).toDF("id"), ["id"]).orderBy("__seq").collect()
    assert [r.id for r in n] == list(range(100)) and len({r["__seq"] for r in n}) == 100


def test_score_order_of_doubles(spark, tmp_path):
    vals = [float("-inf"), -1.5, 0.0, 2.5, float("inf")]
    z = with_weight(spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "x double, i int"))
    r = views(ScoreBy("x") >> Map(score=F.col("score"), i=F.col("i")) >> Ranked("r"), z)["r"]
    assert [x.score for x in Ranked.bottom(r, 9).orderBy("score").collect()] == vals
    assert math.isinf(Ranked.top(r, 1).first().score)


def test_caches_of_others_survive_a_commit(spark, tmp_path):
    mine = spark.range(5).persist()
    mine.count()
    s = Stream(spark, str(tmp_path), Distinct("d") >> Count("c"), "v int")
    with s.wtx() as tx:
        tx.insert([(1,), (1,)])
    assert s.rtx()["c"].get() == 1 and mine.storageLevel.useMemory
    mine.unpersist()


def test_keyed_changelog_under_structured_streaming(spark, tmp_path):
    from tarnflow.streaming.keyed_state import ROCKSDB, changelog

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    z = spark.createDataFrame([("a", 3, 1), ("a", 5, 1), ("b", 1, 1)], "k string, v bigint, __w bigint")
    z.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = stream_signed(spark, str(tmp_path / "in"), z.schema, maxFilesPerTrigger="1")
    out = []

    def run():
        q = changelog(src, "k", lambda acc, r, w: ((acc[0] if acc else 0) + w * r["v"],), "total bigint", ("total",))
        q.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(out) == [("a", 8, 1), ("b", 1, 1)]
    out.clear()
    spark.createDataFrame([("a", 5, -1), ("b", 1, -1)], z.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(out) == [("a", 3, 1), ("a", 8, -1), ("b", 1, -1)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_keyed_writes_give_the_rows_they_replace(spark, tmp_path):
    s = KeyedStream(spark, str(tmp_path), Count("c"), "key int, val string", ["key"])
    with s.wtx() as tx:
        assert tx.upsert([(1, "a"), (2, "b")]).rows().count() == 0
        first = tx.upsert([(1, "c")])
        assert first.get().val == "a" and tx.upsert([(3, "d")]).get() is None
    with s.wtx() as tx:
        old = tx.upsert([(1, "x"), (2, "y"), (9, "z")])
        assert sorted(map(tuple, old.rows().collect())) == [(1, "c"), (2, "b")]
        with pytest.raises(ValueError):
            old.get()
        assert tx.remove([(2,)]).get().val == "y" and tx.remove([(2,)]).get() is None
        assert tx.remove([(77,)]).get() is None
    assert sorted(map(tuple, s.table().collect())) == [(1, "x"), (3, "d"), (9, "z")]


def test_batches_are_never_applied_twice(spark, tmp_path):
    s = Stream(spark, str(tmp_path), Count("c"), "v int")

    def commit(batch, source):
        with s.wtx(batch_id=batch, source=source) as tx:
            tx.insert([(1,)])
        return s.rtx()["c"].get()

    assert [commit(*x) for x in ((0, "a"), (1, "a"), (0, "b"), (0, "a"), (1, "b"), ("x", "b"), ("x", "b"), (1, "a"), ("x", "a"), (5, "a"), (4, "a"))] == [1, 2, 3, 3, 4, 5, 5, 5, 6, 7, 7]
    m = s.store.manifest()
    m["batches"]["a"]["last"] = 10**6
    s.store.publish(m | {"version": m["version"] + 1})
    assert commit(3, "a") == 7 and len(m["batches"]) == 2


LARGE = {
    "distinct": lambda: Distinct("n") >> Count("o"),
    "aggregate": lambda: KeyBy("v") >> Aggregate("n", total=F.col("score")) >> Table("o"),
    "retain": lambda: Retain("n", 1000) >> Bag("o"),
    "topk": lambda: TopK("n", 5) >> Bag("o"),
    "ranked": lambda: Ranked("o"),
    "multimap": lambda: Map(key=F.col("v"), val=F.col("score")) >> Multimap("o"),
    "bm25": lambda: Map(key=F.col("v"), text=F.concat_ws(" ", F.lit("the word"), F.col("score"))) >> Bm25("o"),
}


@pytest.mark.parametrize("name", LARGE)
def test_a_small_commit_writes_few_rows_into_a_large_state(spark, tmp_path, name):
    n = 20_000
    s = Stream(spark, str(tmp_path), LARGE[name](), "v bigint, score bigint")
    with s.wtx(now_ms=1) as tx:
        tx.insert(spark.range(n).selectExpr("id as v", "id % 1000 as score"))
    before = {(node, t): {p["path"] for p in ps} for node, ts in s.store.manifest()["tables"].items() for t, ps in ts.items()}
    with s.wtx(now_ms=2) as tx:
        tx.insert([(n + i, 5) for i in range(5)])
        tx.remove([(i, i) for i in range(5)])
    written = 0
    for node, ts in s.store.manifest()["tables"].items():
        for t, ps in ts.items():
            written += sum(spark.read.parquet(p["path"]).count() for p in ps if p["path"] not in before[node, t])
    assert 0 < written <= 120


def test_topk_goes_on_below_its_boundary(spark, tmp_path):
    s = Stream(spark, str(tmp_path), TopK("k", 4) >> Bag("b"), "score int, val string")
    r, live = random.Random(3), {}
    for _ in range(7):
        rows = [(r.randrange(6), r.choice("ab")) for _ in range(4)]
        gone = [x for x in list(live) if r.random() < 0.4]
        with s.wtx() as tx:
            tx.insert(rows)
            tx.push([x for x in gone], -1)
        for x in rows:
            live[x] = live.get(x, 0) + 1
        for x in gone:
            live[x] -= 1
            if not live[x]:
                del live[x]
        copies = sorted((x for x, c in live.items() for _ in range(c)), reverse=True)[:4]
        assert bag(s.rtx()["b"].iter()) == {x: copies.count(x) for x in copies}


def recall(index, rows, queries, metric, k, probes=0):
    import numpy as np

    keys, x = np.array(list(rows)), np.array(list(rows.values()), float)
    hit = 0
    for q in queries:
        d = {"l2": ((x - q) ** 2).sum(1), "l1": np.abs(x - q).sum(1)}[metric]
        want = set(keys[np.argsort(d, kind="stable")[:k]].tolist())
        hit += len(want & {r.key for r in index.search(q.tolist(), k, probes).collect()})
    return hit / (k * len(queries))


def test_cells_of_vectors_under_deletion_and_churn(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(5)
    make = lambda first, n: {first + i: v for i, v in enumerate(r.normal(0, 1, (n, 12)).round(3).tolist())}
    rows = make(0, 1500)
    s = Stream(spark, str(tmp_path), VectorIndex("v", dim=12), "key int, embedding array<double>")
    with s.wtx() as tx:
        tx.insert(list(rows.items()))
    index = s.rtx()["v"]
    assert index.centres.count() > 20 and index.len() == 1500
    queries = r.normal(0, 1, (12, 12))
    assert recall(index, rows, queries, "l2", 10) > 0.9
    for step in range(2):
        gone = [k for k in rows if r.random() < 0.2]
        new = make(10_000 * (step + 1), 300)
        with s.wtx() as tx:
            tx.remove([(k, rows.pop(k)) for k in gone])
            tx.insert(list(new.items()))
        rows |= new
    index = s.rtx()["v"]
    assert index.len() == len(rows) and recall(index, rows, queries, "l2", 10) > 0.85
    assert recall(index, rows, queries, "l2", 10, None) == 1
    assert {x.key for x in index.search(queries[0].tolist(), 50, 0).collect()} <= set(rows)


def test_integer_vectors_and_metrics_of_ones_own(spark, tmp_path):
    import numpy as np

    from tarnflow.functions.metrics import Metric
    from tarnflow.operators.search import knn_join

    r = np.random.default_rng(6)
    rows = dict(enumerate(r.integers(-50, 50, (800, 6)).tolist()))
    s = Stream(spark, str(tmp_path / "a"), VectorIndex("v", "l1"), "key int, embedding array<int>")
    with s.wtx() as tx:
        tx.insert(list(rows.items()))
    assert recall(s.rtx()["v"], rows, r.integers(-50, 50, (10, 6)), "l1", 5) > 0.8
    first = Metric(lambda a, b: F.abs(a[0] - b[0]).cast("double"), lambda q, b: np.abs(q[:, None, 0] - b[None, :, 0]))
    small = spark.createDataFrame([(k, v) for k, v in rows.items() if k < 40], "key int, embedding array<int>")
    s = Stream(spark, str(tmp_path / "b"), VectorIndex("v", first), "key int, embedding array<int>")
    with s.wtx() as tx:
        tx.insert(small)
    near = [x.key for x in s.rtx()["v"].search([7, 0, 0, 0, 0, 0], 3).collect()]
    assert near == sorted(range(40), key=lambda k: (abs(rows[k][0] - 7), k))[:3]
    q = spark.createDataFrame([(1, [7, 0])], "query_key int, embedding array<int>")
    assert [x.key for x in knn_join(small, q, 3, first).orderBy("rank").collect()] == near


def test_bm25_counts_follow_edits_and_empty_texts(spark, tmp_path):
    s = Stream(spark, str(tmp_path), Bm25("b"), "key int, text string")
    with s.wtx() as tx:
        tx.insert([(1, "north wind over the harbour"), (2, ""), (3, "wind")])
    with s.wtx() as tx:
        tx.remove([(1, "north wind over the harbour")])
        tx.insert([(1, "calm"), (4, "wind and wind again")])
    docs = [(1, "calm"), (2, ""), (3, "wind"), (4, "wind and wind again")]
    want = [(r.key, round(r.score, 9)) for r in bm25(spark.createDataFrame(docs, "key int, text string"), "wind calm", 10).collect()]
    b = s.rtx()["b"]
    assert b.doc_count() == 4 and [(r.key, round(r.score, 9)) for r in b.search("wind calm", 10).collect()] == want


def test_quantiles_over_many_buckets(spark):
    df = spark.range(5000).selectExpr("id * 3 as bucket", "id % 7 + 1 as n")
    flat = [b * 3 for b in range(5000) for _ in range(b % 7 + 1)]
    got = {r.q: r.bucket for r in Histogram.quantiles(df, [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    assert got == {q: flat[max(1, math.ceil(q * len(flat))) - 1] for q in (0.0, 0.1, 0.5, 0.999, 1.0)}


def test_broadcasts_go_by_bytes(spark):
    from tarnflow import session

    wide = spark.createDataFrame([("x" * 1000, [1, 2], {"a": "b"}, (1, "z"), None)] * 10, "a string, b array<int>, c map<string,string>, d struct<e:int,f:string>, g string")
    assert 10_000 < session.weigh(wide) < 13_000
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(session.small(wide)) and not hint(session.small(wide, 5_000))
    assert session.weigh(wide.limit(0)) == 0
