"""Metrics, exact neighbours and embedding."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import embedding as E
from tarnflow.functions.metrics import BLOCK_METRICS, METRICS
from tarnflow.operators.search import fuse, knn, knn_join


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0], [3.0, 1.0]), ([0.0], [1.0]), ([], [])], "a array<float>, b array<float>")
    got = df.select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in METRICS.items())).collect()
    assert got[0].asDict() == pytest.approx({"l2": 5, "euclidean": 5**0.5, "l1": 3, "chebyshev": 2, "neg_dot": -5, "cosine": 1 - 5 / 50**0.5, "hamming": 2})
    assert got[1].cosine == 0 and got[2].l2 == 0 and got[2].hamming == 0


@pytest.mark.parametrize("metric", METRICS)
def test_join_finds_what_single_searches_find(spark, metric):
    r = np.random.default_rng(4)
    v = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(60)] + [(99, None)]
    base = spark.createDataFrame(v, "key int, embedding array<float>").repartition(3)
    q = base.filter("key < 3").withColumnRenamed("key", "query_key")
    got = {}
    for x in knn_join(base, q, 5, metric, block=2).collect():
        got.setdefault(x.query_key, {})[x["rank"]] = (round(x.distance, 9), x.key)
    for i in range(3):
        x, m = np.array([v[i][1]]), np.array([a for _, a in v[:60]])
        want = sorted(zip(np.round(BLOCK_METRICS[metric](x, m)[0], 9), range(60)))[:5]
        assert [d for d, _ in got[i].values()] == pytest.approx([d for d, _ in want]) and sorted(got[i]) == [1, 2, 3, 4, 5]
    one = knn(base, v[0][1], 5, metric).collect()
    assert [round(x.distance, 6) for x in one] == pytest.approx([round(got[0][k][0], 6) for k in sorted(got[0])])


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "key int, s double")
    b = spark.createDataFrame([(3, 0.1), (4, 0.2)], "key int, d double")
    got = fuse([(a, [F.desc("s")]), (b, [F.asc("d")])], 2).collect()
    assert [x.key for x in got] == [3, 1] and got[0].score == pytest.approx(1 / 63 + 1 / 61)


def test_normalisation_and_pieces():
    assert E.normalize("ÉtÉ\x0bX\tY\x00") == "etex y"
    assert E.normalize("a你b") == "a 你 b"
    assert E.pretokens("don't stop--now ¡ya!") == ["don", "'", "t", "stop", "-", "-", "now", "¡", "ya", "!"]
    vocabulary = {"un": 1, "##able": 2, "##a": 3, "x": 4}
    assert E.pieces("unable", vocabulary) == [1, 2] and E.pieces("una?", vocabulary) == [1, 3, E.UNK] and E.pieces("q", vocabulary) == [E.UNK] and E.pieces("x" * 101, vocabulary) == [E.UNK]


def test_model_pooling_and_quantising(spark):
    m = E.stand_in(["rain", "wind"], 16)
    i = m.ids("Rain wind")
    assert len(i) == 2 and np.allclose(m.encode("Rain wind"), m.weights[[E.CLS, *i, E.SEP]].sum(0) / 2)
    assert np.allclose(m.encode(""), m.weights[[E.CLS, E.SEP]].sum(0))
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cos(m.encode("rain on wind"), m.quantized(16).encode("rain on wind")) > 0.999999 and cos(m.encode("rain"), m.quantized(8).encode("rain")) > 0.999
    assert np.allclose(m.truncated(4).encode("rain"), m.encode("rain")[:4]) and m.truncated(4).dimensions == 4
    got = spark.createDataFrame([("rain",), (None,)], "t string").select(E.embed(spark, m)("t").alias("e")).collect()
    assert np.allclose(got[0].e, m.encode("rain")) and got[1].e is None


def test_safetensors():
    head = b'{"a": {"dtype": "F16", "shape": [2, 1], "data_offsets": [0, 4]}, "b": {"dtype": "BF16", "shape": [1], "data_offsets": [4, 6]}}'
    data = struct.pack("<Q", len(head)) + head + np.array([1.5, -2], "<f2").tobytes() + struct.pack("<H", 0x3FC0)
    t = E.read_safetensors(data)
    assert t["a"].tolist() == [[1.5], [-2]] and t["b"].tolist() == [1.5]


def test_any_text_can_be_encoded():
    r, m = random.Random(0), E.stand_in([], 4)
    for _ in range(500):
        t = "".join(chr(r.choice([r.randrange(128), r.randrange(0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(r.randrange(30)))
        assert np.isfinite(m.encode(t)).all()
