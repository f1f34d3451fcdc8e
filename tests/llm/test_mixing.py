from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnflow.llm.mixing import TOKENIZERS, clean_targets, count_tokens, curriculum, encoding, mix, mix_report, plan_mix

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no vocabulary files here")
DOC = "doc_id bigint, text string, source string, tokens string"


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_tokens_are_counted_whole(spark):
    texts = ["rain fell", "", None, "x" * 5000 + " 你好", "<|endoftext|>"]
    got = count_tokens(spark.createDataFrame(enumerate(texts), "doc_id int, text string")).collect()
    e = encoding()
    assert [r.tokens for r in got] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    assert e.decode(e.encode_ordinary(texts[3])) == texts[3]


def test_targets_are_cleaned(spark, rows):
    t = targets(spark, [(" News ", 2.0, 3), ("NEWS", 2.0, 3), ("a", 0.0, 1), ("b", None, 1), (None, 3.0, 1), ("c", float("nan"), 1), ("d", 1.0, None), ("  ", 1.0, 1), ("e", -1.0, 2)])
    assert rows(clean_targets(t)) == [("d", 1.0, 1), ("news", 2.0, 3)]


def sizes(docs):
    return docs.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


def brute_short(docs, weights):
    total, s = sum(t for _, t in docs), sum(w for w, _ in weights.values())
    return {k for k, (w, r) in weights.items() if sum(t for src, t in docs if src == k) * r < w / s * total}


def test_shares_repeats_and_short_sources(spark):
    data = [(i, "big" if i % 3 else "mid", 20 + i % 7) for i in range(3000)] + [(9000 + i, "small", 30) for i in range(40)] + [(9900 + i, None, 500) for i in range(10)] + [(9950, "zero", 0)]
    docs = spark.createDataFrame(data, "doc_id bigint, src string, tokens bigint")
    weights = {"big": (4.0, 2), "mid": (4.0, 3), "small": (1.0, 2), "zero": (0.5, 9), "absent": (0.5, 1)}
    plan = plan_mix(sizes(docs), targets(spark, [(k, *v) for k, v in weights.items()]))
    chosen = mix(docs, plan)
    got = chosen.collect()
    used, seen = {}, {}
    for r in got:
        used[r.src] = used.get(r.src, 0) + r.tokens
        seen[r.doc_id, r.copy] = seen.get((r.doc_id, r.copy), 0) + 1
    assert max(seen.values()) == 1
    rep = {r.src: r for r in mix_report(chosen, plan).collect()}
    total = sum(t for _, _, t in data)
    assert {k for k, r in rep.items() if r.short} == brute_short([(s, t) for _, s, t in data], weights) == {"small", "zero", "absent"}
    for k in ("big", "mid"):
        assert abs(used[k] - 0.4 * total) <= 30 and rep[k].share == pytest.approx(0.4)
    assert used["small"] == 40 * 30 * 2 and rep["small"].copies == 80
    assert all(r.copy < weights[r.src][1] for r in got)
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    # constant weights: every stretch of training has the target shares of what isn't short
    half = [r for r in got if r.position < total / 2]
    assert abs(sum(r.tokens for r in half if r.src == "big") - 0.2 * total) < 200


def test_positions_follow_the_schedule(spark):
    data = [(i, "ab"[i % 2], 10) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id bigint, src string, tokens bigint")
    plan = plan_mix(sizes(docs), targets(spark, [("a", 1.0, 5), ("b", 1.0, 5)]), {"a": [(0.0, 2.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 2.0)]})
    rows = mix(docs, plan).collect()
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in rows if lo * 40_000 <= r.position < (lo + 0.25) * 40_000]
        a = sum(r.tokens for r in part if r.src == "a") / sum(r.tokens for r in part)
        assert a == pytest.approx(1 - lo - 0.125, abs=0.02)


def test_from_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "rain fell on the gate", " Log"), (2, None, "log"), (2, "wind", None), (3, "", "other")], "doc_id bigint, text string, source string")
    chosen, report = curriculum(d, targets(spark, [("LOG ", 1.0, 2)]))
    assert {(r.doc_id, r["copy"]) for r in chosen.collect()} == {(1, 0)} and report.first().share == 1.0
    for docs, ts in ((d.limit(0), [("log", 1.0, 1)]), (d, [])):
        chosen, report = curriculum(docs, targets(spark, ts))
        assert chosen.count() == 0 and report.count() == len(ts)
