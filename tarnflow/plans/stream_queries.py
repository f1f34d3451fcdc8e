"""Queries that run the incremental engine itself: tables written in several commits, views read from the last snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.search import Bm25, VectorIndex
from tarnflow.operators.sinks import Bag, Count, Histogram, InvertedIndex, KeyedRanked, Multimap, Ranked, Stats, Table
from tarnflow.operators.stateful import Aggregate, Distinct, KeyedReduce, Retain, TopK
from tarnflow.operators.stateless import Filter, KeyBy, Map
from tarnflow.plans.core_queries import DAY, Z, _bm25_sql, _TOKENS, div, epoch_ms
from tarnflow.plans.node import Node
from tarnflow.session import delete_at_end, ensure_checkpoint_dir, table
from tarnflow.sources.tables import read_signed, stream_signed, write_signed
from tarnflow.streaming.stream import KeyedStream, Snapshot, Stream, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def state_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state, beside the checkpoints; it is deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    delete_at_end(spark, folder)
    return folder


class Aborted(Exception):
    pass


def replayed(spark: SparkSession, pipeline: Callable[[], Node | Sequence[Node]], rows: DataFrame, key: str) -> Stream:
    """``rows`` through a stream: a third inserted, an abort, a third with first withdrawals, a reopened store, the rest.

    In the end all rows whose ``key`` is divisible by 5 are withdrawn.
    """
    path, third, gone = state_folder(spark), F.col(key) % 3, F.col(key) % 5 == 0
    s = Stream(spark, path, pipeline(), rows.schema)
    with s.wtx() as tx:
        tx.insert(rows.filter(third == 0))
    try:
        with s.wtx() as tx:
            tx.remove(rows.filter(third == 0))
            tx.insert(rows)
            raise Aborted
    except Aborted:
        pass
    with s.wtx(batch_id=1) as tx:
        tx.insert(rows.filter(third == 1))
        tx.remove(rows.filter((third == 0) & gone))
    s = Stream(spark, path, pipeline(), rows.schema)
    with s.wtx(batch_id=1) as tx:  # the same batch again changes nothing
        tx.insert(rows)
    with s.wtx(batch_id=2) as tx:
        tx.insert(rows.filter(third == 2))
        tx.remove(rows.filter((third > 0) & gone))
    return s


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", epoch_ms("ts").alias("at_ms"), "user_id", "event_type", "value")


def _view(spark: SparkSession, d: str, pipeline: Callable[[], Node | Sequence[Node]]) -> Snapshot:
    return replayed(spark, pipeline, _events(spark, d), "event_id").rtx()


_LIVE = f"WITH {Z}, live AS (SELECT user_id, event_id, ts, event_type, value FROM z GROUP BY ALL HAVING sum(w) > 0)"


@query(f"{_LIVE} SELECT event_type, count(*) AS n FROM live GROUP BY 1")
def stream_bag(spark, d):
    return _view(spark, d, lambda: Map(event_type=F.col("event_type")) >> Bag("b"))["b"].iter()


@query(f"{_LIVE} SELECT count(*) AS count, 2 * count(*) AS twice FROM live")
def stream_count(spark, d):
    v = _view(spark, d, lambda: Filter(F.lit(True)) >> (Count("a"), Map(event_id=F.col("event_id")) >> Distinct("d") >> Count("b")))
    return spark.createDataFrame([(v["a"].get(), v["a"].get() + v["b"].get())], "count bigint, twice bigint")


@query(f"{_LIVE} SELECT count(*) AS count, round(sum(value), 3) AS sum, round(avg(value), 6) AS mean, round(var_pop(value), 3) AS variance, round(stddev_pop(value), 4) AS stddev FROM live")
def stream_stats(spark, d):
    x = _view(spark, d, lambda: Stats("s", F.col("value")))["s"]
    return spark.createDataFrame([(x.count(), round(x.sum(), 3), round(x.mean(), 6), round(x.variance(), 3), round(x.stddev(), 4))], "count bigint, sum double, mean double, variance double, stddev double")


@query(f"{_LIVE} SELECT (epoch_us(ts) // 1000) // 3600000 AS key, count(*) AS n, round(sum(value), 4) AS total FROM live GROUP BY 1")
def stream_hourly_table(spark, d):
    v = _view(spark, d, lambda: KeyBy(div("at_ms", 3_600_000)) >> Aggregate("hours", total=F.col("value")) >> Table("t"))["t"]
    return v.iter().select("key", "n", F.round("total", 4).alias("total"))


@query(f"{_LIVE} SELECT DISTINCT user_id AS key, event_type AS val FROM live")
def stream_multimap(spark, d):
    p = lambda: Map(key=F.col("user_id"), val=F.col("event_type")) >> Distinct("d") >> Multimap("m")
    return _view(spark, d, p)["m"].iter().select("key", "val")


@query(f"{_LIVE} SELECT DISTINCT user_id AS key FROM live WHERE event_type = 'purchase'")
def stream_inverted_index(spark, d):
    p = lambda: Map(key=F.col("user_id"), val=F.col("event_type")) >> Distinct("d") >> InvertedIndex("i")
    return _view(spark, d, p)["i"].keys_of("purchase")


def _scored(by: bool) -> Map:
    return Map(**({"key": F.col("user_id")} if by else {}), score=F.col("value"), event_id=F.col("event_id"))


@query(f"{_LIVE} SELECT value AS score, event_id FROM live ORDER BY value DESC, event_id DESC LIMIT 20")
def stream_ranked(spark, d):
    rows = _view(spark, d, lambda: _scored(False) >> Ranked("r"))["r"].top(20)
    return spark.createDataFrame([(r.score, r.event_id) for r in rows], "score double, event_id bigint")


@query(f"{_LIVE} SELECT value AS score, event_id, 1::BIGINT AS n FROM live WHERE value > 10 AND value <= 30")
def stream_ranked_range(spark, d):
    return _view(spark, d, lambda: _scored(False) >> Ranked("r"))["r"].range(10.0, 30.0, low_open=True)


@query(f"{_LIVE} SELECT user_id AS key, value AS score, event_id, 1::BIGINT AS n FROM live QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) <= 2")
def stream_keyed_ranked(spark, d):
    return _view(spark, d, lambda: _scored(True) >> KeyedRanked("r"))["r"].top(2)


@query(f"{_LIVE} SELECT floor(value / 10)::BIGINT AS bucket, count(*) AS n FROM live GROUP BY 1")
def stream_histogram(spark, d):
    return _view(spark, d, lambda: Histogram("h", div("value", 10)))["h"].iter()


@query(f"{_LIVE}, top AS (SELECT * FROM live ORDER BY value DESC, event_id DESC LIMIT 100) SELECT value AS score, event_id, 1::BIGINT AS n FROM top")
def stream_topk(spark, d):
    return _view(spark, d, lambda: _scored(False) >> TopK("k", 100) >> Bag("b"))["b"].iter()


@query(f"{_LIVE} SELECT count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM live ORDER BY value DESC, event_id DESC LIMIT 100)")
def stream_topk_sum(spark, d):
    v = _view(spark, d, lambda: _scored(False) >> TopK("k", 100) >> KeyBy(F.lit(0)) >> Aggregate("a", total=F.col("score")) >> Table("t"))["t"]
    return v.iter().select("n", F.round("total", 4).alias("total"))


@query(f"{_LIVE} SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS total FROM live GROUP BY 1")
def stream_reduce(spark, d):
    add = lambda acc, row, w: {"total": (acc["total"] if acc else 0.0) + w * row["value"]}
    v = _view(spark, d, lambda: KeyBy("user_id") >> KeyedReduce("f", add, "total double") >> Table("t"))["t"]
    return v.iter().select("key", "n", F.round("total", 4).alias("total"))


#: The ends of three parts of the events' month, in days of the epoch.
_ENDS = (19_733, 19_743, 19_754)


@query(f"""SELECT event_id, event_type FROM events WHERE (epoch_us(ts) // 1000) >= {_ENDS[0] * DAY} AND event_id % 5 <> 0""")
def stream_retain(spark, d):
    """Each third of a month is committed at its end; 12 days later it has gone. Withdrawals meet what is still there."""
    e = _events(spark, d).select("event_id", "event_type", "at_ms")
    s = Stream(spark, state_folder(spark), Map(event_id=F.col("event_id"), event_type=F.col("event_type")) >> Retain("r", 12 * DAY) >> Bag("b"), e.schema)
    start = 0
    for end in _ENDS:
        with s.wtx(now_ms=end * DAY) as tx:
            tx.insert(e.filter((F.col("at_ms") >= start * DAY) & (F.col("at_ms") < end * DAY)))
        start = end
    with s.wtx(now_ms=_ENDS[-1] * DAY + 1) as tx:  # the first third has gone: its withdrawals are absorbed
        tx.remove(e.filter("event_id % 5 = 0"))
    return s.rtx()["b"].iter().select("event_id", "event_type")


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def stream_first_version(spark, d):
    """The snapshot of the first commit, read after all others."""
    s = replayed(spark, lambda: KeyBy("event_type") >> Aggregate("a") >> Table("t"), _events(spark, d), "event_id")
    return s.rtx(1)["t"].iter().select("key", "n")


def _live_docs(sql: str) -> str:
    return sql.replace("FROM documents)", "FROM documents WHERE doc_id % 5 <> 0)")


def _doc_stream(spark: SparkSession, d: str) -> Snapshot:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return replayed(spark, lambda: Bm25("b"), docs, "key").rtx()


@query(_live_docs(_bm25_sql(["barometer", "rain"], "SELECT doc_id AS key, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 50")))
def stream_bm25(spark, d):
    return _doc_stream(spark, d)["b"].search("Rain, BAROMETER!", 50).select("key", F.round("score", 6).alias("score"))


@query(_live_docs(f"WITH {_TOKENS} SELECT n AS docs FROM st"))
def stream_bm25_count(spark, d):
    return spark.createDataFrame([(_doc_stream(spark, d)["b"].doc_count(),)], "docs bigint")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 1)
SELECT v.vec_id AS key, round(list_sum(list_transform(list_zip(v.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6)::DOUBLE AS distance FROM v, q WHERE vec_id % 5 <> 0
ORDER BY list_sum(list_transform(list_zip(v.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), vec_id LIMIT 10""")
def stream_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    x = replayed(spark, lambda: VectorIndex("v", dim=64), v, "key").rtx()["v"]
    query = v.filter("key = 1").first()["embedding"]
    return x.search(query, 10).select("key", F.round("distance", 6).alias("distance"))


def _orders(spark: SparkSession, d: str) -> tuple[KeyedStream, DataFrame]:
    """Orders as the latest one of each customer, upserted in three commits; then every seventh customer is removed."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    p = lambda: (Count("c"), KeyBy("o_orderstatus") >> Aggregate("a", total=F.col("price")) >> Table("t"))
    path = state_folder(spark)
    s = KeyedStream(spark, path, p(), o.schema, ["key"])
    for n in range(3):
        if n == 2:
            s = KeyedStream(spark, path, p(), o.schema, ["key"])
        with s.wtx() as tx:
            tx.upsert(o.filter(F.col("o_orderkey") % 3 == n).withColumn("__seq", F.col("o_orderkey")))
    try:
        with s.wtx() as tx:
            tx.remove(o.select("key").distinct())
            raise Aborted
    except Aborted:
        pass
    with s.wtx() as tx:
        gone = tx.remove(o.select("key").distinct().filter("key % 7 = 0")).rows()
    return s, gone


_LATEST = "last AS (SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderkey % 3, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderkey % 3, o_orderkey)) AS o_orderstatus, arg_max(round(o_totalprice, 2), (o_orderkey % 3, o_orderkey)) AS price FROM orders GROUP BY 1)"


@query(f"WITH {_LATEST} SELECT key, o_orderkey, o_orderstatus FROM last WHERE key % 7 <> 0")
def upsert_latest(spark, d):
    return _orders(spark, d)[0].table().select("key", "o_orderkey", "o_orderstatus")


@query(f"WITH {_LATEST} SELECT o_orderstatus AS key, count(*) AS n, round(sum(price), 2) AS total FROM last WHERE key % 7 <> 0 GROUP BY 1")
def keyed_stream_views(spark, d):
    return _orders(spark, d)[0].rtx()["t"].iter().select("key", "n", F.round("total", 2).alias("total"))


@query(f"WITH {_LATEST} SELECT key, o_orderkey, o_orderstatus FROM last WHERE key % 7 = 0")
def keyed_stream_replaced(spark, d):
    """The rows that a removal gave back."""
    return _orders(spark, d)[1].select("key", "o_orderkey", "o_orderstatus")


class Twice(Node):
    """An operator of one's own: every row also under its negative number."""

    def batch(self, z: DataFrame) -> DataFrame:
        return z.unionByName(z.withColumn("event_id", -F.col("event_id")))


@query(f"{_LIVE} SELECT s * event_id AS event_id FROM live, (VALUES (1), (-1)) t(s)")
def stream_own_operator(spark, d):
    return _view(spark, d, lambda: Map(event_id=F.col("event_id")) >> Twice() >> Bag("b"))["b"].iter().select("event_id")


@query(f"{_LIVE} SELECT event_type, user_id, count(*) AS n FROM live GROUP BY 1, 2")
def stream_micro_batches(spark, d):
    """Files through Structured Streaming, one commit per micro-batch, and the same again, which changes nothing."""
    folder = state_folder(spark)
    e = _events(spark, d).withColumn("__w", F.lit(1).cast("bigint"))
    gone = F.col("event_id") % 5 == 0
    write_signed(e.filter("event_id % 2 = 0").coalesce(1), f"{folder}/in")
    write_signed(e.filter("event_id % 2 = 1").unionByName(e.filter(gone).withColumn("__w", F.lit(-1).cast("bigint"))).coalesce(1), f"{folder}/in", mode="append")
    s = Stream(spark, f"{folder}/state", Map(event_type=F.col("event_type"), user_id=F.col("user_id")) >> Bag("b"), _events(spark, d).schema)
    for _ in range(2):
        run_stream(s, stream_signed(spark, f"{folder}/in", e.schema, maxFilesPerTrigger="2"), f"{folder}/checkpoint").awaitTermination()
    return s.rtx()["b"].iter()


@query("SELECT f AS format, count(*) AS n, sum(w * event_id)::BIGINT AS ids, round(sum(value), 3) AS total FROM (SELECT event_id, value, 1 AS w FROM events), (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(f) GROUP BY 1")
def connector_roundtrip(spark, d):
    """Signed tables written and read in every file format."""
    folder, e = state_folder(spark), _events(spark, d).withColumn("__w", F.lit(1).cast("bigint"))
    out = None
    for fmt in ("csv", "json", "orc", "parquet"):
        write_signed(e, f"{folder}/{fmt}", fmt, partition=("event_type",) if fmt == "parquet" else ())
        r = read_signed(spark, f"{folder}/{fmt}", fmt, e.schema).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__w") * F.col("event_id")).alias("ids"), F.round(F.sum("value"), 3).alias("total"))
        r = r.select(F.lit(fmt).alias("format"), "n", "ids", "total")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {_LATEST} SELECT k AS key, o_orderkey, o_orderkey IS NOT NULL AS here FROM (VALUES (1::BIGINT), (2), (7), (14), (100), (-5)) t(k) LEFT JOIN (SELECT * FROM last WHERE key % 7 <> 0) l ON l.key = k")
def keyed_stream_lookup(spark, d):
    """Single keys of a keyed stream: their rows, and whether they are there."""
    s, _ = _orders(spark, d)
    found = [(k, s.get(k), s.contains(k)) for k in (1, 2, 7, 14, 100, -5)]
    return spark.createDataFrame([(k, r["o_orderkey"] if r else None, here) for k, r, here in found], "key bigint, o_orderkey bigint, here boolean")
