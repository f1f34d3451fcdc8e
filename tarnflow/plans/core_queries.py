"""Queries of the engine's own operators over events, lineitem, orders, documents, embeddings and the sample programs' tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.embedding import embed, normalized, stand_in
from tarnflow.functions.metrics import Metric
from tarnflow.functions.text import tokenize
from tarnflow.operators.search import Bm25, VectorIndex, bm25, fuse, knn, knn_join
from tarnflow.operators.sinks import Bag, Count, Histogram, InvertedIndex, KeyedRanked, Multimap, Ranked, Stats, Table
from tarnflow.operators.stateful import Aggregate, Distinct, KeyedReduce, Retain, TopK
from tarnflow.operators.stateless import Filter, FilterMap, FlatMap, KeyBy, Map, ScoreBy, Unkey, Unscore
from tarnflow.plans.node import SEQ, Node, views
from tarnflow.session import table
from tarnflow.zset import W, consolidate, negate, plus, with_weight

DAY = 86_400_000


def epoch_ms(c: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def with_retractions(df: DataFrame, key: str) -> DataFrame:
    """All rows inserted, then those whose ``key`` is divisible by 5 withdrawn."""
    z = with_weight(df)
    return plus(z.withColumn(SEQ, F.lit(0).cast("bigint")), negate(z.filter(F.col(key) % 5 == 0)).withColumn(SEQ, F.lit(1).cast("bigint")))


def events(spark: SparkSession, d: str) -> DataFrame:
    return with_retractions(table(spark, d, "events"), "event_id").withColumn("at_ms", epoch_ms("ts"))


def view(root: Node, z: DataFrame, name: str) -> DataFrame:
    return views(root, z)[name]


def div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / F.lit(n)).cast("bigint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: events as a signed table, in SQL.
Z = "z AS (SELECT *, 1 AS w FROM events UNION ALL SELECT *, -1 FROM events WHERE event_id % 5 = 0)"


@query(f"""WITH {Z} SELECT (epoch_us(ts) // 1000) // 3600000 AS key, sum(w)::BIGINT AS n, round(sum(w * value), 4) AS total
FROM z WHERE value > 1 GROUP BY 1 HAVING sum(w) > 0""")
def hourly_aggregate(spark, d):
    p = Filter(F.col("value") > 1) >> KeyBy(div("at_ms", 3_600_000)) >> Aggregate("hours", total=F.col("value")) >> Table("hourly")
    return view(p, events(spark, d), "hourly").select("key", "n", F.round("total", 4).alias("total"))


@query(f"WITH {Z} SELECT event_id, round(value * 2, 6) AS doubled FROM z WHERE event_type = 'error' GROUP BY event_id, value HAVING sum(w) > 0")
def filter_map(spark, d):
    p = Filter("event_type = 'error'") >> Map(event_id=F.col("event_id"), doubled=F.round(F.col("value") * 2, 6)) >> Bag("b")
    return view(p, events(spark, d), "b").select("event_id", "doubled")


@query(f"WITH {Z} SELECT k, sum(w)::BIGINT AS n FROM (SELECT json_extract_string(props, '$.k')::INT AS k, w FROM z) WHERE k > 50 GROUP BY 1 HAVING sum(w) > 0")
def filter_map_option(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return view(FilterMap(k=F.when(k > 50, k)) >> Bag("b"), events(spark, d), "b")


@query(r"""SELECT token, count(*) AS n FROM (
  SELECT unnest(list_filter(list_transform(regexp_split_to_array(text, '[\s\x0B\p{Z}]+'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: w <> '')) AS token
  FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def flat_map_tokens(spark, d):
    return view(FlatMap("token", tokenize(F.col("text"))) >> Bag("b"), with_weight(table(spark, d, "documents").select("text")), "b")


@query(f"WITH {Z} SELECT sum(w)::BIGINT AS count FROM z")
def count_live(spark, d):
    return view(Count("c"), events(spark, d), "c")


@query(f"WITH {Z} SELECT user_id, event_type, sum(w)::BIGINT AS n FROM z GROUP BY 1, 2 HAVING sum(w) > 0")
def bag_event_types(spark, d):
    return view(Map(user_id=F.col("user_id"), event_type=F.col("event_type")) >> Bag("b"), events(spark, d), "b")


@query(f"WITH {Z} SELECT user_id FROM z GROUP BY 1 HAVING sum(w) > 0")
def distinct_users(spark, d):
    return view(Map(user_id=F.col("user_id")) >> Distinct("u") >> Bag("b"), events(spark, d), "b").select("user_id")


@query(f"""WITH {Z}, s AS (SELECT sum(w)::BIGINT AS n, sum(w * value) AS s, sum(w * value * value) AS ss FROM z)
SELECT n AS count, round(s, 3) AS sum, round(s / n, 6) AS mean, round(greatest(ss / n - (s / n) * (s / n), 0), 3) AS variance, round(sqrt(greatest(ss / n - (s / n) * (s / n), 0)), 4) AS stddev FROM s""")
def stats_value(spark, d):
    s = view(Stats("s", F.col("value")), events(spark, d), "s")
    return s.select("count", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"), F.round("stddev", 4).alias("stddev"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def table_lww(spark, d):
    z = with_weight(table(spark, d, "events")).select(F.col("user_id").alias("key"), "event_type", W, F.col("event_id").alias(SEQ))
    return view(Table("t"), z, "t")


@query("""WITH z AS (SELECT user_id AS key, event_type, event_id * 2 AS s, 1 AS w FROM events UNION ALL SELECT user_id, event_type, event_id * 2 + 101, -1 FROM events WHERE event_id % 5 = 0)
SELECT key, arg_max(event_type, s) AS event_type FROM z GROUP BY 1 HAVING arg_max(w, s) > 0""")
def table_deletes(spark, d):
    e = with_weight(table(spark, d, "events")).select(F.col("user_id").alias("key"), "event_type", W, (F.col("event_id") * 2).alias(SEQ))
    z = plus(e, negate(e.filter(F.col(SEQ) % 10 == 0)).withColumn(SEQ, F.col(SEQ) + 101))
    return view(Table("t"), z, "t")


_LAST = "pairs AS (SELECT user_id AS key, event_type AS val, event_id AS s, CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS w FROM events)"


def _pairs(spark, d):
    w = F.when(F.col("event_id") % 7 == 0, -1).otherwise(1).cast("bigint")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("val"), w.alias(W), F.col("event_id").alias(SEQ))


@query(f"WITH {_LAST} SELECT key, val FROM pairs GROUP BY 1, 2 HAVING arg_max(w, s) > 0")
def multimap_user_types(spark, d):
    return view(Multimap("m"), _pairs(spark, d), "m")


@query(f"WITH {_LAST} SELECT key FROM pairs WHERE val = 'purchase' GROUP BY 1 HAVING arg_max(w, s) > 0")
def inverted_type_users(spark, d):
    return view(InvertedIndex("i"), _pairs(spark, d), "i").filter("val = 'purchase'").select("key")


def _scored(spark, d, by: str | None = None) -> DataFrame:
    return events(spark, d).select(*([F.col(by).alias("key")] if by else []), F.col("value").alias("score"), "event_id", W)


_LIVE = f"WITH {Z}, live AS (SELECT user_id, event_id, ts, value FROM z GROUP BY ALL HAVING sum(w) > 0)"


@query(f"{_LIVE} SELECT value AS score, event_id, 1::BIGINT AS n FROM live ORDER BY value DESC, event_id DESC LIMIT 100")
def ranked_top(spark, d):
    return Ranked.top(view(Ranked("r"), _scored(spark, d), "r"), 100)


@query(f"{_LIVE} SELECT value AS score, event_id, 1::BIGINT AS n FROM live ORDER BY value, event_id LIMIT 100")
def ranked_bottom(spark, d):
    return Ranked.bottom(view(Ranked("r"), _scored(spark, d), "r"), 100)


@query(f"{_LIVE} SELECT value AS score, event_id, 1::BIGINT AS n FROM live WHERE value >= 10 AND value < 20")
def ranked_range(spark, d):
    return Ranked.range(view(Ranked("r"), _scored(spark, d), "r"), 10.0, 20.0, high_open=True)


@query(f"{_LIVE} SELECT user_id AS key, value AS score, event_id, 1::BIGINT AS n FROM live QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) <= 3")
def keyed_ranked_top3(spark, d):
    return Ranked.top(view(KeyedRanked("r"), _scored(spark, d, "user_id"), "r"), 3, ("key",))


@query(f"{_LIVE} SELECT user_id AS key, min(value) AS low, max(value) AS high FROM live GROUP BY 1")
def keyed_ranked_extremes(spark, d):
    e = Ranked.extremes(view(KeyedRanked("r"), _scored(spark, d, "user_id"), "r"), ("key",))
    return e.select("key", F.col("min.score").alias("low"), F.col("max.score").alias("high"))


@query(f"""WITH {Z}, m AS (SELECT floor(value)::BIGINT AS score, event_type, sum(w)::BIGINT AS n FROM z GROUP BY ALL HAVING sum(w) > 0),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC, event_type DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
SELECT score, event_type, least(n, 50 - b)::BIGINT AS n FROM r WHERE b < 50""")
def topk_copies(spark, d):
    p = Map(value=F.col("value"), event_type=F.col("event_type")) >> ScoreBy(F.floor("value").cast("bigint")) >> Map(score=F.col("score"), event_type=F.col("event_type")) >> TopK("k", 50)
    return view(p, events(spark, d), "k").withColumnRenamed(W, "n")


@query(f"{_LIVE}, top AS (SELECT * FROM live ORDER BY (epoch_us(ts) // 1000) DESC, value DESC, event_id DESC LIMIT 1000) SELECT count(*) AS n, round(sum(value), 4) AS total FROM top")
def topk_aggregate(spark, d):
    p = Map(score=F.col("at_ms"), value=F.col("value"), event_id=F.col("event_id")) >> TopK("k", 1000) >> Unscore() >> KeyBy(F.lit(0)) >> Aggregate("a", total=F.col("value")) >> Table("t")
    return view(p, events(spark, d), "t").select("n", F.round("total", 4).alias("total"))


@query(f"WITH {Z} SELECT floor(value / 10)::BIGINT AS bucket, sum(w)::BIGINT AS n FROM z GROUP BY 1 HAVING sum(w) > 0")
def histogram_buckets(spark, d):
    return view(Histogram("h", div("value", 10)), events(spark, d), "h")


@query("""WITH z AS (SELECT floor(value / 10)::BIGINT AS b FROM events WHERE event_id % 5 <> 0)
SELECT q, quantile_disc(b, q) AS bucket FROM z, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.9), (0.99), (1.0)) t(q) GROUP BY q""".replace("quantile_disc(b, q)", "list_sort(list(b))[greatest(1, ceil(q * count(*)))::INT]"))
def histogram_quantiles(spark, d):
    return Histogram.quantiles(view(Histogram("h", div("value", 10)), events(spark, d), "h"), [0.0, 0.25, 0.5, 0.9, 0.99, 1.0])


@query(f"{_LIVE} SELECT event_id, (epoch_us(ts) // 1000) AS at_ms FROM live WHERE (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 86400000")
def retain_window(spark, d):
    z = events(spark, d).select("event_id", "at_ms", W)
    return Retain("w", DAY).batch(z).select("event_id", "at_ms")


@query(f"""WITH {Z} SELECT 'hour' AS grain, (epoch_us(ts) // 1000) // 3600000 AS key, sum(w)::BIGINT AS n, round(sum(w * value), 4) AS total FROM z GROUP BY ALL HAVING sum(w) > 0
UNION ALL SELECT 'day', (epoch_us(ts) // 1000) // 86400000, sum(w)::BIGINT, round(sum(w * value), 4) FROM z GROUP BY ALL HAVING sum(w) > 0""")
def rollup_hour_day(spark, d):
    branch = lambda n, ms: KeyBy(div("at_ms", ms)) >> Aggregate(f"{n}s", total=F.col("value")) >> Table(n)
    v = views(Filter(F.lit(True)) >> (branch("hour", 3_600_000), branch("day", DAY)), events(spark, d))
    one = lambda n: v[n].select(F.lit(n).alias("grain"), "key", "n", F.round("total", 4).alias("total"))
    return one("hour").unionByName(one("day"))


@query("SELECT l_shipdate::DATE AS key, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount > 0 GROUP BY 1")
def daily_positive(spark, d):
    p = Filter(F.col("l_discount") > 0) >> KeyBy(F.col("l_shipdate").cast("date")) >> Aggregate("a", total=F.col("l_extendedprice")) >> Table("t")
    return view(p, with_weight(table(spark, d, "lineitem")), "t").select("key", "n", F.round("total", 2).alias("total"))


_TOKENS = r"""toks AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\s\x0B\p{Z}]+'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: w <> '') AS t FROM documents),
lens AS (SELECT doc_id, coalesce(len(t), 0) AS dl, t FROM toks), st AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM lens)"""


def _bm25_sql(terms: list[str], cols: str) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {_TOKENS}, q(term) AS (VALUES {values}),
tf AS (SELECT doc_id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM lens, q WHERE list_contains(t, term)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st GROUP BY 1)
{cols}"""


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")


@query(_bm25_sql(["barometer", "rain"], "SELECT doc_id AS key, round(score, 6) AS score FROM s"))
def bm25_search(spark, d):
    return bm25(_documents(spark, d), "Rain, BAROMETER!").select("key", F.round("score", 6).alias("score"))


_WORDS = "words AS (SELECT doc_id, coalesce(string_split(lower(text), ' '), []) AS t FROM documents), lens AS (SELECT doc_id, len(t) AS dl, t FROM words), st AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM lens)"


@query(_bm25_sql(["rain", "the"], "SELECT doc_id AS key, round(score, 6) AS score FROM s").replace(_TOKENS, _WORDS).replace("tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))", "tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))"))
def bm25_own_tokenizer(spark, d):
    """A tokenizer and parameters of one's own."""
    return bm25(_documents(spark, d), "the rain", tokenizer=lambda c: F.split(F.lower(c), " "), k1=0.9, b=0.4).select("key", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS} SELECT n AS docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_doc_stats(spark, d):
    docs = view(Bm25("b"), with_weight(_documents(spark, d)), "b")
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.coalesce(F.size("toks"), F.lit(0)).cast("double")), 6).alias("avgdl"))


#: The stated query set: every vector whose id is divisible by 20.
def _knn(spark, d, metric: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    if metric == "hamming":
        v = v.select("key", F.transform("embedding", lambda x: F.round(x.cast("double"), 1).cast("float")).alias("embedding"))
    live = view(VectorIndex("v", metric, 64), with_weight(v), "v")
    q = live.filter("key % 20 = 0").withColumnRenamed("key", "query_key")
    return knn_join(live, q, 10, metric).select("query_key", "rank", F.round("distance", 6).alias("distance"))


def _knn_sql(dist: str, vec: str = "embedding") -> str:
    return f"""WITH v AS (SELECT vec_id, {vec}::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_key, b.vec_id AS key, {dist} AS d FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_key, row_number() OVER (PARTITION BY query_key ORDER BY d, key)::INT AS rank, round(d, 6)::DOUBLE AS distance FROM p QUALIFY rank <= 10"""


def _zip(f: str, agg: str = "list_sum") -> str:
    return f"{agg}(list_transform(list_zip(a.e, b.e), lambda x: {f}))"


@query(_knn_sql(_zip("(x[1] - x[2]) * (x[1] - x[2])")))
def knn_l2(spark, d):
    return _knn(spark, d, "l2")


@query(_knn_sql("sqrt(" + _zip("(x[1] - x[2]) * (x[1] - x[2])") + ")"))
def knn_euclidean(spark, d):
    return _knn(spark, d, "euclidean")


@query(_knn_sql(_zip("abs(x[1] - x[2])")))
def knn_l1(spark, d):
    return _knn(spark, d, "l1")


@query(_knn_sql(_zip("abs(x[1] - x[2])", "list_max")))
def knn_linf(spark, d):
    return _knn(spark, d, "chebyshev")


@query(_knn_sql("-" + _zip("x[1] * x[2]")))
def knn_negdot(spark, d):
    return _knn(spark, d, "neg_dot")


@query(_knn_sql("1 - list_cosine_similarity(a.e, b.e)"))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql(_zip("CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END"), "list_transform(embedding, lambda y: round(y::DOUBLE, 1)::FLOAT)"))
def knn_hamming(spark, d):
    return _knn(spark, d, "hamming")


def _near(spark, d, query: Callable[[Column], Column], metric) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    q = v.filter("key % 20 = 0").select(F.col("key").alias("query_key"), query(F.col("embedding")).alias("embedding"))
    return knn_join(v, q, 10, metric).select("query_key", "rank", F.round("distance", 6).alias("distance"))


@query(_knn_sql("list_sum(list_transform(list_zip(a.e[1:24], b.e[1:24]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"))
def knn_short_queries(spark, d):
    """Queries shorter than the vectors: compared over the shorter length."""
    return _near(spark, d, lambda e: F.slice(e, 1, 24), "l2")


@query(_knn_sql("abs(a.e[1] - b.e[1]) + 3 * abs(a.e[2] - b.e[2])"))
def knn_own_metric(spark, d):
    weighted = Metric(lambda a, b: F.abs(a[0] - b[0]) + 3 * F.abs(a[1] - b[1]), lambda q, b: np.abs(q[:, None, 0] - b[None, :, 0]) + 3 * np.abs(q[:, None, 1] - b[None, :, 1]))
    return _near(spark, d, lambda e: e, weighted)


@query(_knn_sql(_zip("abs(x[1] - x[2])"), "list_transform(embedding, lambda y: round(y::DOUBLE * 100)::DOUBLE)"))
def knn_integers(spark, d):
    """Vectors of whole numbers by L1."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int")).alias("embedding"))
    q = v.filter("key % 20 = 0").withColumnRenamed("key", "query_key")
    return knn_join(v, q, 10, "l1").select("query_key", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT author AS key, sum(__w)::BIGINT AS n FROM messages GROUP BY 1 HAVING sum(__w) > 0")
def author_counts(spark, d):
    p = KeyBy("author") >> Aggregate("a") >> Table("t")
    return view(p, table(spark, d, "messages"), "t")


@query("SELECT id, at_ms, author, body, sum(__w)::BIGINT AS n FROM messages GROUP BY ALL HAVING sum(__w) > 0")
def message_log(spark, d):
    return view(Bag("b"), table(spark, d, "messages"), "b").orderBy("id")


@query("SELECT coalesce(sum(__w), 0)::BIGINT AS next_id FROM messages")
def next_message_id(spark, d):
    return view(Count("c"), table(spark, d, "messages"), "c").withColumnRenamed("count", "next_id")


_LIVE_READINGS = "live AS (SELECT sensor, at_ms, temp_c_tenths AS t, rain_mm_tenths AS r, wind_mph_tenths AS v, sum(__w)::BIGINT AS w FROM readings WHERE sensor IS NOT NULL AND at_ms IS NOT NULL GROUP BY ALL HAVING sum(__w) > 0)"


def _readings(spark, d) -> DataFrame:
    return consolidate(table(spark, d, "readings").filter("sensor is not null and at_ms is not null").select("sensor", "at_ms", "temp_c_tenths", "rain_mm_tenths", "wind_mph_tenths", W), clamp=True)


@query(f"""WITH {_LIVE_READINGS} SELECT sensor, at_ms // 3600000 AS hour, sum(w)::BIGINT AS samples, coalesce(sum(w * t), 0)::BIGINT AS temp, coalesce(sum(w * r), 0)::BIGINT AS rain, coalesce(sum(w * v), 0)::BIGINT AS wind,
round(coalesce(sum(w * t), 0)::DOUBLE / sum(w) / 10, 6) AS avg_temp_c FROM live GROUP BY 1, 2""")
def hourly_weather(spark, d):
    cols = {"temp": "temp_c_tenths", "rain": "rain_mm_tenths", "wind": "wind_mph_tenths"}
    p = KeyBy(F.struct("sensor", div("at_ms", 3_600_000).alias("hour"))) >> Aggregate("hours", **{k: F.col(c).cast("bigint") for k, c in cols.items()}) >> Table("weather")
    v = view(p, _readings(spark, d), "weather")
    return v.select("key.sensor", "key.hour", F.col("n").alias("samples"), *cols, F.round(F.col("temp") / F.col("n") / 10, 6).alias("avg_temp_c"))


@query(f"WITH {_LIVE_READINGS} SELECT at_ms // 86400000 AS key, sum(w)::BIGINT AS n, sum(w * r)::BIGINT AS rain FROM live WHERE r > 0 GROUP BY 1")
def daily_rain(spark, d):
    p = Filter("rain_mm_tenths > 0") >> KeyBy(div("at_ms", DAY)) >> Aggregate("days", rain=F.col("rain_mm_tenths").cast("bigint")) >> Table("rain")
    return view(p, _readings(spark, d), "rain")


@query(f"WITH {_LIVE_READINGS} SELECT sensor, at_ms, t AS temp_c_tenths, w AS n FROM live WHERE at_ms >= (SELECT max(at_ms) FROM live) - 30 * {DAY}::BIGINT")
def recent_readings(spark, d):
    """The readings of the last 30 days as they are kept, copies counted."""
    z = _readings(spark, d)
    return view(Bag("b"), Retain("r", 30 * DAY).batch(z), "b").select("sensor", "at_ms", "temp_c_tenths", "n")


@query("SELECT id AS key, arg_max(text, __seq) AS text FROM memories WHERE id IS NOT NULL GROUP BY 1 HAVING arg_max(__w, __seq) > 0")
def memory_table(spark, d):
    return _memories(spark, d)


def _memories(spark, d) -> DataFrame:
    z = table(spark, d, "memories").filter("id is not null").select(F.col("id").alias("key"), "text", W, SEQ)
    return view(Table("t"), z, "t")


@query("SELECT coalesce(max(id) + 1, 0) AS next_id FROM (SELECT id FROM memories WHERE id IS NOT NULL GROUP BY 1 HAVING arg_max(__w, __seq) > 0)")
def next_memory_id(spark, d):
    return _memories(spark, d).agg(F.coalesce(F.max("key") + 1, F.lit(0)).alias("next_id"))


def _semantic(spark, rows: DataFrame, text: str, k: int) -> DataFrame:
    model = stand_in(["rain", "gauge", "index", "view", "wind", "search"])
    vectors = rows.select("key", embed(spark, model)("text").alias("embedding"))
    return knn(view(VectorIndex("v", "cosine"), with_weight(vectors), "v"), model.encode(text).tolist(), k, "cosine")


@query(_bm25_sql(["rain"], ", a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10))") + """, b AS (
  SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT b.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS d
    FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ORDER BY d, vec_id LIMIT 10))
SELECT key, round(sum(1 / (60.0 + r)), 9)::DOUBLE AS score FROM (SELECT doc_id AS key, r FROM a UNION ALL SELECT vec_id, r FROM b) GROUP BY 1 ORDER BY sum(1 / (60.0 + r)) DESC, key LIMIT 3""")
def hybrid_rrf(spark, d):
    words = bm25(_documents(spark, d), "rain", 10)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    near = knn_join(v, v.filter("key = 0").withColumnRenamed("key", "query_key"), 10)
    both = fuse([(words, [F.desc("score"), F.asc("key")]), (near, [F.round("distance", 9), F.asc("key")])], 3)
    return both.select("key", F.round("score", 9).alias("score"))


@query()
def memory_search_hybrid(spark, d):
    """Keyword and semantic search over the live memories, fused."""
    rows = _memories(spark, d)
    text = "rain gauge near the index"
    lists = [(bm25(rows, text, 10), [F.desc("score"), F.asc("key")]), (_semantic(spark, rows, text, 10), [F.asc("distance"), F.asc("key")])]
    return fuse(lists, 3).join(rows, "key").select("key", "text", F.round("score", 9).alias("score"))


@query()
def embed_text(spark, d):
    """A vector for every live memory, by the stand-in model."""
    return _memories(spark, d).select("key", embed(spark, stand_in(["rain", "wind"]))("text").alias("embedding"))


@query(r"SELECT doc_id, strip_accents(lower(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}]', '', 'g'), '[\s\p{Z}]', ' ', 'g'), '([\p{Han}])', ' \1 ', 'g'))) AS text FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", normalized(F.col("text")).alias("text"))


@query(f"WITH {Z} SELECT user_id AS key, sum(w)::BIGINT AS n, max(value) FILTER (w > 0 AND event_id % 5 <> 0) AS best FROM z GROUP BY 1 HAVING sum(w) > 0")
def reduce_best_live(spark, d):
    """A non-linear aggregate: the greatest live value of a user, with retractions replayed."""

    def step(acc, row, w):
        kept = acc["kept"] if acc else {}
        n = kept.get(row["value"], 0) + w
        if n:
            kept[row["value"]] = n
        else:
            kept.pop(row["value"])
        return {"kept": kept}

    z = events(spark, d).select(F.col("user_id").alias("key"), "value", W, SEQ)
    f = view(KeyedReduce("f", step, "kept map<double, bigint>"), z, "f")
    return f.select("key", "n", F.array_max(F.map_keys("kept")).alias("best"))


@query(f"WITH {Z} SELECT event_id, value, sum(w)::BIGINT AS n FROM z GROUP BY 1, 2 HAVING sum(w) > 0")
def unkey_roundtrip(spark, d):
    p = KeyBy("user_id") >> Unkey() >> ScoreBy("value") >> Unscore() >> Map(event_id=F.col("event_id"), value=F.col("value")) >> Bag("b")
    return view(p, events(spark, d), "b")

