"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.contamination import leak_counts, leaks, without_leaks
from tarnflow.llm.mixing import curriculum
from tarnflow.llm.neighbours import pairs, similar
from tarnflow.llm.quality import not_prose, text_quality
from tarnflow.llm.rank_sketch import build_sketches, merge_sketches, percentiles
from tarnflow.operators.readings import DAY_MS, live_rows
from tarnflow.session import cut, table

QS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
VALUES = ("temp_c_tenths", "wind_mph_tenths")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per sensor, and for all sensors (sensor null): percentiles with the bound of their rank error."""
    parts = build_sketches(live_rows(table(spark, d, "readings")), ["sensor"], VALUES)
    each = cut(merge_sketches(parts, ["sensor"]))
    everything = percentiles(merge_sketches(each), QS).select(F.lit(None).cast("string").alias("sensor"), "field", "q", "n", "value", "lower", "upper", "rank_error")
    return percentiles(each, QS, ["sensor"]).unionByName(everything)


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per sensor from the sketches of its separate days."""
    live = live_rows(table(spark, d, "readings")).withColumn("day", F.floor(F.col("at_ms") / F.lit(DAY_MS)).cast("bigint"))
    days = merge_sketches(build_sketches(live, ["sensor", "day"], VALUES), ["sensor", "day"])
    return percentiles(merge_sketches(days, ["sensor"]), QS, ["sensor"])


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact ranks of the percentiles lie within their stated error: (sensor, field, q, n, within)."""
    return _ranks_checked(spark, d, p2_percentiles(spark, d))


def p2_daily_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same of the percentiles added up from days."""
    return _ranks_checked(spark, d, p2_daily(spark, d))


def _ranks_checked(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    found = cut(found)
    each = F.inline(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("v")) for v in VALUES)))
    counts = live_rows(table(spark, d, "readings")).select("sensor", each).filter("v is not null").groupBy("sensor", "field", "v").agg(F.count(F.lit(1)).alias("c"))
    both = counts.unionByName(counts.groupBy("field", "v").agg(F.sum("c").alias("c")).withColumn("sensor", F.lit(None).cast("string")))
    asked = found.groupBy(F.col("sensor").alias("s"), F.col("field").alias("f")).agg(F.collect_list(F.struct("q", "n", "value", "rank_error")).alias("qs"))
    x = both.join(asked, F.col("sensor").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))).select("sensor", "field", "v", "c", F.explode("qs").alias("a"))
    below, upto = F.sum(F.when(F.col("v") < F.col("a.value"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("v") <= F.col("a.value"), F.col("c")).otherwise(0))
    ranks = x.groupBy("sensor", "field", F.col("a.q").alias("q"), F.col("a.n").alias("n"), F.col("a.rank_error").alias("e")).agg(below.alias("below"), upto.alias("upto"))
    rank = F.col("q") * F.col("n")
    # the q quantile is the value at rank ceil(q n), so the wanted rank itself lies up to one above
    within = (F.col("below") <= rank + F.col("e") * F.col("n") + 1) & (F.col("upto") >= rank - F.col("e") * F.col("n") - 1e-6)
    return ranks.select("sensor", "field", "q", "n", within.alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(similar(table(spark, d, "base_vectors")))


def p4_queries(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest base vectors of every query vector."""
    return similar(table(spark, d, "base_vectors"), table(spark, d, "query_vectors")).select(F.col("id").alias("query_id"), "rank", F.col("near_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked, with the number of documents that hold them."""
    return leak_counts(_leaks(spark, d))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """All documents, without the leaked spans."""
    return without_leaks(table(spark, d, "documents"), _leaks(spark, d)).select("doc_id", "text", "source")


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """The found pairs whose document holds 24 words of the item, from every fourth word on, without any change but case and marks."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " "))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), bare("text"), F.lit(" ")).alias("t"))
    ws = F.split(bare("text"), " ")
    windows = F.when(F.size(ws) >= 24, F.transform(F.sequence(F.lit(0), F.size(ws) - 24, F.lit(4)), lambda n: F.concat(F.lit(" "), F.array_join(F.slice(ws, n + 1, 24), " "), F.lit(" "))))
    items = table(spark, d, "eval_items").select("item_id", windows.alias("ws"))
    found = p6_found(spark, d).join(docs, "doc_id").join(F.broadcast(items), "item_id")
    return found.filter(F.exists("ws", lambda w: F.contains(F.col("t"), w))).select("doc_id", "item_id").distinct()


def p6_clean_checked(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are, and how many stretches of items are left in their cleaned texts."""
    clean = p6_clean(spark, d)
    left = leaks(clean, table(spark, d, "eval_items")).agg(F.count(F.lit(1)).alias("left"))
    return clean.agg(F.count(F.lit(1)).alias("docs")).crossJoin(left)


#: Large sources early, small and scarce ones late.
TILTED = {"forum": ((0.0, 1.3), (1.0, 0.7)), "station_log": ((0.0, 1.2), (1.0, 0.8)), "manual": ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = curriculum(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.filter("short").select(F.col("src").alias("source"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    _, report = curriculum(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix in training order, with weights that change over time."""
    selected, _ = curriculum(table(spark, d, "documents"), table(spark, d, "mix_targets"), schedule=TILTED)
    return selected.orderBy("position", "doc_id", "copy")


def p7_mix_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mix: whether repeats are capped, its size is that of its demand or of its supply, and each pass is whole before the next."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    selected, report = curriculum(docs, targets, schedule=TILTED)
    x = cut(selected).groupBy("src").agg(F.max("copy").alias("last"), F.max("tokens").alias("largest"), F.countDistinct("doc_id", "copy").alias("kinds"), F.count_if(F.col("copy") == 0).alias("firsts"), F.min("position").alias("from"), F.max("position").alias("to"))
    r = report.filter("supply > 0 and repeats > 0").join(x, "src", "left")
    full = F.col("used") == F.col("supply") * F.col("repeats")
    near = F.abs(F.col("used") - F.col("wanted")) <= F.col("largest")
    docs_with_text = F.coalesce(F.col("firsts"), F.lit(0))
    return r.select("src", (F.col("last") < F.col("repeats")).alias("capped"), (full | near).alias("on_target"), ((F.col("last") == 0) | (docs_with_text > 0)).alias("whole_passes"), ((F.col("from") >= 0) & (F.col("from") <= F.col("to"))).alias("in_order"))


def p7_characters(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix whose sizes are characters: shares, supply and the sources that run short."""
    _, report = curriculum(table(spark, d, "documents"), table(spark, d, "mix_targets"), sizes=F.coalesce(F.length("text"), F.lit(0)))
    return report.select("src", "weight", "repeats", "docs", "supply", F.round("share", 9).alias("share"), F.round("wanted", 3).alias("wanted"), "short")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(text_quality(table(spark, d, "documents")))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"))


def p8_certain(spark: SparkSession, d: str) -> DataFrame:
    """The found documents that plainly are tables: nine tenths of their lines have two tabs or bars, or are JSON."""
    lines = F.filter(F.split("text", "\\R"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: x.rlike(r"^[^\t]*\t[^\t]*\t|^[^|]*\|[^|]*\||^\{.*\}$"))
    plain = table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), F.size(rows).alias("r")).filter("n >= 4 and 10 * r >= 9 * n").select("doc_id")
    return p8_found(spark, d).join(plain, "doc_id")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain figures of the texts, which SQL can count too."""
    return p8_quality(spark, d).select("doc_id", "words", "lines", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_ratio", 6).alias("symbol_ratio"))


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_daily": p2_daily, "p2_checked": p2_checked, "p2_daily_checked": p2_daily_checked,
    "p4_found": p4_found, "p4_queries": p4_queries,
    "p6_found": p6_found, "p6_items": p6_items, "p6_clean": p6_clean, "p6_exact": p6_exact, "p6_clean_checked": p6_clean_checked,
    "p7_found": p7_found, "p7_report": p7_report, "p7_mix": p7_mix, "p7_characters": p7_characters, "p7_mix_checked": p7_mix_checked,
    "p8_found": p8_found, "p8_quality": p8_quality, "p8_counts": p8_counts, "p8_certain": p8_certain,
}

_USABLE = """vectors AS (
  SELECT vec_id AS id, min(val)::DOUBLE[] AS v FROM base_vectors
  WHERE vec_id IS NOT NULL AND len(val) = 64 AND len(list_filter(val, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(val, lambda x: x <> 0)) > 0
  GROUP BY 1)"""
_L2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"

ORACLE: dict[str, str] = {
    "p4_found": f"""WITH {_USABLE},
near AS (SELECT a.id AS x, b.id AS y FROM vectors a JOIN vectors b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_L2}, b.id) <= 10)
SELECT DISTINCT least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM near""",
    "p4_queries": f"""WITH {_USABLE},
q AS (SELECT query_id AS id, min(val)::DOUBLE[] AS v FROM query_vectors WHERE len(val) = 64 AND len(list_filter(val, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(val, lambda x: x <> 0)) > 0 GROUP BY 1)
SELECT a.id AS query_id, row_number() OVER w::INT AS rank, b.id AS vec_id, round({_L2}, 6) AS distance FROM q a, vectors b
WINDOW w AS (PARTITION BY a.id ORDER BY {_L2}, b.id) QUALIFY rank <= 10""",
    "p2_checked": """WITH live AS (SELECT sensor, at_ms, temp_c_tenths, rain_mm_tenths, wind_mph_tenths FROM readings WHERE sensor IS NOT NULL AND at_ms IS NOT NULL GROUP BY ALL HAVING sum(__w) > 0),
f AS (SELECT sensor, 'temp_c_tenths' AS field FROM live WHERE temp_c_tenths IS NOT NULL UNION ALL SELECT sensor, 'wind_mph_tenths' FROM live WHERE wind_mph_tenths IS NOT NULL),
n AS (SELECT sensor, field, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT NULL, field, count(*) FROM f GROUP BY field)
SELECT sensor, field, q::DOUBLE AS q, n, true AS within FROM n, (VALUES (0.001), (0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99), (0.999)) t(q)""",
    "p2_daily_checked": """WITH live AS (SELECT sensor, at_ms, temp_c_tenths, rain_mm_tenths, wind_mph_tenths FROM readings WHERE sensor IS NOT NULL AND at_ms IS NOT NULL GROUP BY ALL HAVING sum(__w) > 0),
f AS (SELECT sensor, 'temp_c_tenths' AS field FROM live WHERE temp_c_tenths IS NOT NULL UNION ALL SELECT sensor, 'wind_mph_tenths' FROM live WHERE wind_mph_tenths IS NOT NULL),
n AS (SELECT sensor, field, count(*) AS n FROM f GROUP BY ALL)
SELECT sensor, field, q::DOUBLE AS q, n, true AS within FROM n, (VALUES (0.001), (0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99), (0.999)) t(q)""",
    "p6_exact": """WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
i AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM eval_items),
e AS (SELECT item_id, ' ' || array_to_string(ws[n + 1 : n + 24], ' ') || ' ' AS w FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 23, 4)) AS n FROM i))
SELECT DISTINCT doc_id, item_id FROM d JOIN e ON contains(d.t, e.w)""",
    "p6_clean_checked": "SELECT count(*) AS docs, 0::BIGINT AS left FROM documents",
    "p7_mix_checked": """WITH t AS (SELECT lower(trim(source)) AS src, max({'w': weight, 'r': greatest(coalesce(max_repeats, 1), 0)}) AS m FROM mix_targets WHERE weight > 0 AND NOT isnan(weight) AND source IS NOT NULL GROUP BY 1)
SELECT src, true AS capped, true AS on_target, true AS whole_passes, true AS in_order FROM t WHERE m.r > 0 AND src IN (SELECT lower(trim(source)) FROM documents WHERE length(text) > 0)""",
    "p8_certain": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]'), lambda x: trim(x) <> '') AS ls FROM documents)
SELECT doc_id FROM l WHERE len(ls) >= 4 AND 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[^\t]*\t[^\t]*\t|^[^|]*\|[^|]*\||^\{.*\}$'))) >= 9 * len(ls)""",
    "p7_characters": """WITH t AS (SELECT lower(trim(source)) AS src, max({'w': weight, 'r': greatest(coalesce(max_repeats, 1), 0)}) AS m FROM mix_targets WHERE weight > 0 AND NOT isnan(weight) AND source IS NOT NULL GROUP BY 1),
d AS (SELECT lower(trim(source)) AS src, count(*) AS docs, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY 1),
a AS (SELECT sum(m.w) AS w, (SELECT sum(size) FROM d)::DOUBLE AS size FROM t)
SELECT t.src, m.w AS weight, m.r::INT AS repeats, coalesce(docs, 0)::BIGINT AS docs, coalesce(d.size, 0)::BIGINT AS supply, round(m.w / a.w, 9) AS share, round(m.w / a.w * a.size, 3) AS wanted,
coalesce(d.size, 0) * m.r < m.w / a.w * a.size AS short FROM t LEFT JOIN d USING (src), a""",
    "p8_counts": r"""WITH d AS (SELECT doc_id, replace(text, chr(65279), '') AS t FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{L}\p{Nl}\p{No}]+') AS ws, length(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g')) AS dense FROM d)
SELECT doc_id, CASE WHEN dense > 0 THEN len(ws)::INT END AS words,
CASE WHEN dense > 0 THEN len(list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda l: regexp_matches(l, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')))::INT END AS lines,
CASE WHEN dense > 0 THEN round(coalesce(list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE / nullif(len(ws), 0), 0), 6) END AS mean_word_length,
CASE WHEN dense > 0 THEN round(length(regexp_replace(t, '[\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g'))::DOUBLE / dense, 6) END AS symbol_ratio FROM x""",
    # a source's shortage is the same in characters as in tokens of any tokenizer
    "p7_found": """WITH t AS (SELECT lower(trim(source)) AS source, max(weight) AS weight, max(max_repeats) AS repeats FROM mix_targets WHERE weight > 0 AND NOT isnan(weight) AND source IS NOT NULL GROUP BY 1),
d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents GROUP BY 1)
SELECT t.source FROM t LEFT JOIN d USING (source)
WHERE coalesce(d.size, 0) * t.repeats < t.weight / (SELECT sum(weight) FROM t) * (SELECT sum(size) FROM d)""",
}
