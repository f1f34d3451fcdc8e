"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.session import cut, small

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", data: bytes | None = None):
    """The byte-level BPE of a vocabulary file (or of its contents), loaded once per process."""
    if path not in _encodings:
        import tiktoken

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens, ``tokens``; null text has 0. Texts are read whole.

    The vocabulary file is read by the driver and its contents are broadcast, so executors need no copy of it.
    """
    rest = [c for c in df.columns if c != text]
    with open(path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, vocabulary.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[c] for c in rest] + [pa.array(n, pa.int64())], names=[*rest, "tokens"])

    kinds = dict(df.dtypes)
    return df.select(*rest, text).mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "tokens bigint"]))


def source_name(c: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(src, weight, repeats), one row per source with a positive finite weight; of several rows the heaviest counts.

    Null ``max_repeats`` means 1. Null and blank sources leave.
    """
    w = F.col("weight").cast("double")
    return (
        targets.select(source_name(F.col("source")).alias("src"), w.alias("weight"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("repeats"))
        .filter((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")) & (F.col("src") != ""))
        .groupBy("src")
        .agg(F.max(F.struct("weight", "repeats")).alias("m"))
        .select("src", "m.weight", "m.repeats")
    )


def _factor(src: Column, tau: Column, schedule: Mapping[str, Sequence[tuple[float, float]]]) -> Column:
    """Piecewise linear factor of a source's weight at time ``tau``; 1 where no schedule is given."""
    out = F.lit(1.0)
    for name, points in schedule.items():
        pts = sorted(points)
        f = F.lit(float(pts[-1][1]))
        for (a, x), (b, y) in reversed(list(zip(pts, pts[1:], strict=False))):
            f = F.when(tau < b, x + (tau - a) * ((y - x) / (b - a))).otherwise(f)
        f = F.when(tau <= pts[0][0], float(pts[0][1])).otherwise(f)
        out = F.when(src == name, f).otherwise(out)
    return out


def plan_mix(sizes: DataFrame, targets: DataFrame, schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None, size: int | None = None, steps: int = 64) -> DataFrame:
    """Per source: share, supply, cumulative demand at ``steps`` + 1 points of training time, and its end.

    ``sizes`` has (src, docs, tokens) for all documents, those of no source included: the mix is as large as all of
    them unless ``size`` is given. A source's weight at time tau in [0, 1] is its target weight times its schedule's
    factor; weights are normalised at each time and integrated by the trapezoid rule. With constant factors the
    demand at the end is the target share of the whole.
    """
    total = F.lit(size) if size else F.sum("tokens")
    whole = sizes.agg(F.coalesce(total, F.lit(0)).cast("double").alias("whole"))
    t = clean_targets(targets).join(sizes.filter("src is not null"), "src", "left").fillna(0, ["docs", "tokens"]).crossJoin(F.broadcast(whole))
    k = F.col("k")
    grid = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    grid = grid.withColumn("rate", F.col("weight") * _factor(F.col("src"), k / F.lit(float(steps)), schedule or {}))
    grid = grid.withColumn("rate", F.col("rate") / F.sum("rate").over(Window.partitionBy("k")))
    w = Window.partitionBy("src").orderBy("k")
    piece = (F.col("rate") + F.lag("rate").over(w)) / F.lit(2.0 * steps) * F.col("whole")
    grid = grid.withColumn("piece", F.coalesce(piece, F.lit(0.0)))
    grid = grid.withColumn("cum", F.sum("piece").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cum = F.transform(F.sort_array(F.collect_list(F.struct("k", "cum"))), lambda x: x["cum"])
    return grid.groupBy("src", "weight", "repeats", "docs", "tokens", "whole").agg(cum.alias("demand")).withColumn("wanted", F.element_at("demand", -1)).withColumn("share", F.when(F.col("whole") > 0, F.col("wanted") / F.col("whole")))


def mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The selected copies of documents with their training positions: (key, src, copy, tokens, position).

    ``docs`` has (key, src, tokens). The documents of a source stand in order of a hash of their key; pass r over
    them starts at r times the source's tokens. A copy whose middle lies before the end of the source's demand is
    taken, up to the permitted repeats, and its position is the time at which the source's cumulative demand reaches
    the copy's start, times the size of the mix. Running totals are formed inside (source, hash bucket) groups and
    over the bucket sums, so that a source of any size is spread over 4,096 groups.

    Documents of sources without target, or without tokens, are not selected. Equal keys are different documents
    that follow each other. Sort by (position, key, copy) for the training order.
    """
    h = F.xxhash64(F.col(key))
    d = docs.filter("src is not null and tokens > 0").select(F.col(key), "src", F.col("tokens").cast("bigint"), h.alias("h")).withColumn("b", F.shiftright("h", 52) + F.lit(2048))
    sums = d.groupBy("src", "b").agg(F.sum("tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = small(sums.select("src", "b", before.alias("base")))
    w = Window.partitionBy("src", "b").orderBy("h", key, "tokens").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("inner", F.sum("tokens").over(w) - F.col("tokens")).join(sums, ["src", "b"])
    p = small(plan.select("src", F.col("repeats"), F.col("tokens").alias("supply"), "demand", "wanted", "whole").filter("supply > 0 and repeats > 0"))
    d = d.join(p, "src").withColumn("start", F.col("base") + F.col("inner"))
    passes = F.least(F.col("repeats"), F.ceil(F.col("wanted") / F.col("supply")).cast("int"))
    d = d.filter("wanted > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    d = d.withColumn("start", F.col("start") + F.col("copy") * F.col("supply")).filter("start + tokens / 2 <= wanted")
    i = F.greatest(F.size(F.filter("demand", lambda x: x <= F.col("start"))), F.lit(1))
    d = d.withColumns({"i": F.least(i, F.size("demand") - 1), "n": F.size("demand") - 1})
    lo, hi = F.element_at("demand", F.col("i")), F.element_at("demand", F.col("i") + 1)
    tau = (F.col("i") - 1 + F.when(hi > lo, (F.col("start") - lo) / (hi - lo)).otherwise(0.0)) / F.col("n")
    return d.select(key, "src", "copy", "tokens", F.floor(tau * F.col("whole")).cast("bigint").alias("position"))


def mix_report(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: target and actual share, tokens wanted, supplied and used, and whether it runs short.

    A source runs short if all its documents, each taken as often as permitted, have fewer tokens than wanted: the
    selection then ends before the source's demand does.
    """
    used = selected.groupBy("src").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("copies"))
    r = plan.join(used, "src", "left").fillna(0, ["used", "copies"])
    whole = r.agg(F.sum("used").alias("all_used"))
    permitted = F.col("tokens") * F.col("repeats")
    short = (permitted < F.col("wanted")) & (F.col("used") == permitted)
    return r.crossJoin(F.broadcast(whole)).select(
        "src", "weight", "share", "docs", "repeats", "copies", F.col("tokens").alias("supply"), F.col("wanted").cast("double").alias("wanted"), "used",
        (F.col("used") / F.col("all_used")).alias("actual_share"), short.alias("short"),
    )


def curriculum(documents: DataFrame, targets: DataFrame, key: str = "doc_id", schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None, size: int | None = None, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", sizes: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for documents (key, text, source) and targets (source, weight, max_repeats).

    Sources are compared in lower case without surrounding white space. All documents are tokenised once; their
    token counts are kept in a checkpoint. ``sizes`` is another measure of a document than its tokens, such as a column
    of counts already made. Null texts have no tokens; documents of null or unknown source count for
    the size of the mix and are not selected. Empty tables give an empty selection, and a report of the targets.
    """
    src = source_name(F.col("source")).alias("src")
    counted = cut(count_tokens(documents.select(key, src, "text"), path=path) if sizes is None else documents.select(key, src, sizes.cast("bigint").alias("tokens")))
    totals = counted.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    plan = cut(plan_mix(totals, targets, schedule, size))
    selected = mix(counted, plan, key)
    return selected, mix_report(selected, plan)
