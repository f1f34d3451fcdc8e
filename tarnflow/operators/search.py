"""Full-text search, nearest vectors and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarnflow.functions.metrics import Metric, metric_of
from tarnflow.functions.text import Tokenizer, count_in, tokenize
from tarnflow.plans.node import GONE, SEQ, Context, Node, Patch, State, Step, hold, touched
from tarnflow.session import cut, measure
from tarnflow.zset import W, consolidate

K1, B = 1.2, 0.75
#: Files that the postings of one term are spread over.
SPREAD = 16
#: Live vectors from which a view keeps cells, those that the centres are fitted on, and cells at most.
CELLS_FROM, SAMPLE, CELLS = 500, 20_000, 1024


def query_terms(df: DataFrame, query: str, tokenizer: Tokenizer = tokenize) -> list[str]:
    """The distinct terms of a query, by the same tokenizer as the documents."""
    spark = df.sparkSession
    row = spark.range(1).select(F.array_distinct(tokenizer(F.lit(query))).alias("t")).first()
    return sorted(row["t"] or [])


def bm25(docs: DataFrame, query: str, limit: int | None = None, key: str = "key", text: str = "text", tokenizer: Tokenizer = tokenize, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents with at least one term of the query, best first; ties go to the lesser key.

    ``docs`` has one row per live document with ``text`` or ready ``toks``. Terms are counted inside each document's
    token array, in one pass over the texts whose counts are kept in a checkpoint; no token is shuffled. Documents without
    tokens count as documents.
    """
    terms = query_terms(docs, query, tokenizer)
    toks = F.col("toks") if "toks" in docs.columns else tokenizer(F.col(text))
    # the generator keeps the optimizer from copying the tokenizer into every expression that uses its result
    once = F.explode(F.array(F.coalesce(toks, F.array().cast("array<string>"))))
    d = docs.select(F.col(key).alias("key"), once.alias("toks"))
    tf = [count_in(F.col("toks"), w) for w in terms]
    d = d.select("key", F.coalesce(F.size("toks"), F.lit(0)).alias("dl"), *(F.coalesce(c, F.lit(0)).alias(f"tf{i}") for i, c in enumerate(tf)))
    d = cut(d)  # narrow rows: the texts are read and tokenised once
    stats = d.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"), *(F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("bigint")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))))
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        n, f, t = F.col("docs"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log(1 + (n - f + 0.5) / (f + 0.5))
        score = score + F.when(t > 0, idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    out = d.filter(hit).crossJoin(F.broadcast(stats)).select("key", score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "key").limit(limit)


def postings(docs: DataFrame, key: str = "key", text: str = "text", tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(term, key, tf, dl): the inverted index of a collection."""
    toks = F.col("toks") if "toks" in docs.columns else tokenizer(F.col(text))
    return docs.select(F.col(key).alias("key"), toks.alias("toks")).select("key", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", "key", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "key", "tf", "dl")


def bm25_from_postings(index: DataFrame, stats: DataFrame, terms: Sequence[str], limit: int, k1: float = K1, b: float = B) -> DataFrame:
    """The same scores from ``postings`` and (docs, avgdl): reads only the rows of the query's terms."""
    hit = index.filter(F.col("term").isin(list(terms)))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return s.groupBy("key").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def emptied(delta: DataFrame, live: DataFrame) -> DataFrame:
    """The keys of a delta that have no live row left."""
    ks = live.select(F.col("key").alias("__k0")).distinct()
    return delta.select("key").distinct().join(ks, F.col("key").eqNullSafe(F.col("__k0")), "left_anti")


def replacing(live: DataFrame, gone: DataFrame) -> Patch:
    """The patch that puts ``live`` in place of all rows of its keys and of those in ``gone``."""
    return Patch(live.withColumn(GONE, F.lit(False)).unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True), ["key"])


class Bm25(Node):
    """Full-text view of (key, text): scores always follow the live documents, also after an upsert."""

    def __init__(self, name: str, tokenizer: Tokenizer = tokenize, k1: float = K1, b: float = B) -> None:
        super().__init__()
        self.name, self.tokenizer, self.k1, self.b = name, tokenizer, k1, b

    def batch(self, z: DataFrame) -> DataFrame:
        live = consolidate(z.select("key", "text", W), ["key", "text"], clamp=True)
        return live.select("key", "text", self.tokenizer(F.col("text")).alias("toks"))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        old, z = state.get("docs"), delta.select("key", "text", W)
        if old is not None:
            z = z.unionByName(touched(old, delta, ["key"]).select("key", "text", F.col("__n").alias(W)))
        docs = consolidate(z, ["key", "text"], clamp=True).select("key", "text", F.col(W).alias("__n"), self.tokenizer(F.col("text")).alias("toks"))
        docs = hold(docs)
        # a term that all documents have is spread over several files
        index = postings(docs).repartition(F.col("term"), F.pmod(F.hash("key"), F.lit(SPREAD))).sortWithinPartitions("term", "key")
        gone = emptied(delta, docs)
        before = [] if old is None else [self._counts(touched(old, delta, ["key"]), -1), state["stats"]]
        stats = self._counts(docs, 1)
        for b in before:
            stats = stats.unionByName(b)
        stats = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "tokens")))
        return Step({"docs": replacing(docs, gone), "postings": replacing(index, gone), "stats": stats})

    @staticmethod
    def _counts(docs: DataFrame, sign: int) -> DataFrame:
        """(docs, tokens) of some documents, to be added to or taken from the kept counts."""
        return docs.agg((F.count(F.lit(1)) * sign).alias("docs"), (F.coalesce(F.sum(F.greatest(F.size("toks"), F.lit(0)).cast("bigint")), F.lit(0)) * sign).alias("tokens"))

    class Reader:
        def __init__(self, state: State, node: Bm25) -> None:
            self.state, self.node = state, node

        def doc_count(self) -> int:
            return int(self.state["stats"].first()["docs"]) if "stats" in self.state else 0

        def search(self, query: str, limit: int) -> DataFrame | None:
            if "docs" not in self.state:
                return None
            stats = self.state["stats"].select("docs", (F.col("tokens") / F.col("docs")).alias("avgdl"))
            return bm25_from_postings(self.state["postings"], stats, query_terms(self.state["docs"], query, self.node.tokenizer), limit, self.node.k1, self.node.b)

    def reader(self, state: State) -> Bm25.Reader:
        return self.Reader(state, self)


def knn(base: DataFrame, query: Sequence[float] | Column, k: int, metric: str | Metric = "l2", key: str = "key", vector: str = "embedding") -> DataFrame:
    """(key, distance) of the k nearest vectors to one query, nearest first, ties to the lesser key: exact."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    d = metric_of(metric).column(F.col(vector), q)
    return base.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), d.alias("distance")).orderBy("distance", "key").limit(k)


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[starts[rows][:, None] + np.arange(n)]))
    return out


def knn_join(base: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", key: str = "key", query_key: str = "query_key", vector: str = "embedding", block: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_key, rank, key, distance) of the k nearest base vectors of every query: exact, all rows.

    The stated query set is compared with all rows in blocks of ``block`` queries or about ``block_bytes`` of them, each broadcast to the
    partitions of the base table; every partition keeps its k best per query, and these are merged by query. Vectors
    are compared over the shorter length; null vectors leave.
    """
    spark = base.sparkSession
    kinds = dict(base.dtypes)[key], dict(queries.dtypes)[query_key]
    f = metric_of(metric).block
    if f is None:
        raise ValueError("a join by a metric of one's own needs its distances of blocks")
    qs = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    count, size = measure(qs)
    blocks = max(1, -(-count // block), -(-size // block_bytes))
    out = None
    for n in range(blocks):
        rows = (qs.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n) if blocks > 1 else qs).toArrow()
        shared = spark.sparkContext.broadcast((rows["q"].combine_chunks(), _by_length(rows["v"])))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, groups = shared.value
            best: list[tuple] = []
            held = 0

            def settle() -> None:
                """Keeps the k first of each query."""
                q, d, x = (np.concatenate(c) for c in zip(*best, strict=True))
                order = np.lexsort((x, d, q))
                q, d, x = q[order], d[order], x[order]
                start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                best[:] = [(q[rank < k], d[rank < k], x[rank < k])]

            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                names = b["k"].to_numpy(zero_copy_only=False)
                for at, x in _by_length(b["v"]):
                    for j, v in groups:
                        size = min(x.shape[1], v.shape[1])
                        d = f(v[:, :size], x[:, :size])
                        most = np.partition(d, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1, None]
                        r, c = np.nonzero(d <= most)
                        best.append((j[r], d[r, c], names[at[c]]))
                        held += len(r)
                if held > 4 * k * len(ids) + 100_000:
                    settle()
                    held = len(best[0][0])
            if best:
                settle()
                q, d, x = best[0]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(x, types), pa.array(d, pa.float64())], names=["q", "key", "distance"])

        types = to_arrow_type(base.schema[key].dataType)
        part = base.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(scan, f"q {kinds[1]}, key {kinds[0]}, distance double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "key"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", "key", "distance")


def _towards(x: np.ndarray, metric: str | Metric) -> np.ndarray:
    """Vectors as cells see them: by direction for metrics of direction."""
    if metric not in ("cosine", "neg_dot"):
        return x
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """k-means from vectors spread evenly over the sample."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest_cell(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=cells)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest_cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class VectorIndex(Node):
    """Nearest-vector view of (key, embedding): the latest live vector of each key.

    From CELLS_FROM vectors on the state is kept by cells: centres fitted on at most SAMPLE live vectors, each vector
    under its nearest one; they are fitted anew when the view has four times as many. ``search`` is exact without
    ``probes`` and reads only the rows of the ``probes`` nearest cells with it. With ``dim``, vectors of another length
    leave; without, cells are kept only while all vectors of the sample have one length.
    """

    def __init__(self, name: str, metric: str | Metric = "l2", dim: int | None = None) -> None:
        super().__init__()
        self.name, self.metric, self.dim = name, metric, dim

    def _live(self, z: DataFrame) -> DataFrame:
        seq = F.col(SEQ) if SEQ in z.columns else F.lit(0)
        each = z.filter(F.col("embedding").isNotNull())
        if self.dim is not None:
            each = each.filter(F.size("embedding") == self.dim)
        each = each.groupBy("key", "embedding").agg(F.sum(W).alias("n"), F.max(seq).alias("s")).filter("n > 0")
        return each.groupBy("key").agg(F.max_by("embedding", F.struct("s", "embedding")).alias("embedding"))

    def batch(self, z: DataFrame) -> DataFrame:
        return self._live(z)

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        old, cols = state.get("vectors"), ["key", "embedding"]
        seq = F.col(SEQ) if SEQ in delta.columns else F.lit(0)
        z = delta.select(*cols, W, seq.cast("bigint").alias(SEQ))
        if old is not None:
            z = z.unionByName(touched(old, delta, ["key"]).select(*cols, F.lit(1).cast("bigint").alias(W), F.lit(-1).cast("bigint").alias(SEQ)))
        live = hold(self._live(z))
        gone = emptied(delta, live)
        fitted = state.get("centres")
        left = 0 if old is None else state["size"].first()["n"] - touched(old, delta, ["key"]).count()
        n = left + live.count()
        size = ctx.spark.createDataFrame([(n,)], "n bigint")
        known = [] if fitted is None else fitted.orderBy("cell").collect()
        if n >= CELLS_FROM and (not known or n >= 4 * known[0]["fitted"]):
            everything = live if old is None else replacing(live, gone).applied(old.drop("cell"))
            sample = everything.orderBy(F.xxhash64("key")).limit(SAMPLE).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()["v"]
            groups = _by_length(sample)
            if len(groups) == 1:
                x = _towards(groups[0][1], self.metric)
                c = _centres(x, int(min(CELLS, max(1, n**0.5), len(x) // 8)))
                centres = ctx.spark.createDataFrame([(i, v, n) for i, v in enumerate(c.tolist())], "cell int, centre array<double>, fitted bigint")
                return Step({"vectors": self._celled(everything, c).repartition("cell").sortWithinPartitions("cell"), "centres": centres, "size": size})
        c = np.array([r["centre"] for r in known]) if known else None
        patch = replacing(self._celled(live, c), gone)
        return Step({"vectors": patch, "size": size} | ({} if fitted is None else {"centres": fitted}))

    def _celled(self, vectors: DataFrame, centres: np.ndarray | None) -> DataFrame:
        """``vectors`` with the nearest of the centres (0 without any, and for vectors of another length)."""
        if centres is None:
            return vectors.withColumn("cell", F.lit(0))
        metric = self.metric

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.zeros(b.num_rows, np.int32)
                for at, x in _by_length(b["embedding"]):
                    if x.shape[1] == centres.shape[1]:
                        cell[at] = _nearest_cell(_towards(x, metric), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

        return vectors.mapInArrow(place, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())]))

    class Reader:
        def __init__(self, state: State, metric: str | Metric) -> None:
            self.df, self.centres, self.metric = state.get("vectors"), state.get("centres"), metric
            self.size = state.get("size")

        def search(self, query: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame | None:
            """The k nearest vectors; with ``probes`` (0: a default) those of the nearest cells only."""
            df = self.df
            if df is None:
                return None
            if probes is not None and self.centres is not None:
                rows = self.centres.collect()  # at most CELLS
                c = np.array([r["centre"] for r in rows])
                if c.shape[1] == len(query):
                    q = _towards(np.array([query], float), self.metric)[0]
                    near = np.argsort((c * c).sum(1) / 2 - c @ q, kind="stable")[: probes or 16 + len(rows) // 8]
                    df = df.filter(F.col("cell").isin(sorted({0, *(rows[i]["cell"] for i in near)})))
            return knn(df.drop("cell"), query, k, self.metric)

        def len(self) -> int:
            return 0 if self.size is None else self.size.first()["n"]

        def is_empty(self) -> bool:
            return self.len() == 0

    def reader(self, state: State) -> VectorIndex.Reader:
        return self.Reader(state, self.metric)


def fuse(lists: Sequence[tuple[DataFrame, Sequence[Column]]], k: int, key: str = "key", constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: (key, score), the k best of the sums of 1 / (constant + rank) over ranked lists.

    Each list comes with its order; lists are short (results of a search), so each is ranked in one window.
    """
    out = None
    for df, order in lists:
        part = df.select(F.col(key).alias("key"), (F.lit(1.0) / (F.lit(constant) + F.row_number().over(Window.orderBy(*order)))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "key").limit(k)
