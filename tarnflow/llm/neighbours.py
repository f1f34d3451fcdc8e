"""Most similar vectors through learned partitions of a neighbour graph."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.session import cut, small

#: Vectors each partition model is fitted on, at most.
TRAIN = 12_000
#: Vectors of a part the number of parts aims at. Above FLAT parts there are two levels, of about the square root each.
PART_ROWS, FLAT = 2_000, 256
#: Small collections have up to FEW parts of at least LEAST_ROWS vectors, so that they go the same way.
FEW, LEAST_ROWS = 8, 100
#: Parts of one model at most, and the vectors it needs for each.
PARTS, PART_TRAIN = 700, 16
#: Parts a query is sent to: the most probable ones up to this sum of probabilities, within these numbers.
MASS, LEAST, MOST = 0.995, 3, 16
#: Vectors and queries of one task at most; larger parts are searched in blocks.
BLOCK, QUERIES = 4_096, 16_384
#: Copies of one vector that meet in one task, about.
COPIES = 100_000


def usable(df: DataFrame, key: str, vector: str, dim: int = 64) -> DataFrame:
    """(id, v): one row per id with ``dim`` finite numbers that are not all 0; of several vectors of an id the least."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & (F.size(v) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def nearest(q: np.ndarray, b: np.ndarray, k: int, rows: int = 1024) -> np.ndarray:
    """Positions in ``b`` of about the k nearest to each row of ``q``, in no order, by single-precision products."""
    k = min(k, len(b))
    half = (b * b).sum(1) / 2
    out = np.empty((len(q), k), np.int64)
    for a in range(0, len(q), rows):
        d = half - q[a : a + rows] @ b.T
        out[a : a + rows] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(b) else np.arange(k)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A part for each row of ``x`` that cuts few edges of its neighbour graph, no part above ``slack`` times the mean.

    Starts from halves along the main direction of each set, down to ``parts`` sets of equal size; then vertices move
    to the part that most of their neighbours are in, those with the largest gain first, while there is room.
    """
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        axis = y[0] + 1e-3
        for _ in range(12):
            axis = y.T @ (y @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        left = n // 2
        order = np.argsort(y @ axis, kind="stable")
        at = len(rows) * left // n
        todo += [(rows[order[:at]], first, left), (rows[order[at:]], first + left, n - left)]
    most = int(np.ceil(slack * len(x) / parts))
    n, k = graph.shape
    rows = np.repeat(np.arange(n), k)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int16)
        np.add.at(votes, (rows, part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), part[rows]), 1)
        here = votes[np.arange(n), part]
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - here
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most and size[part[i]] > 1:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < n // 500:
            break
    return part


class Router:
    """A classifier with one hidden layer from vectors to the parts their neighbours are in."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 24, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.parts = parts
        self.mean, self.scale = x.mean(0), np.float32(x.std() + 1e-9)
        sizes = [(x.shape[1], hidden), (hidden, parts)]
        p = [r.normal(0, np.sqrt(2 / a), (a, b)).astype(np.float32) for a, b in sizes]
        self.p = [p[0], np.zeros(hidden, np.float32), p[1] * 0.1, np.zeros(parts, np.float32)]
        target = np.zeros((len(x), parts), np.float32)
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
        target[np.arange(len(x)), part] += 2.0
        target /= target.sum(1, keepdims=True)
        z = self._norm(x)
        m = [np.zeros_like(a) for a in self.p]
        s = [np.zeros_like(a) for a in self.p]
        step = 0
        batch = 256
        for epoch in range(epochs):
            rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = r.permutation(len(z))
            for a in range(0, len(z), batch):
                i = order[a : a + batch]
                h = np.maximum(z[i] @ self.p[0] + self.p[1], 0)
                out = self._softmax(h @ self.p[2] + self.p[3])
                g = (out - target[i]) / len(i)
                gh = (g @ self.p[2].T) * (h > 0)
                step += 1
                for j, d in enumerate((z[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * d
                    s[j] = 0.999 * s[j] + 0.001 * d * d
                    self.p[j] = self.p[j] - (rate / (1 - 0.9**step)) * m[j] / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
        self.p = [a.astype(np.float32) for a in self.p]

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._norm(x) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])


class Routes:
    """The parts of a collection: those of one model, or those of a model of its own below each part of a first one."""

    def __init__(self, top: Router | None = None, below: dict[int, tuple[int, Router | None]] | None = None) -> None:
        self.top, self.below = top, below or {}
        self.first: dict[int, int] = {}
        n = 0
        for i in sorted(self.below):
            self.first[i] = n
            n += self.below[i][0]

    def send(self, x: np.ndarray, mass: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and parts: each row with its most probable parts up to ``mass``, at least ``least`` and at most ``most``."""
        if self.top is None:
            return np.arange(len(x)), np.zeros(len(x), np.int32)
        at, part, p = _likely(self.top.probabilities(x), mass, least, most)
        if not self.below:
            return at, part
        rows, leaves, ps = [], [], []
        for i in np.unique(part):
            n, router = self.below.get(int(i), (1, None))
            here = np.flatnonzero(part == i)
            if router is None:
                r, j, q = np.arange(len(here)), np.zeros(len(here), np.int64), np.ones(len(here), np.float32)
            else:
                r, j, q = _likely(router.probabilities(x[at[here]]), mass, least, most)
            rows.append(at[here][r])
            leaves.append(self.first.get(int(i), 0) + j)
            ps.append(p[here][r] * q)
        rows, leaves, ps = np.concatenate(rows), np.concatenate(leaves), np.concatenate(ps)
        # of the leaves of all parts the most probable ones together
        order = np.lexsort((leaves, -ps, rows))
        rows, leaves, ps = rows[order], leaves[order], ps[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(rows) > 0])) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        before = np.cumsum(ps) - ps
        before -= np.repeat(before[start], np.diff(np.append(start, len(rows))))
        take = (rank < most) & ((rank < least) | (before < mass))
        return rows[take], leaves[take].astype(np.int32)


def _likely(p: np.ndarray, mass: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, probability) of the most probable columns of each row."""
    order = np.argsort(-p, axis=1, kind="stable")[:, :most]
    top = np.take_along_axis(p, order, 1)
    take = (np.cumsum(top, 1) - top < mass) | (np.arange(order.shape[1]) < least)
    at, j = np.nonzero(take)
    return at, order[at, j].astype(np.int32), top[at, j]


def part_count(count: int, part_rows: int = PART_ROWS) -> int:
    """The number of parts of a collection: in proportion to its vectors, and a few for a small one."""
    return max(1, round(count / part_rows), min(FEW, count // LEAST_ROWS))


def fit_router(vectors: DataFrame, count: int, train: int = TRAIN, part_rows: int = PART_ROWS, k: int = 10, parts: int | None = None) -> tuple[Router | None, int]:
    """A router of a collection, fitted on at most ``train`` of its vectors, and its number of parts."""
    parts = int(min(PARTS, parts or part_count(count, part_rows), max(1, min(count, train) // PART_TRAIN)))
    if parts == 1:
        return None, 1
    share = train / max(count, 1)
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.3 * share) + 1)).orderBy(F.xxhash64("id")).limit(train) if count > train else vectors.orderBy("id")
    return _fit(_matrix(sample.select("v").toArrow()["v"]), parts, k), parts


def _fit(x: np.ndarray, parts: int, k: int = 10, **size: int) -> Router:
    graph = nearest(x, x, k + 1)
    return Router(x, graph, balanced_parts(x, graph, parts), parts, **size)


def fit_routes(vectors: DataFrame, count: int, train: int = TRAIN, part_rows: int = PART_ROWS) -> Routes:
    """The routes of a collection of any size: one level of parts, or two above FLAT parts.

    The first level is fitted on at most ``train`` vectors. The second gives each of its parts a number of leaves in
    proportion to the vectors that fall into it, fitted in one task per part on at most ``train`` of these. The models
    are some 100 KB each, and there are at most PARTS of them.
    """
    wanted = part_count(count, part_rows)
    if wanted <= FLAT:
        return Routes(fit_router(vectors, count, train, part_rows)[0])
    top, _ = fit_router(vectors, count, train, part_rows, parts=int(np.ceil(np.sqrt(wanted))))
    shared = vectors.sparkSession.sparkContext.broadcast(Routes(top))
    placed = cut(_routed(vectors, shared, 0.0, 1, 1))
    sizes = {r.part: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    leaves = {p: int(min(PARTS, max(1, round(n / part_rows)), max(1, min(n, train) // PART_TRAIN))) for p, n in sizes.items()}

    def fit(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        x = _matrix(group["v"])[np.argsort(group["id"].to_numpy(), kind="stable")][:train]
        n = min(leaves[part], len(x) // PART_TRAIN)
        model = b"" if n < 2 else pickle.dumps(_fit(x, n, hidden=64, epochs=16))
        return pa.table({"part": group["part"][:1], "n": pa.array([max(1, n)], pa.int32()), "model": pa.array([model], pa.binary())})

    million = 1_000_000
    rate = F.create_map(*(F.lit(x) for p, n in sizes.items() for x in (p, min(million, million * train // n))))
    sample = placed.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(million)) < F.element_at(rate, F.col("part")))
    fitted = sample.groupBy("part").applyInArrow(fit, "part int, n int, model binary").toLocalIterator()
    below = {r.part: (r["n"], pickle.loads(bytes(r.model)) if r.model else None) for r in fitted}
    return Routes(top, {p: below.get(p, (1, None)) for p in range(top.parts)})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(a), -1)


def _routed(vectors: DataFrame, routes, mass: float, least: int, most: int) -> DataFrame:
    """(id, v, part): each vector with the most probable parts."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, part = routes.value.send(_matrix(b["v"]), mass, least, most)
                ids = pa.array(at)
                yield pa.RecordBatch.from_arrays([b["id"].take(ids), b["v"].take(ids), pa.array(part, pa.int32())], names=["id", "v", "part"])

    return vectors.select("id", "v").mapInArrow(route, "id bigint, v array<float>, part int")


def _search(base: DataFrame, queries: DataFrame, routes, k: int, same: bool) -> DataFrame:
    """(id, near array<struct<d double, id bigint>>): for each query its k nearest of the vectors in its parts.

    ``same``: queries are base vectors; none finds itself.
    """
    b = _routed(base, routes, 0.0, 1, 1)
    q = _routed(queries, routes, MASS, LEAST, MOST)
    counts = small(b.groupBy("part").agg(F.count(F.lit(1)).alias("nb")).join(q.groupBy("part").agg(F.count(F.lit(1)).alias("nq")), "part").select("part", F.ceil(F.col("nb") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("nq") / QUERIES).cast("int").alias("nq")))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    b = b.join(counts, "part").select("part", place("nb").alias("i"), every("nq").alias("j"), F.lit(True).alias("base"), "id", "v")
    q = q.join(counts, "part").select("part", every("nb").alias("i"), place("nq").alias("j"), F.lit(False).alias("base"), "id", "v")

    def scan(t: pa.Table) -> pa.Table:
        own = t["base"].to_numpy(zero_copy_only=False)
        ids, x = t["id"].to_numpy(), _matrix(t["v"])
        bi, bx, qi, qx = ids[own], x[own], ids[~own], x[~own]
        if not len(bi) or not len(qi):
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], near)})
        wanted = min(len(bi), k + same)
        cand = nearest(qx, bx, min(len(bi), k + same + 6))
        dist = np.empty(cand.shape)
        for a in range(0, len(qx), 2048):
            d = bx[cand[a : a + 2048]].astype(np.float64) - qx[a : a + 2048, None, :]
            dist[a : a + 2048] = np.einsum("ijk,ijk->ij", d, d)
        got = bi[cand]
        if same:
            dist[got == qi[:, None]] = np.inf
        order = np.lexsort((got, dist), axis=1)[:, :wanted]
        dist, got = np.take_along_axis(dist, order, 1), np.take_along_axis(got, order, 1)
        keep = np.isfinite(dist)
        if k < wanted:
            keep[:, k:] = False
        offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(got[keep])], names=["d", "id"])
        return pa.table({"id": pa.array(qi), "near": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    near = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
    kind = "id bigint, near array<struct<d: double, id: bigint>>"
    found = b.unionByName(q).groupBy("part", "i", "j").applyInArrow(scan, kind)
    return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _copies(vectors: DataFrame, k: int) -> DataFrame:
    """(id, v, ids, n): each value once, under the least of its ids, with the k + 1 least ids and how many have it.

    Of a value that many have only k + 1 ids leave each task.
    """
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    firsts = vectors.withColumn("rank", order).filter(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    counts = vectors.groupBy(F.col("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return cut(firsts.join(counts, F.col("v") == F.col("w")).select(F.element_at("ids", 1).alias("id"), "v", "ids", "n"))


def _to_all(vectors: DataFrame, values: DataFrame) -> DataFrame:
    """``vectors`` joined with a row per value (v, n, ...); the copies of a common value are spread over several tasks."""
    m = F.ceil(F.col("n") / F.lit(COPIES)).cast("int")
    common = small(values.filter(F.col("n") > COPIES).select("v", m.alias("m")))
    left = vectors.join(common, "v", "left").select("id", "v", F.pmod(F.xxhash64("id"), F.coalesce("m", F.lit(1))).cast("int").alias("salt"))
    right = values.withColumn("salt", F.explode(F.sequence(F.lit(0), m - 1)))
    return left.join(right, ["v", "salt"])


def _expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``found`` with each near value replaced by the ids that have it, cut to the k nearest again."""
    each = found.select("id", F.explode("near").alias("x")).select("id", F.col("x.d").alias("d"), F.col("x.id").alias("rep"))
    each = each.join(members, "rep").select("id", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("near"))
    return each.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def similar(base: DataFrame, queries: DataFrame | None = None, key: str = "vec_id", vector: str = "val", query_key: str = "query_id", k: int = 10, dim: int = 64, train: int = TRAIN, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, rank, near_id, distance): about the k nearest base vectors of each usable query, by squared L2.

    Without ``queries`` every usable base vector is a query and doesn't find itself. Equal distances rank by id.

    A model is fitted on at most ``train`` vectors: their neighbour graph is cut into balanced parts, and a small
    classifier learns which parts a vector's neighbours are in. Every base vector is then indexed under its most
    probable part, and every query is compared with all vectors of its few most probable parts. Parts grow in number
    with the collection, above FLAT of them on two levels, so that the work per query stays the same. Parts of any size
    are searched in blocks. Equal vectors are searched as one and expanded to the least k + 1 of their ids, which is
    all that k nearest can name. The only loss is of neighbours in parts a query isn't sent to.

    Vectors of another length, with null or non-finite numbers, or all 0 are not usable. An empty base gives an
    empty result.
    """
    spark = base.sparkSession
    vectors = cut(usable(base, key, vector, dim))
    values = _copies(vectors, k)
    members = values.select(F.col("id").alias("rep"), "ids")
    routes = spark.sparkContext.broadcast(fit_routes(values.select("id", "v"), values.count(), train, part_rows))
    if queries is not None:
        q = usable(queries, query_key, vector, dim)
        found = _expand(_search(values, q, routes, k, False), members, k)
    else:
        other = _expand(_search(values, values, routes, k, True), members, k)
        own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
        rows = values.join(other.select("id", "near"), "id", "left")
        rows = rows.select("v", "n", F.concat(own, F.coalesce("near", F.array().cast("array<struct<d:double,id:bigint>>"))).alias("pool"))
        # every vector of a value has the pool of that value; itself is left out
        found = _to_all(vectors, rows).select("id", F.slice(F.filter("pool", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return found.select("id", F.posexplode("near").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("near_id"), F.col("x.d").alias("distance"))


def pairs(found: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: vectors of which at least one is near the other."""
    return found.select(F.least("id", "near_id").alias("vec_a"), F.greatest("id", "near_id").alias("vec_b")).distinct()
