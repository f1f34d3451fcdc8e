"""Terminal views and their read methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tarnflow.operators.stateful import N, ascending, descending, first_copies, multiset, shown
from tarnflow.plans.node import GONE, SEQ, Context, Node, Patch, State, Step, checked, data_columns
from tarnflow.zset import W, consolidate


def _one(df: DataFrame) -> Row | None:
    rows = df.limit(1).collect()
    return rows[0] if rows else None


def counted(df: DataFrame) -> str:
    """The count column of a shown multiset."""
    return N if N in df.columns else "n"


class Count(Node):
    """The sum of all multiplicities, not clamped; 0 when empty."""

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name = name

    def batch(self, z: DataFrame) -> DataFrame:
        return z.agg(F.coalesce(F.sum(W), F.lit(0)).alias("count"))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        d = self.batch(delta)
        old = state.get("count")
        return Step({"count": d if old is None else d.unionByName(old).agg(F.sum("count").alias("count"))})

    class Reader:
        def __init__(self, state: State) -> None:
            self.df = state.get("count")

        def get(self) -> int:
            row = self.df and _one(self.df)
            return int(row["count"]) if row else 0

    def reader(self, state: State) -> Count.Reader:
        return self.Reader(state)


class Bag(Node):
    """The multiset of live data with their counts, clamped at 0 by every commit."""

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name = name

    def batch(self, z: DataFrame) -> DataFrame:
        return shown(consolidate(z, data_columns(z), clamp=True).withColumnRenamed(W, N))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        cols = data_columns(delta)
        return Step({"bag": multiset(delta, state.get("bag"), cols)})

    class Reader:
        def __init__(self, state: State) -> None:
            self.df = shown(state["bag"]) if "bag" in state else None

        def iter(self) -> DataFrame | None:
            return self.df

        def contains(self, **datum) -> bool:
            if self.df is None:
                return False
            df = self.df
            for c, v in datum.items():
                df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
            return _one(df) is not None

    def reader(self, state: State) -> Bag.Reader:
        return self.Reader(state)


class Stats(Node):
    """Count, sum, mean, population variance and standard deviation of an expression, from three sums.

    Mean, variance and deviation are null while the count is not above 0. A null expression adds to nothing.
    """

    def __init__(self, name: str, value: Column) -> None:
        super().__init__()
        self.name, self.value = name, checked(value)

    def _sums(self, z: DataFrame) -> DataFrame:
        x, w = self.value.cast("double"), F.when(self.value.isNotNull(), F.col(W))
        zero = lambda c, v: F.coalesce(F.sum(c), F.lit(v))
        return z.agg(zero(w, 0).alias("n"), zero(w * x, 0.0).alias("s"), zero(w * x * x, 0.0).alias("ss"))

    @staticmethod
    def derive(sums: DataFrame) -> DataFrame:
        n = F.col("n")
        mean = F.when(n > 0, F.col("s") / n)
        var = F.when(n > 0, F.greatest(F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0)))
        return sums.select(n.alias("count"), F.col("s").alias("sum"), mean.alias("mean"), var.alias("variance"), F.sqrt(var).alias("stddev"))

    def batch(self, z: DataFrame) -> DataFrame:
        return self.derive(self._sums(z))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        d, old = self._sums(delta), state.get("sums")
        return Step({"sums": d if old is None else d.unionByName(old).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))})

    class Reader:
        def __init__(self, state: State) -> None:
            self.df = state.get("sums")
            self.row = _one(Stats.derive(self.df)) if self.df is not None else None

        def count(self) -> int:
            return int(self.row["count"]) if self.row else 0

        def sum(self) -> float:
            return self.row["sum"] if self.row else 0.0

        def mean(self) -> float | None:
            return self.row["mean"] if self.row else None

        def variance(self) -> float | None:
            return self.row["variance"] if self.row else None

        def stddev(self) -> float | None:
            return self.row["stddev"] if self.row else None

    def reader(self, state: State) -> Stats.Reader:
        return self.Reader(state)


def last_writes(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __v, __last): the value and weight of the last delta of each key, by ``__seq``; later insertions win ties."""
    rest = [c for c in data_columns(delta) if c not in keys]
    seq = F.col(SEQ) if SEQ in delta.columns else F.lit(0)
    value = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    last = F.max_by(F.struct(value.alias("__v"), F.col(W).alias("__last")), F.struct(seq.alias("s"), F.col(W).alias("w"), value.alias("v")))
    return delta.groupBy(*keys).agg(last.alias("__m")).select(*keys, "__m.__v", "__m.__last")


class Table(Node):
    """The last value of each ``key``: within a commit the last delta wins, and one of 0 or below deletes the key."""

    def __init__(self, name: str, keys: Sequence[str] = ("key",)) -> None:
        super().__init__()
        self.name, self.keys = name, list(keys)

    def _rows(self, m: DataFrame, z: DataFrame) -> DataFrame:
        rest = [c for c in data_columns(z) if c not in self.keys]
        return m.filter("__last > 0").select(*self.keys, *(F.col(f"__v.{c}").alias(c) for c in rest))

    def batch(self, z: DataFrame) -> DataFrame:
        return self._rows(last_writes(z, self.keys), z)

    def batch_of_distinct(self, z: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Every row is the last of its key: nothing is grouped again."""
        return z.select(*self.keys, *(c for c in data_columns(z) if c not in self.keys)) if list(by) == self.keys else self.batch(z)

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        rest = [c for c in data_columns(delta) if c not in self.keys]
        m = last_writes(delta, self.keys)  # a blind write: what was there before doesn't matter
        return Step({"rows": Patch(m.select(*self.keys, *(F.col(f"__v.{c}").alias(c) for c in rest), (F.col("__last") <= 0).alias(GONE)), self.keys)})

    class Reader:
        def __init__(self, state: State, keys: list[str]) -> None:
            self.df, self.keys = state.get("rows"), keys

        def get(self, *key) -> Row | None:
            if self.df is None:
                return None
            df = self.df
            for c, v in zip(self.keys, key, strict=True):
                df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
            return _one(df)

        def contains(self, *key) -> bool:
            return self.get(*key) is not None

        def iter(self) -> DataFrame | None:
            return self.df

    def reader(self, state: State) -> Table.Reader:
        return self.Reader(state, self.keys)


class Multimap(Table):
    """The set of (key, val): the last delta of a pair adds or removes it."""

    def __init__(self, name: str) -> None:
        super().__init__(name, ("key", "val"))

    class Reader(Table.Reader):
        def values(self, key) -> DataFrame | None:
            """(val) of a key."""
            return None if self.df is None else self.df.filter(F.col("key").eqNullSafe(F.lit(key))).select("val")

        def keys_of(self, val) -> DataFrame | None:
            """(key) of those that have a value."""
            return None if self.df is None else self.df.filter(F.col("val").eqNullSafe(F.lit(val))).select("key")

        def get(self, key) -> list:
            """The values of a key as a list, for keys that have few; see ``values``."""
            return [] if self.df is None else [r["val"] for r in self.values(key).toLocalIterator()]

        def search(self, val) -> list:
            """The keys that have a value as a list, where they are few; see ``keys_of``."""
            return [] if self.df is None else [r["key"] for r in self.keys_of(val).toLocalIterator()]

    def reader(self, state: State) -> Multimap.Reader:
        return self.Reader(state, self.keys)


class InvertedIndex(Multimap):
    """The same set, kept for reads by value."""


class Ranked(Node):
    """An ordered multiset of (score, value columns). Among equal scores ``max`` and ``top`` prefer the greater value."""

    by: tuple[str, ...] = ()

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name = name

    def batch(self, z: DataFrame) -> DataFrame:
        return shown(consolidate(z, data_columns(z), clamp=True).withColumnRenamed(W, N))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        cols = data_columns(delta)
        return Step({"all": multiset(delta, state.get("all"), cols)})

    @staticmethod
    def top(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
        """The ``n`` greatest copies, of each group in ``by``."""
        count = counted(df)
        return first_copies(df, n, descending([c for c in df.columns if c not in (count, *by)]), count, by)

    @staticmethod
    def bottom(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
        count = counted(df)
        return first_copies(df, n, ascending([c for c in df.columns if c not in (count, *by)]), count, by)

    @staticmethod
    def range(df: DataFrame, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
        """Rows with scores between two bounds, either of which may be open, closed or absent."""
        s = F.col("score")
        if low is not None:
            df = df.filter(s > low if low_open else s >= low)
        if high is not None:
            df = df.filter(s < high if high_open else s <= high)
        return df

    @staticmethod
    def extremes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """The least and the greatest entry (of each group) as structs ``min`` and ``max``, in one aggregation."""
        cols = [c for c in df.columns if c not in (counted(df), "score", *by)]
        entry = F.struct("score", *cols)
        return df.groupBy(*by).agg(F.min(entry).alias("min"), F.max(entry).alias("max"))

    class Reader:
        def __init__(self, state: State, by: Sequence[str] = (), key=None) -> None:
            df = shown(state["all"]) if "all" in state else None
            for c in by if df is not None else ():
                df = df.filter(F.col(c).eqNullSafe(F.lit(key))).drop(c)
            self.df = df

        def _rows(self, df: DataFrame | None) -> list[Row]:
            return [] if df is None else df.collect()

        def min(self) -> Row | None:
            return None if self.df is None else _one(Ranked.bottom(self.df, 1))

        def max(self) -> Row | None:
            return None if self.df is None else _one(Ranked.top(self.df, 1))

        def iter(self) -> DataFrame | None:
            return self.df and self.df.orderBy("score", *[c for c in self.df.columns if c not in ("score", counted(self.df))])

        def range(self, *a, **k) -> DataFrame | None:
            return self.df and Ranked.range(self.df, *a, **k)

        def top(self, n: int) -> list[Row]:
            rows = self._rows(self.df and Ranked.top(self.df, n))
            return [r for r in sorted(rows, key=lambda r: tuple(r), reverse=True) for _ in range(r[counted(self.df)])]

        def bottom(self, n: int) -> list[Row]:
            rows = self._rows(self.df and Ranked.bottom(self.df, n))
            return [r for r in sorted(rows, key=lambda r: tuple(r)) for _ in range(r[counted(self.df)])]

    def reader(self, state: State) -> Ranked.Reader:
        return self.Reader(state)


class KeyedRanked(Ranked):
    """``Ranked`` for each ``key``."""

    by = ("key",)

    class Reader:
        def __init__(self, state: State) -> None:
            self.state, self.df = state, shown(state["all"]) if "all" in state else None

        def key(self, key) -> Ranked.Reader:
            return Ranked.Reader(self.state, KeyedRanked.by, key)

        def top(self, n: int) -> DataFrame | None:
            """The ``n`` greatest copies of every key."""
            return self.df and Ranked.top(self.df, n, KeyedRanked.by)

        def extremes(self) -> DataFrame | None:
            return self.df and Ranked.extremes(self.df, KeyedRanked.by)

    def reader(self, state: State) -> KeyedRanked.Reader:
        return self.Reader(state)


class Histogram(Node):
    """Counts per bucket of an expression, exact under retraction."""

    def __init__(self, name: str, bucket: Column) -> None:
        super().__init__()
        self.name, self.bucket = name, checked(bucket)

    def batch(self, z: DataFrame) -> DataFrame:
        return consolidate(z.select(self.bucket.alias("bucket"), W), ["bucket"], clamp=True).withColumnRenamed(W, "n")

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        return Step({"buckets": multiset(delta.select(self.bucket.alias("bucket"), W), state.get("buckets"), ["bucket"])})

    @staticmethod
    def quantiles(df: DataFrame, qs: Sequence[float]) -> DataFrame:
        """(q, bucket): the first bucket whose cumulative count reaches max(1, ceil(q * total)); q is cut to [0, 1].

        Running counts are formed inside ranges of buckets and over the few ranges, so any number of buckets will do.
        """
        parts = df.filter(F.col("bucket").isNotNull()).repartitionByRange("bucket").withColumn("p", F.spark_partition_id())
        sums = parts.groupBy("p").agg(F.sum("n").alias("s"))
        before = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        total = sums.agg(F.sum("s").alias("total"))
        inside = F.sum("n").over(Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        run = parts.withColumn("c", inside).join(F.broadcast(before), "p").crossJoin(F.broadcast(total)).select("bucket", (F.col("c") + F.col("before")).alias("c"), "total")
        each = run.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))
        need = F.greatest(F.lit(1), F.ceil(F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0)) * F.col("total")))
        return each.filter(F.col("c") >= need).groupBy("q").agg(F.min("bucket").alias("bucket"))

    class Reader:
        def __init__(self, state: State) -> None:
            self.df = shown(state["buckets"]) if "buckets" in state else None

        def total(self) -> int:
            return 0 if self.df is None else int(self.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])

        def count(self, bucket) -> int:
            row = None if self.df is None else _one(self.df.filter(F.col("bucket").eqNullSafe(F.lit(bucket))))
            return int(row["n"]) if row else 0

        def iter(self, reverse: bool = False) -> DataFrame | None:
            return self.df and self.df.orderBy(F.desc("bucket") if reverse else F.asc("bucket"))

        def quantile(self, q: float):
            row = None if self.df is None else _one(Histogram.quantiles(self.df, [q]))
            return row["bucket"] if row else None

    def reader(self, state: State) -> Histogram.Reader:
        return self.Reader(state)
