"""Stateful interior operators: distinct, aggregate, top-k and retention."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnflow.plans.node import GONE, SEQ, Context, Node, Patch, State, Step, _keys_of, checked, data_columns, hold, same, touched
from tarnflow.zset import W, consolidate


#: The count column of kept multisets; views show it as ``n`` where the datum has no such column.
N = "__n"


def merged(delta: DataFrame, state: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """(cols, __n0, __n1): the clamped counts before and after a delta of each datum in it; nulls equal nulls.

    Of the state only the touched rows are read into the shuffle.
    """
    zero = F.lit(0).cast("bigint")
    d = delta.select(*cols, zero.alias("__n0"), F.col(W).alias("__d"))
    if state is not None:
        d = d.unionByName(touched(state, delta, cols).select(*cols, F.col(N).alias("__n0"), zero.alias("__d")))
    m = d.groupBy(*cols).agg(F.sum("__n0").alias("__n0"), F.sum("__d").alias("__d"))
    return m.select(*cols, "__n0", F.greatest(F.col("__n0") + F.col("__d"), zero).alias("__n1"))


def patched(m: DataFrame, cols: Sequence[str]) -> Patch:
    """The change of a kept multiset (cols, __n) from ``merged``."""
    return Patch(m.filter("__n0 <> __n1").select(*cols, F.col("__n1").alias(N), (F.col("__n1") == 0).alias(GONE)), list(cols))


def multiset(delta: DataFrame, state: DataFrame | None, cols: Sequence[str]) -> Patch:
    return patched(merged(delta, state, cols), cols)


def shown(df: DataFrame) -> DataFrame:
    return df if "n" in df.columns else df.withColumnRenamed(N, "n")


def changes(old: DataFrame | None, new: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """The delta between two weighted views, retractions first (by ``__seq``)."""
    parts = [v.select(*cols, (F.col(W) * s).alias(W)) for v, s in ((old, -1), (new, 1)) if v is not None]
    z = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _sequenced(consolidate(z, cols))


def _sequenced(z: DataFrame) -> DataFrame:
    return z.withColumn(SEQ, F.when(F.col(W) < 0, 0).otherwise(1).cast("bigint"))


class Distinct(Node):
    """Each datum once while its count is above 0; a commit emits at most one change per datum."""

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name = name

    def batch(self, z: DataFrame) -> DataFrame:
        return consolidate(z, data_columns(z), clamp=True).withColumn(W, F.lit(1).cast("bigint"))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        cols = data_columns(delta)
        m = hold(merged(delta, state.get("counts"), cols))
        out = m.filter((F.col("__n0") > 0) != (F.col("__n1") > 0)).select(*cols, F.when(F.col("__n1") > 0, 1).otherwise(-1).cast("bigint").alias(W))
        return Step({"counts": patched(m, cols)}, _sequenced(out))


class Aggregate(Node):
    """Sums per ``key``: each output column is the sum of an expression times the multiplicity.

    Emits (key, n, sums) as one row per key with at least one live record; a change emits the old row's retraction
    and the new row, and nothing if they are equal. A key whose count comes to 0 or below is forgotten with its sums.
    Null expressions add 0.
    """

    distinct = ("key",)

    def __init__(self, name: str, **sums: Column) -> None:
        super().__init__()
        self.name, self.sums = name, {k: checked(c) for k, c in sums.items()}

    def _partial(self, z: DataFrame) -> DataFrame:
        w = F.col(W)
        return z.groupBy("key").agg(F.sum(w).alias("n"), *(F.coalesce(F.sum(c * w), F.lit(0)).alias(k) for k, c in self.sums.items()))

    def batch(self, z: DataFrame) -> DataFrame:
        return self._partial(z).filter("n > 0").withColumn(W, F.lit(1).cast("bigint"))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        names = ["n", *self.sums]
        d = self._partial(delta).select("key", *(F.col(c).alias(f"d_{c}") for c in names))
        old = state.get("groups")
        if old is None:
            old = d.limit(0).select("key", *(F.col(f"d_{c}").alias(c) for c in names))
        o = touched(old, d, ["key"]).select("key", F.struct(*names).alias("o"))
        x = d.select("key", F.struct(*(F.col(f"d_{c}").alias(c) for c in names)).alias("d"))
        blank = lambda s: x.select("key", F.lit(None).cast(o.schema["o"].dataType).alias("o"), F.col("d")) if s else o.select("key", "o", F.lit(None).cast(x.schema["d"].dataType).alias("d"))
        m = blank(True).unionByName(blank(False)).groupBy("key").agg(F.first("o", ignorenulls=True).alias("o"), F.first("d", ignorenulls=True).alias("d"))
        add = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))
        m = hold(m.select("key", "o", F.struct(*(add(c).cast(old.schema[c].dataType).alias(c) for c in names)).alias("a")))
        alive0, alive1 = F.coalesce(F.col("o.n") > 0, F.lit(False)), F.col("a.n") > 0
        moved = m.filter(~(alive0 & alive1 & (F.col("o") == F.col("a"))))
        row = lambda s, w: moved.filter(alive0 if s == "o" else alive1).select("key", f"{s}.*", F.lit(w).cast("bigint").alias(W))
        return Step({"groups": Patch(m.select("key", "a.*", (~alive1).alias(GONE)), ["key"])}, _sequenced(row("o", -1).unionByName(row("a", 1))))


class KeyedReduce(Node):
    """A user-defined aggregate per ``key``: ``step(acc, row, w) -> acc`` over rows in ``__seq`` order.

    ``acc`` is a dict with the columns of ``schema`` (DDL), None at first; ``row`` a dict. The function has to undo an
    insertion when called with a negative weight. One group is held by one task: for sums use ``Aggregate``.
    """

    distinct = ("key",)

    def __init__(self, name: str, step: Callable[[dict | None, dict, int], dict], schema: str) -> None:
        super().__init__()
        self.name, self.apply_row, self.schema = name, step, schema

    def _run(self, z: DataFrame, old: DataFrame | None) -> DataFrame:
        key = z.schema["key"].dataType.simpleString()
        fields = StructType.fromDDL(self.schema).names
        apply_row = self.apply_row
        if SEQ not in z.columns:
            z = z.withColumn(SEQ, F.lit(0).cast("bigint"))

        def go(k: tuple, o: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            n = int(o["n"].iloc[0]) if len(o) else 0
            acc = {c: o[c].iloc[0] for c in fields} if len(o) else None
            rows = [(*k, n, *(acc[c] for c in fields), "o")] if n > 0 else []
            d = d.sort_values(SEQ, kind="stable")
            names = [c for c in d.columns if c != W]
            for w, *r in zip(d[W].tolist(), *(d[c].tolist() for c in names), strict=True):
                acc = apply_row(acc, dict(zip(names, r, strict=True)), w)
                n += w
            if n > 0:
                rows.append((*k, n, *(acc[c] for c in fields), "a"))
            return pd.DataFrame(rows, columns=["key", "n", *fields, "__side"])

        schema = f"key {key}, n bigint, {self.schema}, __side string"
        if old is None:
            return z.groupBy("key").applyInPandas(lambda k, d: go(k, (), d), schema)
        return old.groupBy("key").cogroup(z.groupBy("key")).applyInPandas(go, schema)

    def batch(self, z: DataFrame) -> DataFrame:
        return self._run(z, None).filter("__side = 'a'").drop("__side").withColumn(W, F.lit(1).cast("bigint"))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        old = state.get("groups")
        r = hold(self._run(delta, None if old is None else touched(old, delta, ["key"])))
        after = r.filter("__side = 'a'").drop("__side").withColumn(GONE, F.lit(False))
        left = r.filter("__side = 'o'").drop("__side").join(after.select(F.col("key").alias("__k0")), F.col("key").eqNullSafe(F.col("__k0")), "left_anti").withColumn(GONE, F.lit(True))
        out = r.withColumn(W, F.when(F.col("__side") == "o", -1).otherwise(1).cast("bigint")).drop("__side")
        return Step({"groups": Patch(after.unionByName(left), ["key"])}, _sequenced(consolidate(out, [c for c in out.columns if c != W])))


def first_copies(z: DataFrame, k: int, order: Sequence[Column], n: str = W, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` copies of a multiset in a total order: multiplicity counts against k.

    Without ``by`` only the first k rows are ever gathered (every row has at least one copy); with it the window is
    limited per group before its shuffle.
    """
    if not by:
        top = z.orderBy(*order).limit(k)
        w = Window.orderBy(*order)
    else:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        top = z.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
        w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("__before", before).filter(F.col("__before") < k).withColumn(n, F.least(F.col(n), k - F.col("__before"))).drop("__before")


def descending(cols: Sequence[str]) -> list[Column]:
    """``score`` and then the other columns, all descending: the order of the greatest."""
    return [F.desc("score"), *(F.desc(c) for c in cols if c != "score")]


def ascending(cols: Sequence[str]) -> list[Column]:
    return [F.asc("score"), *(F.asc(c) for c in cols if c != "score")]


class TopK(Node):
    """The ``k`` copies with the greatest scores; ties go to the greater value columns. Keeps the whole multiset."""

    def __init__(self, name: str, k: int) -> None:
        super().__init__()
        self.name, self.k = name, k

    def batch(self, z: DataFrame) -> DataFrame:
        cols = data_columns(z)
        return first_copies(consolidate(z, cols, clamp=True), self.k, descending(cols))

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        """Keeps the rows that reach into the top with their whole counts: what a commit does above the last of them
        is told from these and its own rows, and the multiset is gone through only if too few are left."""
        cols = data_columns(delta)
        old, top0 = state.get("all"), state.get("top")
        m = hold(merged(delta, old, cols))
        patch = patched(m, cols)
        mine = m.filter("__n1 > 0").select(*cols, F.col("__n1").alias(N))
        if old is None:
            pool = mine
        else:
            rows = top0.collect()  # at most k
            pool = top0.join(_keys_of(m, cols), same(cols), "left_anti").unionByName(mine)
            if sum(r[N] for r in rows) >= self.k:
                last = F.broadcast(top0.orderBy(*ascending(cols)).limit(1).select(F.struct("score", *(c for c in cols if c != "score")).alias("__last")))
                above = pool.crossJoin(last).filter(F.struct("score", *(c for c in cols if c != "score")) >= F.col("__last")).drop("__last")
                enough = above.agg(F.coalesce(F.sum(N), F.lit(0)).alias("n")).first()["n"] >= self.k
                pool = above if enough else patch.applied(old)
        whole = first_copies(pool.withColumn(W, F.col(N)), self.k, descending(cols))
        whole = hold(whole.select(*cols, N, W))
        before = None if top0 is None else first_copies(top0.withColumnRenamed(N, W), self.k, descending(cols))
        return Step({"all": patch, "top": whole.drop(W)}, changes(before, whole.drop(N), cols))


class Retain(Node):
    """A sliding window in processing time: rows live until their commit is more than ``horizon_ms`` old.

    Each commit first retracts what has aged (strictly older than the horizon), then applies its net deltas: insertions
    are stamped with the commit's time and passed on; retractions cancel kept copies, the oldest first, and only the
    cancelled number is passed on. An empty commit expires. Reads between commits may see aged rows.
    """

    def __init__(self, name: str, horizon_ms: int) -> None:
        super().__init__()
        self.name, self.horizon = name, horizon_ms

    def batch(self, z: DataFrame, at: str = "at_ms", now_ms: int | None = None) -> DataFrame:
        """What lives at ``now_ms`` (default: the last stamp) if each row was committed at its ``at``."""
        now = F.lit(now_ms) if now_ms is not None else F.max(at)
        last = z.agg(now.alias("__now"))
        cols = data_columns(z)
        live = z.crossJoin(F.broadcast(last)).filter(F.col(at) >= F.col("__now") - self.horizon).drop("__now")
        return consolidate(live, cols, clamp=True)

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        cols = data_columns(delta)
        old = state.get("kept")
        net = consolidate(delta, cols)
        fresh = net.filter(F.col(W) > 0).select(*cols, F.lit(ctx.now_ms).cast("bigint").alias("__ms"), F.lit(ctx.version).cast("bigint").alias("__tx"), F.col(W).alias(N))
        keys = [*cols, "__ms", "__tx"]
        entered = fresh.withColumn(GONE, F.lit(False))
        if old is None:
            return Step({"kept": Patch(entered, keys)}, _sequenced(net.filter(F.col(W) > 0)))
        limit = ctx.now_ms - self.horizon
        aged = hold(old.filter(F.col("__ms") < limit))
        # a commit's insertions outnumbering its retractions have a positive net, so negatives only meet kept copies
        need = hold(net.filter(F.col(W) < 0).select(*cols, (-F.col(W)).alias("__need")))
        alive = touched(old.filter(F.col("__ms") >= limit), need, cols)
        both = alive.withColumn("__need", F.lit(0).cast("bigint")).unionByName(need.select(*cols, F.lit(-(2**62)).alias("__ms"), F.lit(0).cast("bigint").alias("__tx"), F.lit(0).cast("bigint").alias(N), "__need"))
        w = Window.partitionBy(*cols).orderBy("__ms", "__tx")
        both = both.withColumn("__all", F.sum("__need").over(Window.partitionBy(*cols))).withColumn("__before", F.coalesce(F.sum(N).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        both = hold(both.withColumn("__cut", F.least(F.col(N), F.greatest(F.col("__all") - F.col("__before"), F.lit(0)))).filter("__cut > 0"))
        left = both.select(*keys, (F.col(N) - F.col("__cut")).alias(N), (F.col(N) == F.col("__cut")).alias(GONE))
        out = aged.select(*cols, (-F.col(N)).alias(W)).unionByName(both.select(*cols, (-F.col("__cut")).alias(W))).unionByName(net.filter(F.col(W) > 0))
        patch = aged.select(*keys, N).withColumn(GONE, F.lit(True)).unionByName(left).unionByName(entered)
        return Step({"kept": Patch(patch, keys)}, _sequenced(consolidate(out, cols)))

