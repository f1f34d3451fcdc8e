"""Streams: transactions over a pipeline's views, with snapshots, own-write reads, abort and keyed upserts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.plans.node import GONE, SEQ, Context, Node, Patch, State, hold, holding, lazily, touched
from tarnflow.sources.store import Store, StoreError
from tarnflow.zset import W

ROOT = "_root"


class Snapshot:
    """The readers of all views over one state: ``snapshot["name"]``."""

    def __init__(self, nodes: Sequence[Node], states: Mapping[str, State]) -> None:
        self._readers = {n.name: r for n in nodes if n.name and (r := n.reader(states.get(n.name, {}))) is not None}

    def __getitem__(self, name: str):
        return self._readers[name]


class Tx:
    """Pending deltas of one commit."""

    def __init__(self, stream: Stream) -> None:
        self._stream = stream
        self._parts: list[DataFrame] = []

    def push(self, rows: DataFrame | Sequence[tuple], w: int = 1) -> None:
        """Signed copies of rows; a DataFrame with its own ``__w`` keeps it times ``w``."""
        df = self._stream.frame(rows)
        weight = (F.col(W) * w if W in df.columns else F.lit(w)).cast("bigint")
        cols = [f.name for f in self._stream.schema.fields]
        order = F.col(SEQ) if SEQ in df.columns else F.lit(0)
        self._parts.append(df.select(*cols, weight.alias(W), (order + len(self._parts) * 2**40).cast("bigint").alias(SEQ)))

    def insert(self, rows: DataFrame | Sequence[tuple]) -> None:
        self.push(rows, 1)

    def remove(self, rows: DataFrame | Sequence[tuple]) -> None:
        self.push(rows, -1)

    def delta(self) -> DataFrame:
        if not self._parts:
            return self._stream.frame([]).withColumn(W, F.lit(0).cast("bigint")).withColumn(SEQ, F.lit(0).cast("bigint")).limit(0)
        out = self._parts[0]
        for p in self._parts[1:]:
            out = out.unionByName(p)
        return out

    def rtx(self) -> Snapshot:
        """The views as they would be if the transaction committed now."""
        s = self._stream
        return Snapshot(s.nodes, s._after(s._pinned, s._steps(self.delta(), s._pinned, s._context)))


class Stream:
    """A pipeline with persistent views. One writer; any number of readers of committed versions."""

    def __init__(self, spark: SparkSession, path: str, pipeline: Node | Sequence[Node], schema: T.StructType | str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.roots = list(pipeline) if isinstance(pipeline, (tuple, list)) else [pipeline]
        self.nodes = [n for r in self.roots for n in r.walk()]
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = [n.name for n in self.nodes if n.name]
        if len(names) != len(set(names)) or ROOT in names:
            raise StoreError(f"duplicate names among {sorted(names)}")
        self.shape = ",".join(r.shape() for r in self.roots)
        known = self.store.manifest()["shape"]
        if known is not None and known != self.shape:
            raise StoreError(f"the store has {known}, not {self.shape}")
        self._pinned: dict[str, State] = {}
        self._context = Context(spark)

    def frame(self, rows: DataFrame | Sequence[tuple]) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.schema)

    def _steps(self, delta: DataFrame, states: Mapping[str, State], ctx: Context) -> dict[str, dict[str, DataFrame | Patch]]:
        """What the commit of a delta changes in each node's state."""
        new: dict[str, dict[str, DataFrame | Patch]] = {}

        def go(node: Node, z: DataFrame) -> None:
            step = node.step(z, states.get(node.name, {}) if node.name else {}, ctx)
            if step.state:
                new[node.name] = step.state
            for c in node.children:
                go(c, step.out)

        for r in self.roots:
            go(r, delta)
        return new

    @staticmethod
    def _after(states: Mapping[str, State], changed: Mapping[str, Mapping[str, DataFrame | Patch]]) -> dict[str, State]:
        out = {n: dict(s) for n, s in states.items()}
        for name, tables in changed.items():
            for t, c in tables.items():
                old = out.setdefault(name, {}).get(t)
                out[name][t] = c.applied(old) if isinstance(c, Patch) else c
        return out

    @contextmanager
    def wtx(self, now_ms: int | None = None, batch_id: int | str | None = None, source: str = "") -> Iterator[Tx]:
        """A transaction: all views change together on leaving the block, or not at all if it raises.

        A ``batch_id`` that was committed before makes the whole transaction a no-op. Numbers rise with every batch of a
        ``source``, as those of Structured Streaming do, so the highest one of each is kept, and none is ever
        forgotten; other ids are kept all.
        """
        m = self.store.manifest()
        self._pinned = self.store.read(m)
        self._context = Context(self.spark, m["version"] + 1, int(time.time() * 1000) if now_ms is None else now_ms)
        tx = self._begin()
        with holding():
            yield tx
            seen = m["batches"].get(source, {"last": -1, "ids": []})
            if batch_id is None or (batch_id > seen["last"] if isinstance(batch_id, int) else batch_id not in seen["ids"]):
                self._commit(tx, m, batch_id, source)

    def _begin(self) -> Tx:
        return Tx(self)

    def _extra(self, tx: Tx) -> dict[str, dict[str, DataFrame | Patch]]:
        return {}

    def _commit(self, tx: Tx, m: dict, batch_id: int | str | None, source: str) -> None:
        staged: list[str] = []
        tables = {k: dict(v) for k, v in m["tables"].items()}
        delta = hold(tx.delta())
        try:
            for name, changed in (self._steps(delta, self._pinned, self._context) | self._extra(tx)).items():
                for t, c in changed.items():
                    staged += self.store.add(tables, name, t, c)
            batches = dict(m["batches"])
            if batch_id is not None:
                last, ids = (b := batches.get(source, {"last": -1, "ids": []}))["last"], b["ids"]
                batches[source] = {"last": batch_id, "ids": ids} if isinstance(batch_id, int) else {"last": last, "ids": [*ids, batch_id]}
            self.store.publish({"version": m["version"] + 1, "tables": tables, "batches": batches, "shape": self.shape})
        except BaseException:
            self.store.discard(staged)
            raise

    def rtx(self, version: int | None = None) -> Snapshot:
        """All views as of one committed version."""
        return Snapshot(self.nodes, self.store.read(self.store.manifest(version)))

    def tick(self, now_ms: int) -> None:
        """An empty commit: retention expires even while nothing arrives."""
        with self.wtx(now_ms=now_ms):
            pass

    def checkpoint(self) -> int:
        """The last version that is durable. Every commit has written its files and manifest out; nothing is deleted."""
        return self.store.manifest()["version"]

    def vacuum(self, keep: int = 2, older_than_ms: int = 0) -> int:
        """Drops all versions but the last ``keep`` and those younger than ``older_than_ms``, and the files only they name.

        A reader that still holds a dropped version can't read it any more: give it time with ``older_than_ms``.
        """
        return self.store.vacuum(keep, older_than_ms)


class Replaced:
    """The rows that an upsert or a removal replaced, computed when asked for."""

    def __init__(self, rows: Callable[[], DataFrame]) -> None:
        self._rows = rows

    def rows(self) -> DataFrame:
        with lazily():
            return self._rows()

    def get(self):
        """The replaced row of a single key, None if there was none."""
        found = self.rows().limit(2).collect()
        if len(found) > 1:
            raise ValueError("several keys were written: use rows()")
        return found[0] if found else None


class KeyedTx(Tx):
    """Upserts and removals by primary key; the last one of a key in a transaction counts."""

    def __init__(self, stream: KeyedStream) -> None:
        super().__init__(stream)
        self._ops: list[DataFrame] = []

    def push(self, rows, w: int = 1) -> None:
        raise TypeError("a keyed stream is written by upsert and remove")

    def _before(self, df: DataFrame) -> Replaced:
        earlier = KeyedTx(self._stream)
        earlier._ops = list(self._ops)
        return Replaced(lambda: earlier.current(df.select(*self._stream.keys)))

    def upsert(self, rows: DataFrame | Sequence[tuple]) -> Replaced:
        """Writes rows by their keys; gives the rows they replace, writes of this transaction included."""
        cols = [f.name for f in self._stream.schema.fields]
        df = self._stream.frame(rows)
        order = F.col(SEQ) if SEQ in df.columns else F.lit(0)
        before = self._before(df)
        self._ops.append(df.select(*cols, F.lit(1).alias("op"), (order + len(self._ops) * 2**40).cast("bigint").alias(SEQ)))
        return before

    def remove(self, keys: DataFrame | Sequence[tuple]) -> Replaced:
        """Removes keys; gives the rows that were there."""
        s = self._stream
        fields = {f.name: f for f in s.schema.fields}
        df = keys if isinstance(keys, DataFrame) else s.spark.createDataFrame(list(keys), T.StructType([fields[k] for k in s.keys]))
        rest = [F.lit(None).cast(f.dataType).alias(c) for c, f in fields.items() if c not in s.keys]
        before = self._before(df)
        self._ops.append(df.select(*s.keys, *rest).select(*fields, F.lit(-1).alias("op"), F.lit(len(self._ops) * 2**40).cast("bigint").alias(SEQ)))
        return before

    def _joined(self) -> DataFrame:
        """(keys, __o, __v, __op): the committed row and the last operation of each key that was written."""
        s = self._stream
        cols = [f.name for f in s.schema.fields]
        frame = s.frame([]).select(*cols, F.lit(0).alias("__op"), F.lit(-1).cast("bigint").alias(SEQ))
        for o in self._ops:
            frame = frame.unionByName(o.withColumnRenamed("op", "__op"))
        old = s._pinned.get(ROOT, {}).get("rows")
        if old is not None:
            frame = frame.unionByName(touched(old, frame, s.keys).select(*cols, F.lit(0).alias("__op"), F.lit(-1).cast("bigint").alias(SEQ)))
        v = F.struct(*(c for c in cols if c not in s.keys)) if len(cols) > len(s.keys) else F.struct(F.lit(0).alias("_"))
        w = F.max_by(F.struct(v.alias("__v"), F.col("__op")), F.struct(SEQ, "__op"))
        o = F.first(F.when(F.col("__op") == 0, v), ignorenulls=True)
        return frame.groupBy(*s.keys).agg(w.alias("__m"), o.alias("__o")).select(*s.keys, "__o", "__m.__v", "__m.__op")

    def delta(self) -> DataFrame:
        s = self._stream
        rest = [f.name for f in s.schema.fields if f.name not in s.keys]
        cols = [f.name for f in s.schema.fields]
        j = self._joined()
        changed = j.filter((F.col("__op") == -1) | ~F.col("__o").eqNullSafe(F.col("__v")))
        row = lambda side, w: changed.filter(F.col("__o").isNotNull() if side == "o" else F.col("__op") == 1).select(*s.keys, *(F.col(f"__{side}.{c}").alias(c) for c in rest), F.lit(w).cast("bigint").alias(W), F.lit(max(w, 0)).cast("bigint").alias(SEQ)).select(*cols, W, SEQ)
        return row("o", -1).unionByName(row("v", 1))

    def patch(self) -> Patch:
        s = self._stream
        rest = [f.name for f in s.schema.fields if f.name not in s.keys]
        j = self._joined().select(*s.keys, *(F.col(f"__v.{c}").alias(c) for c in rest), (F.col("__op") == -1).alias(GONE))
        return Patch(j.select(*(f.name for f in s.schema.fields), GONE), s.keys)

    def rows(self) -> DataFrame:
        return self.patch().applied(self._stream._pinned.get(ROOT, {}).get("rows"))

    def current(self, keys: DataFrame | Sequence[tuple]) -> DataFrame:
        """The rows that upserts of these keys would replace, this transaction's writes included."""
        s = self._stream
        fields = {f.name: f for f in s.schema.fields}
        df = keys if isinstance(keys, DataFrame) else s.spark.createDataFrame(list(keys), T.StructType([fields[k] for k in s.keys]))
        return touched(self.rows(), df, s.keys)

    def get(self, *key):
        """The row of a key, this transaction's writes included."""
        return self._stream._find(self.rows(), key)

    def contains(self, *key) -> bool:
        return self.get(*key) is not None


class KeyedStream(Stream):
    """A table by primary key in front of a pipeline: upserts reach it as retraction and insertion."""

    def __init__(self, spark: SparkSession, path: str, pipeline: Node | Sequence[Node], schema: T.StructType | str, keys: Sequence[str]) -> None:
        super().__init__(spark, path, pipeline, schema)
        self.keys = list(keys)

    def _begin(self) -> KeyedTx:
        return KeyedTx(self)

    def _extra(self, tx: KeyedTx) -> dict[str, State]:
        return {ROOT: {"rows": tx.patch()}}

    def _find(self, df: DataFrame, key: tuple):
        for c, v in zip(self.keys, key, strict=True):
            df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
        rows = df.limit(1).collect()
        return rows[0] if rows else None

    def table(self, version: int | None = None) -> DataFrame:
        m = self.store.manifest(version)
        return self.store.read(m)[ROOT]["rows"] if ROOT in m["tables"] else self.frame([])

    def get(self, *key):
        return self._find(self.table(), key)

    def contains(self, *key) -> bool:
        return self.get(*key) is not None


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``__seq`` by the given order: range-partitioned offsets, no single-task sort."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn(SEQ, F.col("__p").cast("bigint") * 2**32 + within).drop("__p")


def run_stream(stream: Stream, source: DataFrame, checkpoint: str, apply: Callable[[Tx, DataFrame], None] | None = None, clock: Callable[[], int] | None = None):
    """Feeds a streaming DataFrame into a stream, one commit per micro-batch, each exactly once.

    ``apply(tx, batch)`` writes a batch (default: push it, with its ``__w`` if it has one). A micro-batch that is
    replayed after a failure finds that its number under this ``checkpoint`` was committed, however long ago, and
    changes nothing. Returns the running query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with stream.wtx(now_ms=clock() if clock else None, batch_id=batch_id, source=checkpoint) as tx:
            (apply or (lambda t, b: t.push(b)))(tx, batch)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
