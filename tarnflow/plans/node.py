"""Plan nodes: a pipeline is a tree of operators over signed tables whose leaves are named views.

Every node has two lowerings that agree: ``batch`` over a whole signed table, and ``step`` over the delta of one
commit and the node's kept state. Both only build DataFrames; Catalyst plans and runs them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow import session
from tarnflow.zset import W

SEQ = "__seq"
GONE = "__gone"
State = dict[str, DataFrame]

_changing = re.compile(r"\b(rand|randn|random|uuid|shuffle|current_timestamp|now|current_date|localtimestamp|monotonically_increasing_id|input_file_name|spark_partition_id)\s*\(", re.I)


class NotDeterministic(ValueError):
    """An expression whose retraction would not undo its insertion."""


def checked(c: Column | str) -> Column | str:
    """``c`` itself; raises if it can give another value for the same row."""
    if _changing.search(str(c)):
        raise NotDeterministic(f"{c} is not deterministic: its retraction would not undo it")
    return c


@dataclass
class Context:
    """What a commit gives its nodes."""

    spark: SparkSession
    version: int = 0
    now_ms: int = 0


_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def hold(df: DataFrame) -> DataFrame:
    """``df`` persisted until the transaction ends."""
    held = _held.get()
    if held is not None:
        held.append(df)
    return df.persist()


@contextmanager
def holding() -> Iterator[None]:
    """Within the block ``hold`` persists; afterwards what it held is released, and nothing else."""
    held: list[DataFrame] = []
    token = _held.set(held)
    try:
        yield
    finally:
        _held.reset(token)
        for df in held:
            df.unpersist()


@contextmanager
def lazily() -> Iterator[None]:
    """Within the block plans are built without running anything, also inside a transaction."""
    token = _held.set(None)
    try:
        yield
    finally:
        _held.reset(token)


def same(keys: Sequence[str], mark: str = "__k") -> Column:
    """Equality of ``keys`` and their copies named ``mark`` + number; nulls are equal."""
    out = F.lit(True)
    for i, c in enumerate(keys):
        out = out & F.col(c).eqNullSafe(F.col(f"{mark}{i}"))
    return out


def _keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys under other names; in a transaction marked for broadcast if they were found to be small."""
    ks = df.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys))).distinct()
    if _held.get() is None:  # a reader: the files' sizes decide how Catalyst joins
        return ks
    ks = hold(ks)
    return F.broadcast(ks) if session.weigh(ks) <= session.BROADCAST_BYTES else ks


def touched(state: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a state whose keys occur in a delta. A small delta is broadcast, so that the state isn't shuffled."""
    return state.join(_keys_of(delta, keys), same(keys), "left_semi")


@dataclass
class Patch:
    """What a commit changes in a state table: all rows of its keys are replaced by ``rows``.

    ``rows`` has the table's columns and ``__gone``; a key whose only row is gone has none left. Only patches are
    written by a commit, so its cost follows the delta and not the state.
    """

    rows: DataFrame
    keys: list[str]

    def live(self) -> DataFrame:
        return self.rows.filter(~F.col(GONE)).drop(GONE)

    def applied(self, state: DataFrame | None) -> DataFrame:
        """The table after the patch."""
        if state is None:
            return self.live()
        return state.join(_keys_of(self.rows, self.keys), same(self.keys), "left_anti").unionByName(self.live())


@dataclass
class Step:
    """Changes of state by a commit (a whole new table or a ``Patch``), and the delta for the children."""

    state: dict[str, DataFrame | Patch] = field(default_factory=dict)
    out: DataFrame | None = None


class Node:
    """An operator. Subclass it for own operators: ``batch`` and, where state is kept, ``step`` and ``name``."""

    name: str | None = None
    #: Columns in which all rows of the batch lowering differ; each of its rows then has the weight 1.
    distinct: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.children: list[Node] = []

    def __rshift__(self, other: Node | Sequence[Node]) -> Node:
        """Append ``other`` (several nodes fan out) after the last node of this chain."""
        end = self
        while end.children:
            if len(end.children) > 1:
                raise ValueError("a node that fans out has no single end to append to")
            end = end.children[0]
        end.children = list(other) if isinstance(other, (tuple, list)) else [other]
        if len(end.children) > 16:
            raise ValueError("at most 16 branches")
        return self

    def batch(self, z: DataFrame) -> DataFrame:
        raise NotImplementedError

    def batch_of_distinct(self, z: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """The batch lowering over rows of weight 1 that differ in the columns ``by``."""
        return self.batch(z)

    def step(self, delta: DataFrame, state: State, ctx: Context) -> Step:
        """One commit; stateless nodes are their own batch lowering."""
        return Step({}, self.batch(delta))

    def reader(self, state: State) -> object | None:
        """The view's read methods over one snapshot of its state; interior nodes have none."""
        return None

    def shape(self) -> str:
        """Name and kind, for the fingerprint by which a reopened store recognises its pipeline."""
        inner = ",".join(c.shape() for c in self.children)
        return f"{type(self).__name__}({self.name or ''}){'[' + inner + ']' if inner else ''}"

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def data_columns(z: DataFrame) -> list[str]:
    """The columns of the datum."""
    return [c for c in z.columns if c not in (W, SEQ)]


def views(root: Node | Sequence[Node], z: DataFrame) -> dict[str, DataFrame]:
    """Batch evaluation of a whole pipeline: name of each leaf -> its view over ``z``."""
    out: dict[str, DataFrame] = {}
    roots = root if isinstance(root, (tuple, list)) else [root]

    def go(node: Node, z: DataFrame, by: tuple[str, ...] = ()) -> None:
        r = node.batch_of_distinct(z, by) if by else node.batch(z)
        if not node.children:
            out[node.name or type(node).__name__] = r
        for c in node.children:
            go(c, r, node.distinct)

    for n in roots:
        go(n, z)
    return out
