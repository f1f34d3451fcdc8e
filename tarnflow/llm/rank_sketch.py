"""Percentiles of very large columns from mergeable relative-rank compactors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.session import cut

SECTIONS = 3
#: Relative standard error of a rank counted from the protected end, times k (Cormode et al., 2021, as measured).
RELATIVE = (0.0512 / SECTIONS) ** 0.5
#: Standard errors in the stated bounds.
SIGMAS = 3.0


class _Tail:
    """Compactors that protect the largest values: level h holds values that stand for 2**h each.

    A full level is sorted; its upper half always stays, and of the lower half a number of sections given by the
    trailing ones of its compaction count; every other one of the rest, from a random start, moves a level up.
    """

    __slots__ = ("k", "levels", "counts", "sections", "seed")

    def __init__(self, k: int) -> None:
        self.k, self.levels, self.counts, self.sections, self.seed = k, [], [], [], 1

    def _grow(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.zeros(0))
            self.counts.append(0)
            self.sections.append(SECTIONS)

    def _coin(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % 2**64
        return self.seed >> 63

    def _size(self, h: int) -> int:
        """Values of a section: smaller as their number doubles, so that a level grows with the root of the logarithm."""
        return max(4, int(self.k / (self.sections[h] / SECTIONS) ** 0.5) // 2 * 2)

    def add(self, values: np.ndarray, h: int = 0) -> None:
        self._grow(h)
        self.levels[h] = np.concatenate([self.levels[h], values])
        while h < len(self.levels):
            while len(self.levels[h]) > 2 * self.sections[h] * self._size(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        s, size, c = self.sections[h], self._size(h), self.counts[h]
        free = min(s, ((~c) & (c + 1)).bit_length())
        stay = s * size + (s - free) * size
        v = np.sort(self.levels[h])
        n = (len(v) - stay) // 2 * 2
        self._grow(h + 1)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], v[self._coin() : n : 2]])
        self.levels[h] = v[n:]
        self.counts[h] = c + 1
        if self.counts[h] >= 2 ** (s - 1):
            self.sections[h] = 2 * s

    def merge(self, other: _Tail) -> None:
        self.seed = (self.seed ^ (other.seed * 2 + 1)) % 2**64
        for h, v in enumerate(other.levels):
            self._grow(h)
            self.counts[h] |= other.counts[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
            self.levels[h] = np.concatenate([self.levels[h], v])
        if self.levels:
            self.add(np.zeros(0))

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and, for each, how many of all values stand at or above it."""
        v = np.concatenate(self.levels) if self.levels else np.zeros(0)
        w = np.concatenate([np.full(len(x), 2.0**h) for h, x in enumerate(self.levels)]) if self.levels else np.zeros(0)
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o][::-1])[::-1]


class RankSketch:
    """A mergeable summary of numbers with multiplicative rank error at both ends.

    Up to 6 k values are kept as they are. Above, two sets of compactors protect the largest and the smallest values.
    A rank R counted from the nearer end is found within SIGMAS * RELATIVE / k * R (with k = 50 below 0.8 % of R).
    """

    __slots__ = ("k", "n", "raw", "high", "low")

    def __init__(self, k: int = 50) -> None:
        self.k, self.n, self.raw, self.high, self.low = k, 0, np.zeros(0), None, None

    def add(self, values: np.ndarray) -> RankSketch:
        v = np.asarray(values, float)
        v = v[~np.isnan(v)]
        self.n += len(v)
        if self.high is None:
            self.raw = np.concatenate([self.raw, v])
            if len(self.raw) > 2 * SECTIONS * self.k:
                self._split()
        else:
            self.high.add(v)
            self.low.add(-v)
        return self

    def _split(self) -> None:
        self.high, self.low = _Tail(self.k), _Tail(self.k)
        self.high.seed, self.low.seed = self.n, self.n + 1
        self.high.add(self.raw)
        self.low.add(-self.raw)
        self.raw = np.zeros(0)

    def merge(self, other: RankSketch) -> RankSketch:
        if other.high is None:
            n = self.n
            self.add(other.raw)
            self.n = n + other.n
            return self
        if self.high is None:
            mine, self.n = self.raw, self.n + other.n
            self.raw = np.zeros(0)
            self.high, self.low = _Tail(self.k), _Tail(self.k)
            self.high.merge(other.high)
            self.low.merge(other.low)
            self.high.add(mine)
            self.low.add(-mine)
        else:
            self.n += other.n
            self.high.merge(other.high)
            self.low.merge(other.low)
        return self

    def error(self, q: float) -> float:
        """The bound of the rank error at quantile ``q``, as a share of all values."""
        return 0.0 if self.high is None else min(q, 1 - q) * SIGMAS * RELATIVE / self.k

    def quantiles(self, qs: Sequence[float]) -> list[float]:
        """The smallest value with at least a share q of the values at or below it."""
        if not self.n:
            return [float("nan")] * len(qs)
        if self.high is None:
            v = np.sort(self.raw)
            return [float(v[min(max(int(np.ceil(q * self.n - 1e-9)) - 1, 0), self.n - 1)]) for q in qs]
        (hv, hr), (lv, lr) = self.high.weighted(), self.low.weighted()
        out = []
        for q in qs:
            r = min(max(np.ceil(q * self.n - 1e-9), 1), self.n)
            if q > 0.5:  # n - r + 1 values stand at or above the wanted one
                out.append(float(hv[max(int(np.searchsorted(-hr, -(self.n - r + 1), side="right")) - 1, 0)]))
            else:
                out.append(float(-lv[max(int(np.searchsorted(-lr, -r, side="right")) - 1, 0)]))
        return out

    def to_bytes(self) -> bytes:
        parts = [self.raw] if self.high is None else [*self.high.levels, *self.low.levels]
        v = np.concatenate(parts) if parts else np.zeros(0)
        wide = bool((v.astype(np.float32) != v).any())
        head = [self.k, self.n, int(wide), len(self.raw)]
        for t in () if self.high is None else (self.high, self.low):
            head += [t.seed >> 1, len(t.levels)]
            for x, c, s in zip(t.levels, t.counts, t.sections, strict=True):
                head += [len(x), c, s]
        return zlib.compress(struct.pack(f"<H{len(head)}q", len(head), *head) + v.astype(np.float64 if wide else np.float32).tobytes(), 1)

    @staticmethod
    def from_bytes(b: bytes) -> RankSketch:
        b = zlib.decompress(b)
        (m,) = struct.unpack_from("<H", b)
        head = list(struct.unpack_from(f"<{m}q", b, 2))
        k, n, wide, raw = head[:4]
        v = np.frombuffer(b, np.float64 if wide else np.float32, offset=2 + 8 * m).astype(float)
        out = RankSketch(k)
        out.n, out.raw, v = n, v[:raw], v[raw:]
        at = 4
        if at < m:
            out.high, out.low = _Tail(k), _Tail(k)
            for t in (out.high, out.low):
                t.seed = head[at] * 2 + 1
                count = head[at + 1]
                at += 2
                for _ in range(count):
                    size, c, s = head[at : at + 3]
                    t.levels.append(v[:size])
                    t.counts.append(c)
                    t.sections.append(s)
                    v = v[size:]
                    at += 3
        return out


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "field string", "sketch binary"])


def build_sketches(df: DataFrame, keys: Sequence[str], values: Sequence[str], k: int = 50, hold: int = 1_000_000) -> DataFrame:
    """Partial sketches (keys, field, sketch), one per task, key and field; ``merge_sketches`` adds them up.

    Each task sorts up to ``hold`` rows at a time by key and sketches each key's values at once; nothing is shuffled,
    and a key with any share of the rows sends only its sketches. Null keys are a key of their own; null and NaN
    values leave; infinities stay.
    """
    keys, values = list(keys), list(values)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= hold:
                yield from _sketch_rows(pa.Table.from_batches(held), keys, values, k)
                held, rows = [], 0
        if rows:
            yield from _sketch_rows(pa.Table.from_batches(held), keys, values, k)

    return df.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).mapInArrow(build, _kinds(df, keys))


def _sketch_rows(t: pa.Table, keys: list[str], values: list[str], k: int) -> Iterator[pa.RecordBatch]:
    code = np.zeros(t.num_rows, np.int64)
    for c in keys:
        d = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
    ends = np.append(starts[1:], len(order))
    heads = t.select(keys).take(pa.array(order[starts])).combine_chunks() if keys else None
    for f in values:
        v = t[f].to_numpy()[order]
        sketches = [RankSketch(k).add(v[a:b]) for a, b in zip(starts, ends, strict=True)]
        kept = [i for i, s in enumerate(sketches) if s.n]
        if kept:
            cols = [heads[c].take(pa.array(kept)).combine_chunks() for c in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f] * len(kept)), pa.array([sketches[i].to_bytes() for i in kept], pa.binary())], names=[*keys, "field", "sketch"])


#: Sketches that one task adds up for a result, about.
FAN = 64


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), spread: int | None = None) -> DataFrame:
    """Sketches added up by ``keys`` and field; their days, files or partitions don't matter.

    A result of more than FAN sketches is added up as a tree: they are merged in groups of about FAN, and their sums
    again, until FAN or fewer are left. The sketches are counted for that, and kept. ``spread`` forces one such level
    of that many groups per result.
    """
    keys = list(keys)

    def merge(group: pa.Table) -> pa.Table:
        it = iter(group["sketch"])
        out = RankSketch.from_bytes(next(it).as_py())
        for b in it:
            out.merge(RankSketch.from_bytes(b.as_py()))
        return group.select([*keys, "field"]).slice(0, 1).append_column("sketch", pa.array([out.to_bytes()], pa.binary()))

    levels = [spread] if spread else []
    if spread is None:
        sketches = cut(sketches)
        most = sketches.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        while most > FAN:
            most = -(-most // FAN)
            levels.append(most)
    for n in levels:
        sketches = sketches.groupBy(*keys, "field", F.pmod(F.xxhash64("sketch"), F.lit(n)).alias("__part")).applyInArrow(merge, _kinds(sketches, keys))
    return sketches.groupBy(*keys, "field").applyInArrow(merge, _kinds(sketches, keys))


def percentiles(sketches: DataFrame, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, q, n, value, lower, upper, rank_error) of each sketch.

    ``rank_error`` bounds how far, as a share of the values, the rank of ``value`` is from q: SIGMAS standard errors of
    the sketch (0 where it holds all values). ``lower`` and ``upper`` are the values at those ranks. Groups without values have no sketch
    and no rows.
    """
    keys, qs = list(keys), sorted(qs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], [[] for _ in range(6)]
            for i, raw in enumerate(b["sketch"]):
                s = RankSketch.from_bytes(raw.as_py())
                e = [s.error(q) for q in qs]
                mid = s.quantiles(qs)
                lo = s.quantiles([max(q - x, 0) for q, x in zip(qs, e, strict=True)])
                hi = s.quantiles([min(q + x, 1) for q, x in zip(qs, e, strict=True)])
                at += [i] * len(qs)
                for c, x in zip(cols, (qs, [s.n] * len(qs), mid, lo, hi, e), strict=True):
                    c.extend(x)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in [*keys, "field"]), *(pa.array(c, pa.int64() if i == 1 else pa.float64()) for i, c in enumerate(cols))], names=[*keys, "field", "q", "n", "value", "lower", "upper", "rank_error"])

    kinds = dict(sketches.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    return sketches.select(*keys, "field", "sketch").mapInArrow(read, head + "field string, q double, n bigint, value double, lower double, upper double, rank_error double")
