"""Keyed changelogs under Structured Streaming for aggregates that are no sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnflow.zset import W

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The weight's name on the way through Python, where leading underscores are lost.
PLAIN = "weight__"


def changelog(source: DataFrame, key: str, step: Callable[[tuple | None, dict, int], tuple], schema: str, names: tuple[str, ...]) -> DataFrame:
    """(key, names, __w): per micro-batch the retraction of a key's old accumulator and its new one.

    ``step(acc, row, w)`` gives the new accumulator as a tuple in the order of ``names``; ``schema`` is their DDL. A
    key whose count comes to 0 is dropped with its state. Needs the RocksDB state store provider.
    """

    class Keep(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("acc", f"n bigint, {schema}")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            old = tuple(self.state.get()) if self.state.exists() else None
            n, acc = (int(old[0]), tuple(old[1:])) if old else (0, None)
            for pdf in rows:
                for r in pdf.to_dict("records"):
                    w = int(r.pop(PLAIN))
                    acc = step(acc, r, w)
                    n += w
            out = [(*key, *old[1:], -1)] if old else []
            if n > 0:
                self.state.update((n, *acc))
                out.append((*key, *acc, 1))
            elif old:
                self.state.clear()
            if len(out) == 2 and out[0][:-1] == out[1][:-1]:
                out = []
            yield pd.DataFrame(out, columns=[key_name, *names, PLAIN])

        def close(self) -> None:
            pass

    key_name = key
    kind = dict(source.dtypes)[key]
    rows = source.withColumnRenamed(W, PLAIN)
    return rows.groupBy(key).transformWithStateInPandas(Keep(), f"{key} {kind}, {schema}, {PLAIN} bigint", "Update", "None").withColumnRenamed(PLAIN, W)
