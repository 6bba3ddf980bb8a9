"""Walks over streams in the order of event time, whatever order rows come in.

A row waits in its key's state until the watermark has passed it; then nothing older can come, and the key's rows
that are due are taken in order of (ts, id) and decided one by one. So the outcome is that of the batch forms,
however the rows were spread over micro-batches, as long as none is later than the watermark allows. Rows that
are not due yet stay undecided: a stream ends one watermark delay before its newest row.

Walks can follow each other: each gives its rows on with their own ts, and none after the watermark has left them
behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: List state, timers and large keys need this state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Takes what the key keeps (None at first) and one row, and returns what it keeps then and the row's outcome.
Step = Callable[[Any, Any], tuple[Any, tuple]]


class InOrder(StatefulProcessor):
    """rows: the fields of a row as it waits, at (microseconds) and id first. kept: the field that a walk keeps, a long.

    until: from what is kept and the time of the key's last row (seconds) to when it has no use any more.
    """

    def __init__(self, key: list[str], rows: T.StructType, outcome: list[str], step: Step, until: Callable[[int | None, int], int]):
        self.key, self.rows, self.outcome, self.step, self.until = key, rows, outcome, step, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.kept = handle.getValueState("kept", "kept long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, least = self.rows.fieldNames(), None
        for frame in rows:
            if len(frame):
                whole = [isinstance(f.dataType, T.IntegralType) for f in self.rows.fields]
                self.waiting.appendList([tuple(map(_plain, r, whole)) for r in frame[names].itertuples(index=False, name=None)])
                first = int(frame["at"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(-(-least // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get())
        due = sorted((tuple(r) for r in every if r[0] <= now * 1000), key=lambda r: r[:2])
        kept, last = self.kept.get() if self.kept.exists() else (None, 0)
        out, of = [], tuple(map(_plain, key))
        for row in due:
            kept, outcome = self.step(kept, dict(zip([*self.key, *self.rows.fieldNames()], [*of, *row], strict=True)))
            out.append((*row, *of, *outcome))
        if due:
            last = due[-1][0] // 1_000_000
            self.kept.update((kept, last))
        rest = [tuple(r) for r in every if r[0] > now * 1000]
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        elif self.until(kept, last) * 1000 < now:
            self.kept.clear()
        else:
            self.handle.registerTimer(self.until(kept, last) * 1000)
        if out:
            frame = pd.DataFrame(out, columns=[*self.rows.fieldNames(), *self.key, *self.outcome], dtype=object)
            frame["ts"] = pd.to_datetime(frame.pop("at"), unit="us")
            yield frame

    def close(self) -> None:
        pass


def _plain(value: Any, whole: bool = False) -> Any:
    """A value of pandas as the state takes it; whole numbers among nulls come as floats."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return int(value) if whole else value.item() if hasattr(value, "item") else value


def walked(rows: DataFrame, key: list[str], step: Step, outcome: str, until: Callable[[int | None, int], int]) -> DataFrame:
    """The rows (ts, id and others) with the fields of outcome, decided key by key in order of (ts, id).

    A step sees the keys too. ts must carry the watermark; in the result it does again, so that another walk can follow.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    others = [f for f in rows.schema.fields if f.name not in ("ts", "id", *key)]
    held = T.StructType([T.StructField("at", T.LongType()), rows.schema["id"], *others])
    added = T.StructType.fromDDL(outcome)
    out = T.StructType([T.StructField("ts", T.TimestampType()), *held.fields[1:], *(rows.schema[k] for k in key), *added.fields])
    processor = InOrder(key, held, added.fieldNames(), step, until)
    grouped = rows.withColumn("at", F.unix_micros("ts")).groupBy(*key)
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime", eventTimeColumnName="ts")
