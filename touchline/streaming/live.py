"""The folds of ``functions.folds`` over streams: a match's state lives in Spark's state store and ends by a timer."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that this kind of state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MatchFold(StatefulProcessor):
    """Steps through the frames of a match as they come, each micro-batch in order; ``idle_ms`` after the last one the match is over and its state goes."""

    def __init__(self, start: Callable, step: Callable, columns: list[str], names: list[str], idle_ms: int):
        self.start, self.step, self.columns, self.names, self.idle_ms = start, step, columns, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        frames: dict[int, list[dict]] = {}
        for part in rows:
            part.columns = self.columns  # names that Python reserves arrive changed
            for row in part.astype(object).where(part.notna(), None).to_dict("records"):
                frames.setdefault(int(row["frame"]), []).append(row)
        found: list[tuple] = []
        for frame in sorted(frames):
            found += self.step(state, key[0], frame, frames[frame])
        self.state.update((pickle.dumps(state),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(found, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def live(stream: DataFrame, start: Callable, step: Callable, schema: str, idle_ms: int = 600_000) -> DataFrame:
    """What ``folds.fold`` gives, for a stream whose rows of a frame come together and whose frames come in order."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = spark.createDataFrame([], schema).columns
    return stream.groupBy("match_id").transformWithStateInPandas(MatchFold(start, step, stream.columns, names, idle_ms), schema, "Append", "ProcessingTime")
