"""Sequential processors with timers and with states that end: what time alone brings about is told when its time has come, and a key that rests is forgotten.

Time is event time: a timer fires when the stream's watermark has passed it, whether or not its key has had another event, so that a stream and a run of it over old events tell the same. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from attestra.streaming.folds import Processor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = StructType([StructField("held", StringType()), StructField("last", LongType()), StructField("timer", LongType())])


class _Timed(StatefulProcessor):
    """A key's state: what the processor holds, when its last event was, and the one timer that is set (-1: none). The names of the methods are those that Spark calls."""

    def __init__(self, processor: Processor, key: str, order: list[str], at: str, idle_ms: int):
        self.processor, self.key, self.order, self.at, self.idle_ms = processor, key, order, at, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _HELD)

    def _load(self) -> tuple[dict, int, int]:
        if not self.state.exists():
            return json.loads(json.dumps(self.processor.start)), -1, -1
        held, last, timer = self.state.get()
        return json.loads(held), last, timer

    def _keep(self, held: dict, last: int, timer: int, fired: bool) -> None:
        """Keep a state and set the timer that it needs; one that rests and has rested long enough goes."""
        p, due = self.processor, self.processor.due(held)
        rests = due is None and p.at_rest(held)
        wanted = due if due is not None else last + self.idle_ms if rests else -1
        if timer >= 0 and timer != wanted and not fired:
            self.handle.deleteTimer(timer)
        if fired and rests and timer >= last + self.idle_ms:
            self.state.clear()
            return
        if wanted >= 0 and (fired or wanted != timer):
            self.handle.registerTimer(wanted)
        self.state.update((json.dumps(held), last, wanted))

    def _frame(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            found = pd.DataFrame(rows, columns=self.processor.names(), dtype=object)
            found.insert(0, self.key, key[0])
            yield found

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, last, timer = self._load()
        out: list[dict] = []
        for event in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            out += self.processor.step(held, event)
            last = max(last, int(event[self.at]))
        self._keep(held, last, timer, fired=False)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        held, last, timer = self._load()
        if at != timer:  # an older one
            return
        out = self.processor.elapse(held, at)
        self._keep(held, last, timer, fired=True)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def with_states(spark: SparkSession) -> None:
    """Streams that start from now on keep their states in RocksDB; those that have a checkpoint go on as they began."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS_DB)


def timed(events: DataFrame, key: str, order: list[str], processor: Processor, time: str, at: str, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """The rows that a processor emits, as a stream in append mode, timers included.

    time: the column of event time, with a watermark that runs `late` behind it; at: the same in milliseconds. Events that are later than that are dropped, as the timers of their time have fired. A state at rest (the processor says which) goes idle_ms after its last event; others stay, as something is still to come of them.
    """
    with_states(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    marked = events.withWatermark(time, late)
    return marked.groupBy(key).transformWithStateInPandas(_Timed(processor, key, order, at, idle_ms), f"{key} {kind}, {processor.emits}", "append", "eventTime")
