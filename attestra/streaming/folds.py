"""Sequential processors: state folded over the ordered events of each key, in a stream or over a table.

A processor is a state to start with and a step (state, event) -> rows to emit; it changes the state, a plain dictionary, in place. Keys are spread over the cluster; within a micro-batch a key's events are taken in order. Events that a step judges stale it ignores.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Processor:
    """due: when time alone will bring something about (in milliseconds; null: never), and elapse what it brings about until then; a step asks for that itself. at_rest: whether a state may be forgotten, as nothing depends on it any more."""

    start: dict
    step: Callable[[dict, dict], list[dict]]
    emits: str
    due: Callable[[dict], int | None] = lambda state: None
    elapse: Callable[[dict, int], list[dict]] = lambda state, now: []
    at_rest: Callable[[dict], bool] = lambda state: False

    def names(self) -> list[str]:
        return [x.strip().split(" ")[0] for x in self.emits.split(",")]


def _emitted(processor: Processor, state: dict, key: str, value: object, events: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    rows = [out for event in events.sort_values(order).to_dict("records") for out in processor.step(state, event)]
    found = pd.DataFrame(rows, columns=processor.names(), dtype=object)  # whole numbers stay whole beside nulls
    found.insert(0, key, value)
    return found


def streamed(events: DataFrame, key: str, order: list[str], processor: Processor) -> DataFrame:
    """The rows a processor emits, as a stream in append mode; its states survive in the query's checkpoint."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(processor.start))
        yield _emitted(processor, held, key, k[0], pd.concat(list(batches)), order)
        state.update((json.dumps(held),))

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {processor.emits}", "state string", "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, key: str, order: list[str], processor: Processor) -> DataFrame:
    """The same over a table."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _emitted(processor, json.loads(json.dumps(processor.start)), key, k[0], pdf, order)

    return events.groupBy(key).applyInPandas(run, f"{key} {kind}, {processor.emits}")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream of what is there now emits, written under a shared folder and read back."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
