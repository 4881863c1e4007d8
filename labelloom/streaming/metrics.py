"""Best metric per experiment as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_STATE = "value double, ts timestamp, event_id long"


class _Best(StatefulProcessor):
    """Holds one row per experiment: the best value so far, the earliest of equal ones."""

    def __init__(self, sign: int):
        self.sign = sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best = None if held is None else (held[0] * self.sign, pd.Timestamp(held[1]), held[2])
        before = best
        for frame in rows:
            frame = frame.dropna(subset=["value"])
            if len(frame):
                first = frame.assign(_v=frame["value"] * self.sign).sort_values(["_v", "ts", "event_id"]).iloc[0]
                found = (float(first["_v"]), pd.Timestamp(first["ts"]), int(first["event_id"]))
                best = found if best is None else min(best, found)
        if best is not None and best != before:
            row = (best[0] * self.sign, best[1].to_pydatetime(), best[2])
            self.best.update(row)
            yield pd.DataFrame({"experiment_id": [key[0]], "value": [row[0]], "ts": [row[1]], "event_id": [row[2]]})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


def best_metric(metrics: DataFrame, mode: str = "min") -> DataFrame:
    """Rows ``experiment_id, value, ts, event_id`` whenever an experiment's best value changes.

    Null and NaN values are passed over; of equal values the earliest by ``ts`` and
    ``event_id`` counts, also where it arrives later. State is one row per experiment and is
    restored from the checkpoint after a stop.
    """
    rows = metrics.select("experiment_id", "value", "ts", "event_id")
    kind = dict(rows.dtypes)["experiment_id"]
    return rows.groupBy("experiment_id").transformWithStateInPandas(
        _Best(1 if mode == "min" else -1), f"experiment_id {kind}, {_STATE}", outputMode="Update", timeMode="None"
    )
