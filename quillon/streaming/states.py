"""State by key that outlives batches: processors of transformWithState, kept in RocksDB.

States have a schema of their own, so that fields can be added later; timers on event time release rows that
waited for the watermark and clear keys that have been idle for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB provider; a stream keeps the one it was started with."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def _millis(at: pd.Timestamp) -> int:
    return int(at.value // 10**6)


class Lag(StatefulProcessor):
    """Each key's rows in the order of time and tie, with the value and time of the row before.

    Rows wait in a list until the watermark has passed them, so that late ones within its delay take their place. What
    has been emitted leaves one value and one time behind. A row more than `idle_ms` after the one before counts as a first
    one, however batches lie, so a timer clears what is left of a key that has been idle for so long.
    """

    def __init__(self, columns: dict[str, str], *, time: str, tie: str, value: str, outputs: tuple[str, str], idle_ms: int):
        self.columns, self.time, self.tie, self.value, self.outputs, self.idle_ms = columns, time, tie, value, outputs, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "value double, micros long")
        # times are kept as microseconds: they come back as they were whatever the zone
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {'long' if c == self.time else kind}" for c, kind in self.columns.items()))

    def _kept(self) -> pd.DataFrame:
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=list(self.columns))
        rows[self.time] = pd.to_datetime(rows[self.time], unit="us").astype("datetime64[ns]")
        return rows

    def _release(self, rows: pd.DataFrame, mark: int) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values([self.time, self.tie], kind="stable")
        done = rows[self.time] <= pd.Timestamp(mark, unit="ms")
        ready, left = rows[done], rows[~done]
        if len(ready):
            value, micros = self.before.get() if self.before.exists() else (None, None)
            first = pd.NaT if micros is None else pd.Timestamp(micros, unit="us")
            out = ready.copy()
            out[self.outputs[0]] = pd.Series([value, *ready[self.value].iloc[:-1]], index=out.index, dtype="float64")
            out[self.outputs[1]] = pd.to_datetime(pd.Series([first, *ready[self.time].iloc[:-1]], index=out.index, dtype="datetime64[ns]"))
            long_ago = out[self.time] - out[self.outputs[1]] > pd.Timedelta(self.idle_ms, unit="ms")
            out.loc[long_ago, list(self.outputs)] = None
            last = ready[self.value].iloc[-1]
            self.before.update((None if pd.isna(last) else float(last), int(ready[self.time].iloc[-1].value // 1000)))
            yield out
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            as_kept = left.assign(**{self.time: left[self.time].astype("int64") // 1000})
            self.waiting.put([tuple(None if pd.isna(v) else v for v in row) for row in as_kept.astype(object).itertuples(index=False)])
            self.handle.registerTimer(_millis(left[self.time].iloc[0]) + 1)
        else:
            self.waiting.clear()
            newest = self.before.get()[1] // 1000 if self.before.exists() else mark
            self.handle.registerTimer(max(newest + self.idle_ms, mark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        new = [p[list(self.columns)] for p in rows if len(p)]
        yield from self._release(pd.concat([*([kept] if len(kept) else []), *new], ignore_index=True) if new else kept, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, mark = self._kept(), timerValues.getCurrentWatermarkInMs()
        if len(kept):
            yield from self._release(kept, mark)
        elif self.before.exists() and self.before.get()[1] // 1000 + self.idle_ms <= mark:
            self.before.clear()

    def close(self) -> None:
        pass
