"""Progress of reviews as a state machine on a stream: per track, the reviews since the last retraining, and when one is due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State that timers and lists need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DUE = "track long, event_id long, t long, n long, n_retrained long"


class ReviewProgress(StatefulProcessor):
    """Counts reviews in the order of their times, whatever order they come in: rows wait in a list until the watermark has passed them.

    A timer at the earliest waiting row's time wakes the track; all rows that the watermark has passed are then counted, and the next timer is set. A
    retraining sets the count to 0. Every count that `every` divides is put out.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, event_id long, retrained boolean")
        self.counts = handle.getValueState("counts", "n long, n_retrained long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = list(zip(batch.t.tolist(), batch.event_id.tolist(), batch.retrained.tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                least = min(new)[0]
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] // 1000 < mark]
        left = rows[len(ready) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        n, n_retrained = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        for t, event_id, retrained in ready:
            if retrained:
                n, n_retrained = 0, n_retrained + 1
            else:
                n += 1
                if n % self.every == 0:
                    out.append((key[0], event_id, t, n, n_retrained))
        if ready:
            self.counts.update((n, n_retrained))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DUE.split(", ")])

    def close(self) -> None:
        pass


def review_progress(events: DataFrame, every: int = 5, late: str = "1 day", *, by: str = "user_id", ts: str = "ts", review: str = "event_type <> 'error'", retrained: str = "false") -> DataFrame:
    """track, event_id, t, n, n_retrained: the reviews at which a track's count since its last retraining reaches a multiple of `every`.

    Rows later than `late` are dropped, as the rows after them may have been counted; what the watermark hasn't passed is still waiting. The stream can be
    stopped and started again from its checkpoint at any time: waiting rows, counts and timers are in the state. It needs STATE_STORE. Rows without a track or time are left out.
    """
    rows = events.withWatermark(ts, late).where(F.col(by).isNotNull() & F.col(ts).isNotNull()).where(f"({review}) or ({retrained})")
    rows = rows.select(F.col(by).cast("long").alias("track"), ts, F.unix_micros(ts).alias("t"), "event_id", F.expr(retrained).alias("retrained"))
    return rows.groupBy("track").transformWithStateInPandas(ReviewProgress(every), DUE, "Append", "EventTime")
