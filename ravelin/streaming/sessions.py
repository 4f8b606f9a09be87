"""Rolling summaries of sessions as a stateful stream: list and value state, a start from stored summaries, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that list states and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "conv_id long, summary string, cursor long, ended boolean"


class RollingSummaries(StatefulProcessor):
    """The state of a session: its summary and cursor, and the messages behind that which are still recent. ``merge``
    makes a new summary of the old one and the lines that have left the recent window; a blank leaves all as it is.

    A session without messages for ``idle_ms`` ends: what is still recent is merged too, and its state goes. That takes a
    query that keeps running: one that ends with what is there now may not see the time come.
    """

    def __init__(self, merge: Callable[[str, list[str]], str], recent: int, line_chars: int, idle_ms: int | None):
        self.merge, self.recent, self.line_chars, self.idle_ms = merge, recent, line_chars, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", "summary string, cursor long")
        self.open = handle.getListState("open", "turn long, role string, text string")

    def _read(self) -> tuple[str, int, set]:
        summary, cursor = self.summary.get() if self.summary.exists() else ("", -1)
        return summary, cursor, {tuple(r) for r in self.open.get()} if self.open.exists() else set()

    def _merged(self, summary: str, rows: list[tuple]) -> str:
        return (self.merge(summary, [f"{'user' if r == 'user' else 'assistant'}: {(x or '')[: self.line_chars]}" for _, r, x in rows]) or "").strip()

    @staticmethod
    def _out(key: tuple, summary: str, cursor: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "summary": [summary], "cursor": [cursor], "ended": [ended]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.summary.update((row["summary"] or "", int(row["cursor"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        summary, cursor, held = self._read()
        for batch in rows:
            held |= {(int(t), r, x) for t, r, x in zip(batch["turn"], batch["role"], batch["text"]) if t > cursor}
        ordered = sorted(held, key=lambda m: (m[0], m[1] or "", m[2] or ""))
        pending = ordered[: -self.recent] if len(ordered) > self.recent else []
        new = self._merged(summary, pending) if pending else ""
        if new:
            summary, cursor, ordered = new, pending[-1][0], ordered[-self.recent :]
            yield self._out(key, summary, cursor, False)
        self.summary.update((summary, cursor))
        if ordered:
            self.open.put(ordered)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        summary, cursor, held = self._read()
        rows = sorted(held, key=lambda m: (m[0], m[1] or "", m[2] or ""))
        new = self._merged(summary, rows) if rows else ""
        yield self._out(key, new or summary, rows[-1][0] if new else cursor, True)
        self.summary.clear()
        self.open.clear()

    def close(self) -> None:
        pass


def rolling_summaries(messages: DataFrame, merge: Callable[[str, list[str]], str], recent: int = 6, line_chars: int = 300, idle_ms: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(conv_id, summary, cursor, ended) whenever messages of a stream (conv_id, turn, role, text) have left a session's
    recent window, or the session has ended.

    ``stored`` (conv_id, summary, cursor), a batch table with one row a session, is where the first run starts; later
    runs go on from the checkpoint. The state of a session is as small as a window. Needs the state store ``PROVIDER``
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    initial = None if stored is None else stored.select("conv_id", "summary", "cursor").groupBy("conv_id")
    processor = RollingSummaries(merge, recent, line_chars, idle_ms)
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Update", timeMode="None" if idle_ms is None else "ProcessingTime", initialState=initial)
