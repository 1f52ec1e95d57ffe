"""Approval requests as a stream: several deadlines a request, handed from level to level."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "request long, n int, level string, outcome string, at timestamp"
#: State of stateful processors is kept in RocksDB, on local disk and in the query's checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status(asked: int, answers: list[tuple[int, bool]], levels: list[tuple[str, float]], now: int) -> tuple[str | None, str]:
    """Level and outcome of a request at a moment (microseconds): as ``decisions.approval_outcomes`` tells them."""
    first = min((a for a in answers if a[0] >= asked), default=None)
    waited, total, level = (first[0] if first else now) - asked, 0.0, None
    for name, seconds in levels:
        total += seconds
        if waited <= int(total * 1_000_000):
            level = name
            break
    if level is None:
        return None, "expired"
    return level, "waiting" if first is None else "approved" if first[1] else "rejected"


class _Approvals(StatefulProcessor):
    def __init__(self, levels: list[tuple[str, float]], keep_s: float):
        self.levels, self.keep_s = levels, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at long")
        self.answers = handle.getListState("answers", "at long, approved boolean")
        self.said = handle.getValueState("said", "n int, level string, outcome string")

    def _tell(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        """A row if the request stands otherwise than it was last told."""
        if not self.asked.exists():
            return
        answers = [(int(a[0]), bool(a[1])) for a in self.answers.get()] if self.answers.exists() else []
        level, outcome = status(int(self.asked.get()[0]), answers, self.levels, now)
        n, *before = self.said.get() if self.said.exists() else (0, "", "")
        if [level or "", outcome] != before:
            self.said.update((int(n) + 1, level or "", outcome))
            yield pd.DataFrame({"request": [key[0]], "n": [int(n) + 1], "level": [level], "outcome": [outcome], "at": [pd.Timestamp(now, unit="us")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked, latest = [int(self.asked.get()[0])] if self.asked.exists() else [], 0
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            latest = max(latest, int(at.max()))
            asked += at[batch["kind"] == "asked"].tolist()
            said = batch["kind"].isin(["approved", "rejected"])
            if said.any():
                self.answers.appendList([(int(t), k == "approved") for t, k in zip(at[said], batch["kind"][said], strict=True)])
        if asked and (not self.asked.exists() or min(asked) < int(self.asked.get()[0])):
            self.asked.update((min(asked),))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            total = 0.0
            for _, seconds in self.levels:  # a timer for each level, and one that forgets the request
                total += seconds
                self.handle.registerTimer((min(asked) + int(total * 1_000_000)) // 1000 + 1)
            self.handle.registerTimer((min(asked) + int((total + self.keep_s) * 1_000_000)) // 1000 + 1)
        if not asked:  # answers without a request are forgotten too
            self.handle.registerTimer((latest + int(self.keep_s * 1_000_000)) // 1000 + 1)
        yield from self._tell(key, max(latest, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._tell(key, now * 1000)
        end = sum(s for _, s in self.levels) + self.keep_s
        if not self.asked.exists() or now > (int(self.asked.get()[0]) + int(end * 1_000_000)) // 1000:
            for state in (self.asked, self.answers, self.said):
                state.clear()

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """Sets the session's state store to the one that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def approval_stream(events: DataFrame, levels: list[tuple[str, float]], late: str = "0 seconds", keep_s: float = 7 * 86_400) -> DataFrame:
    """Where each approval request stands, told whenever that changes: request, n, level, outcome, at.

    ``events``: request, ts, kind (asked, approved, rejected; others are left out). A request
    counts from its first ``asked``, and the first answer from then on decides. A timer for
    each of ``levels`` (names and seconds) hands the request on to the next when the
    watermark passes its deadline, or lets it expire after the last. ``n`` counts what was
    told of a request; the row with the largest is the present state. Answers may come
    before their request or out of order, and correct what was told, until ``keep_s`` after
    the last deadline; then the request's state is forgotten. Answers of no known request
    wait ``keep_s`` for it.
    """
    rows = events.filter(F.col("kind").isin("asked", "approved", "rejected")).withWatermark("ts", late)
    return rows.groupBy("request").transformWithStateInPandas(_Approvals(levels, keep_s), OUT, "append", "eventTime")
