"""Progress of steps, published no oftener than wanted: a stateful operator with timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = ("succeeded", "done", "failed", "missed", "skipped")
PUBLISHED = "run_id {id}, step string, ts timestamp, percentage double, state string"


def worth_publishing(rows: list[tuple], published: int | None, state: str | None, seconds: float) -> tuple[list[int], int | None, str | None]:
    """Which of a step's ordered updates (microseconds, state) are published: the first, one whose state is another than
    before, one that ends the step, and one at least so many seconds after the last published; with the state to go on from."""
    out = []
    for k, (at, now) in enumerate(rows):
        if published is None or now != state or now in ENDED or at - published >= seconds * 1e6:
            out.append(k)
            published = at
        state = now
    return out, published, state


class Throttle(StatefulProcessor):
    """Keeps of each step when it was last published and its state; forgets a step some days after its last update.

    Steps are many and have few updates each, so a call asks the store only for what it needs: a step has one timer, which is
    set again when it fires if the step was updated since.
    """

    def __init__(self, seconds: float, keep_days: float) -> None:
        self.seconds, self.keep = seconds, int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("published", T.LongType()), T.StructField("state", T.StringType()), T.StructField("seen", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        t = sorted(rows, key=lambda r: (r["at"], r["event_id"] is None, r["event_id"]))
        before = self.last.get()
        published, state, seen = before if before is not None else (None, None, None)
        chosen, published, state = worth_publishing([(r["at"], r["state"]) for r in t], published, state, self.seconds)
        newest = max(t[-1]["at"] // 1000, seen or 0)
        if before is None:
            self.handle.registerTimer(newest + self.keep)
        self.last.update((published, state, newest))
        for k in chosen:
            yield Row(run_id=key[0], step=key[1], ts=t[k]["ts"], percentage=t[k]["percentage"], state=t[k]["state"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        end = self.last.get()[2] + self.keep
        if end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        """Nothing to close."""


def throttled(events: DataFrame, seconds: float = 1.0, delay: str = "1 hour", keep_days: float = 7) -> DataFrame:
    """The updates of a stream of events (run_id, step, ts, event_id, percentage, state) that are worth publishing.

    A step's first update is published, one that changes its state, one that ends it, and else one at most in so many
    seconds; the last published snapshot is the step's. Updates later than delay are dropped, those of one batch are put in
    order by ts and event_id. Needs the RocksDB state store. State is two numbers and a word for each step that was updated
    in the last keep_days, however many updates it has.
    """
    kind = events.schema["run_id"].dataType.simpleString()
    rows = events.withWatermark("ts", delay).select("run_id", "step", "ts", "event_id", "percentage", "state", F.unix_micros("ts").alias("at"))
    return rows.groupBy("run_id", "step").transformWithState(Throttle(seconds, keep_days), PUBLISHED.format(id=kind), "append", "eventTime")
