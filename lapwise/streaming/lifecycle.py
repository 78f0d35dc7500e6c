"""The life cycle of jobs as a keyed state machine over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapwise.operators.jobs import MAX_CLAIMS
from lapwise.session import setting
from lapwise.streaming.jobs import logged
from lapwise.streaming.state import BatchLog, latest_rows

# The states a job may leave by an event, and where the event leads.
TRANSITIONS = {
    ("new", "queued"): "pending",
    ("pending", "claim"): "running",
    ("running", "progress"): "running",
    ("running", "completed"): "completed",
    ("running", "failed"): "failed",
}
# A restart takes running jobs back, or fails those that were claimed too often.
RECOVERY = "recover"

LIFECYCLE = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("refused", T.LongType()),
        T.StructField("late", T.LongType()),
        T.StructField("updated_us", T.LongType()),
    ]
)
_SETTLED = "status string, attempts long, step long, accepted long, refused long, late long, updated_us long, us long, event_id long"
_WAITING = "us long, event_id long, event string, step long"
_NEW = ("new", 0, None, 0, 0, 0, None)


def apply_event(state: tuple, us: int, event: str, step: int | None, max_claims: int = MAX_CLAIMS) -> tuple:
    """The state (status, attempts, step, accepted, refused, late, updated) after an event; a refused one is only counted."""
    status, attempts, reached, accepted, refused, late, updated = state
    if event == RECOVERY and status == "running":
        following = "pending" if attempts < max_claims else "failed"
    else:
        following = TRANSITIONS.get((status, event))
    if following is None:
        return status, attempts, reached, accepted, refused + 1, late, updated
    attempts += event == "claim"
    reached = None if event == "claim" else step if event == "progress" else reached
    return following, attempts, reached, accepted + 1, refused, late, us


class Lifecycle(StatefulProcessor):
    """Events of a job in the order of their times, also when they arrive in another.

    Events wait for ``lateness_us`` behind the newest of their job; those older
    are settled, in order, and kept as one state.  What is shown is the settled
    state with the waiting events on it.  An event older than a settled one is
    counted as late and changes nothing; a null time counts as late, too.
    """

    def __init__(self, lateness_us: int):
        self.lateness_us = lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", _SETTLED)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.settled.get()
        state, place = (_NEW, (-(1 << 63), -(1 << 63))) if kept is None else (tuple(kept[:7]), tuple(kept[7:]))
        events = [tuple(e) for e in self.waiting.get()]
        late = 0
        for row in rows:
            event = (row["us"], row["event_id"], row["event"], row["step"])
            if event[0] is None or event[:2] < place:
                late += 1
            else:
                events.append(event)
        state = (*state[:5], state[5] + late, state[6])
        events.sort(key=lambda e: e[:2])
        settling = [e for e in events if e[0] < events[-1][0] - self.lateness_us]
        for us, _, event, step in settling:
            state = apply_event(state, us, event, step)
        if settling:
            place = settling[-1][:2]
        self.settled.update((*state, *place))
        self.waiting.put(events[len(settling) :]) if len(events) > len(settling) else self.waiting.clear()
        for us, _, event, step in events[len(settling) :]:
            state = apply_event(state, us, event, step)
        yield Row(job_id=key[0], **dict(zip(LIFECYCLE.names[1:], state)))

    def close(self) -> None:
        pass


def job_lifecycle(events: DataFrame, lateness_seconds: int) -> DataFrame:
    """Jobs (:data:`LIFECYCLE`) as their events (``job_id, event_id, event_ts, event, step``) leave them."""
    keyed = events.selectExpr("job_id", "event_id", "unix_micros(event_ts) AS us", "event", "step")
    return keyed.groupBy("job_id").transformWithState(
        statefulProcessor=Lifecycle(lateness_seconds * 1_000_000), outputStructType=LIFECYCLE, outputMode="Update", timeMode="None"
    )


def run_lifecycle(spark: SparkSession, events: DataFrame, state: str, checkpoint: str, lateness_seconds: int = 3_600) -> DataFrame:
    """Fold the events that have landed; returns the current state of every job, refused events counted."""
    log = BatchLog(spark, f"{state}/lifecycle", LIFECYCLE)
    # Only this store keeps state of any kind by key.
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", provider):
        logged(job_lifecycle(events, lateness_seconds), log, checkpoint)
    return latest_rows(log.read(), ["job_id"])
