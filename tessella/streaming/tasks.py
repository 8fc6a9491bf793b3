"""The task queue as a stream: a state machine for each task, and one oldest queued task a tick.

Task events (task_id, action, ts, progress) come in any order within the watermark. State is kept by
task, so it is dealt out over all executors and lives in the state store; what a task is depends on
its events alone, not on their order of arrival, and an event that comes twice changes nothing.
A finished task is forgotten `keep` seconds after it was submitted, by a timer on event time.

The queue loop is a sink: each micro-batch writes the states that changed as one folder named after
the batch, takes the oldest queued task, and the events that its work gives become a new input file
named after the batch too. So a batch that is repeated after a crash writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "task_id long, action string, ts timestamp, progress int"
STATES = "task_id long, status string, progress int, created_at timestamp, updated_at timestamp"
#: The same with times in microseconds.
SHOWN = "status string, progress int, created_at long, updated_at long"
#: What a tick took.
TOOK = "task_id long, created_at timestamp"
TAKEN = f"{TOOK}, tick long"
#: The state store that timers and list states need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FINISHED = ("completed", "failed", "cancelled")
# Progress at the start of work and at its end.
STARTED, DONE = 10, 100


def status_of(events: list[tuple[int, str, int | None]]) -> tuple[str, int, int, int] | None:
    """(status, progress, created_at, updated_at) after a task's events (time, action, progress); None before it was submitted.

    The latest submission counts, and events not older than it. Completed and cancelled tasks stay so; a failed
    one can still be cancelled. Of events of one time, submit comes first, then start, progress, complete, fail, cancel.
    """
    order = {"submit": 0, "start": 1, "progress": 2, "complete": 3, "fail": 4, "cancel": 5}
    submitted = max((t for t, a, _ in events if a == "submit"), default=None)
    if submitted is None:
        return None
    status, progress, last = "queued", 0, submitted
    for t, action, p in sorted((e for e in events if e[0] >= submitted and e[1] in order), key=lambda e: (e[0], order[e[1]], e[2] or 0)):
        if status in ("completed", "cancelled") or (status == "failed" and action != "cancel"):
            continue
        if action == "start" and status == "queued":
            status, progress = "processing", max(progress, STARTED)
        elif action == "progress":
            progress = max(progress, p or 0)
        elif action in ("complete", "fail", "cancel"):
            status = {"complete": "completed", "fail": "failed", "cancel": "cancelled"}[action]
            progress = {"complete": DONE, "fail": 0, "cancel": progress}[action]
        last = max(last, t)
    return status, progress, submitted, last


class TaskMachine(StatefulProcessor):
    """Events of one task -> its state, whenever it changes; `expired` when a finished task is forgotten."""

    def __init__(self, keep: int = 300) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, action string, progress int")
        self.shown = handle.getValueState("shown", SHOWN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        known = {(e[0], e[1], e[2]) for e in self.events.get()} if self.events.exists() else set()
        merged = known | {(r["at"], r["action"], r["progress"]) for r in rows if r["at"] is not None}
        now = status_of(list(merged))
        if now is not None:  # what is older than the submission, and progress that a larger one replaces, goes
            merged = {e for e in merged if e[0] >= now[2]}
            reports = [e for e in merged if e[1] == "progress"]
            ends = {e[0] for e in merged if e[1] not in ("submit", "start", "progress")}
            if reports and not ends:
                top = max(reports, key=lambda e: (e[2] or 0, e[0]))
                latest = max(reports, key=lambda e: (e[0], e[2] or 0))
                merged = {e for e in merged if e[1] != "progress"} | {top, latest}
        if merged != known:
            self.events.put([Row(at=t, action=a, progress=p) for t, a, p in merged])
        was = self.shown.get() if self.shown.exists() else None
        if now is None or (was is not None and tuple(was) == now):
            return
        self.shown.update(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now[0] in FINISHED:
            self.handle.registerTimer(now[2] // 1000 + self.keep * 1000)
        yield Row(task_id=key[0], status=now[0], progress=now[1], created_at=now[2], updated_at=now[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.shown.exists():
            _, progress, created, updated = self.shown.get()
            yield Row(task_id=key[0], status="expired", progress=progress, created_at=created, updated_at=updated)
        self.events.clear()
        self.shown.clear()

    def close(self) -> None:
        pass


def changes(events: DataFrame, keep: int = 300, late: str = "10 minutes") -> DataFrame:
    """A stream of task events -> a stream of states (STATES), one row whenever a task's state changes or expires."""
    timed = events.where("task_id is not null").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    found = timed.groupBy("task_id").transformWithState(TaskMachine(keep), outputStructType=f"task_id long, {SHOWN}", outputMode="Update", timeMode="EventTime", eventTimeColumnName="")
    return found.select("task_id", "status", "progress", F.timestamp_micros("created_at").alias("created_at"), F.timestamp_micros("updated_at").alias("updated_at"))


def latest(log: DataFrame) -> DataFrame:
    """The last state of each task in a log of changes (STATES and `batch`), without expired ones."""
    order = F.struct("batch", (F.col("status") != "expired").cast("int"), "updated_at", "progress")
    columns = ("status", "progress", "created_at", "updated_at")
    last = log.groupBy("task_id").agg(F.max_by(F.struct(*columns), order).alias("s"))
    return last.select("task_id", *[f"s.{c}" for c in columns]).where("status <> 'expired'")


def oldest(states: DataFrame, n: int = 1) -> DataFrame:
    """The queued tasks that were submitted first (ties: smallest id)."""
    return states.where("status = 'queued'").orderBy("created_at", "task_id").limit(n)


def log_changes(stream: DataFrame, path: str, checkpoint: str, work: Callable[[Row], list[tuple]] | None = None, inbox: str | None = None) -> StreamingQuery:
    """Write the changes of each micro-batch to `path`, a folder for each batch; with `work`, run one queue tick after each.

    work(task) returns events (task_id, action, ts, progress) of the task that was taken; they are
    written to `inbox`, where the stream reads them in a later batch. What was taken is written down, so
    the next tick takes the next task even if that batch has not come yet.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if work is None:
            return
        before = batch.sparkSession.read.schema(TAKEN).option("basePath", f"{path}/taken").parquet(f"{path}/taken/tick=*").where(F.col("tick") < number)
        states = latest(read_log(batch.sparkSession, path).where(F.col("batch") <= number))
        taken = oldest(states.join(before, ["task_id", "created_at"], "left_anti")).collect()  # one row
        batch.sparkSession.createDataFrame([(r["task_id"], r["created_at"]) for r in taken], TOOK).coalesce(1).write.mode("overwrite").parquet(f"{path}/taken/tick={number}")
        events = work(taken[0]) if taken else []
        if events:
            batch.sparkSession.createDataFrame(events, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{inbox}/tick={number}")

    for k, v in STORE.items():
        spark.conf.set(k, v)
    if work is not None:
        spark.createDataFrame([], TOOK).write.mode("overwrite").parquet(f"{path}/taken/tick=-1")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STATES}, batch long").option("basePath", path).parquet(f"{path}/batch=*")


def incoming(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Task events from the Parquet files of a folder and its subfolders, as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(path)
