"""Job status as a stream and as a batch: the state machine, crash recovery, progress, encoder progress lines.

Batch and stream share the fold: of a job's status events in order, a terminal state holds, progress is clamped."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")


def clamp(x: Column) -> Column:
    """x within 0 and 1; null stays null, which least() alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def latest_state(events: DataFrame) -> DataFrame:
    """(job_id, status, progress, n_events) of events (job_id, seq, status, progress): up to the first terminal state."""
    order = Window.partitionBy("job_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin(*TERMINAL).cast("int")).over(before), F.lit(0))
    live = events.withColumn("ended", ended).filter("ended = 0")
    return live.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max_by(clamp(F.col("progress")), "seq").alias("progress"), F.count(F.lit(1)).alias("n_events"))


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs as after a restart: what was being processed has failed; the queued and the ended stay."""
    lost = F.col("status") == "PROCESSING"
    return jobs.withColumn("error", F.when(lost, F.lit("Interrupted by a restart.")).otherwise(F.col("error"))).withColumn("status", F.when(lost, F.lit("FAILED")).otherwise(F.col("status")))


def progress_lines(lines: DataFrame, duration_s: Column) -> DataFrame:
    """lines (job_id, seq, value) of an encoder's key=value progress, as progress from 0 to 1 where they tell the time."""
    micros = F.regexp_extract("value", r"^out_time_us=(\d+)\s*$", 1).try_cast("double")
    return lines.withColumn("progress", clamp(micros / 1e6 / duration_s)).filter(F.col("progress").isNotNull())


def progress_rollup(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window, in batch or stream: late rows count until the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def run_job(spark: SparkSession, job_id, action: Callable[[], object]) -> tuple[str, object]:
    """(status, result or error) of an action, whose Spark jobs carry the job's tag, so that cancel_job() ends them."""
    sc, tag = spark.sparkContext, f"job-{job_id}"
    sc.addJobTag(tag)
    try:
        return "COMPLETED", action()
    except Exception as e:
        return ("CANCELLED" if "cancelled" in str(e).lower() else "FAILED"), str(e)
    finally:
        sc.removeJobTag(tag)


def cancel_job(spark: SparkSession, job_id) -> None:
    spark.sparkContext.cancelJobsWithTag(f"job-{job_id}")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOB = "job_id long, status string, progress double, n_events long"


class JobFold(StatefulProcessor):
    """A job's events by their seq, so that the state is that of the batch, in whatever order they come.

    Events after the first terminal one are dropped, and come to nothing when they arrive later; an event that belongs
    before it still counts, and an earlier terminal one takes its place. With keep_ms, a job that has ended is closed
    keep_ms later: a timer replaces its events by their outcome, which with forget_ms goes that much later in turn."""

    def __init__(self, keep_ms: int | None, forget_ms: int | None):
        self.keep_ms, self.forget_ms = keep_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "seq long", "status string, progress double")
        self.outcome = handle.getValueState("outcome", "status string, progress double, n_events long")
        self.due = handle.getValueState("due", "at long")

    def _events(self) -> list[tuple]:
        """(seq, status, progress) up to the first terminal one; the others go."""
        found, ended = sorted((k[0], v[0], v[1]) for k, v in self.open.iterator()), False
        kept = []
        for seq, status, progress in found:
            if ended:
                self.open.removeKey((seq,))
            else:
                kept.append((seq, status, progress))
            ended = ended or status in TERMINAL
        return kept

    @staticmethod
    def _outcome(events: list[tuple]) -> tuple:
        _, status, progress = events[-1]
        return status, None if progress is None else max(0.0, min(1.0, progress)), len(events)

    def handleInputRows(self, key, rows, timerValues):
        if self.outcome.exists():
            return
        for row in rows:
            self.open.updateValue((row.seq,), (row.status, row.progress))
        events = self._events()
        if self.keep_ms is not None and events[-1][1] in TERMINAL and not self.due.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield Row(job_id=key[0], **dict(zip(("status", "progress", "n_events"), self._outcome(events), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.outcome.exists():
            self.outcome.clear()
            return
        events = self._events()
        self.open.clear()
        self.due.clear()
        self.outcome.update(self._outcome(events))
        if self.forget_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield from ()

    def close(self) -> None:
        pass


def follow_jobs(events: DataFrame, keep_ms: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """The stream of latest_state(): status events (job_id, seq, status, progress) of a job, folded in the order of seq.

    After all events have come, in whatever batches, a job's last row is that of the batch. With keep_ms, the events of
    ended jobs are forgotten that much later; such a query runs on a processing-time trigger, as one of availableNow
    would wait for its timers forever. The session's state store must be RocksDB, which this sets."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("job_id").transformWithState(JobFold(keep_ms, forget_ms), _JOB, "Update", "None" if keep_ms is None else "ProcessingTime")


def session_rollup(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Of each user the sessions that a gap without events ends: (user_id, session_start, session_end, n, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "value")


def publish(rollup: DataFrame, path: str, checkpoint: str, subscriber: Callable[[DataFrame, int], None] | None = None, **trigger):
    """A started query that writes each batch of a stream to a folder of its own, and tells a subscriber of it.

    A batch that runs again after a restart has the same number and replaces what it wrote: no row stands twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if subscriber:
            subscriber(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return rollup.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def published(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """What publish() has written: of each key the row of its latest batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")


class ProgressFeed(StreamingQueryListener):
    """Progress of streaming queries for subscribers by query name; each has a queue, of which the oldest entries go."""

    def __init__(self, most: int = 100):
        self.most, self.queues, self.lock = most, {}, threading.Lock()

    def subscribe(self, name: str) -> deque:
        with self.lock:
            self.queues.setdefault(name, []).append(queue := deque(maxlen=self.most))
        return queue

    def unsubscribe(self, name: str, queue: deque) -> None:
        with self.lock:
            self.queues[name] = [q for q in self.queues.get(name, []) if q is not queue]

    def _tell(self, name: str | None, entry: dict) -> None:
        with self.lock:
            for queue in self.queues.get(name or "", []):
                queue.append(entry)

    def onQueryStarted(self, event) -> None:
        self.names = getattr(self, "names", {}) | {str(event.id): event.name}
        self._tell(event.name, {"state": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell(p.name, {"state": "progress", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryTerminated(self, event) -> None:
        self._tell(getattr(self, "names", {}).get(str(event.id)), {"state": "terminated", "error": event.exception})

    def onQueryIdle(self, event) -> None:
        pass
