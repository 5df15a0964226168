"""Job queues and ledgers as streams: a state machine with retries, micro-batch upserts, windowed usage."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.schema import USAGE
from loomgraph.scratch import ship

#: Attempts of a job, first delay before another one (it doubles), jobs taken at once.
ATTEMPTS, BACKOFF_MS, CONCURRENCY = 3, 2000, 4
#: Failures that no retry helps.
FINAL_ERRORS = ("no-key",)
ENDED = ("done", "failed")
JOB_EVENTS = "job_id string, t timestamp, event string, error string"
JOB_STATES = "job_id string, status string, attempts int, error string, delay_ms long"
#: Jobs of a group by id; due: when a waiting one queues again; heard: when anything was heard of it, both in milliseconds.
_STATE = "jobs array<struct<job_id:string,status:string,attempts:int,error:string,due:long,heard:long>>"
#: Groups that jobs are dealt to by their id. A call of the machine, a state and a timer are a group's, as each costs milliseconds in Python.
GROUPS = 2048
#: How long a job that nothing is heard of is kept.
TTL_MS = 24 * 3600 * 1000
#: Bytes of events that a micro-batch takes, about three millions of them; they are sorted by group and read one by one.
BATCH_BYTES = 256 << 20
#: State partitions a core at most: each costs a batch a task with its store, whatever it holds.
STORES_PER_CORE = 4
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _advance(status: str, attempts: int, event: str, error: str | None) -> tuple[str, int, int | None]:
    """Status, attempts and milliseconds to wait after one event. queued -> processing -> done or failed; a failure waits while attempts
    are left, then queues again.

    An upload of a job that has ended begins it anew, as one of a new job does. A waiting job may be started early.
    """
    if event == "upload" and status in ("", *ENDED):
        return "queued", 0, None
    if event == "start" and status in ("queued", "waiting"):
        return "processing", attempts + 1, None
    if event == "finish" and status == "processing":
        return "done", attempts, None
    if event == "fail" and status == "processing":
        if error in FINAL_ERRORS or attempts >= ATTEMPTS:
            return "failed", attempts, None
        return "waiting", attempts, BACKOFF_MS * 2 ** (attempts - 1)
    return status, attempts, None  # repeated and late events change nothing


class JobMachine(StatefulProcessor):
    """Status and attempts of a group's jobs as one value state; a timer queues those again whose delay is over. A job that has ended has
    no state, and one that nothing is heard of for ttl_ms lapses: by itself where its group is heard of, with the group elsewhere."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.group = handle, handle.getValueState("group", _STATE, self.ttl_ms)

    def _held(self, now: int) -> dict[str | None, tuple]:
        held = self.group.get()
        return {x[0]: tuple(x[1:]) for x in held[0] if now - x[5] < self.ttl_ms} if held else {}

    def _keep(self, held: dict[str | None, tuple]) -> None:
        if held:
            self.group.update(([(job, *x) for job, x in held.items()],))
        else:
            self.group.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, events = self._held(now), {}
        for row in rows:
            events.setdefault(row.job_id, []).append((row.t is None, row.t or 0, row.event, row.error))
        out, timers = [], set()
        for job, heard in events.items():
            status, attempts, error, due, _ = held.pop(job, ("", 0, None, None, None))
            delay = None
            for *_, event, said in sorted(heard, key=lambda x: x[:2]):
                before = status
                status, attempts, wait = _advance(status, attempts, event, said)
                if status != before or wait is not None:
                    delay, due = wait, None if wait is None else now + wait
                error = said if event == "fail" and before == "processing" else None if event == "start" else error
            if status and status not in ENDED:
                held[job] = status, attempts, error, due, now
            if status == "waiting" and delay is not None:
                timers.add(due)
            if status:
                out.append(Row(job_id=job, status=status, attempts=attempts, error=error, delay_ms=delay if status == "waiting" else None))
        self._keep(held)
        for due in timers:
            self.handle.registerTimer(due)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The timer of a job that was started before it rang finds nothing that is due."""
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held(now)
        over = [job for job, x in held.items() if x[0] == "waiting" and x[3] <= now]
        for job in over:
            held[job] = "queued", *held[job][1:3], None, now
        if over:
            self._keep(held)
        for job in over:
            yield Row(job_id=job, status="queued", attempts=held[job][1], error=held[job][2], delay_ms=None)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_ms: int = TTL_MS, groups: int = GROUPS) -> DataFrame:
    """Each job's state after every micro-batch that has events of it, and when its delay is over and it queues again. [STM-02, STM-03]

    events: a stream of job_id, t, event (upload, start, finish, fail) and error; delay_ms is how long a waiting job waits. Events
    of a job that isn't known, but for an upload, give no row. The session must keep state in RocksDB (STORE). A query that goes on
    from a checkpoint must have the same number of groups.
    """
    ship(events.sparkSession)
    dealt = events.withColumn("_group", F.pmod(F.xxhash64("job_id"), F.lit(groups)))
    return dealt.groupBy("_group").transformWithState(JobMachine(ttl_ms), JOB_STATES, "Update", "processingTime")


def run_jobs(spark: SparkSession, folder: str, attempt: Callable[[DataFrame], DataFrame], done: Callable[[], bool], seconds: int = 3600) -> dict:
    """Runs the jobs whose events are put into `folder`/in, until done() or the time is up; the last progress of the query. [STM-02, STM-03, STM-04]

    attempt: given queued jobs (job_id and attempts so far), returns what became of each: event (finish or fail) and error. What
    it returns goes back into the folder as events, so a failure is tried again when its timer says so. States of a batch are
    written under its number to `folder`/out; a batch that runs again writes them anew.

    A batch takes what has come in, up to BATCH_BYTES, in as many files as there are: what one batch writes is all there for the next,
    so batches are as many as attempts and waits make them, not as files do. That the time is up before done() is an error.
    """
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STORES_PER_CORE * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": stores}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    states = job_states(spark.readStream.schema(JOB_EVENTS).option("maxBytesPerTrigger", BATCH_BYTES).json(f"{folder}/in"))

    def take(batch: DataFrame, number: int) -> None:
        path = f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        queued = spark.read.schema(JOB_STATES).parquet(path).where("status = 'queued'").select("job_id", "attempts")
        if queued.isEmpty():
            return
        came = attempt(queued).select("job_id", F.explode(F.array(F.struct(F.lit("start").alias("event"), F.lit(None).cast("string").alias("error")), F.struct("event", "error"))).alias("e"))
        # JSON has milliseconds; a start and its end must differ in them, as tasks that read parts of a file keep no order among each other
        at = F.timestamp_millis(F.lit(number * 10) + F.when(F.col("e.event") == "start", 0).otherwise(1))
        # a name of its own for each batch: one that runs again replaces what it wrote
        came.select("job_id", at.alias("t"), "e.event", "e.error").write.mode("overwrite").json(f"{folder}/next/{number}")
        _move(spark, f"{folder}/next/{number}", f"{folder}/in", f"batch-{number}")

    try:
        query = states.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    last = run_until(query, done, seconds)
    if not done():
        raise TimeoutError("the jobs didn't end in time")
    return last


def run_until(query, done: Callable[[], bool], seconds: int = 600) -> dict:
    """Lets a query run until done() or the time is up, and stops it; its last progress. One with timers never ends by itself. [STM-04]"""
    end = time.time() + seconds
    while time.time() < end and query.isActive and not done():
        query.awaitTermination(1)
    batches = lambda: (query.lastProgress or {"batchId": -1})["batchId"]
    ended = batches()
    while time.time() < end and query.isActive and query.status["isTriggerActive"] and batches() == ended:
        query.awaitTermination(0.1)  # a batch that is under way counts in the progress when it has ended
    if query.exception():
        raise query.exception()
    last = query.lastProgress
    query.stop()
    return last


def rows_read(query) -> int:
    """Rows that the query's recent micro-batches have read."""
    return sum(p["numInputRows"] for p in query.recentProgress)


def _move(spark: SparkSession, source: str, folder: str, prefix: str) -> None:
    """Gives a folder's data files to another folder; the names are the prefix and a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().toString() for f in files.listStatus(path(source)) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        files.rename(path(part), path(f"{folder}/{prefix}-{i}.json"))


def work_queue(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Takes new files of jobs, a few at a time, and gives each micro-batch to `handle`, which upserts its results. [STM-01, SNK-09]"""
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", CONCURRENCY).json(folder)
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(USAGE).json(folder)


def usage_totals(usage: DataFrame) -> DataFrame:
    """Running totals per tool, for update or complete output. [STM-07]"""
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("out"), F.sum("base").alias("base"))


def usage_windows(usage: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Totals per tool and event-time window; rows later than `late` are dropped. An extension beyond the ledgers above."""
    window = F.window("t", width, slide or width)
    rows = usage.withWatermark("t", late).groupBy(window.alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("out"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "n", "out")


def usage_sessions(usage: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Questions per tool in sessions that a pause of `gap` ends. An extension, as usage_windows."""
    rows = usage.withWatermark("t", late).groupBy(F.session_window("t", gap).alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "n")


def dirty_bindings(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """node and prop of the bindings (var, node, prop) of changed variables (var). [STM-06]"""
    return dependencies.join(changed, "var", "left_semi").select("node", "prop").distinct()


def wait_for(query, seconds: int = 60) -> bool:
    """Whether the query ended in time. [STM-04]"""
    return query.awaitTermination(seconds)
