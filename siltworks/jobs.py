"""Long work in the background: started, watched, cancelled between and within its Spark jobs, and cleaned up after."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from siltworks.session import drop_scratch_of, owning_scratch

STATES = ("started", "cancelled", "failed", "completed")


class Cancelled(Exception):
    """The job was asked to stop."""


@dataclass
class Job:
    """What is known of a job. state: one of STATES; phase: what it says it does, cancelling once it was asked to stop."""

    job_id: str
    state: str = "started"
    phase: str = ""
    completed: int = 0
    total: int = 0
    message: str = ""
    result: Any = None
    stop: threading.Event = field(default_factory=threading.Event, repr=False)
    future: Future | None = field(default=None, repr=False)


class Jobs:
    """Runs work(report) on a few threads of the driver. report(phase, completed, total) tells how far it is, and raises Cancelled when it should stop; so does
    every scratch table that the work begins. Spark jobs of a cancelled job are cut off by their tag. However a job ends but completed, the scratch
    tables that it wrote go; those of a completed job stay with its result, until discard()."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.context = spark, spark.sparkContext
        self.pool = ThreadPoolExecutor(workers, thread_name_prefix="siltworks-job")
        self.lock = threading.Lock()
        self.jobs: dict[str, Job] = {}

    def start(self, work: Callable[[Callable[[str, int, int], None]], Any]) -> str:
        job = Job(f"siltworks-job-{uuid.uuid4().hex}")
        with self.lock:
            self.jobs[job.job_id] = job
        job.future = self.pool.submit(self._run, job, work)
        return job.job_id

    def _run(self, job: Job, work: Callable) -> None:
        def check() -> None:
            if job.stop.is_set():
                raise Cancelled

        def report(phase: str, completed: int = 0, total: int = 0) -> None:
            with self.lock:
                if not job.stop.is_set():
                    job.phase, job.completed, job.total = phase, completed, total
            check()

        self.context.setJobGroup(job.job_id, job.job_id, True)
        self.context.addJobTag(job.job_id)
        try:
            with owning_scratch(job.job_id, check):
                check()
                job.result = work(report)
                check()
            ended = ("completed", "completed", "")
        except Cancelled:
            ended = ("cancelled", "cancelled", "The job was cancelled.")
        except Exception as broken:  # noqa: BLE001  a job's failure is its own
            # Spark jobs that were cut off raise errors of their own.
            ended = ("cancelled", "cancelled", "The job was cancelled.") if job.stop.is_set() else ("failed", "failed", f"{type(broken).__name__}: {broken}"[:2000])
        finally:
            self.context.removeJobTag(job.job_id)
        if ended[0] != "completed":
            job.result = None
            drop_scratch_of(job.job_id)
        with self.lock:
            job.state, job.phase, job.message = ended

    def cancel(self, job_id: str) -> Job | None:
        """Ask a job to stop; a job that has ended is left as it is, None where there is no such job."""
        job = self.jobs.get(job_id)
        if job is None or job.state != "started":
            return job
        with self.lock:
            job.stop.set()
            job.phase = "cancelling"
        if not job.future.cancel():
            threading.Thread(target=self._cut_off, args=(job,), daemon=True).start()
        else:
            with self.lock:
                job.state, job.phase, job.message = "cancelled", "cancelled", "The job was cancelled."
        return job

    def _cut_off(self, job: Job) -> None:
        """Cancels what carries the job's tag until the job has ended: it may start another Spark job before it notices."""
        while not job.future.done():
            self.context.cancelJobsWithTag(job.job_id)
            time.sleep(0.2)

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        job = self.jobs[job_id]
        if not job.future.cancelled():
            job.future.result(seconds)
        return job

    def discard(self, job_id: str) -> None:
        """Forget an ended job and delete its scratch tables."""
        job = self.jobs[job_id]
        if job.state == "started":
            raise ValueError(f"{job_id} is running")
        drop_scratch_of(job_id)
        del self.jobs[job_id]

    def stages(self, job_id: str) -> list[tuple]:
        """(job_id, stage_id, name, tasks, done, active, failed) of the Spark stages of a job that Spark still remembers."""
        tracker, out = self.context.statusTracker(), []
        for spark_job in tracker.getJobIdsForGroup(job_id):
            info = tracker.getJobInfo(spark_job)
            for stage in sorted(info.stageIds if info else ()):
                s = tracker.getStageInfo(stage)
                if s:
                    out.append((job_id, stage, s.name, s.numTasks, s.numCompletedTasks, s.numActiveTasks, s.numFailedTasks))
        return sorted(set(out))

    def table(self) -> DataFrame:
        """All jobs, a row each."""
        rows = [(j.job_id, j.state, j.phase, j.completed, j.total, j.message) for j in list(self.jobs.values())]
        return self.spark.createDataFrame(rows, "job_id string, state string, phase string, completed long, total long, message string")

    def shutdown(self) -> None:
        """Wait for all jobs."""
        self.pool.shutdown(wait=True)


class StreamProgress(StreamingQueryListener):
    """The last batches of all streams of a session: (query, batch, input_rows, state_rows, state), and how each query ended."""

    def __init__(self, size: int = 200):
        self.rows: deque[tuple] = deque(maxlen=size)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows.append((event.name or str(event.id), -1, 0, 0, "started"))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators), "running"))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query string, batch long, input_rows long, state_rows long, state string")
