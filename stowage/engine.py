"""Jobs: run one and wait, or submit it and hold a handle."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import SparkSession

from .model import EngineOptions, JobRequest, JobStats, PackError, Progress, Status
from .plans import pack


class JobHandle:
    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self._tag = spark, tag
        self._future: Future[JobStats] = Future()
        self._progress = Progress()
        self._stop = threading.Event()

    def wait(self, timeout: float | None = None) -> PackError | None:
        """Any number of times, from any thread: None if the job went well, else its error."""
        try:
            self._future.result(timeout)
        except PackError as e:
            return e
        return None

    def cancel(self) -> None:
        self._stop.set()
        self._spark.interruptTag(self._tag)

    def __enter__(self) -> JobHandle:
        return self

    def __exit__(self, *_) -> None:
        """Leaving the block stops a job that still runs."""
        if not self.done():
            self.cancel()

    def progress(self) -> Progress:
        return self._progress

    def done(self) -> bool:
        return self._future.done()

    def error(self) -> PackError | None:
        return self.wait()

    def stats(self) -> JobStats | None:
        return None if self.wait() else self._future.result()


class Engine:
    def __init__(self, spark: SparkSession, options: EngineOptions = EngineOptions()):
        self.spark, self.options = spark, options

    def submit(self, request: JobRequest, on_progress: Callable[[Progress], None] | None = None) -> JobHandle:
        pack.validate(request)
        handle = JobHandle(self.spark, f"pack-{uuid.uuid4().hex}")

        def seen(p: Progress) -> None:
            handle._progress = p
            if on_progress:
                on_progress(p)

        def work() -> None:
            self.spark.addTag(handle._tag)  # of this thread's jobs
            try:
                handle._future.set_result(pack.run(self.spark, request, self.options, seen, stopped=handle._stop.is_set))
            except PackError as e:
                handle._future.set_exception(e)
            except BaseException as e:  # noqa: BLE001  an error of any kind belongs to the handle
                stopped = handle._stop.is_set()
                handle._future.set_exception(PackError(Status.CANCELLED if stopped else _status(e), "cancelled" if stopped else str(e)[:2000]))

        threading.Thread(target=work, daemon=True).start()
        return handle

    def run(self, request: JobRequest, on_progress: Callable[[Progress], None] | None = None) -> JobStats:
        handle = self.submit(request, on_progress)
        if error := handle.wait():
            raise error
        return handle.stats()


def _status(e: BaseException) -> Status:
    """A task's own error code, if its message carries one."""
    text = str(e)
    return next((s for s in Status if f"PackError: {s.name}:" in text or f"{s.name}: " in text[:200]), Status.INTERNAL)
