"""Progress and cancellation of batch jobs and streams."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Cancelled(Exception):
    """A run was stopped by its caller."""


class Progress(StreamingQueryListener):
    """Calls back with rows seen so far and, at the end, None."""

    def __init__(self, report: Callable[[int | None], None]):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event: object) -> None:
        self.rows = 0

    def onQueryProgress(self, event: object) -> None:
        self.rows += event.progress.numInputRows
        self.report(self.rows)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.report(None)


def memory_mb() -> float:
    """Memory of this process now."""
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) / 1024 for line in f if line.startswith("VmRSS:"))


class MemoryMeter:
    """How much a run has added to this process's memory since the meter was made; what was given back counts as nothing."""

    def __init__(self, read: Callable[[], float] = memory_mb):
        self.read, self.baseline = read, read()

    def added_mb(self) -> float:
        return max(0.0, self.read() - self.baseline)


class Signals:
    """What a run tells its host: progress in percent, log lines, its result when it ends, or its error."""

    def __init__(self, progress: Callable[[int], None] = print, log: Callable[[str], None] = print, finished: Callable[[object], None] = print, error: Callable[[str], None] = print):
        self.progress, self.log, self.finished, self.error = progress, log, finished, error

    def run(self, steps: list[tuple[str, Callable[[], object]]]) -> object:
        """Runs named steps in turn. The last one's result is told and returned; an error is told and ends the run."""
        result = None
        for k, (name, step) in enumerate(steps):
            self.log(name)
            try:
                result = step()
            except Exception as e:
                self.error(f"{name}: {e}")
                return None
            self.progress(100 * (k + 1) // len(steps))
        self.finished(result)
        return result


def cancellable(spark: SparkSession, action: Callable[[], object], cancelled: Callable[[], bool], every: float = 0.2, name: str = "tileframe") -> object:
    """Runs an action; once cancelled() holds, its jobs are stopped and Cancelled is raised."""
    done, result = threading.Event(), {}

    def run() -> None:
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        try:
            result["value"] = action()
        except Exception as e:
            result["error"] = e
        finally:
            done.set()

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    stopped = False
    while not done.wait(every):
        if cancelled():
            stopped = True
            spark.sparkContext.cancelJobGroup(name)
    if stopped:
        raise Cancelled(name)
    if "error" in result:
        raise result["error"]
    return result.get("value")
