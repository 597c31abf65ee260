"""One long job at a time, with its state to be asked for while it runs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Busy(RuntimeError):
    """A job is running; there is one slot."""


@dataclass(frozen=True)
class Status:
    name: str | None = None
    state: str = "idle"  # idle, running, done, failed, cancelled
    stage: str | None = None
    started_at: float | None = None
    ended_at: float | None = None
    result: Any = None
    error: str | None = None


class JobSlot:
    """Runs f(on_step) in a thread; a second start is refused until it has ended. The last job's state stays until the next."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._lock, self._status, self._thread, self._group = threading.Lock(), Status(), None, None

    def start(self, name: str, f: Callable[[Callable[[str], None]], Any]) -> None:
        with self._lock:
            if self._thread is not None and self._thread.is_alive():
                raise Busy(f"{self._status.name} is running")
            self._status, self._group = Status(name, "running", started_at=time.time()), uuid.uuid4().hex
            self._thread = InheritableThread(target=self._run, args=(f, self._group), session=self.spark)
            self._thread.start()

    def _run(self, f: Callable[[Callable[[str], None]], Any], group: str) -> None:
        self.spark.sparkContext.setJobGroup(group, self._status.name or "", interruptOnCancel=True)
        try:
            result, error = f(self._step), None
        except BaseException as e:  # whatever ends the job is its state
            result, error = None, f"{type(e).__name__}: {e}".splitlines()[0][:500]
        with self._lock:
            state = "done" if error is None else "cancelled" if self._status.state == "cancelled" else "failed"
            self._status = replace(self._status, state=state, ended_at=time.time(), result=result, error=error)

    def _step(self, stage: str) -> None:
        with self._lock:
            if self._status.state == "cancelled":
                raise InterruptedError("cancelled")
            self._status = replace(self._status, stage=stage)

    def status(self) -> Status:
        with self._lock:
            return replace(self._status, state="running") if self._status.state == "cancelled" and self._status.ended_at is None else self._status

    def cancel(self) -> None:
        """Ends the running job's Spark jobs, and the job at its next step."""
        with self._lock:
            if self._status.state != "running":
                return
            self._status = replace(self._status, state="cancelled")
        self.spark.sparkContext.cancelJobGroup(self._group)

    def wait(self, seconds: float | None = None) -> Status:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status()
