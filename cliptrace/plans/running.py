"""A match that runs beside its caller: phases, progress, cancel.

The parts of a match are written one after another, each a phase; jobs of all of
them carry one group, by which their tasks are counted and stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from .align import MAIN, Profile
from .match import match

#: Phases of a match, and the share of its work that lies before each, about.
PHASES = {"alignment": 0.0, "segments": 0.8, "unmatched": 0.9, "alternates": 0.94, "pool": 0.97, "done": 1.0}


@dataclass
class Status:
    """``state``: processing, completed, cancelled or failed; the phase that is
    or was the last one; the share of all work and the tasks that are done."""

    state: str
    phase: str
    share: float
    tasks: int
    error: str | None = None


class Running:
    """A match that was started.  Its parts are Parquet tables below ``path``:
    segments, unmatched, alternates, pool."""

    def __init__(self, short: DataFrame, movie: DataFrame, path: str, profile: Profile = MAIN, progress: Callable[[Status], None] | None = None, **limits):
        self.spark, self.path, self.group = short.sparkSession, path, f"match-{uuid.uuid4().hex}"
        self._args = (short, movie, profile, limits)
        self._progress = progress
        self._state, self._phase, self._error, self._stop = "processing", "alignment", None, False
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        self.spark.sparkContext.setJobGroup(self.group, "match", interruptOnCancel=True)
        got = None
        try:
            short, movie, profile, limits = self._args
            self._enter("alignment")
            got = match(short, movie, profile, **limits)
            for part in ("segments", "unmatched", "alternates", "pool"):
                if part != "segments":
                    self._enter(part)
                getattr(got, part).write.mode("overwrite").parquet(f"{self.path}/{part}")
            self._enter("done")
            self._state = "completed"
        except _Stopped:
            self._state = "cancelled"
        except Exception as e:  # noqa: BLE001  kept for whoever asks
            self._state, self._error = ("cancelled", None) if self._stop else ("failed", f"{type(e).__name__}: {e}"[:2_000])
        finally:
            if got is not None:
                got.release()

    def _enter(self, phase: str) -> None:
        if self._stop:
            raise _Stopped
        self._phase = phase
        if self._progress is not None:
            self._progress(self.status())

    def status(self) -> Status:
        """Where the match is now."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                about = tracker.getStageInfo(stage)
                if about is not None:
                    done, total = done + about.numCompletedTasks, total + about.numTasks
        names = list(PHASES)
        low = PHASES[self._phase]
        high = PHASES[names[min(names.index(self._phase) + 1, len(names) - 1)]]
        return Status(self._state, self._phase, low + (high - low) * (done / total if total and self._phase == "alignment" else 0.0), done, self._error)

    def cancel(self) -> None:
        """Stop it and wait until it has: running tasks end, no further phase
        begins.  Parts that are written stay.  Once it has ended nothing happens."""
        self._stop = True
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.group)  # also what was between two jobs
            self._thread.join(0.2)

    def wait(self, seconds: float | None = None) -> Status:
        """Its status when it has ended, or after ``seconds``."""
        self._thread.join(seconds)
        return self.status()


class _Stopped(Exception):
    """Cancelled between two phases."""
