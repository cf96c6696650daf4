"""A time limit around actions: jobs carry a tag, and when time is up whatever runs under it ends."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

#: An ordinary search takes well under a second of a warm cluster; a caller can't use an answer that comes much later than this.
DEFAULT_SECONDS = 20.0
_EVERY = 0.2


@dataclass(frozen=True)
class Refused:
    """The answer in place of a result that took too long."""

    seconds: float

    def __str__(self) -> str:
        return f"The search took more than {self.seconds:g} seconds and was ended. Narrow the pattern or the files and ask again."


def within(spark: SparkSession, action: Callable[[], Any], seconds: float = DEFAULT_SECONDS) -> Any:
    """What ``action`` returns, or ``Refused`` if it isn't done in time.

    Every job that the action starts in this thread has a tag of its own, so that other work of the session goes on. A job that starts after the time is up ends as
    well. Its tasks are interrupted, not waited for. An error of the action itself is raised as it is.
    """
    if seconds <= 0:
        raise ValueError("a limit must be above zero: it would refuse every search")
    context, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while True:
            spark.interruptTag(tag)
            context.cancelJobsWithTag(tag)
            if done.wait(_EVERY):
                return

    before = context.getLocalProperty("spark.job.interruptOnCancel")
    context.setLocalProperty("spark.job.interruptOnCancel", "true")
    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        result = action()
        return result if not late.is_set() else Refused(seconds)
    except Exception:
        if late.is_set():
            return Refused(seconds)
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.job.interruptOnCancel", before)
