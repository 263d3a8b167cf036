"""A time limit for the jobs of a block: when it runs out they are cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class DeadlineExceeded(TimeoutError):
    pass


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[str]:
    """Jobs started in the block by this thread form a group and are cancelled together."""
    sc, group, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()
    named = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {n: sc.getLocalProperty(n) for n in named}

    def cancel() -> None:
        over.set()
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)  # also one that is only being planned

    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        yield group
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"not done within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for n, v in before.items():
            sc.setLocalProperty(n, v)
