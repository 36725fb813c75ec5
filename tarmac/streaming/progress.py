"""Progress of streams and batch jobs, to callbacks and as columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Progress:
    """Counts of a job of known size."""

    total: int
    processed: int = 0
    success: int = 0
    failed: int = 0
    skipped: int = 0
    current: str = ""
    started: float = field(default_factory=time.time)

    @property
    def percent(self) -> float:
        return 100.0 * self.processed / self.total if self.total else 0.0

    @property
    def elapsed(self) -> float:
        return time.time() - self.started

    @property
    def eta(self) -> float | None:
        return (self.total - self.processed) * self.elapsed / self.processed if self.processed else None


def tracked(items: Iterable, total: int, on_step: Callable[[Progress], None]) -> Iterator:
    """Items one by one, a call after each; an item whose handling raises counts as failed and the error goes on."""
    p = Progress(total)
    for x in items:
        p.current = str(x)
        try:
            yield x
            p.success += 1
        except GeneratorExit:
            raise
        finally:
            p.processed += 1
            p.failed = p.processed - p.success - p.skipped
            on_step(p)


class StreamProgress(StreamingQueryListener):
    """Calls back with batch number and rows of each micro-batch."""

    def __init__(self, on_batch: Callable[[int, int], None]):
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.on_batch(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def eta_seconds(total: Column, processed: Column, elapsed: Column) -> Column:
    return F.when(processed > 0, (total - processed) * elapsed / processed)


def batch_results(log: DataFrame) -> DataFrame:
    """status, files, rows of a log of files (status, rows)."""
    return log.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
