"""Progress and cancellation of running work."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Hands (phase, status, rows) to a callback as streams start, advance and end."""

    def __init__(self, callback: Callable[[dict], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.callback({"phase": event.name or str(event.id), "status": "starting", "rows": 0})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.callback({"phase": event.progress.name or str(event.progress.id), "status": "running", "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.callback({"phase": str(event.id), "status": "error" if event.exception else "done", "rows": 0})


def tagged(spark: SparkSession, run_id: str, work: Callable[[], DataFrame | None]) -> threading.Thread:
    """Start work in a thread whose jobs carry the run's tag."""

    def run() -> None:
        spark.addTag(run_id)
        try:
            work()
        finally:
            spark.removeTag(run_id)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread


def cancel(spark: SparkSession, run_id: str) -> list[str]:
    """Interrupt all jobs of a run: running tasks end, not only those to come."""
    return spark.interruptTag(run_id)
