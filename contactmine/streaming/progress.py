"""Live counters of running streams."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class ContactProgress(StreamingQueryListener):
    """Totals over all batches and the last ``keep`` batch messages.

    Register with ``spark.streams.addListener``.
    """

    def __init__(self, keep: int = 50):
        self.rows_read = 0
        self.values = 0
        self.emails = 0
        self.seconds = 0.0
        self.log: deque[str] = deque(maxlen=keep)

    @property
    def rows_per_second(self) -> float:
        return self.rows_read / self.seconds if self.seconds > 0 else 0.0

    def onQueryStarted(self, event) -> None:
        self.log.append(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get("contacts")
        self.rows_read += progress.numInputRows
        self.seconds += (progress.durationMs.get("triggerExecution") or 0) / 1000
        if found is not None:
            self.values += found.n_values
            self.emails += found.n_emails
        self.log.append(f"batch {progress.batchId}: {progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.append(f"stopped {event.id}")
