"""Figures of running queries: rows, seconds and state over the last batches."""

from __future__ import annotations

from collections import deque
from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """The last ``keep`` batches of each query; register with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 100) -> None:
        super().__init__()
        self.keep, self.batches, self.lock = keep, {}, Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.lock:
            self.batches.setdefault(str(event.id), deque(maxlen=self.keep))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        with self.lock:
            self.batches.setdefault(str(p.id), deque(maxlen=self.keep)).append((p.numInputRows, p.batchDuration / 1000, state))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def stats(self, query_id: str) -> dict[str, float]:
        with self.lock:
            held = list(self.batches.get(str(query_id), ()))
        rows, seconds = sum(b[0] for b in held), sum(b[1] for b in held)
        return {"batches": len(held), "rows": rows, "last_s": held[-1][1] if held else 0.0, "mean_s": seconds / len(held) if held else 0.0, "rows_a_second": rows / seconds if seconds else 0.0, "state_rows": held[-1][2] if held else 0}
