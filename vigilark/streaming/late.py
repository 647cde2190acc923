"""Rows that a running stream refused because the watermark had passed them."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class DroppedRows(StreamingQueryListener):
    """Adds up what the engine reports as dropped by the watermark, by stream (its name, else its id).

    Add it with `spark.streams.addListener`. The engine counts the rows that reach a stateful operator, so rows that
    were combined before it count once. A batch that is reported again replaces its earlier report. It holds one entry
    per stream, however many batches run.
    """

    def __init__(self) -> None:
        self._last: dict[str, tuple[int, int, int]] = {}  # batch, dropped in it, dropped in those before it

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        stream = progress.name or str(progress.id)
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        batch, latest, before = self._last.get(stream, (progress.batchId, 0, 0))
        if batch != progress.batchId:
            before += latest
        self._last[stream] = progress.batchId, dropped, before

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        return {stream: latest + before for stream, (_, latest, before) in self._last.items()}
