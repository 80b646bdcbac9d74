"""Progress of streaming queries, as numbers to scrape."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Totals by query name, rendered in the text format that scrapers read."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.failed: set[str] = set()
        self.running: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.running[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + int(event.progress.numInputRows)
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.running.pop(str(event.runId), str(event.id))
        if event.exception:
            self.failed.add(name)

    def healthy(self) -> bool:
        return not self.failed

    def text(self) -> str:
        lines = [f'ledgerloom_input_rows_total{{query="{n}"}} {v}' for n, v in sorted(self.rows.items())]
        lines += [f'ledgerloom_batches_total{{query="{n}"}} {v}' for n, v in sorted(self.batches.items())]
        return "\n".join([*lines, f"ledgerloom_up {int(self.healthy())}"]) + "\n"
