"""Progress of runs: counts observed on the way, times, and listeners of streams."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Callback = Callable[[str, int, float], None]


class Watch:
    """Row counts of a batch run's stages, taken while the rows pass: no stage is run again for its count.

        watch = Watch(on=print)
        found = watch.stage("found", search.hybrid(...))
        out = watch.stage("built", context.build(found, 5))
        watch.run(lambda: out.write.parquet(path))      # stage, rows, ms of the whole run to every callback

    A stage whose rows are cut off by a later limit counts what passed.  Counts are there after run().
    """

    def __init__(self, *on: Callback):
        self._on, self._held = list(on), {}
        self.counts: dict[str, int] = {}
        self.ms = 0.0

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        if name in self._held:
            raise ValueError(f"stage {name} is watched already")
        self._held[name] = Observation(name)
        return df.observe(self._held[name], F.count(F.lit(1)).alias("rows"))

    def run(self, action: Callable):
        """The action's result; a failing callback doesn't end the run."""
        began = time.perf_counter()
        out = action()
        self.ms = (time.perf_counter() - began) * 1000
        self.counts = {name: o.get["rows"] for name, o in self._held.items()}
        for name, rows in self.counts.items():
            _tell(self._on, name, rows, self.ms)
        return out


def _tell(on: list[Callback], name: str, rows: int, ms: float) -> None:
    for f in on:
        try:
            f(name, rows, ms)
        except Exception:  # noqa: BLE001 - a listener's own failure
            pass


@dataclass
class Seen:
    """What a stream has done: batches with rows, rows, rows by observed name, failure of its end."""

    batches: int = 0
    rows: int = 0
    observed: dict[str, int] = field(default_factory=dict)
    ended: bool = False
    failure: str | None = None


class Listener(StreamingQueryListener):
    """Progress of the session's streams by their names, passed on to callbacks (name, rows, ms of the batch)."""

    def __init__(self, *on: Callback):
        self._on, self.seen, self._names = list(on), {}, {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self.seen.setdefault(self._names[str(event.id)], Seen())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        seen = self.seen.setdefault(name, Seen())
        if p.numInputRows:
            seen.batches += 1
            seen.rows += p.numInputRows
        for key, row in p.observedMetrics.items():
            for metric, value in row.asDict().items():
                at = f"{key}.{metric}"
                seen.observed[at] = seen.observed.get(at, 0) + (value or 0)
        _tell(self._on, name, p.numInputRows, float(p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        seen = self.seen.setdefault(self._names.get(str(event.id), str(event.id)), Seen())
        seen.ended, seen.failure = True, event.exception
