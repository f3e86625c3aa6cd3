"""Tables that grow by batches and are merged in generations.

Batch n is a folder ``batch_id=n``, overwritten if the batch is run again.  When
``fan`` tables of one generation have gathered, the oldest of them are merged
into one of the next, so a reader opens at most ``fan`` tables a generation,
O(log batches) in all, and a row is rewritten once a generation.

Which merged tables count, and up to which batch, is written in a manifest; the
manifest of the highest number holds.  It is published in one step after a merge
is complete: a merge that dies leaves files that no manifest names, and the
batches it read still count as they are.  What a manifest has replaced is
deleted only when the next one follows, so that readers of the older one finish.
One writer at a time is assumed, as with a stream and its checkpoint.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketry.plans import files


@dataclass(frozen=True)
class Run:
    """Batches ``low`` to ``high`` as one table; generation 0 is a batch as it came."""

    generation: int
    low: int
    high: int
    path: str


class Generations:
    """The tables below ``root``; ``fan`` tables of a generation make one of the next."""

    def __init__(self, spark: SparkSession, root: str, fan: int = 4):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan

    def part(self, batch: int) -> str:
        """The folder of a batch."""
        return f"{self.root}/batch_id={batch}"

    def _versions(self) -> list[int]:
        found = (re.fullmatch(r"(\d+)\.json", name) for name in files.names(self.spark, f"{self.root}/_manifest"))
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, version: int) -> list[Run]:
        rows = json.loads(files.read_text(self.spark, f"{self.root}/_manifest/{version:08d}.json"))
        return [Run(g, low, high, f"{self.root}/_merged/{name}") for g, low, high, name in rows]

    def merged(self) -> list[Run]:
        """Merged tables, oldest batches first."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else []

    def _batches(self) -> list[int]:
        found = (re.fullmatch(r"batch_id=(\d+)", name) for name in files.names(self.spark, self.root))
        batches = sorted(int(m[1]) for m in found if m)
        return [n for n in batches if files.exists(self.spark, f"{self.part(n)}/_SUCCESS")]

    def covers(self, batch: int) -> bool:
        """Whether a batch is in a merged table already; it must not be added again."""
        return any(batch <= run.high for run in self.merged())

    def runs(self) -> list[Run]:
        """All tables that count: merged ones, then batches that no merged table covers."""
        merged = self.merged()
        upto = max((run.high for run in merged), default=-1)
        return merged + [Run(0, n, n, self.part(n)) for n in self._batches() if n > upto]

    def read(self, schema=None) -> DataFrame:
        """The rows of all tables that count; ``schema`` is needed if there may be none."""
        paths = [run.path for run in self.runs()]
        if not paths:
            if schema is None:
                raise LookupError(f"nothing has been written below {self.root}")
            return self.spark.createDataFrame([], schema)
        schema = schema or self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(schema).parquet(*paths)

    def add(self, batch: int, rows: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> bool:
        """Write a batch and merge what is due; False if the batch had been merged before."""
        if self.covers(batch):
            return False
        rows.write.mode("overwrite").parquet(self.part(batch))
        self.merge(combine)
        return True

    def merge(self, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Merge the oldest ``fan`` tables of a generation, as long as a generation has so many."""
        while True:
            runs = self.runs()
            due = {run.generation for run in runs if sum(r.generation == run.generation for r in runs) >= self.fan}
            if not due:
                return
            oldest = [run for run in runs if run.generation == min(due)][: self.fan]
            low, high = oldest[0].low, oldest[-1].high
            made = Run(oldest[0].generation + 1, low, high, f"{self.root}/_merged/{low}-{high}-{uuid.uuid4().hex}")
            schema = self.spark.read.parquet(oldest[0].path).schema
            combine(self.spark.read.schema(schema).parquet(*[run.path for run in oldest])).write.parquet(made.path)
            kept = [run for run in runs if run not in oldest and run.generation > 0]
            self._publish(sorted([*kept, made], key=lambda run: run.low))

    def _publish(self, runs: list[Run]) -> None:
        versions = self._versions()
        before = self._manifest(versions[-1]) if versions else []
        rows = [(run.generation, run.low, run.high, run.path.rsplit("/", 1)[1]) for run in runs]
        version = versions[-1] + 1 if versions else 0
        files.publish(self.spark, f"{self.root}/_manifest/{version:08d}.json", json.dumps(rows))
        # readers of the manifest before this one may still be at work; older ones are done
        upto = max((run.high for run in before), default=-1)
        for n in self._batches():
            if n <= upto:
                files.delete(self.spark, self.part(n))
        named = {run.path.rsplit("/", 1)[1] for run in [*before, *runs]}
        for name in files.names(self.spark, f"{self.root}/_merged"):
            if name not in named:
                files.delete(self.spark, f"{self.root}/_merged/{name}")
        for old in versions[:-1]:
            files.delete(self.spark, f"{self.root}/_manifest/{old:08d}.json")
