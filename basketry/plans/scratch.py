"""Intermediate tables of iterative jobs.

Steps that are read several times are written as Parquet in the shared folder
named by ``spark.checkpoint.dir``.  A lost executor then costs a re-read, not a
replay of all earlier steps, and the files tell the optimizer their true size,
so whether a side is broadcast is decided on measured bytes.

What is written to reach a table is not kept: shuffle files go with the write
that made them, and tables written within ``passing_tables`` at its end.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: deletes the shuffle files of a write at its end; else they stay until the driver collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: compressed bytes of an exchange that go to one task, and rows, where a task sorts or hashes all that it gets
SHARE_BYTES, SHARE_ROWS = 16 << 20, 1 << 20

#: scratch tables written in the innermost ``passing_tables``
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing has used yet."""
    return f"{scratch_root(spark)}/basketry/{label}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def small_shares(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """What is written within is read and dealt in shares of SHARE_BYTES and, of ``rows`` in all, SHARE_ROWS.

    A task's sorts and hash tables are then bounded at any size of the input;
    smaller shares and more partitions that the session sets stay.  Files get
    SHARE_ROWS rows at most, as a reader cannot cut a row group.
    """
    advised, split = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    partitions = "spark.sql.shuffle.partitions"
    values = {key: str(min(_n_bytes(spark.conf.get(key)), SHARE_BYTES)) for key in (advised, split)}
    values[partitions] = str(max(int(spark.conf.get(partitions)), -(-rows // SHARE_ROWS)))
    values["spark.sql.files.maxRecordsPerFile"] = str(SHARE_ROWS)
    with _settings(spark, values):
        yield


def _n_bytes(setting: str) -> int:
    size, unit = re.match(r"(\d+)\s*([kmgtp]?)", setting.lower()).groups()
    return int(size) << 10 * " kmgtp".index(unit or " ")


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to a fresh scratch table and return that table; a ``lasting`` one outlives ``passing_tables``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if not lasting and _passing.get() is not None:
        _passing.get().append(path)
    with _settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """Like ``materialize``, with aggregates over the rows taken while writing."""
    seen = Observation()
    table = materialize(df.observe(seen, *metrics), label)
    return table, seen.get


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within are deleted at the end, but for ``lasting`` ones.

    For steps that have run when the block ends: no later step may read such a table.
    """
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no further step reads."""
    if not path.startswith(f"{scratch_root(spark)}/basketry/"):
        raise ValueError(f"{path} is not a scratch table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
