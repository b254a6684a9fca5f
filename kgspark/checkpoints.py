"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many short rows is sent to every executor; a larger one is joined by a shuffle.
SMALL_ROWS = 50_000
#: For each open block, the folders that it has saved and that go when it is done.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets its own; a cluster must name one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession, broadcast: bool = True) -> Iterator[None]:
    """Within, what saved() writes lasts until the end of the block; what it is told to keep goes with the block around.

    Without broadcast no join broadcasts a side but those of counted rows, see small(): the size of a
    written file says little about its rows in memory.
    """
    paths: list[str] = []
    mark, name = _scratch.set((*_scratch.get(), paths)), "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(name)
    if not broadcast:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        _scratch.reset(mark)
        spark.conf.set(name, limit)
        for path in paths:
            delete(spark, path)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in the shared one, which goes at the end of the block if there is one."""
    path, blocks = f"{shared_dir(spark)}/kgspark-{name}-{uuid.uuid4().hex}", _scratch.get()
    if len(blocks) > keep:
        blocks[-2 if keep else -1].append(path)
    return path


def saved(df: DataFrame, name: str, keep: bool = False, **measures: Column) -> DataFrame:
    """df, written and read back: a loop's plan stays short, and a lost executor costs no earlier round.

    Its rows are counted as they are written, and so are the measures, which are aggregates: see counted().
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in measures.items())).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at, out._seen = path, seen.get
    return out


def counted(table: DataFrame, measure: str = "rows") -> int:
    """What saved() has counted of a table."""
    return table._seen[measure] or 0


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The saved table, for one side of a join: broadcast if its rows are few enough, which are counted, else for a merge join.

    Were that left to Spark, it would go by the size of the files, which are compressed: a table of millions of
    short rows could be sent to the driver.
    """
    return F.broadcast(table) if counted(table) <= rows else table.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that saved() wrote and nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := getattr(table, "_saved_at", None):
            delete(table.sparkSession, path)
