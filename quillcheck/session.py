"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays below this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: What a Python worker keeps between its tasks.
KEPT = 4
_built: dict[str, object] = {}
T = TypeVar("T")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row stages at least one partition per core.

    For scans: large inputs already have more splits than cores and pass through
    without a shuffle; only an input of very few splits is redistributed.  A plan
    with a shuffle of its own would be run to count its partitions: see ``shuffled``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """Spread the rows of an aggregate before CPU-heavy work: as many partitions as shuffles have, not joined together for being small in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def once_per_worker(key: str, build: Callable[[], T]) -> T:
    """What ``build`` gives, made once in each Python worker and not once in each task."""
    if key not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[key] = build()
    return _built[key]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.  On one machine a private one where none is set; on a cluster that is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillcheck-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table by writing it, compressed and by columns, to the shared checkpoint folder; deleted when the session ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, form: str, column: str = "id") -> DataFrame:
    """``rows`` with a number in global order, from 1, written by ``form`` into ``column``.

    Rows are divided by ranges of the order and written; a row's number is its
    place in its range behind the sizes of the ranges before, one number each.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = {r[0]: r[1] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(b).cast("long") for b in before or [0]]), F.spark_partition_id())
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(column, F.format_string(form, offset + place + 1))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is within the limit; otherwise leave the join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must stay below ``limit`` rows; a larger one is an error, never cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} exceeds its documented bound of {limit} rows")
    return rows
