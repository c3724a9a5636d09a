"""What every Python-backed operator needs from the session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(suffix=".zip", prefix=f"{root.name}-")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; where it names none (tests, one machine) a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tincture-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and forget how it came about, so that loops keep short plans."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A frame written to the shared folder by columns and read back: smaller than ``cut`` and read only as far as it is asked for, but neither the
    order of rows nor their partitions are kept."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many rows a rank is taken in one task; beyond it by range partitions.
ONE_TASK_ROWS = 200_000


def ranked(df: DataFrame, order: list[str], name: str, start: int = 0, rows: int | None = None) -> DataFrame:
    """Number rows densely from ``start`` by ``order``.

    ``rows``: how many there are, if known. Few are numbered by a window; otherwise they are range-partitioned, sorted and
    numbered within partitions, with each partition's offset from the partitions' counts, so that no task sees all rows.
    """
    if rows is not None and rows <= ONE_TASK_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name, start)


def numbered(placed: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Number rows densely from ``start`` in the order in which they lie, by partition and place in it, and write them to the shared folder."""
    at = f"_{name}_at"  # no caller's column, nor the number's own
    placed = stored(placed.withColumn(at, F.monotonically_increasing_id()))
    counts = dict(placed.groupBy(F.shiftright(at, 33).alias("p")).count().collect())
    offsets, total = [], start
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    if not offsets:
        return placed.drop(at).withColumn(name, F.lit(start).cast("long"))
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.shiftright(at, 33).cast("int")) + within).drop(at)


#: About so many rows meet in a task where each takes memory until the task ends.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int | None, by: str) -> DataFrame:
    """The frame dealt by a column into so many tasks as ``rows`` (of it, or of what it is joined to) need. Partitions whose number was asked for are not
    merged, as Spark merges others by their compressed size. Few or unknown rows are left to Spark."""
    return df if rows is None or rows <= TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), by)


def ranged(df: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """The frame dealt by ranges of columns, into so many tasks as ``rows`` of it need; few or unknown rows are left to Spark."""
    return df.repartitionByRange(*by) if rows is None or rows <= TASK_ROWS else df.repartitionByRange(-(-rows // TASK_ROWS), *by)


def meet(df: DataFrame, rows: int | None, of: DataFrame, by: str) -> DataFrame:
    """Join of a frame of about ``rows`` rows with the fewer ones of ``of`` by a column of both. Many rows meet in bounded tasks, which hash their part
    of ``of`` and sort nothing; few or unknown ones are left to Spark."""
    if rows is None or rows <= TASK_ROWS:
        return df.join(of, by)
    return spread(df, rows, by).join(spread(of, rows, by).hint("shuffle_hash"), by)


#: A table of up to so many classes goes to every task, so that the rows they are joined to need not move.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """The frame, marked to be broadcast if its ``rows`` are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df
