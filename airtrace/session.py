"""Session helpers: one place for the settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F

# Folders of intermediate files of the run that is under way.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)

T = TypeVar("T")

# A side is broadcast by hint only up to this number of rows, which are counted.
BROADCAST_ROWS = 100_000


def local_session(cpus: str = "8", shuffle_partitions: int = 8, name: str = "airtrace") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.metricsEnabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir`` or by
    ``setCheckpointDir``. Only a session on one machine, as in tests, may go
    without: it gets a temporary folder. On a cluster that is an error, since
    executors would not see each other's files.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not parent:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        parent = tempfile.mkdtemp(prefix="airtrace-")
    return f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where one result feeds several later steps; the written files survive
    the loss of an executor and cut the lineage.
    """
    return _written(df, purpose, _OWNED.get())


def materialise_by(df: DataFrame, purpose: str, *by: str) -> DataFrame:
    """As ``materialise``, in a folder for each value of ``by``: a filter on it reads that folder only."""
    return _written(df, purpose, _OWNED.get(), by)


def _written(df: DataFrame, purpose: str, owned: list[str] | None, by: Sequence[str] = ()) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    if owned is not None:
        owned.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sortable_times(spark: SparkSession) -> Iterator[None]:
    """Write timestamps in a form of which Parquet keeps minima and maxima.

    The default form has none, so no filter on time could skip a row group.
    """
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def at_once(spark: SparkSession, tasks: Sequence[Callable[[], T]]) -> list[T]:
    """Run a few calls in a thread each and give their results in order; Spark shares its cores among their jobs.

    For small jobs and for calls of the file system, which one by one leave
    cores idle. The first error is raised when all have ended. Calls must not
    change settings of the session.
    """
    ends: list[Future[T]] = [Future() for _ in tasks]

    def run(task: Callable[[], T], end: Future[T]) -> None:
        try:
            end.set_result(task())
        except BaseException as e:
            end.set_exception(e)

    # they have the job group and the properties of the caller, such as those of a stream
    threads = [InheritableThread(target=run, args=pair, session=spark) for pair in zip(tasks, ends)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return [e.result() for e in ends]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]


@contextmanager
def owned_files(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove the intermediate files made inside when the work is done or has failed.

    Frames over such files are of no use afterwards. What is given writes a
    frame that is still needed, as ``materialise`` does outside.
    """
    outer = _OWNED.get()
    token = _OWNED.set([])
    try:
        yield lambda df, purpose: _written(df, purpose, outer)
    finally:
        made = _OWNED.get() or []
        _OWNED.reset(token)
        for path in made:
            remove(spark, path)


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the frame is counted to have few rows.

    The count stops at the limit. Otherwise the frame is returned as it is and
    Spark shuffles both sides.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
