"""Session settings the jobs rely on, and the one place where lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans.  Everything else (executors, memory,
# shuffle partitions) belongs to whoever submits the job.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run and whatever their folder is."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="ledgerlens-")) / package.name), "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only when that
    is unset (a local test session) a temporary folder is used instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


_STAGING = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and continue from there.

    Used where several later branches read the same shuffled result: a lost executor costs a
    re-read and not a re-run of everything upstream, a reader takes only the columns it asks
    for, and the plan above knows the size.  Inside ``staging`` the table goes when that ends.
    """
    return _written(df, getattr(_STAGING, "folder", None) or ensure_checkpoint_dir(df.sparkSession))


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    """The same for tables that do not depend on each other: their jobs run side by side."""
    folder = getattr(_STAGING, "folder", None) or ensure_checkpoint_dir(dfs[0].sparkSession)
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(lambda df: _written(df, folder), dfs))


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # digests and ids, which Spark's default leaves at their length
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for the tables that this thread materializes; removed at the end."""
    before = getattr(_STAGING, "folder", None)
    folder = _STAGING.folder = f"{ensure_checkpoint_dir(spark)}/staging-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        _STAGING.folder = before
        remove(spark, folder)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in ``folder``; none if there is no such folder."""
    place, fs = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, None if there is none."""
    place, fs = _file_system(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    place, fs = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"could not write {path}")


def share(df: DataFrame) -> DataFrame:
    """Keep ``df`` on executor disk for the branches of one batch; recomputed if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
