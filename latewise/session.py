"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app_name: str = "latewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew splitting on and the time zone pinned to UTC."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may leave that setting out; it then gets a temporary folder, which is remembered so
    that every later call lands beside it. ``clear_work`` deletes what this process made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_base()
    _MADE.append(f"{base.rstrip('/')}/latewise-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_work(spark: SparkSession) -> None:
    """Delete the work folders of this process. Call it when no table that was read from them is needed any more."""
    while _MADE:
        drop_work(spark, _MADE.pop())


def drop_work(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as a write has ended, not when the driver happens to collect garbage.

    What was written is read back from its own files, so the shuffles before it are not needed again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_MADE: list[str] = []
_LOCAL_BASE: list[str] = []


def _local_base() -> str:
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="latewise-", dir=os.environ.get("TMPDIR", "/tmp")))
    return _LOCAL_BASE[0]
