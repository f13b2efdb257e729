"""Session settings: a sized default session, and the shared folder for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30, "t": 2**40, "tb": 2**40}


def local_session(cores: int | str = 8, name: str = "veilframe", settings: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the local benchmark. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Generated methods beyond 8000 bytes are never compiled by the JVM; smaller units are faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; there one temporary folder per application
    stands in. On a cluster a missing setting is an error, because a machine-local folder would
    lose data with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="veilframe-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


# Scopes of the running thread or task, outermost first, as (application, folder).
_scopes: ContextVar[tuple[tuple[str, str], ...]] = ContextVar("scratch scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope for written intermediate tables, which hold raw identifiers: its folder goes when the scope ends, by an error too.

    Frames made inside read from it, so use or write them inside. Without a scope, intermediate tables stay in the
    shared folder, under the application's id, until someone clears it. A scope belongs to the thread that opened it.
    """
    application = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/{application}/scope-{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), (application, folder)))
    try:
        yield folder
    finally:
        _scopes.reset(token)
        path, files = file_system(spark, folder)
        files.delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this thread's innermost scope, else below the shared folder, grouped by application."""
    application = spark.sparkContext.applicationId
    own = [folder for of, folder in _scopes.get() if of == application]
    folder = own[-1] if own else f"{shared_folder(spark)}/{application}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage cut, sizes known exactly."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def file_system(spark: SparkSession, name: str):
    """A path and its file system, as Hadoop knows them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_bytes(spark: SparkSession, name: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    path, files = file_system(spark, name)
    return files.getContentSummary(path).getLength()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder in one step. False, and nothing done, if the target exists already."""
    path, files = file_system(spark, target)
    files.mkdirs(path.getParent())
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(file_system(spark, source)[0], path, options)  # without options an existing target makes it fail
    except Exception:
        if files.exists(path):
            return False
        raise
    return True


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes that the session allows on a broadcast side; not positive when switched off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text).groups()
    return int(number) * _UNITS[unit]
