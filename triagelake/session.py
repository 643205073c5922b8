"""Session helpers: sessions for one machine, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Owners of written tables, innermost last: the paths to delete when each is done.
_owners: list[list[str]] = []
_kept: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", name: str = "triagelake", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    Scans are cut into splits of 1 MB, so small test tables keep all cores busy.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only where the driver is the one executor, as in tests, may the setting be missing;
    a folder is then made. Any cluster, one on this machine included, has to name it.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="triagelake-")
    context.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", by: Sequence[str] = ()) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    A written table survives the loss of executors, and what produced it is never run
    again, which matters when a step calls an outside model. The table belongs to the
    innermost ``temporary`` block, or else to the session: it goes when its owner ends.
    Columns ``by`` are told by folders, so a filter on them reads no other rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _owners:
        _owners[-1].append(path)
    else:
        _kept.append((spark, path))
    df.write.parquet(path, partitionBy=list(by) or None)
    written = spark.read.schema(df.schema).parquet(path)
    return written.select(*[F.col(f"`{c}`") for c in df.columns]) if by else written


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, what a step has shuffled is deleted as soon as its rows are written."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``cut`` writes inside.

    For work whose result has been written or counted by then; a table that is still to
    be read must be written outside.
    """
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.remove(paths)
        for path in paths:
            delete(spark, path)


@contextlib.contextmanager
def outside() -> Iterator[None]:
    """Inside, what ``cut`` writes outlives the innermost ``temporary`` block."""
    inner = _owners.pop()
    try:
        yield
    finally:
        _owners.append(inner)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_kept() -> None:
    """What belongs to a session goes with the program, if its session is still there."""
    for spark, path in _kept:
        with contextlib.suppress(Exception):
            delete(spark, path)
