"""Session helpers: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pagewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only for a local master with nothing set,
    which is the case in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(local)
    return context.getCheckpointDir().rstrip("/")


def read_spread(spark: SparkSession, path: str, min_bytes: int = 1_000_000) -> DataFrame:
    """Read a parquet table; a table that is one file is spread over all cores.

    One row group cannot be split by the scan, so a lone file would run on one
    core. Tables of many files are read as they are.
    """
    df = spark.read.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath)
    if status.isFile() and status.getLen() >= min_bytes:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


# What the current job has written; each thread and each job has a list of its own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch_job(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every intermediate written inside it.

    Write or collect the job's results inside: DataFrames still read the intermediates.
    Jobs of other threads, and a job around this one, keep theirs.
    """
    own: list[str] = []
    outer = _written.set(own)
    try:
        yield
    finally:
        _written.reset(outer)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_through(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where one intermediate feeds several branches: the upstream plan runs
    once, later readers prune columns, and a lost executor re-reads files
    instead of replaying the lineage.
    """
    path = f"{scratch_root(df.sparkSession)}/pagewatch-{label}-{uuid.uuid4().hex}"
    if (own := _written.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
