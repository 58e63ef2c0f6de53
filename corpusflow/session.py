"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the job that wrote them is done: its table is written, or its rows are with the driver.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The paths of the tables written in the innermost scratch().
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once for each application."""
    context = spark.sparkContext
    if not getattr(context, "_corpusflow_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-corpusflow-")) / "corpusflow_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        context._corpusflow_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only in local mode may that be unset: a temporary folder is made then, and kept with the application, as Spark lets nobody
    change that setting while it runs.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_corpusflow_shared", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = context._corpusflow_shared = tempfile.mkdtemp(prefix="spark-corpusflow-", dir="/tmp")
    return base.rstrip("/")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    Sets CLEAN_UP for the session unless the session has set it itself. Within scratch() the table goes at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(CLEAN_UP, None) is None:
        spark.conf.set(CLEAN_UP, "true")
    if (tables := _tables.get()) is not None:
        tables.append(path)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run within sends `rows` rows to Python at a time, or the session's fewer.

    Each task holds its batch several times, outside the heap and in Python, so that long texts by thousands take much memory.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            deleted(df.sparkSession, [files[0].rsplit("/", 1)[0]])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written within, once nothing reads them any more: their last reader belongs within too.

    Operators return frames that read such tables when their rows are asked for. So write what comes of them, or collect it,
    within; kept() holds a table back.
    """
    token = _tables.set([])
    try:
        yield
    finally:
        paths = _tables.get() or []
        _tables.reset(token)
        deleted(spark, paths)


def kept(df: DataFrame) -> DataFrame:
    """df, a table made by written(), which outlives the scratch() that it was written in."""
    paths = _tables.get()
    if paths:
        own = df.inputFiles()
        _tables.set([p for p in paths if not any(p.rsplit("/", 1)[1] in f for f in own)])
    return df
