"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # decode() must accept every charset label the JVM knows (GBK, Big5, Shift_JIS, ...)
    "spark.sql.legacy.javaCharsets": "true",
    # malformed bytes become U+FFFD instead of failing the row
    "spark.sql.legacy.codingErrorAction": "true",
    # duplicate JSON keys: the last one wins instead of failing the row
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shredded pages are wide rows, so Arrow batches are kept small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

# Only settable when the session is built: call-site capture costs more than the expressions.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **BUILD_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset a folder of our own is set, in local mode only: on a
    cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver-side list as a local relation.

    Its size is then known to the optimizer, which broadcasts it below the broadcast threshold and
    joins by shuffle above; a plain list of rows would count as unbounded.
    """
    return spark.createDataFrame(spark.createDataFrame(rows, schema).toArrow())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once below the shared folder and reads it back.

    For tables that several rounds of a job join with: they are computed once, and later stages start
    from files that survive lost executors. The shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_by(df: DataFrame, column: str, path: str, values: int) -> None:
    """Writes a folder for each value of ``column``, which has a few ``values``: a task keeps a file open for each
    of them instead of sorting its rows."""
    spark = df.sparkSession
    before = spark.conf.get(WRITERS)
    # the last file Spark allows makes it sort the rest
    spark.conf.set(WRITERS, str(values + 1))
    try:
        df.write.partitionBy(column).parquet(path)
    finally:
        spark.conf.set(WRITERS, before)
