"""SparkSession factory with the settings the engine's plans assume."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def get_session(app: str = "larkspur", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Return a session with UTC times, ANSI mode and adaptive execution.

    ``master`` and ``partitions`` are only set when given, so that a cluster's own
    configuration wins when the caller leaves them out.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("LARKSPUR_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension written out as literals: Spark knows its size, so joins with it follow the broadcast threshold and shuffle nothing else."""
    fields = StructType.fromDDL(schema).fields
    values = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*values))) if values else spark.createDataFrame([], schema)


def working_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster its executors would each write to their own disk, so
    there the lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under one folder an application so that what a lost driver leaves is easy to find."""
    return f"{working_dir(spark)}/larkspur-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store it lies; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder of whichever store; none for a missing one."""
    fs, at = _place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first, then renamed over an older one."""
    fs, at = _place(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(part, at)


def get_text(spark: SparkSession, path: str) -> str:
    fs, at = _place(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
