"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

Iterative operators cut their lineage here.  A staged table is an ordinary
Parquet table, so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder: what spark.checkpoint.dir or the context's checkpoint folder names.

    Where neither is set, a cluster's tasks share the warehouse, and a local
    master gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            folder = named.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
            _made.append((spark, folder))
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The shuffles behind ``df`` are given up once the table is written.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
