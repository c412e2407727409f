"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Unset, a local session (as in tests) gets a folder of its own; on a
    cluster that is an error, since executors would write to disks that nobody else sees."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master or 'this cluster'} share")
        folder = "file://" + tempfile.mkdtemp(prefix="varspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{_folders[-1] if _folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of tables of ours, wherever Spark keeps it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def compiled(spark: SparkSession) -> None:
    """Row code over 8000 bytes, which HotSpot never compiles, is generated as smaller methods, where the session has Spark's default."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to a folder that is deleted at the end; nothing that reads them may be used afterwards."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        remove(spark, folder)
