"""Tables in the shared folder that end lineage, so that lost executors cost no more than a task."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session uses one under its warehouse, others fail."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when this process ends or drops it."""
    if not _staged:
        atexit.register(drop_staged)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        _remove(df._staged_path)


def _remove(path: str) -> None:
    spark = _staged.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged() -> None:
    """Remove all staged tables that this process wrote, as far as their sessions still run."""
    for path in list(_staged):
        _remove(path)
