"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ONLY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where the session names none and runs in one JVM a temporary folder of this process stands in, and goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL_ONLY:
        made = tempfile.mkdtemp(prefix="boxquery-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_ONLY["dir"] = f"file://{made}"
    return _LOCAL_ONLY["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def parked(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: what comes after it doesn't run it again, nor does the loss of an executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """A small file of this content, in whatever store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path
