"""Cutting lineage through storage that all executors share.

The folder is the one the cluster names in `spark.checkpoint.dir`. Only a local session (tests, a laptop) without that setting
gets a folder of its own; elsewhere a missing setting is an error. Both forms survive the loss of an executor. The tables
of an application lie in one folder, which is deleted when the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _sweep(spark: SparkSession, folder: str) -> None:
    """Deletes the tables of this application, if it can still be reached."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the application is gone
        return


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the checkpoint folder; Spark removes the files when the frame is collected."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """`df` computed once and written as a compressed columnar table below the checkpoint folder."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}"
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
