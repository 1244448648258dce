"""Intermediate tables in the folder that driver and executors share.

What several passes read is computed once and written: plans stay short, and a lost executor costs a read, not the work behind it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder in spark.checkpoint.dir. Only a local session may do without that setting; its folder goes when Python ends."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    path = spark.conf.get(DIR_CONF, None)
    if path:
        return f"{path.rstrip('/')}/framewise-{app}"
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {DIR_CONF} to a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="framewise-")
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def stage(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all that this run has staged; results still to be read must be written elsewhere first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
