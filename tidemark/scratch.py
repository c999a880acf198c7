"""Tables between the steps of an operator: written to a folder that driver and executors share, so that a lost executor takes nothing along."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application, in local mode without the setting


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Only in local mode, where driver and executor are one process, a temporary folder may stand in for it; it is removed at exit."""
    top, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        top = _own[app]
    return f"{top.rstrip('/')}/tidemark-{app}"


def materialize(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write df, with the writer's options, and read it back: cuts the lineage."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables of this application: to be called once its results are written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
