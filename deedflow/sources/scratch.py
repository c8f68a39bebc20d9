"""Tables written in between, for results that several branches of a plan read."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a local session without one gets its own, a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-deedflow-")
        found = _OWN[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, however many branches read it."""
    path = f"{shared_dir(df.sparkSession)}/deedflow/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that tasks can import it on any cluster."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        into = tempfile.mkdtemp(prefix="deedflow-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/deedflow_tasks", "zip", package.parent, package.name))
        _SHIPPED.add(app)
