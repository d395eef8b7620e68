"""Sending this package to the executors of a session, and the folder that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own if
    all run on this machine, as in tests; on a cluster there is none that all can see, and it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lontar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again: computed once, and of a size that Spark knows."""
    path = f"{shared_dir(rows.sparkSession)}/lontar-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files once, so that workers import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        top = tempfile.mkdtemp(prefix="lontar-")
        shutil.copytree(here, f"{top}/package/lontar", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{top}/lontar_package", "zip", f"{top}/package"))
        shutil.rmtree(f"{top}/package")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        _sent.add(context.applicationId)
    return spark
