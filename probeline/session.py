"""The Spark session with the settings that the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "probeline", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions follow the cores of a local master.

    On a cluster the master comes from spark-submit and this only adds what is
    missing there.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(os.cpu_count() if cores == "*" else cores))
        builder = builder.config("spark.driver.memory", conf.pop("spark.driver.memory", "8g")).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from the session (``spark.checkpoint.dir``).  Only where the
    session names none and the master is local, as in tests, a temporary
    folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="probeline-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.

    All paths of an application lie in a folder of its own, which goes when the
    JVM of the driver ends, even if the session was stopped before.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = f"{shared_folder(spark)}/probeline-{app}-{uuid.uuid4().hex}"
        where, files = hadoop_path(spark, folder)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _OWN[app] = folder
    return f"{_OWN[app]}/{name}-{uuid.uuid4().hex}"
