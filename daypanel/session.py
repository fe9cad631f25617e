"""Session defaults shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "daypanel", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    Only settings the operators rely on are made here; memory, executors and
    `spark.checkpoint.dir` belong to the cluster.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to all Python workers, where it need not be installed then.

    Local ones need it too: they don't inherit what the driver added to its path.
    The archive lies in the driver's own folder of files that Spark hands out.
    """
    if getattr(spark.sparkContext, "_daypanel_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(SparkFiles.getRootDirectory(), root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._daypanel_shipped = True
