"""Table sources and sinks, and the one place where lineage is cut."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, where: str, name: str | None = None) -> DataFrame:
    """A catalog table (`load(spark, "db.table")`) or `<where>/<name>.parquet`."""
    if name is None:
        return spark.table(where)
    return spark.read.parquet(os.path.join(where, f"{name}.parquet"))


def save_table(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    bucket_by: str | None = None,
    buckets: int = 0,
    partition_by: list[str] | None = None,
) -> str:
    """Overwrite a catalog table, schema included, and return its name.

    `fmt="delta"` works where the Delta jars are installed. A panel bucketed
    by its id is read back already partitioned, so per-id aggregates and joins
    on it need no further exchange. Its rows are dealt to their buckets first:
    every bucket is one sorted file, however many tasks the panel came from.
    """
    if bucket_by:
        buckets = buckets or int(_conf(df, "spark.sql.shuffle.partitions", "200"))
        df = df.repartition(buckets, bucket_by)
    writer = df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(target)
    return target


def save_files(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> str:
    """Overwrite a directory of files in any built-in format."""
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
    return path


def save_csv(df: DataFrame, path: str) -> str:
    """CSV directory with a header, written by all tasks in parallel."""
    return save_files(df, path, "csv", header="true")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True)


def save_report(df: DataFrame, path: str) -> str:
    """Metric table as JSON lines."""
    return save_files(df, path, "json")


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors can all reach.

    `spark.checkpoint.dir` names it; where that is unset it is a subfolder of
    the session's warehouse. On a cluster that must lie in a shared file system:
    a folder of the driver's machine is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "") or ""
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not folder and not context.master.startswith("local") and warehouse.split(":", 1)[0] in ("file", warehouse):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate")
    return context.getCheckpointDir()


class Intermediates:
    """The folders that were stored inside one scope."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def clear(self) -> None:
        """Delete the folders, through the file system that each of them names."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_scopes: list[Intermediates] = []
_lock = threading.Lock()


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[Intermediates]:
    """A scope that owns what `written` and `cut_lineage` store in it, and clears it at its end.

    Results must have been read or written elsewhere by then. Scopes may lie
    inside each other, each owns what is stored while it is the innermost; what
    is stored outside of any is left for the owner of the folder to clear.
    Threads that the scope's code starts store into it too, so scopes of
    independent threads should not overlap.
    """
    scope = Intermediates(spark)
    with _lock:
        _scopes.append(scope)
    try:
        yield scope
    finally:
        with _lock:
            _scopes.remove(scope)
        scope.clear()


def _own(path: str) -> None:
    with _lock:
        if _scopes:
            _scopes[-1].paths.append(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    cut = df.checkpoint()
    file = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _own(file.get())
    return cut


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written once as Parquet and read back.

    For results that several later steps read: they are computed once, survive
    lost executors, and each step reads only the columns it needs. `path` names
    a target to overwrite; by default each call has its own in the shared folder.
    """
    if path is None:
        path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
        _own(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _conf(df: DataFrame, key: str, default: str) -> str:
    return df.sparkSession.conf.get(key, default) or default
