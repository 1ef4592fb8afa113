"""Working tables in the shared folder.

Lineage is cut by writing a parquet table under the session's checkpoint folder,
never by keeping blocks on executors: a lost executor costs a re-read, not a
recomputation, and a table re-read never moves the partition boundaries that
dense ids depend on.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder set by ``setCheckpointDir``, or else the session's setting.

    Spark makes a folder of its own below the setting, which is no explicit
    choice. Only a session inside one process may fall back to /tmp.
    """
    context = spark.sparkContext
    plain = lambda path: re.sub("^file:/+", "/", path or "").rstrip("/")
    configured, chosen = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if chosen and not (configured and plain(chosen).startswith(plain(configured))):
        return chosen.rstrip("/")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local($|\[)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="topicloom-")
    context.setCheckpointDir(root)
    return root


_open: ContextVar[Workspace | None] = ContextVar("open_workspace", default=None)


class Workspace:
    """Named working tables of one job, under one fresh folder.

    Used as a context manager, it also takes the tables that operators save for
    themselves and deletes them all on exit; results must have been written
    elsewhere by then.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{root or shared_root(spark)}/work-{uuid.uuid4().hex}"
        self._serial = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._named: dict[str, str] = {}

    def __enter__(self) -> Workspace:
        self._token = _open.set(self)
        return self

    def __exit__(self, *exc) -> None:
        _open.reset(self._token)
        for name in self._named.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.path)

    def new_path(self, label: str) -> str:
        self._serial += 1
        return f"{self.path}/{self._serial:05d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        path = self.new_path(label)
        df.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def save_bucketed(self, df: DataFrame, label: str, keys: list[str], buckets: int, placed: bool = False) -> DataFrame:
        """Write ``df`` once in ``buckets`` by ``keys``; joins and groups by these keys read it without an exchange.

        The buckets are known to the session's catalog only; :meth:`drop` takes the
        table out again. ``placed`` says that each task holds whole buckets already.
        """
        path, name = self.new_path(label), f"topicloom_{uuid.uuid4().hex}"
        rows = df if placed else df.repartition(buckets, *keys)
        rows.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self._paths[id(table)] = (table, path)
        self._named[path] = name
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table this workspace saved (superseded sweeps would pile up)."""
        _, path = self._paths.pop(id(table))
        if path in self._named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named.pop(path)}")
        remove_path(self.spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Save ``df`` in the open workspace, or in one of its own."""
    return (_open.get() or Workspace(df.sparkSession)).save(df, label)


SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a small input over all cores before heavy per-row work.

    A table of one or two files would otherwise be tokenised by one or two
    tasks. Only inputs under ``SPREAD_BYTES`` per core are moved, so a large
    table, which has splits enough, is never shuffled for this.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPREAD_BYTES else df


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def touch(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.create(target, True).close()


def remove_path(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)
