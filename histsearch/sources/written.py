"""Tables written on the way: lineage ends at them, and they go when they are spent."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_run_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one of
    our own only where that is unset and everything runs in one local JVM."""
    global _own_root
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="histsearch-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{os.path.abspath(_own_root)}"


def _store(spark: SparkSession, path: str):
    """(file system, path) of *path*, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run_folder(spark: SparkSession) -> str:
    """The application's own folder for written tables; it goes when the application ends."""
    app, root = spark.sparkContext.applicationId, checkpoint_root(spark)
    if app not in _run_folders:
        path = f"{root}/histsearch-{app}"
        store, at = _store(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _run_folders[app] = path
    return _run_folders[app]


#: Spark removes a query's shuffle files at its end: a table once written needs them no more.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Write *df* as Parquet under the shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation of what came before. Tables
    that were *spent* on it, and are read by nothing else, are removed then."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    discard(*spent)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_at", None)
        if path:
            store, at = _store(table.sparkSession, path)
            store.delete(at, True)
