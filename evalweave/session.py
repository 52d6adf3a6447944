"""Session helpers: table access, the shared work folder, and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and the session is a single local JVM (tests), a
    temporary folder stands in; on a cluster without the setting an error is raised, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        base = spark.conf.get(_CHECKPOINT_KEY, None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
            base = f"file://{tempfile.gettempdir()}"
        _folders[app] = f"{base.rstrip('/')}/evalweave-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has already ended; the folder's owner cleans up
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cache it survives lost executors, cuts the lineage, and later jobs read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for stages that are heavy for each row.

    Only a plan without an exchange is touched, and only if it has fewer partitions: a small table in one file would
    otherwise run in one task. A large table has its file splits and goes through unchanged, without a shuffle.
    """
    plan = df._jdf.queryExecution()
    if df.isStreaming or "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores)
