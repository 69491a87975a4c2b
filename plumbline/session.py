"""Session set-up and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def _own_folder() -> str:
    """A folder for one machine's intermediate tables, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="spark-plumbline-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def build_session(master: str, app: str = "plumbline", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster the submitter's settings are used instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_CONF, _own_folder())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there the driver and
    the executors are the same process.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = _own_folder()
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan read one reduced result: they share the
    written table, and a lost executor re-reads it instead of re-running its inputs.
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
