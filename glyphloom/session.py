"""Session building, lineage cutting and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "glyphloom", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the settings every operator relies on.

    UTC timestamps, adaptive execution with skew-join splitting, Arrow transfer.
    ``conf`` overrides; on a cluster only set what the cluster does not.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # checkpoint files go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | (conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="glyphloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Used where a table is read by more than one later job, or where row order
    inside partitions must stay fixed when a lost executor's tasks run again.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_path(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def working_folder(spark: SparkSession) -> str:
    """A new folder for files of this session, in the shared folder."""
    return f"{checkpoint_path(spark)}/files-{uuid.uuid4().hex}"
