"""Session helpers: local session for tests, table access, durable checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE on); its Python workers find this package from any folder."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home not in (path := os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (home, path) if x)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesela")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESELA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def durable(df: DataFrame, eager: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir`` (shared by
    the executors, so losing one executor loses nothing).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def release(spark: SparkSession) -> None:
    """Frees what finished steps left: shuffle files, broadcasts and plans that nothing refers to.

    Spark drops them when the driver happens to collect its garbage, so a query of many small steps
    heaps them up on the disk and in the driver until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tesela-checkpoint-")
