"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "crivo", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps, adaptive execution and skew-join handling on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # HotSpot leaves methods over 8000 bytes interpreted; wide projections then run faster as
        # split expressions than as one fused method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, for functions that run in Python there."""
    if getattr(spark.sparkContext, "_crivo_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="crivo-package-")  # the driver serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(
        f"{root}/crivo", f"{folder}/code/crivo", ignore=shutil.ignore_patterns("__pycache__")
    )
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/crivo", "zip", f"{folder}/code"))
    spark.sparkContext._crivo_shipped = True


def _shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder the cluster names, or a temporary one in local sessions that name none.

    A machine-local folder would be lost with its machine, so on a cluster the missing setting is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix=prefix)
    return folder.rstrip("/")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Points checkpoints at the shared folder, unless the session already does."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared_folder(spark, "crivo-checkpoint-"))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder; survives the loss of executors."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder once and reads them back: lineage ends here.

    The files outlive executors and tell the planner their size; the owner of the shared folder
    removes them with the run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files behind a table that `stored` returned, when no plan reads them any more."""
    spark = df.sparkSession
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder name under the shared folder."""
    return f"{_shared_folder(spark, 'crivo-scratch-')}/{name}-{uuid.uuid4().hex}"
