"""Session helpers: tables, shared materialisation, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "lontar", cpus: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. An own one is made only where none is set and all run here:
    on a cluster every executor would write to its own disk."""
    given = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = getattr(spark.sparkContext, "_lontar_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lontar-")
        spark.sparkContext._lontar_dir = own
        atexit.register(_remove, own[len("file://") :])
    return own


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _session_dir(spark: SparkSession) -> str:
    """The session's part of the shared folder, deleted when the driver ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/lontar/{context.applicationId}"
    if getattr(context, "_lontar_cleaned", None) != path:
        context._lontar_cleaned = path
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(context._jsc.hadoopConfiguration())
        atexit.register(_forget, files, target)
    return path


def _forget(files, target) -> None:
    try:
        files.delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before; the folder then stays
        pass


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    Returns the frame and the path, so that an iteration can delete what it has superseded.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session; workers needn't share the driver's path."""
    context = spark.sparkContext
    if getattr(context, "_lontar_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lontar-ship-")  # served by the driver for the session
    atexit.register(_remove, folder)
    target = os.path.join(folder, "lontar-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    context._lontar_shipped = True
