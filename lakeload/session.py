"""Session settings and the folder shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_BASE: str | None = None


def build_session(app: str = "lakeload", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    The cluster names a folder that every executor can reach. Only a local
    session without that setting falls back to a temporary folder.
    """
    global _LOCAL_BASE
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _LOCAL_BASE is None:
            _LOCAL_BASE = tempfile.mkdtemp(prefix="lakeload-")
        base = _LOCAL_BASE
    return f"{base.rstrip('/')}/lakeload/{label}-{uuid.uuid4().hex[:12]}"


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete intermediate rows from the shared folder once a load is done."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
