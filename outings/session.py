"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


PACKAGE_ZIP = "outings_package.zip"


def local_session(cpus: int | str = 8, app: str = "outings", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in ``mapInPandas``, ``mapInArrow`` or ``cogroup`` are imported there by name,
    so the workers need the code even when the application starts from another folder.
    """
    context = spark.sparkContext
    if any(name.rpartition("/")[2] == PACKAGE_ZIP for name in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), PACKAGE_ZIP)  # goes with the application
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path(root.name, source.relative_to(root)))
    context.addPyFile(str(path))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, benchmark) gets a temporary folder for the
    application; on a cluster this is an error, as executors would write to their own disks.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a shared folder")
        base = tempfile.mkdtemp(prefix="outings-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what reads it twice computes it once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
