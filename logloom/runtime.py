"""Session helpers shared by all operators.

The helpers read the session they are given, so several sessions can live side by side;
the only setting they make is a folder for intermediate tables where none is set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, app: str = "logloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per context.

    Workers import operator kernels by name; on a cluster they have no checkout of
    the repository, so the package travels as a zip through ``addPyFile``.
    """
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="logloom-ship-"))
    archive = folder / "logloom_pkg.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, Path(_PACKAGE.name) / file.relative_to(_PACKAGE))
    context.addPyFile(str(archive))
    context._logloom_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (local tests) is a folder of our own
    chosen and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = tempfile.mkdtemp(prefix="logloom-shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; the file system is asked to remove it when the
    driver ends."""
    path = f"{shared_folder(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what exists can be marked
    files.deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably.

    A lost executor loses nothing of it, and later readers prune columns.
    """
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a Parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
