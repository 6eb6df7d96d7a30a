"""Session defaults and staged tables.

Staged tables replace cached or locally checkpointed intermediates: they are Parquet
files in the shared folder named by ``spark.checkpoint.dir``, so a lost executor costs a
re-read, never a recomputation of the whole lineage or a failed job.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_own_root: list[str] = []
_shipped: set[str] = set()
_scratch: dict[str, list[str]] = {}
_forget: list[Callable[[SparkSession], None]] = []


def session(app: str = "corvane", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session with the settings used by the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORVANE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's ``spark.checkpoint.dir`` where it is set.

    Only where the setting is missing and the master is this machine (as in tests) a folder of
    this process is created, and removed at exit; on a cluster, where executors would write to
    their own disks, a missing setting is an error.
    """
    root = spark.conf.get(_CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{_CHECKPOINT} must name a folder that all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="corvane-"))
            atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
        root = _own_root[0]
    return root.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/corvane/{spark.sparkContext.applicationId}"


def on_release(forget: Callable[[SparkSession], None]) -> None:
    """Have ``forget`` called before staged tables go, to drop what reads them."""
    _forget.append(forget)


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application; nothing built on them can be read afterwards."""
    for forget in _forget:
        forget(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over the files.

    What isn't to ``keep`` belongs to one query and goes with the next ``sweep``.
    """
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}" if keep else scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes with the next ``sweep``."""
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete the intermediates of all queries so far, whose results must have been read; indexes stay. Gives their bytes."""
    freed = 0
    for name in _scratch.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            freed += fs.getContentSummary(path).getLength()
            fs.delete(path, True)
    return freed


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    Functions travel by reference, so workers must be able to import the package wherever the
    driver found it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corvane-package-")
    target = Path(folder, "corvane.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(context.applicationId)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a table's files are: names, sizes and times of change, by the file system's listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()
