"""Session helpers: a local session for tests, table loading and durable lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int = 4, memory: str = "6g", **extra: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terraweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()
_SCRATCH: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Make the package importable for Python workers, once per application.

    Where PYTHONPATH names the folder of the package nothing is done; else the
    package is sent along as a zip file.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    application = spark.sparkContext.applicationId
    if root in paths or application in _SHIPPED:
        return
    _SHIPPED.add(application)
    folder = tempfile.mkdtemp(prefix="terraweave-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "terraweave.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for at, _, files in os.walk(os.path.join(root, "terraweave")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local tests) a temporary folder of this machine is chosen.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"terraweave-checkpoints-{os.getuid()}")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame, *partition_by: str) -> str:
    """Write ``df`` as a Parquet table in the shared folder and return its path.

    The table is removed when the driver's process ends.
    """
    path = scratch_path(df.sparkSession, "table")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(release)
    _SCRATCH.append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder.

    The files survive the loss of any executor, are compressed and read column
    by column.  In contrast to a checkpoint the new frame carries neither the
    constraints nor the partitionings of the plan it cuts; in a loop these
    multiply from round to round until planning takes longer than running.
    """
    path = written(df)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def durable_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``durable`` with aggregates of the rows taken while they are written, so no second job reads them.

    A task that is repeated after the loss of an executor may be counted
    twice; what is zero stays zero.
    """
    seen = Observation()
    out = durable(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, seen.get


def release() -> None:
    """Remove all tables that were stored so far; for drivers that live long, when the results have been read."""
    for spark, path in _SCRATCH:
        _remove(spark, path)
    _SCRATCH.clear()


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames that nothing will read again."""
    for frame in frames:
        if path := getattr(frame, "_table_path", None):
            _remove(frame.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
