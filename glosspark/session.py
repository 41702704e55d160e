"""What operators need from the session: this package on the executors, and a folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors, once per application."""
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, only a master on this machine gets one of its own: on a cluster no other machine could read it.
    """
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches short where a row holds a whole list: a batch is held whole by the JVM and by Python. A smaller value of the session's own stays."""
    own = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(own, rows) if own > 0 else rows))


def wide(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: sorted and merged, never broadcast through the driver.

    Without the hint a table of many keys that compress to less than the broadcast threshold is gathered and hashed in the driver.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of the plans that are made and run inside the block go as soon as each has run, not when the driver's collector comes to them.

    For steps that are cut, so that nothing reads the files again. What the block returns is best planned anew behind it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)
