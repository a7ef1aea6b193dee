"""Cutting lineage in the folder that the whole cluster shares.

Jobs with several passes keep intermediate results in reliable checkpoints, so a
lost executor never makes earlier passes unreadable.  The folder comes from
``spark.checkpoint.dir``; only where nothing is configured and all runs in one process (tests,
a laptop) does the library pick a folder of its own.
"""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets one only where none is configured, in local mode."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="patternlake-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*done: DataFrame) -> None:
    """Delete the checkpoints of results of ``cut`` that nothing reads any more.

    Whatever was made of them must have been cut itself.  The driver's garbage is collected as
    well: Spark deletes the shuffle files of finished passes only then, and long jobs would
    otherwise keep all of them until the end.
    """
    for df in done:
        spark = df.sparkSession
        place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if place.isDefined():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if done:
        done[0].sparkSession.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most_rows`` rows at most, else as it is.

    Call it on something cheap to count, such as a checkpoint.  Beyond the bound the join
    that uses ``df`` shuffles both sides and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The place of ``data`` in the shared folder; it is written once, under ``name``, which must tell its contents."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark), name)
    files = target.getFileSystem(conf)
    if not files.exists(target):
        part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{name}.{spark.sparkContext.applicationId}")
        out = files.create(part, True)
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
        out.close()
        if not files.rename(part, target):  # another session was first
            files.delete(part, False)
    return target.toString()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Have the Python workers of every machine import this package, wherever the driver has it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(package.rglob("*.py")):  # fixed times: equal sources, equal bytes
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(package.parent))), path.read_bytes())
    data = packed.getvalue()
    name = f"{package.name}-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    spark.sparkContext.addPyFile(shared_file(spark, name, data))
    _SHIPPED.add(spark.sparkContext.applicationId)
