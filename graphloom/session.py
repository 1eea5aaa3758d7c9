"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    if top.parent.is_dir():  # not itself running from a zip
        with tempfile.NamedTemporaryFile(suffix=".zip", prefix="graphloom-", delete=False) as f:
            with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(top.rglob("*.py")):
                    z.write(p, p.relative_to(top.parent).as_posix())
        context.addPyFile(f.name)
    context._graphloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not here:
        here = spark.conf.get("spark.graphloom.scratch", None)
        if not here:
            here = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.conf.set("spark.graphloom.scratch", here)
    return here.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks of later steps.
    Spark deletes the write's shuffle files when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
