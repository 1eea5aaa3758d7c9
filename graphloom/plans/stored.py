"""Derived tables that many queries read, built once for a Spark application.

The graph's edges cost far more to derive than to read, so they are an index:
the first query that needs one writes it to the shared folder, and the others
read it.  A table is named by the application and the folder of its sources;
sources are taken not to change while the application runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

_tables: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of ``folder``, written by ``build`` where it is not there yet."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key in _tables:
        path, schema = _tables[key]
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(schema).parquet(path)
    out = materialize(build(), f"index-{name}")
    _tables[key] = (out._graphloom_path, out.schema)
    return out
