"""Helpers that the operators of this subpackage share: the shared folder and staged tables in it."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_UNSET: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A local session that names none (a test on one machine) gets a new temporary folder; on a cluster that is an error,
    because executors don't see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _UNSET:
        _UNSET[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _UNSET[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Empty the folders of staged tables that no later step reads; what was made of them must be written by now."""
    for table in tables:
        files = table.inputFiles()
        if files:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(unquote(files[0].rsplit("/", 1)[0]))
