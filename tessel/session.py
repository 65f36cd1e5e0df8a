"""Session helpers that every part of the engine shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "tessel.shipped"


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if os.environ.get(_SHIPPED) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessel-")
    target = os.path.join(folder, "tessel_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tessel") / p.relative_to(root))
    sc.addPyFile(target)
    os.environ[_SHIPPED] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessel-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it from there.

    It cuts the lineage: a lost executor costs a re-read and never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
