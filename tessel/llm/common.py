"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import materialize, shared_dir, ship, work_path

__all__ = ["carried", "materialize", "prepare", "read", "rest", "shared_dir", "ship", "work_path"]

#: The column that carries an input's other columns through an operator, whatever their names are.
REST = "_rest"


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rest(df: DataFrame, *own: str) -> Column:
    """All columns but own as one struct, so that no name can clash with the operator's."""
    cols = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return (F.struct(*cols) if cols else F.struct(F.lit(0).alias("none"))).alias(REST)


def carried(like: DataFrame, df: DataFrame, **new: str) -> DataFrame:
    """df with the columns of like, those in REST unpacked again and those in new taken from the column named."""
    own = {c: F.col(f"`{new.get(c, c)}`") for c in like.columns if c in new}
    return df.select(*[own[c].alias(c) if c in own else F.col(f"{REST}.`{c}`").alias(c) for c in like.columns])


def chunks(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]
