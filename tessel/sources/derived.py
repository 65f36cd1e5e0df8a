"""Detection, ground-truth and track tables derived from the star tables by fixed arithmetic.

The star tables hold no detections, so these recipes make some with about 64 boxes an image at any scale. Each is one
SQL projection that Spark and DuckDB read alike; the DuckDB forms serve the checking statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 400

_DET = [
    "CAST(floor(l_orderkey / 16) AS BIGINT) AS image_id",
    "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS det_id",
    "CAST(l_suppkey % 3 AS INT) AS cls",
    "round(l_discount * 5 + l_tax, 4) AS conf",
    "CAST((l_partkey * 37) % 400 AS DOUBLE) AS x1",
    "CAST((l_orderkey * 17 + l_suppkey * 29) % 400 AS DOUBLE) AS y1",
    "CAST((l_partkey * 37) % 400 AS DOUBLE) + 20 + l_quantity AS x2",
    "CAST((l_orderkey * 17 + l_suppkey * 29) % 400 AS DOUBLE) + 20 + l_linenumber * 8 AS y2",
]
DET_SQL = f"SELECT DISTINCT {', '.join(_DET)} FROM lineitem"

_GT = [
    "image_id", "det_id AS gt_id", "cls", "x1 + det_id % 7 AS x1", "y1 + det_id % 7 AS y1", "x2 + det_id % 7 AS x2", "y2 + det_id % 7 AS y2",
]
GT_SQL = f"SELECT {', '.join(_GT)} FROM ({DET_SQL}) WHERE det_id % 3 = 0"

_TRACK = [
    "user_id AS track_id", "event_type AS cls", "frame",
    "CAST((user_id * 13) % 500 AS DOUBLE) + frame * (6 * (user_id % 2) - 3) AS x", "value AS y",
]
_FRAME = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame"
TRACK_SQL = f"SELECT {', '.join(_TRACK)} FROM (SELECT *, {_FRAME} FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """image_id, det_id, cls, conf and box corners, one row per line item; not distinct: repeats stay, which the caller drops."""
    d = table(spark, sf_dir, "lineitem").selectExpr(*_DET)
    return d.dropDuplicates(["det_id", "conf"]) if distinct else d


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third detection, shifted by up to six pixels."""
    return detections(spark, sf_dir).where("det_id % 3 = 0").selectExpr(*_GT)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, cls, frame and centre of each event; half of the tracks move left."""
    return table(spark, sf_dir, "events").selectExpr("*", _FRAME).selectExpr(*_TRACK)


def rings(det: DataFrame) -> DataFrame:
    """Each box as a ring of four corners, clockwise from the top left."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return det.withColumn("ring", F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")))


#: The same rings for the checking statements.
RING_SQL = f"""SELECT *, [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}] AS ring FROM ({DET_SQL})"""
