"""Queries over motion filters, assignment and tracking, from frames of all customers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.merging import shapes
from tessel.plans.registry import register
from tessel.session import ship
from tessel.sources.derived import DET_SQL, detections, table
from tessel.streaming import tracker

OBJECTS, FRAMES = 20, 30  # of a stream: streams grow with the customers


def frames(spark, sf_dir) -> DataFrame:
    """stream_id, video, frame, det_id, conf, cls and box: customers that move at their own speeds, twenty a stream.

    In every seventh frame of an object its score is low, so that only the second stage can hold it; every third object is
    hidden for four frames, and every fourth comes late. The frames after the twentieth are another video.
    """
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(FRAMES))).alias("f"))
    c = c.where("NOT (k % 3 = 0 AND f BETWEEN 10 AND 13) AND NOT (k % 4 = 1 AND f < 5)")
    x, y = (F.col("k") * 97 % 1900) + F.col("f") * (F.col("k") % 5 - 2), (F.col("k") * 61 % 1000) + F.col("f") * (F.col("k") % 3 - 1)
    box = {n: v.cast("double").alias(n) for n, v in (("x1", x), ("y1", y), ("x2", x + 30), ("y2", y + 40))}
    conf = F.when((F.col("k") + F.col("f")) % 7 == 0, 0.2).otherwise(0.8)
    return c.select(F.floor(F.col("k") / OBJECTS).alias("stream_id"), (F.col("f") > 20).cast("int").alias("video"), F.col("f").cast("long").alias("frame"), (F.col("k") * 1000 + F.col("f")).alias("det_id"), conf.alias("conf"), F.lit("c").alias("cls"), *box.values())


def tracked(spark, sf_dir) -> DataFrame:
    return tracker.track_batch(frames(spark, sf_dir))


register("r1_byte_tracker")(lambda spark, sf_dir: tracked(spark, sf_dir).select("stream_id", "frame", "det_id", "track_id", "score"))
register("r2_track_activate")(lambda spark, sf_dir: tracked(spark, sf_dir).where("event IN ('activate', 'confirm')").select("stream_id", "track_id", "frame", "event"))
register("r3_track_re_activate")(lambda spark, sf_dir: tracked(spark, sf_dir).where("event = 're_activate'").select("stream_id", "track_id", "frame", "det_id"))
register("r4_track_update")(lambda spark, sf_dir: tracked(spark, sf_dir).where("event = 'update'").groupBy("stream_id", "track_id").agg(F.count("*").alias("updates"), F.max("frame").alias("last"), F.round(F.min("score"), 4).alias("least")))
register("r16_tracker_per_stream", f"SELECT c_custkey // {OBJECTS} AS stream_id, CAST(1 AS BIGINT) AS first_id, count(*) FILTER (c_custkey % 4 <> 1 AND (c_custkey + 1) % 7 <> 0) AS at_once FROM customer GROUP BY 1 HAVING at_once > 0")(  # ids begin at 1 in each stream
    lambda spark, sf_dir: tracked(spark, sf_dir).groupBy("stream_id").agg(F.min("track_id").alias("first_id"), F.count_if((F.col("event") == "activate") & (F.col("frame") == 1)).alias("at_once"))
)
register("r18_next_id")(lambda spark, sf_dir: tracked(spark, sf_dir).groupBy("stream_id", "track_id").agg(F.min("frame").alias("since"), F.count("*").alias("boxes")))
register("r17_tracker_reset")(lambda spark, sf_dir: tracker.track_videos(frames(spark, sf_dir), persist=False).groupBy("stream_id", "video").agg(F.min("track_id").alias("first_id"), F.countDistinct("track_id").alias("tracks")))


def next_boxes(spark, sf_dir) -> DataFrame:
    """For every two frames of a stream in a row the optimal one-to-one assignment of their boxes by IoU distance."""
    ship(spark)
    f = frames(spark, sf_dir)
    both = f.withColumn("at", F.col("frame")).withColumn("side", F.lit(0)).unionByName(f.withColumn("at", F.col("frame") - 1).withColumn("side", F.lit(1)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == i].sort_values("det_id") for i in (0, 1))
        box = ["x1", "y1", "x2", "y2"]
        pairs = tracker.assign(tracker.iou_cost(a[box].to_numpy(float), b[box].to_numpy(float)), 0.8)
        return pd.DataFrame({"det_id": [int(a.det_id.iloc[i]) for i, _ in pairs], "next_id": [int(b.det_id.iloc[j]) for _, j in pairs]}, dtype="int64")

    return both.groupBy("stream_id", "at").applyInPandas(run, "det_id long, next_id long")


register("j34_linear_assignment")(next_boxes)

# Motion filters, each with its closed form.
_BOX = ("x1", "y1", "x2", "y2")
_W, _H = "(x2 - x1)", "(y2 - y1)"


def _z(r) -> np.ndarray:
    return tracker.to_xyah(np.array([r.x1, r.y1, r.x2, r.y2]))


def by_box(name: str, f, **columns: str) -> None:
    """Numbers of a detection's box by a motion filter: f(row) gives them, columns their closed forms."""
    sql = ", ".join(f"round({v}, 8) + 0.0 AS {k}" for k, v in columns.items())
    fields = ", ".join(f"{k} double" for k in columns)
    register(name, f"SELECT det_id, {sql} FROM ({DET_SQL})")(
        lambda spark, sf_dir: shapes(detections(spark, sf_dir), f, fields, *_BOX).select("det_id", *[(F.round(k, 8) + 0.0).alias(k) for k in columns])
    )


def _moved(r, tracked: bool) -> float:
    """The height after a step, a box ten pixels higher and another step, with or without its velocity."""
    z = _z(r)
    mean, cov = tracker.predict(*tracker.initiate(z))
    mean, cov = tracker.correct(mean, cov, z + [0, 0, 0, 10])
    return float(tracker.predict(mean, cov, tracked)[0][3])


by_box("r9_kalman_initiate", lambda r: (lambda s: (s[0][0], s[1][0, 0], s[1][7, 7]))(tracker.initiate(_z(r))), x="(x1 + x2) / 2", v=f"(2 * {_H} / 20) ** 2", w=f"(10 * {_H} / 160) ** 2")
by_box("r10_kalman_predict", lambda r: (lambda s: (s[1][0, 0], s[1][0, 4]))(tracker.predict(*tracker.initiate(_z(r)))), v=f"(2 * {_H} / 20) ** 2 + (10 * {_H} / 160) ** 2 + ({_H} / 20) ** 2", c=f"(10 * {_H} / 160) ** 2")
by_box("r5_multi_predict", lambda r: (_moved(r, True), _moved(r, False)), tracked=f"{_H} + 10 * (0.01640625 + 0.00390625) / 0.01890625", lost=f"{_H} + 10 * 0.01640625 / 0.01890625")
by_box(
    "r14_kalman_predict_xywh", lambda r: (lambda s: (s[1][0, 0], s[1][1, 1], s[1][2, 2], s[1][3, 3]))(tracker.predict_wh(*tracker.initiate_wh(tracker.to_xywh(np.array([r.x1, r.y1, r.x2, r.y2]))))),
    x=f"(2 * {_W} / 20) ** 2 + (10 * {_W} / 160) ** 2 + ({_W} / 20) ** 2", y=f"(2 * {_H} / 20) ** 2 + (10 * {_H} / 160) ** 2 + ({_H} / 20) ** 2",
    w=f"(2 * {_W} / 20) ** 2 + (10 * {_W} / 160) ** 2 + ({_W} / 20) ** 2", h=f"(2 * {_H} / 20) ** 2 + (10 * {_H} / 160) ** 2 + ({_H} / 20) ** 2",
)
by_box("r11_kalman_project", lambda r: (lambda s: (s[0][3], s[1][0, 0]))(tracker.observe(*tracker.initiate(_z(r)))), h=_H, v=f"(2 * {_H} / 20) ** 2 + ({_H} / 20) ** 2")
by_box("r12_kalman_update", lambda r: (lambda s: (s[0][0] - _z(r)[0], s[1][0, 0]))(tracker.correct(*tracker.initiate(_z(r)), _z(r) + [10, 0, 0, 0])), dx="10 * 4 / 5.0", v=f"(2 * {_H} / 20) ** 2 / 5")
by_box("r13_gating_distance", lambda r: (tracker.gating(*tracker.initiate(_z(r)), (_z(r) + [10, 0, 0, 0])[None])[0],), d=f"100 / ((2 * {_H} / 20) ** 2 + ({_H} / 20) ** 2)")
_WARP = np.array([[0.5, -0.25, 3.0], [0.25, 0.5, -2.0]])
by_box(
    "r6_multi_gmc", lambda r: (lambda s: (s[0][0], s[0][1], s[1][0, 0], s[1][0, 2]))(tracker.warp(*tracker.initiate(_z(r)), _WARP)),
    x="0.5 * (x1 + x2) / 2 - 0.25 * (y1 + y2) / 2 + 3", y="0.25 * (x1 + x2) / 2 + 0.5 * (y1 + y2) / 2 - 2", v=f"0.3125 * (2 * {_H} / 20) ** 2", c="0.0",
)
