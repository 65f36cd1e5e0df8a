"""Queries over track analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import tracks as K
from tessel.plans.registry import register
from tessel.sources.derived import TRACK_SQL, table, tracks

LINE = (300.0, 0.0, 300.0, 400.0)
ZONE = [(100.0, 20.0), (400.0, 40.0), (350.0, 260.0), (120.0, 220.0)]
REGIONS = {"left": [(0.0, 0.0), (250.0, 0.0), (250.0, 300.0), (0.0, 300.0)], "right": ZONE}
SLOTS = {"a": (0, 0, 120, 80), "b": (121, 0, 240, 80), "c": (241, 10, 400, 90)}
_T = f"WITH t AS ({TRACK_SQL})"
_LAG = f"{_T}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))"


def _in(p) -> str:
    hits = " + ".join(f"CAST(({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} AS INT)" for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]) if ay != by)
    return f"(({hits}) % 2 = 1)"


_side = lambda a, b, c, d, e, f: f"(({c} - {a}) * ({f} - {b}) - ({d} - {b}) * ({e} - {a}))"
_L = [str(v) for v in LINE]
_D = (_side("px", "py", "x", "y", _L[0], _L[1]), _side("px", "py", "x", "y", _L[2], _L[3]), _side(*_L, "px", "py"), _side(*_L, "x", "y"))
_CROSS = f"{_D[0]} * {_D[1]} <= 0 AND {_D[2]} * {_D[3]} <= 0 AND ({_D[0]} <> 0 OR {_D[1]} <> 0 OR {_D[2]} <> 0 OR {_D[3]} <> 0)"


def _query(name: str, sql: str, run) -> None:
    register(name, sql)(lambda spark, sf_dir: run(tracks(spark, sf_dir)))


_query("w5_store_tracking_history", f"{_T}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) AS r FROM t) SELECT track_id, count(*) AS n, round(sum(x), 4) AS sx, min(frame) AS first FROM r WHERE r <= 30 GROUP BY track_id",
       lambda t: K.history(t).select("track_id", F.size("path").cast("long").alias("n"), F.round(F.aggregate("path", F.lit(0.0), lambda a, p: a + p["x"]), 4).alias("sx"), F.col("path")[0]["frame"].alias("first")))
_query("w6_count_objects_line", f"{_LAG}, c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k FROM s WHERE px IS NOT NULL AND {_CROSS}) SELECT track_id, frame, CASE WHEN x > px THEN 'in' ELSE 'out' END AS direction, cls FROM c WHERE k = 1",
       lambda t: K.line_counts(t, LINE))
_query("w6_count_objects_zone", f"{_LAG}, c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k FROM s WHERE px IS NOT NULL AND {_in(ZONE)}) SELECT track_id, frame, CASE WHEN x > px THEN 'in' ELSE 'out' END AS direction FROM c WHERE k = 1",
       lambda t: K.zone_counts(t, ZONE))
_query("w7_speed_estimator", f"{_LAG}, a AS (SELECT * FROM s WHERE r = 1), b AS (SELECT * FROM s WHERE r = 5) SELECT track_id, CAST(least(trunc(sqrt((b.x - a.x)**2 + (b.y - a.y)**2) * 0.05::DOUBLE / ((b.frame - a.frame) / 30.0::DOUBLE) * 3.6::DOUBLE), 120) AS INT) AS kmh FROM a JOIN b USING (track_id)",
       K.speeds)
_ANGLE = "(x * 7 + y * 3) % 180"
_query("w8_ai_gym", f"{_T}, a AS (SELECT track_id, frame, {_ANGLE} AS angle FROM t), b AS (SELECT *, last_value(CASE WHEN angle < 60 THEN 'down' WHEN angle > 120 THEN 'up' END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame) AS stage FROM a), c AS (SELECT *, lag(stage) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM b) SELECT track_id, frame, stage, sum(CASE WHEN stage = 'down' AND before = 'up' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame)::BIGINT AS reps FROM c",
       lambda t: K.repetitions(t.selectExpr("track_id", "frame", f"{_ANGLE} AS angle"), 120, 60).select("track_id", "frame", "stage", "reps"))
_query("w9_estimate_pose_angle", f"{_T}, a AS (SELECT track_id, frame, abs(degrees(atan2(y - 50, x - 100) - atan2(20 - 50, 30 - 100))) AS d FROM t) SELECT track_id, frame, round(CASE WHEN d > 180 THEN 360 - d ELSE d END, 5) AS angle FROM a",
       lambda t: t.select("track_id", "frame", F.round(K.angle(F.lit(30.0), F.lit(20.0), F.lit(100.0), F.lit(50.0), F.col("x"), F.col("y")), 5).alias("angle")))
_query("w10_analytics_process", f"{_T} SELECT frame, cls, count(*) AS n FROM t WHERE frame % 30 = 0 GROUP BY ALL", K.class_series)
_query("w11_update_graph", f"{_T}, c AS (SELECT cls, frame, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY frame DESC) AS r FROM c) SELECT cls, frame, n FROM r WHERE r <= 45",
       lambda t: K.tail_series(t.groupBy("cls", "frame").agg(F.count("*").alias("n")), "cls", "frame"))
_query("w11_pie_shares", f"{_T}, c AS (SELECT cls, count(*) AS n FROM t GROUP BY cls) SELECT cls, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 4) AS percent FROM c", lambda t: K.shares(t.groupBy("cls").agg(F.count("*").alias("n")), "cls", "n"))
_query("r19_region_counter", f"{_T} SELECT frame, region, n FROM (SELECT frame, 'left' AS region, sum(CAST({_in(REGIONS['left'])} AS INT))::BIGINT AS n FROM t GROUP BY frame UNION ALL SELECT frame, 'right', sum(CAST({_in(ZONE)} AS INT))::BIGINT FROM t GROUP BY frame)",
       lambda t: K.region_counts(t, REGIONS))
_query("r20_queue_manager", f"{_LAG} SELECT frame, count(*) AS n FROM s WHERE r > 1 AND {_in(ZONE)} GROUP BY frame", lambda t: K.queue_counts(t, ZONE))
_SLOT = " + ".join(f"max(CAST(trunc(x) BETWEEN {a} AND {c} AND trunc(y) BETWEEN {b} AND {d} AS INT))" for a, b, c, d in SLOTS.values())
_query("r21_parking_management", f"{_T} SELECT frame, {_SLOT} AS occupied, 3 - ({_SLOT}) AS free FROM t GROUP BY frame", lambda t: K.parking(t, SLOTS))
_query("r22_heatmap", f"{_T} SELECT floor(x)::BIGINT + i AS px, floor(y)::BIGINT + j AS py, count(*) * 2 AS heat FROM t, range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j < 9 GROUP BY ALL", K.heat)
_query("r23_distance_calculation", f"{_T} SELECT frame, round(sqrt((a.x - b.x)**2 + (a.y - b.y)**2), 5) AS distance FROM t a JOIN t b USING (frame) WHERE a.track_id = 3 AND b.track_id = 8",
       lambda t: K.track_distance(t, 3, 8).select("frame", F.round("distance", 5).alias("distance")))
_query("r24_security_alarm", f"{_T} SELECT min(frame) AS frame FROM (SELECT frame FROM t GROUP BY frame HAVING count(*) >= 10)", lambda t: K.first_alarm(t, 10))
_query("r25_track_zone", f"{_T} SELECT track_id, count(*) AS n FROM t WHERE {_in(ZONE)} GROUP BY track_id", lambda t: t.where(K.inside(F.col("x"), F.col("y"), ZONE)).groupBy("track_id").agg(F.count("*").alias("n")))
_query("s9_load_streams_next", f"{_T} SELECT track_id, max(frame) AS frame FROM t GROUP BY track_id", lambda t: t.groupBy("track_id").agg(F.max("frame").alias("frame")))
_query("s8_load_streams_stride", f"{_T} SELECT track_id, frame FROM t WHERE frame % 4 = 0", lambda t: t.where("frame % 4 = 0").select("track_id", "frame"))
_AGE = f"(SELECT track_id, max(frame) AS age, arg_max(x, frame) AS x, arg_max(y, frame) AS y FROM ({TRACK_SQL}) GROUP BY track_id)"


def _last(t):
    return t.groupBy("track_id").agg(F.max("frame").alias("age"), F.max_by("x", "frame").alias("x"), F.max_by("y", "frame").alias("y"))


_query("u1_joint_stracks", f"SELECT track_id, age FROM {_AGE} WHERE track_id % 3 = 0 UNION ALL SELECT track_id, -age FROM {_AGE} WHERE track_id % 2 = 0 AND track_id % 3 <> 0",
       lambda t: K.union_tracks(_last(t).where("track_id % 3 = 0").select("track_id", "age"), _last(t).where("track_id % 2 = 0").select("track_id", (-F.col("age")).alias("age"))))
_query("u2_sub_stracks", f"SELECT track_id FROM {_AGE} WHERE track_id % 3 = 0 AND track_id % 2 <> 0", lambda t: K.minus_tracks(_last(t).where("track_id % 3 = 0"), _last(t).where("track_id % 2 = 0")).select("track_id"))
_query("u3_remove_duplicate_stracks", f"WITH p AS (SELECT * FROM {_AGE}), a AS (SELECT * FROM p WHERE track_id % 2 = 0), b AS (SELECT * FROM p WHERE track_id % 2 = 1), c AS (SELECT a.track_id AS ai, b.track_id AS bi, a.age AS aa, b.age AS ba FROM a, b WHERE sqrt((a.x - b.x)**2 + (a.y - b.y)**2) < 60) SELECT 'a' AS side, track_id FROM a WHERE track_id NOT IN (SELECT ai FROM c WHERE aa <= ba) UNION ALL SELECT 'b', track_id FROM b WHERE track_id NOT IN (SELECT bi FROM c WHERE aa > ba)",
       lambda t: K.drop_doubles(_last(t).where("track_id % 2 = 0"), _last(t).where("track_id % 2 = 1"), 60.0))
register("w4_set_rectangle", "WITH i AS (SELECT p_partkey AS id, (200 + p_partkey % 300) / (150 + p_partkey % 411)::DOUBLE AS ar FROM part), b AS (SELECT *, (row_number() OVER (ORDER BY ar, id) - 1) // 16 AS batch FROM i) SELECT batch, CAST(CASE WHEN max(ar) < 1 THEN ceil(max(ar) * 640 / 32) * 32 ELSE 640 END AS BIGINT) AS h, CAST(CASE WHEN max(ar) < 1 OR min(ar) <= 1 THEN 640 ELSE ceil(1 / min(ar) * 640 / 32) * 32 END AS BIGINT) AS w FROM b GROUP BY batch")(
    lambda spark, sf_dir: rectangles(spark, sf_dir)
)


def rectangles(spark, sf_dir: str, size: int = 16, side: int = 640, stride: int = 32):
    """Images in order of their aspect ratio in batches of size, and the shape that fits each batch."""
    from tessel.plans.detection import batches, images

    i = images(spark, sf_dir).select("image_id", (F.col("height") / F.col("width")).alias("ar")).withColumn("key", F.struct("ar", "image_id"))
    b = batches(i, "key", size).groupBy("batch").agg(F.min("ar").alias("lo"), F.max("ar").alias("hi"))
    fit = lambda v: (F.ceil(v * side / stride) * stride).cast("long")
    h = F.when(F.col("hi") < 1, fit(F.col("hi"))).otherwise(F.lit(side).cast("long"))
    w = F.when((F.col("hi") < 1) | (F.col("lo") <= 1), F.lit(side).cast("long")).otherwise(fit(1 / F.col("lo")))
    return b.select("batch", h.alias("h"), w.alias("w"))
