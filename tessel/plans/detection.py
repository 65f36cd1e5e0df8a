"""Queries over tiles, suppression and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.operators import nms, tiles
from tessel.operators.graph import components
from tessel.operators.spatial import box_join, others
from tessel.plans.geometry import GEO, boundary_filter
from tessel.plans.registry import register
from tessel.sources.derived import DET_SQL, detections, table

_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"
_IOU = f"({_INTER} / ({_AREA} - {_INTER} + 1e-7))"
_AHEAD = "(b.conf > a.conf OR (b.conf = a.conf AND b.det_id < a.det_id))"
_PAIR = "a.image_id = b.image_id AND a.cls = b.cls"
_CLIPPED = f"(SELECT image_id, det_id, cls, conf, x1, y1, least(x2, 399) AS x2, least(y2, 399) AS y2 FROM ({DET_SQL}) WHERE (x1+x2)/2 < 400 AND (y1+y2)/2 < 400 AND x1 < 399 AND y1 < 399)"


def images(spark, sf_dir: str) -> DataFrame:
    """One image per part: its size follows from the part key."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS image_id", "CAST(200 + p_partkey % 300 AS INT) AS height", "CAST(150 + p_partkey % 411 AS INT) AS width")


IMG_SQL = "SELECT p_partkey AS image_id, CAST(200 + p_partkey % 300 AS INT) AS height, CAST(150 + p_partkey % 411 AS INT) AS width FROM part"


@register(
    "entry_merged_detections",
    f"""WITH d AS {_CLIPPED}, k AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE {_PAIR} AND {_AHEAD} AND {_IOU} >= 0.5))
    SELECT image_id, cls, count(*) AS n, round(max(conf), 6) AS best, round(min(500000 + x1 * 0.5 + y1 * 0.1), 6) AS west FROM k GROUP BY image_id, cls""",
)
def entry_merged(spark, sf_dir):
    """Boundary filter, class-aware suppression, georeference and counts: the flow over one large raster."""
    kept = nms.fast_nms(boundary_filter(detections(spark, sf_dir), 400, 400), 0.5)
    gx, _ = B.pixel_to_geo(F.col("x1"), F.col("y1"), GEO)
    return kept.groupBy("image_id", "cls").agg(F.count("*").alias("n"), F.round(F.max("conf"), 6).alias("best"), F.round(F.min(gx), 6).alias("west"))


register("a3_fast_nms", f"WITH d AS ({DET_SQL}) SELECT det_id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE {_PAIR} AND {_AHEAD} AND {_IOU} >= 0.5)")(
    lambda spark, sf_dir: nms.fast_nms(detections(spark, sf_dir), 0.5).select("det_id")
)


def _greedy_sql(test: str, keys: str = _PAIR) -> str:
    """The greedy rule by rounds: a box is decided once all boxes before it that it touches are."""
    return f"""WITH RECURSIVE d AS ({DET_SQL}),
    e AS (SELECT a.det_id AS lo, b.det_id AS hi FROM d a JOIN d b ON {keys} AND {_AHEAD} AND {_INTER} / ({_AREA} - {_INTER}) {test}),
    s AS (SELECT 0 AS step, det_id, CASE WHEN det_id NOT IN (SELECT lo FROM e) THEN 1 ELSE 0 END AS state FROM d
      UNION ALL
      SELECT step + 1, s.det_id, CASE WHEN state <> 0 THEN state WHEN n.won THEN -1 WHEN n.open THEN 0 ELSE 1 END
      FROM s LEFT JOIN (SELECT lo, bool_or(t.state = 1) AS won, bool_or(t.state = 0) AS open FROM e JOIN s t ON t.det_id = e.hi GROUP BY lo) n ON n.lo = s.det_id
      WHERE step < 12)
    SELECT det_id FROM s WHERE step = 12 AND state = 1"""


register("a2_nms", _greedy_sql("> 0.3"))(lambda spark, sf_dir: nms.greedy_nms(detections(spark, sf_dir), 0.3).select("det_id"))
register("a4_batched_nms", _greedy_sql("> 0.5"))(lambda spark, sf_dir: nms.greedy_nms(detections(spark, sf_dir), 0.5).select("det_id"))
register("a5_global_nms", _greedy_sql(">= 0.4"))(lambda spark, sf_dir: nms.greedy_nms(detections(spark, sf_dir), 0.4, strict=True).select("det_id"))
register("a1_non_max_suppression")(lambda spark, sf_dir: nms.non_max_suppression(detections(spark, sf_dir), 0.25, 0.45, [0, 1], max_det=20).select("det_id", "image_id", "cls"))
register("k10_postprocess", f"WITH d AS ({DET_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rk FROM d WHERE conf > 0.25 AND cls IN (0, 2)) SELECT image_id, det_id FROM r WHERE rk <= 10")(
    lambda spark, sf_dir: detections(spark, sf_dir).where("conf > 0.25 AND cls IN (0, 2)").withColumn("rk", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id"))).where("rk <= 10").select("image_id", "det_id")
)
register("a6_merge_detection", f"WITH d AS {_CLIPPED}, k AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE {_PAIR} AND {_AHEAD} AND {_IOU} >= 0.5)) SELECT det_id, cls, conf, x1, y1, x2, y2 FROM k")(
    lambda spark, sf_dir: nms.fast_nms(boundary_filter(detections(spark, sf_dir), 400, 400), 0.5).select("det_id", "cls", "conf", "x1", "y1", "x2", "y2")
)


def pairs(spark, sf_dir, test, cell: float = 64.0, keys=("image_id", "cls")) -> DataFrame:
    """Ordered pairs of different detections that overlap and pass a test."""
    det = detections(spark, sf_dir)
    return box_join(det, others(det, "det_id", "conf", keys=tuple(keys)), list(keys), cell, (F.col("det_id") < F.col("odet_id")) & test)


register("j2_box_iou", f"WITH d AS ({DET_SQL}) SELECT a.det_id, b.det_id AS odet_id, round({_IOU}, 6) AS v FROM d a JOIN d b ON {_PAIR} AND a.det_id < b.det_id WHERE {_INTER} > 0")(
    lambda spark, sf_dir: pairs(spark, sf_dir, F.lit(True)).select("det_id", "odet_id", F.round(B.iou(B.col_box(), nms.other_box()), 6).alias("v"))
)
register("j9_calculate_box_iou", f"WITH d AS ({DET_SQL}) SELECT a.det_id, b.det_id AS odet_id, round({_IOU}, 6) AS v FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE {_IOU} >= 0.3")(
    lambda spark, sf_dir: pairs(spark, sf_dir, B.iou(B.col_box(), nms.other_box()) >= 0.3, keys=("image_id",)).select("det_id", "odet_id", F.round(B.iou(B.col_box(), nms.other_box()), 6).alias("v"))
)
for _n in ("j11_query_potential_overlaps", "j13_find_potential_overlap_pairs"):
    register(_n, f"WITH d AS ({DET_SQL}) SELECT a.det_id, b.det_id AS odet_id FROM d a JOIN d b ON {_PAIR} AND a.det_id < b.det_id WHERE {_INTER} > 0")(
        lambda spark, sf_dir, c=96.0 if _n[1:3] == "13" else 48.0: pairs(spark, sf_dir, F.lit(True), c).select("det_id", "odet_id")
    )
register("j10_grid_insert", f"WITH d AS ({DET_SQL}) SELECT det_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy FROM d, range(0, 20) r(cx), range(0, 20) s(cy) WHERE cx BETWEEN floor(x1/64) AND floor(x2/64) AND cy BETWEEN floor(y1/64) AND floor(y2/64)")(
    lambda spark, sf_dir: _cells(detections(spark, sf_dir))
)


def _cells(det):
    from tessel.operators.spatial import _cells as cells

    return cells(det, 64.0, ("x1", "y1", "x2", "y2")).select("det_id", F.col("__cx").alias("cx"), F.col("__cy").alias("cy"))


register("j7_batch_probiou")(lambda spark, sf_dir: pairs(spark, sf_dir, F.lit(True)).select("det_id", "odet_id", F.round(B.prob_iou(_rot(""), _rot("o")), 6).alias("v")))


def _rot(p):
    x1, y1, x2, y2, conf = (F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2", "conf"))
    return B.Rotated((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, conf * 3)


_TILE = f"""t AS (SELECT image_id, CAST(r * CAST(ceil(width / 96.0) AS INT) + c AS INT) AS tile_id, CAST(r AS INT) AS grid_row, CAST(c AS INT) AS grid_col, CAST(r * 96 AS INT) AS row_off, CAST(c * 96 AS INT) AS col_off,
  CAST(least(128, height - r * 96) AS INT) AS h, CAST(least(128, width - c * 96) AS INT) AS w FROM ({IMG_SQL}), range(0, 10) a(r), range(0, 10) b(c) WHERE r * 96 < height AND c * 96 < width)"""


def grid(spark, sf_dir):
    return tiles.tile_grid(images(spark, sf_dir), 128, 0.25)


register("t2_generate_tiles_with_georef", f"WITH {_TILE} SELECT *, round(500000 + col_off * 0.5, 6) AS ul_x, round(4000000 - row_off * 0.5, 6) AS ul_y FROM t")(
    lambda spark, sf_dir: grid(spark, sf_dir).withColumns(dict(zip(("ul_x", "ul_y"), (F.round(c, 6) for c in tiles.tile_origin(GEO)), strict=True)))
)
register("t1_generate_tiles", f"WITH {_TILE} SELECT image_id, row_off, col_off FROM t")(lambda spark, sf_dir: grid(spark, sf_dir).select("image_id", "row_off", "col_off"))
register("t3_grid_info", f"SELECT image_id, CAST(ceil(height / 96.0) AS INT) AS rows, CAST(ceil(width / 96.0) AS INT) AS cols FROM ({IMG_SQL})")(
    lambda spark, sf_dir: images(spark, sf_dir).select("image_id", F.ceil(F.col("height") / 96).cast("int").alias("rows"), F.ceil(F.col("width") / 96).cast("int").alias("cols"))
)
register("t4_adjacency_map", f"WITH {_TILE} SELECT a.image_id, a.tile_id, b.tile_id AS other_id FROM t a JOIN t b ON a.image_id = b.image_id AND a.tile_id <> b.tile_id AND abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1")(
    lambda spark, sf_dir: tiles.neighbours(images(spark, sf_dir), 128, 0.25).select("image_id", "tile_id", "other_id")
)
register(
    "t5_overlap_regions",
    f"WITH {_TILE}, o AS (SELECT a.image_id, a.tile_id, b.tile_id AS other_id, greatest(a.row_off, b.row_off) AS r1, greatest(a.col_off, b.col_off) AS c1, least(a.row_off + a.h, b.row_off + b.h) AS r2, least(a.col_off + a.w, b.col_off + b.w) AS c2 FROM t a JOIN t b ON a.image_id = b.image_id AND a.tile_id <> b.tile_id AND abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1) SELECT * FROM o WHERE r1 < r2 AND c1 < c2",
)(lambda spark, sf_dir: tiles.overlap_strips(images(spark, sf_dir), 128, 0.25))
register("t6_tile_grid_position", f"WITH {_TILE}, n AS (SELECT image_id, CAST(ceil(width / 96.0) AS INT) AS cols FROM ({IMG_SQL})) SELECT image_id, tile_id, CAST(tile_id // cols AS INT) AS r, CAST(tile_id % cols AS INT) AS c FROM t JOIN n USING (image_id)")(
    lambda spark, sf_dir: grid(spark, sf_dir).join(images(spark, sf_dir).select("image_id", F.ceil(F.col("width") / 96).cast("int").alias("cols")), "image_id").selectExpr("image_id", "tile_id", "CAST(tile_id DIV cols AS INT) AS r", "CAST(tile_id % cols AS INT) AS c")
)
register("t20_build_point_grid", "SELECT CAST(i AS BIGINT) AS id, (i % 16 + 0.5::DOUBLE) / 16 AS x, (i // 16 + 0.5::DOUBLE) / 16 AS y FROM range(0, 256) t(i)")(lambda spark, sf_dir: tiles.point_grid(spark, 16))
register("t21_all_layer_point_grids", "SELECT CAST(l AS INT) AS layer, (i % n + 0.5::DOUBLE) / n AS x, (i // n + 0.5::DOUBLE) / n AS y FROM (VALUES (0, 16), (1, 8), (2, 4)) v(l, n), range(0, 256) t(i) WHERE i < n * n")(
    lambda spark, sf_dir: tiles.layer_grids(spark, 16, 2, 2)
)
register("t22_generate_crop_boxes")(lambda spark, sf_dir: tiles.crop_boxes(images(spark, sf_dir), 2, 512 / 1500))
register(
    "t23_batch_iterator",
    "SELECT b AS batch, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS b FROM part) GROUP BY b",
)(lambda spark, sf_dir: batches(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows in order of key in batches of size: ranges sort, and only their row counts meet to give each its first number."""
    parts = df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("__p"))
    from tessel.session import materialize

    parts = materialize(parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key))), "ranges")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("c"))
    first = sizes.withColumn("__first", F.sum("c").over(Window.orderBy("__p")) - F.col("c"))  # a row per partition
    return parts.join(F.broadcast(first), "__p").withColumn("batch", F.floor((F.col("__first") + F.col("__i") - 1) / size)).drop("__p", "__i", "__first", "c")


_COVER = f"({_INTER} / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))"


def merge_boxes(det: DataFrame, least: float = 0.3, cell: float = 64.0) -> DataFrame:
    """A10 for axis-aligned shapes: those of a class whose coverage is at least `least` merge transitively.

    The three-way predicate of cross-tile IoU and coverage is, at the usual thresholds, exactly this one. A group's
    confidence is its maximum, its id the smallest member's; the shape is given by its bounds.
    """
    test = (F.col("det_id") < F.col("odet_id")) & (B.coverage(B.col_box(), nms.other_box()) >= least)
    links = box_join(det, others(det, "det_id", keys=("image_id", "cls")), ["image_id", "cls"], cell, test).select("det_id", "odet_id")
    of = components(links, "det_id", "odet_id")
    grouped = det.join(of, F.col("det_id") == F.col("node"), "left").withColumn("group_id", F.coalesce("comp", "det_id"))
    return grouped.groupBy("image_id", "cls", "group_id").agg(
        F.count("*").alias("members"), F.max("conf").alias("conf"), F.round(F.avg("conf"), 6).alias("mean_conf"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


_MERGE = f"""WITH RECURSIVE d AS (SELECT * FROM ({DET_SQL})),
  l AS (SELECT a.det_id AS u, b.det_id AS v FROM d a JOIN d b ON {_PAIR} AND a.det_id <> b.det_id AND {_COVER} >= 0.3),
  r AS (SELECT det_id AS a, det_id AS b FROM d UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
  c AS (SELECT a AS det_id, min(b) AS group_id FROM r GROUP BY a)"""
register("a10_merge_polygons_by_iou", _MERGE + " SELECT image_id, cls, group_id, count(*) AS members, max(conf) AS conf, round(avg(conf), 6) AS mean_conf, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM d JOIN c USING (det_id) GROUP BY ALL")(
    lambda spark, sf_dir: merge_boxes(detections(spark, sf_dir))
)
register("a20_merge_classification", f"WITH d AS ({DET_SQL}), s AS (SELECT image_id, cls, sum(conf) AS s, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS votes, row_number() OVER (PARTITION BY image_id ORDER BY round(s, 6) DESC, cls) AS rk FROM s) SELECT image_id, cls, round(s / votes, 10) AS conf FROM r WHERE rk = 1")(
    lambda spark, sf_dir: vote(detections(spark, sf_dir))
)


def vote(det: DataFrame) -> DataFrame:
    """The class of each image with the largest summed confidence, which is divided by all votes."""
    sums = det.groupBy("image_id", "cls").agg(F.sum("conf").alias("s"), F.count("*").alias("n"))
    best = F.max(F.struct(F.round("s", 6).alias("r"), (-F.col("cls")).alias("c"), "s"))
    return sums.groupBy("image_id").agg(best.alias("b"), F.sum("n").alias("votes")).select("image_id", (-F.col("b.c")).alias("cls"), F.round(F.col("b.s") / F.col("votes"), 10).alias("conf"))


register("j16_find_overlapping_mask_indices", f"WITH d AS ({DET_SQL}) SELECT det_id FROM d WHERE (x1 < 256 AND x2 > 192) OR (y1 < 256 AND y2 > 192)")(
    lambda spark, sf_dir: strip_split(detections(spark, sf_dir)).where("in_strip").select("det_id")
)
def strip_split(det: DataFrame, low: float = 192.0, high: float = 256.0) -> DataFrame:
    """Whether a box touches a strip that tiles share, in either direction."""
    return det.withColumn("in_strip", ((F.col("x1") < high) & (F.col("x2") > low)) | ((F.col("y1") < high) & (F.col("y2") > low)))
