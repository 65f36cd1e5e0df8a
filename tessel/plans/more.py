"""Queries over polygons, mosaics, neighbour joins, ingest, normalization, filters of motion and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.functions import rings as R
from tessel.operators import masks as M
from tessel.operators import nms, tiles
from tessel.operators.spatial import box_join
from tessel.plans.detection import IMG_SQL, grid, images, pairs
from tessel.plans.evaluation import _IOU
from tessel.plans.geometry import GEO
from tessel.plans.registry import register
from tessel.plans.results import NAMES, pieces, pixels
from tessel.session import work_path
from tessel.sources import formats
from tessel.sources.derived import DET_SQL, TRACK_SQL, detections, rings, table, tracks

# Polygons: triangles of each box.


def triangles(spark, sf_dir: str) -> DataFrame:
    """det_id and the ring of a triangle in each box."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return detections(spark, sf_dir).withColumn("ring", F.array(p("x1", "y1"), p("x2", "y1"), p("x1", "y2")))


_RUNS = f"SELECT det_id, r AS row, CAST(x1 AS INT) AS start, CAST(least(200, ceil(x2 + (r + 0.5 - y1) * (x1 - x2) / (y2 - y1) - 0.5)) AS INT) AS stop FROM (SELECT *, CAST(unnest(range(CAST(y1 AS BIGINT), CAST(least(y2, 200) AS BIGINT))) AS INT) AS r FROM ({DET_SQL}))"
register("p33_polygon2mask", f"SELECT * FROM ({_RUNS}) WHERE stop > start")(
    lambda spark, sf_dir: triangles(spark, sf_dir).select("det_id", F.inline(R.runs(F.col("ring"), 200, 200)))
)
register("p34_polygons2masks", f"SELECT image_id, det_id, CAST(greatest(0, least(x2, 200) - x1) * greatest(0, least(y2, 200) - y1) AS BIGINT) AS pixels FROM ({DET_SQL})")(
    lambda spark, sf_dir: rings(detections(spark, sf_dir)).select(
        "image_id", "det_id", F.aggregate(R.runs(F.col("ring"), 200, 200), F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"]).alias("pixels")
    )
)

# Tiles: georeference, mosaics, windows.
_CELLS = f"(SELECT image_id, CAST(r * ceil(width / 96.0)::INT + c AS INT) AS tile_id, CAST(r * 96 AS INT) AS ro, CAST(c * 96 AS INT) AS co, least(128, height - r * 96) AS h, least(128, width - c * 96) AS w FROM ({IMG_SQL}), range(0, 10) a(r), range(0, 10) b(c) WHERE r * 96 < height AND c * 96 < width)"
#: Small rasters (a sixteenth of an image's sides) in tiles of 8 pixels that share 2, pixel by pixel.
_SMALL = f"(SELECT image_id, CAST(height // 16 AS INT) AS height, CAST(width // 16 AS INT) AS width FROM ({IMG_SQL}))"
_SCELL = f"(SELECT image_id, r * ceil(width / 6.0)::INT + c AS tile_id, r * 6 AS ro, c * 6 AS co, least(8, height - r * 6) AS h, least(8, width - c * 6) AS w FROM {_SMALL}, range(0, 10) a(r), range(0, 10) b(c) WHERE r * 6 < height AND c * 6 < width)"
_TPX = f"(SELECT image_id, CAST(ro + i AS INT) AS row, CAST(co + j AS INT) AS col, i, j, h, w, tile_id % 7 AS v FROM {_SCELL}, range(0, 8) a(i), range(0, 8) b(j) WHERE i < h AND j < w)"
_EDGE = "least(least(1.0, (i + 1) / 2.0, (h - i) / 2.0), least(1.0, (j + 1) / 2.0, (w - j) / 2.0))::DOUBLE"


def tile_pixels(spark, sf_dir):
    """The pixels of each tile of small rasters, with the tile's value."""
    small = images(spark, sf_dir).selectExpr("image_id", "CAST(height DIV 16 AS INT) AS height", "CAST(width DIV 16 AS INT) AS width")
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    g = tiles.tile_grid(small, 8, 0.25).select("*", every("h", "i")).select("*", every("w", "j"))
    return g.select("image_id", (F.col("row_off") + F.col("i")).alias("row"), (F.col("col_off") + F.col("j")).alias("col"), "i", "j", "h", "w", (F.col("tile_id") % 7).cast("double").alias("v"))


def _weight():
    return F.least(tiles.edge_weight(F.col("i"), F.col("h"), 2), tiles.edge_weight(F.col("j"), F.col("w"), 2))


register("t7_tile_geotransform", f"SELECT image_id, tile_id, round(500000 + co * 0.5, 4) AS ul_x, round(4000000 - ro * 0.5, 4) AS ul_y FROM {_CELLS}")(
    lambda spark, sf_dir: grid(spark, sf_dir).select("image_id", "tile_id", *[F.round(c, 4).alias(n) for c, n in zip(tiles.tile_origin(GEO), ("ul_x", "ul_y"), strict=True)])
)
register("t9_merge_tiles_weighted", f"SELECT image_id, row, col, round(sum(v * {_EDGE}) / (sum({_EDGE}) + 1e-8), 5) AS v FROM {_TPX} GROUP BY ALL")(lambda spark, sf_dir: tiles.mosaic(tile_pixels(spark, sf_dir), _weight()).withColumn("v", F.round("v", 5)))
register("t10_create_weight_mask", f"SELECT image_id, row, col, round(max({_EDGE}), 6) AS w FROM {_TPX} GROUP BY ALL")(lambda spark, sf_dir: tile_pixels(spark, sf_dir).groupBy("image_id", "row", "col").agg(F.round(F.max(_weight()), 6).alias("w")))
register("t12_merge_tiles_mean", f"SELECT image_id, row, col, CAST(trunc(sum(v) / (count(*) + 1e-8)) AS INT) AS v FROM {_TPX} GROUP BY ALL")(lambda spark, sf_dir: tiles.mosaic(tile_pixels(spark, sf_dir)).withColumn("v", F.col("v").cast("int")))
register("t11_generate_tiles_pixels", f"SELECT image_id, count(*) AS n FROM ({IMG_SQL}), range(0, 10) a(r), range(0, 10) b(c) WHERE r * 100 < height AND c * 100 < width GROUP BY image_id")(
    lambda spark, sf_dir: tiles.tile_grid(images(spark, sf_dir), 128, 28.5 / 128).groupBy("image_id").agg(F.count("*").alias("n"))
)
register("t8_pad_tile", f"SELECT image_id, tile_id, CAST(128 - h AS INT) AS bottom, CAST(128 - w AS INT) AS right FROM {_CELLS}")(
    lambda spark, sf_dir: grid(spark, sf_dir).select("image_id", "tile_id", (128 - F.col("h")).alias("bottom"), (128 - F.col("w")).alias("right"))
)


def crops(spark, sf_dir):
    """T16, T15 for boxes: objects with 0.7 of their area in a window, in the window's normalized coordinates."""
    win = spark.range(16).select(F.col("id").alias("win"), (F.col("id") % 4 * 110).cast("double").alias("ox1"), (F.floor(F.col("id") / 4) * 110).cast("double").alias("oy1"))
    win = win.withColumns({"ox2": F.col("ox1") + 150, "oy2": F.col("oy1") + 150})
    d = box_join(detections(spark, sf_dir), win, [], 150.0, B.inter_area(B.col_box(), nms.other_box()) / B.area(B.col_box()) >= 0.7)
    b = B.xyxy_to_xywhn(B.clip_box(B.Box(F.col("x1") - F.col("ox1"), F.col("y1") - F.col("oy1"), F.col("x2") - F.col("ox1"), F.col("y2") - F.col("oy1")), 150.0, 150.0), 150, 150)
    return d.select("det_id", "win", *[F.round(c, 6).alias(n) for c, n in zip(b, ("cx", "cy", "w", "h"), strict=True)])


_CROP = f"WITH d AS ({DET_SQL}), w AS (SELECT i AS win, (i % 4 * 110)::DOUBLE AS a, (i // 4 * 110)::DOUBLE AS b FROM range(0, 16) t(i)), c AS (SELECT *, least(150, greatest(0, x1 - a)) AS p, least(150, greatest(0, y1 - b)) AS q, least(150, greatest(0, x2 - a)) AS r, least(150, greatest(0, y2 - b)) AS s FROM d, w WHERE greatest(0, least(x2, a + 150) - greatest(x1, a)) * greatest(0, least(y2, b + 150) - greatest(y1, b)) / ((x2 - x1) * (y2 - y1)) >= 0.7)"
register("t16_crop_and_save", f"{_CROP} SELECT det_id, win, round((p + r) / 300, 6) AS cx, round((q + s) / 300, 6) AS cy, round((r - p) / 150, 6) AS w, round((s - q) / 150, 6) AS h FROM c")(crops)
# Pair predicates and neighbour joins.
_PAIR = f"WITH d AS ({DET_SQL}), p AS (SELECT a.det_id, b.det_id AS odet_id, a.conf AS c1, b.conf AS c2, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1) AS u, (b.x2-b.x1)*(b.y2-b.y1) AS v FROM d a JOIN d b ON a.image_id = b.image_id AND a.cls = b.cls AND a.det_id < b.det_id)"
for _n in ("j12_find_potential_overlap_pairs", "j17_bbox_overlap", "j18_masks_overlap"):
    register(_n, f"{_PAIR} SELECT det_id, odet_id FROM p WHERE i > 0")(lambda spark, sf_dir: pairs(spark, sf_dir, B.overlaps(B.col_box(), nms.other_box())).select("det_id", "odet_id"))
register("j19_bbox_intersects_overlap_region", f"SELECT det_id FROM ({DET_SQL}) WHERE x1 < 256 AND x2 > 192 AND y1 < 400 AND y2 > 0")(
    lambda spark, sf_dir: detections(spark, sf_dir).where(B.overlaps(B.col_box(), B.Box(F.lit(192.0), F.lit(0.0), F.lit(256.0), F.lit(400.0)))).select("det_id")
)
for _n in ("j20_bbox_iou_from_cache", "j28_calculate_batch", "j29_calculate_iou_chunk"):
    register(_n, f"{_PAIR} SELECT det_id, odet_id, round(i / (u + v - i), 6) AS iou FROM p WHERE i > 0")(lambda spark, sf_dir: pairs(spark, sf_dir, F.lit(True)).select("det_id", "odet_id", F.round(B.iou(B.col_box(), nms.other_box(), 0), 6).alias("iou")))
register("j31_iou_distance", f"{_PAIR} SELECT det_id, odet_id, round(1 - i / (u + v - i + 1e-7), 6) AS cost FROM p WHERE i > 0")(lambda spark, sf_dir: pairs(spark, sf_dir, F.lit(True)).select("det_id", "odet_id", F.round(1 - B.iou(B.col_box(), nms.other_box()), 6).alias("cost")))
register("j6_probiou")(lambda spark, sf_dir: detections(spark, sf_dir).select("det_id", F.round(B.prob_iou(*(B.Rotated((F.col("x1") + F.col("x2")) / 2 + s, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("conf") * 3) for s in (0, 5))), 6).alias("v")))


def on_tiles(spark, sf_dir):
    """Detections with the tile of their centre, on a grid of 100 pixels."""
    c = B.xyxy_to_xywh(B.col_box())
    return detections(spark, sf_dir).withColumns({"tr": F.floor(c.b / 100).cast("int"), "tc": F.floor(c.a / 100).cast("int")})


def adjacent(spark, sf_dir, test=None):
    """Overlapping pairs whose tiles are neighbours, by the tile grid in the key and a shift of it on one side."""
    d = on_tiles(spark, sf_dir)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    a = d.select("*", F.explode(steps).alias("s")).withColumns({"tr": F.col("tr") + F.col("s.i"), "tc": F.col("tc") + F.col("s.j")})
    b = d.select("image_id", "tr", "tc", *[F.col(c).alias(f"o{c}") for c in ("det_id", "cls", "x1", "y1", "x2", "y2")])
    out = a.join(b, ["image_id", "tr", "tc"]).where("det_id < odet_id").where(B.overlaps(B.col_box(), nms.other_box()))
    return out if test is None else out.where(test)


_ADJ = f"WITH d AS (SELECT *, floor((y1+y2)/2/100) AS tr, floor((x1+x2)/2/100) AS tc FROM ({DET_SQL})), p AS (SELECT a.det_id, b.det_id AS odet_id, a.cls AS c1, b.cls AS c2, {_IOU} AS iou FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id < b.det_id AND abs(a.tr - b.tr) <= 1 AND abs(a.tc - b.tc) <= 1 AND (a.tr <> b.tr OR a.tc <> b.tc) WHERE a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"
register("j14_find_adjacent_tile_pairs", f"{_ADJ} SELECT det_id, odet_id FROM p")(lambda spark, sf_dir: adjacent(spark, sf_dir).select("det_id", "odet_id"))
register("j15_find_cross_tile_candidates", f"{_ADJ} SELECT det_id, odet_id FROM p WHERE iou >= 0.2")(lambda spark, sf_dir: adjacent(spark, sf_dir, B.iou(B.col_box(), nms.other_box()) >= 0.2).select("det_id", "odet_id"))
_PX = f"WITH d AS ({DET_SQL}), px AS (SELECT image_id, det_id, conf, cls, row, CAST(unnest(range(floor(x1/8)::INT, floor(x2/8)::INT + 1)) AS INT) AS col FROM (SELECT *, CAST(unnest(range(floor(y1/8)::INT, floor(y2/8)::INT + 1)) AS INT) AS row FROM d))"
register("o5_export_masks_from_instance_map", f"{_PX}, m AS (SELECT image_id, row, col, max(det_id) AS det_id FROM px GROUP BY ALL) SELECT det_id, count(*) AS pixels FROM m GROUP BY det_id")(
    lambda spark, sf_dir: pixels(spark, sf_dir).groupBy("image_id", "row", "col").agg(F.max("det_id").alias("det_id")).groupBy("det_id").agg(F.count("*").alias("pixels"))
)
register("o7_export_instance_map", f"{_PX}, i AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS k FROM d) SELECT image_id, CAST(max(k) AS INT) AS instances FROM i GROUP BY image_id")(lambda spark, sf_dir: M.instance_map(pixels(spark, sf_dir)).groupBy("image_id").agg(F.max("instance").alias("instances")))


register("a37_gather_stats", f"SELECT image_id % 4 AS rank, count(*) AS n FROM ({DET_SQL}) GROUP BY 1")(lambda spark, sf_dir: detections(spark, sf_dir).groupBy((F.col("image_id") % 4).alias("rank")).agg(F.count("*").alias("n")))
register("k5_top1", "SELECT doc_id, list_position(p, list_max(p)) - 1 AS top1 FROM (SELECT doc_id, [doc_id % 7, doc_id % 5, n_chars % 11] AS p FROM documents)")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.array(*[F.expr(e) for e in ("doc_id % 7", "doc_id % 5", "n_chars % 11")]).alias("p")).select("doc_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("top1"))
)
register("k8_parents", "SELECT p_partkey, p_retailprice / sum(p_retailprice) OVER () AS weight FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9)")(
    lambda spark, sf_dir: (lambda t: t.join(F.broadcast(t.agg(F.sum("p_retailprice").alias("s")))).select("p_partkey", (F.col("p_retailprice") / F.col("s")).alias("weight")))(table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(9))
)
register("u9_random_load_text", "WITH h AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat('7|', p_partkey))) AS r FROM part) SELECT p_brand, p_partkey FROM h WHERE r <= 3")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("p_partkey").cast("string")), 256)))).where("r <= 3").select("p_brand", "p_partkey")
)
# Ingest, normalization, configuration.


@dataclass(frozen=True)
class Job:
    """A validated job; the task is one of the list, overlaps and thresholds are shares."""

    task: str = "segment"
    tile_size: int = 640
    overlap: float = 0.25
    conf: float = 0.5
    iou: float = 0.5

    def __post_init__(self):
        if self.task not in ("detect", "segment", "obb", "pose", "classify"):
            raise ValueError(f"no such task: {self.task}")
        if not 0 <= self.overlap < 1 or not 0 <= self.conf <= 1 or not 0 <= self.iou <= 1 or self.tile_size < 1:
            raise ValueError("out of range")


def source_kind(path):
    """What a source is, by its text: a camera, a list of streams, a remote or a local file or folder."""
    url = path.rlike("^(?i)(rtsp|rtmp|tcp|http)s?://")
    file = path.rlike(r"(?i)\.(jpe?g|png|tiff?|bmp|webp|mp4|avi|mov|mkv)$")
    return F.when(path.rlike(r"^[0-9]+$"), "camera").when(path.rlike(r"\.streams$"), "streams").when(path == "screen", "screen").when(url & ~file, "stream").when(url, "download").when(file, "file").otherwise("folder")


_SRC = "CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN 'rtsp://h/a' WHEN 2 THEN 'https://h/a.jpg' WHEN 3 THEN '/d/a.PNG' WHEN 4 THEN 'x.streams' ELSE '/d/e' END"
for _n in ("s6_check_source", "s7_load_inference_source", "s14_autocast_list"):
    register(_n, "SELECT p_partkey, ['camera', 'stream', 'download', 'file', 'streams', 'folder'][p_partkey % 6 + 1] AS kind FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", source_kind(F.expr(_SRC)).alias("kind")))
register("s10_load_images_and_videos", "SELECT p_partkey, CAST(f AS INT) AS frame FROM part, range(0, 50) t(f) WHERE f % 4 = 0 AND f < p_size")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1, F.lit(4))).alias("frame"))
)
register("s18_verify_image", f"SELECT image_id, height >= 10 AND width >= 10 AND image_id % 7 <> 0 AS ok FROM ({IMG_SQL})")(lambda spark, sf_dir: images(spark, sf_dir).select("image_id", ((F.col("height") >= 10) & (F.col("width") >= 10) & (F.col("image_id") % 7 != 0)).alias("ok")))


def snapshot(df: DataFrame, path: str, version: str) -> DataFrame:
    """The snapshot at a path if it was written for this version, else df, written there."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(f"{path}/{version}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


_NORM = "WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE value END AS v FROM events), p AS (SELECT user_id, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b, avg(v) + stddev_pop(v) AS t FROM v GROUP BY user_id)"


def normalize_float(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Float pixels to 0..255: what isn't finite is 0; flat groups split at mean and deviation, groups with long
    tails stretch between the 2nd and 98th percentile, others between their ends."""
    v = F.when(F.isnan(value) | (F.abs(value) == float("inf")) | F.col(value).isNull(), 0.0).otherwise(F.col(value))
    df = df.withColumn(value, v)
    p = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.percentile(value, [0.02, 0.98]).alias("__p"), (F.avg(value) + F.stddev_pop(value)).alias("__t"))
    a, b, x, span = F.col("__p")[0], F.col("__p")[1], F.col(value), F.col("__hi") - F.col("__lo")
    out = F.when(span < 1e-6, F.when(x > F.col("__t"), 255.0).otherwise(0.0)).when(span / F.greatest(b - a, F.lit(1e-7)) > 2, (x - a) / (b - a) * 255).otherwise((x - F.col("__lo")) / span * 255)
    return df.join(p, keys).withColumn("u8", F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0)).cast("int")).drop("__lo", "__hi", "__p", "__t")


for _n in ("s2_normalize_image", "s3_normalize_float_image"):
    register(_n, f"{_NORM} SELECT event_id, CAST(trunc(least(255, greatest(0, CASE WHEN hi - lo < 1e-6 THEN CASE WHEN v > t THEN 255 ELSE 0 END WHEN (hi - lo) / greatest(b - a, 1e-7) > 2 THEN (v - a) / (b - a) * 255 ELSE (v - lo) / (hi - lo) * 255 END))) AS INT) AS u8 FROM v JOIN p USING (user_id)")(
        lambda spark, sf_dir: normalize_float(table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value")).alias("value")), ["user_id"], "value").select("event_id", "u8")
    )


def multispectral(rgb: DataFrame, bands: int) -> DataFrame:
    """Bands at even wavelengths from 450 to 700 nm, linear between blue, green and red, kept in 0..255.

    Fixed values: the wavelengths 475, 540 and 650 nm of the three colours.
    """
    at = lambda i: 450 + i * 250 / (bands - 1)
    line = lambda w, x0, y0, x1, y1: F.col(y0) + (F.col(y1) - F.col(y0)) * (w - x0) / (x1 - x0)
    value = lambda w: line(w, 475, "b", 540, "g") if w <= 540 else line(w, 540, "g", 650, "r")
    return rgb.select("id", F.array(*[F.least(F.greatest(value(at(i)), F.lit(0.0)), F.lit(255.0)) for i in range(bands)]).alias("bands"))


register("s29_convert_to_multispectral", "SELECT p_partkey AS id, round(least(255, greatest(0, b + (g - b) * (450 - 475) / 65.0)), 4) AS first, round(least(255, greatest(0, g + (r - g) * (700 - 540) / 110.0)), 4) AS last FROM (SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS r, (p_partkey * 13 % 256)::DOUBLE AS g, (p_partkey * 29 % 256)::DOUBLE AS b FROM part)")(
    lambda spark, sf_dir: multispectral(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey * 7 % 256 AS DOUBLE) AS r", "CAST(p_partkey * 13 % 256 AS DOUBLE) AS g", "CAST(p_partkey * 29 % 256 AS DOUBLE) AS b"), 10).select("id", F.round(F.col("bands")[0], 4).alias("first"), F.round(F.col("bands")[9], 4).alias("last"))
)
register("s30_load_categories", "SELECT CAST(i - 1 AS INT) AS cls, 'n' || i AS name FROM range(1, 6) t(i)")(
    lambda spark, sf_dir: spark.range(1).select(F.explode(F.transform_keys(F.create_map(*[F.lit(x) for i in range(1, 6) for x in (i, f"n{i}")]), lambda k, v: k - 1)).alias("cls", "name"))
)


def grounded(spark, sf_dir):
    """S22 over made-up captions: whole texts, and a phrase of the first and the last word of each, by spans."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("caption"))
    im = d.select(F.col("doc_id").alias("image_id"), F.lit(100).alias("width"), F.lit(50).alias("height"), "caption")
    n, last = F.length("caption"), F.length(F.substring_index("caption", " ", -1))
    spans = F.array(F.array(F.lit(0), F.length(F.substring_index("caption", " ", 1))), F.array(n - last, n))
    a = d.select(F.col("doc_id").alias("image_id"), F.lit(1).alias("category_id"), (F.col("doc_id") % 5 == 0).alias("iscrowd"), spans.alias("tokens_positive"), F.lit(10.0).alias("bx"), F.lit(10.0).alias("by"), F.lit(20.0).alias("bw"), F.lit(10.0).alias("bh"))
    return formats.grounding(im, a).select("image_id", "phrase", "cx")


register("s22_grounding_cache_labels", "WITH d AS (SELECT doc_id, lower(string_split(text, ' ')[1]) || ' ' || lower(string_split(text, ' ')[-1]) AS p FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0) SELECT DISTINCT doc_id AS image_id, trim(p, ' ') AS phrase, 0.2::DOUBLE AS cx FROM d WHERE trim(p, ' ') <> ''")(grounded)


def round_trip(spark, sf_dir):
    """Detections written as NDJSON records and read back."""
    d = detections(spark, sf_dir)
    b = B.xyxy_to_xywhn(B.col_box(), 500, 500)
    rec = d.groupBy("image_id").agg(F.collect_list(F.array(F.col("cls").cast("double"), *b)).alias("boxes"))
    rec = rec.select(F.lit("image").alias("type"), F.concat(F.lit("im"), F.col("image_id"), F.lit(".jpg")).alias("file"), F.lit(500).alias("width"), F.lit(500).alias("height"), F.when(F.col("image_id") % 4 == 0, "val").otherwise("train").alias("split"), F.create_map(F.lit("boxes"), F.col("boxes")).alias("annotations"))
    path = work_path(spark, "ndjson")
    rec.write.json(path)
    return formats.read_ndjson(spark, path).groupBy("split", "cls").agg(F.count("*").alias("n"), F.round(F.sum(F.col("numbers")[2]), 4).alias("w"))


register("s26_convert_ndjson", f"SELECT CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, cls, count(*) AS n, round(sum((x2 - x1) / 500), 4) AS w FROM ({DET_SQL}) GROUP BY ALL")(round_trip)


def geo_trip(spark, sf_dir):
    """Boxes written as one GeoJSON collection and read back as label lines."""
    d = detections(spark, sf_dir, False).repartitionByRange("det_id").dropDuplicates(["det_id", "conf"])  # dealt as the writer sorts
    path = work_path(spark, "geojson")
    formats.write_geojson_parts(d, path, NAMES, GEO, "EPSG:32650")
    return formats.read_geojson_parts(spark, path).groupBy("cls").agg(F.count("line").alias("n"))


for _n in ("o1_geojson_export", "s32_convert_single_geojson", "o13_results_to_geojson"):
    register(_n, f"SELECT cls, count(*) AS n FROM ({DET_SQL}) GROUP BY cls")(geo_trip)


def written(kind: str):
    """A sink's round trip: results written in a format and counted when read back."""

    def run(spark, sf_dir):
        d, path = detections(spark, sf_dir), work_path(spark, kind)
        if kind == "csv":
            formats.summary(d, NAMES).withColumn("box", F.to_json("box")).write.option("header", True).csv(path)
            return spark.read.option("header", True).csv(path).groupBy("class").agg(F.count("*").alias("n")).select(F.col("class").cast("int").alias("cls"), "n")
        if kind == "json":
            formats.summary(d, NAMES).write.json(path)
            return spark.read.schema("class int").json(path).groupBy(F.col("class").alias("cls")).agg(F.count("*").alias("n"))
        formats.result_lines(d, 400.0, 400.0).select("line").write.text(path)
        return spark.read.text(path).groupBy(F.substring_index("value", " ", 1).cast("int").alias("cls")).agg(F.count("*").alias("n"))

    return run


_COUNT = f"SELECT cls, count(*) AS n FROM ({DET_SQL}) GROUP BY cls"
for _n, _k in (("o18_to_df", "json"), ("o19_to_csv", "csv"), ("o20_to_json", "json"), ("o22_save_one_txt", "text"), ("o12_export_combined_pixel_results", "json"), ("o14_simple_format", "text"), ("o25_results_to_csv", "csv")):
    register(_n, _COUNT)(written(_k))
register("o9_shapefile_fields", f"SELECT det_id AS fid, cls AS cls_id, substr(CASE cls WHEN 0 THEN 'ship' WHEN 1 THEN 'plane' ELSE 'class_2' END, 1, 254) AS cls_nm, round(conf, 4) AS confid, round((x2-x1)*(y2-y1), 2) AS area_px FROM ({DET_SQL})")(
    lambda spark, sf_dir: detections(spark, sf_dir).select(F.col("det_id").alias("fid"), F.col("cls").alias("cls_id"), F.substring(formats.class_name(F.col("cls"), NAMES), 1, 254).alias("cls_nm"), F.round("conf", 4).alias("confid"), F.round(B.area(B.col_box()), 2).alias("area_px"))
)
register("o11_export_polygons_before_merge", f"SELECT image_id, count(*) AS n, round(sum((x2-x1)*(y2-y1)), 3) AS area FROM ({DET_SQL}) GROUP BY image_id")(
    lambda spark, sf_dir: (lambda d: d.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum(R.area(F.col("ring"))), 3).alias("area")))(rings(detections(spark, sf_dir)))
)
register("o23_metadata_builder", f"SELECT count(*) AS detections, count(DISTINCT image_id) AS images, round(max(conf), 4) AS best FROM ({DET_SQL})")(lambda spark, sf_dir: detections(spark, sf_dir).agg(F.count("*").alias("detections"), F.countDistinct("image_id").alias("images"), F.round(F.max("conf"), 4).alias("best")))
register("o24_write_state", "SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id")(
    lambda spark, sf_dir: (lambda p: (table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).write.json(p), spark.read.schema("user_id long, last long").json(p))[1])(work_path(spark, "state"))
)
register("w14_read_log_file", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-03 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 40")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").where("ts > TIMESTAMP_NTZ '2024-01-03 00:00:00'").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id")
)
register("r26_extract_tracks", f"SELECT track_id, frame, round(x, 4) AS x FROM ({TRACK_SQL})")(lambda spark, sf_dir: tracks(spark, sf_dir).select("track_id", "frame", F.round("x", 4).alias("x")))


register("r7_get_dists", f"{_PAIR} SELECT det_id, odet_id, round(least(1 - i / (u + v - i + 1e-7) * c2, abs(c1 - c2)), 6) AS cost FROM p WHERE i > 0")(
    lambda spark, sf_dir: pairs(spark, sf_dir, F.lit(True)).select("det_id", "odet_id", F.round(F.least(B.fuse_score(1 - B.iou(B.col_box(), nms.other_box()), F.col("oconf")), F.abs(F.col("conf") - F.col("oconf"))), 6).alias("cost"))
)
register("r8_update_features", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (0.9::DOUBLE * p[1] + 0.1::DOUBLE * p[2]) ** 2)), 5) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda spark, sf_dir: (lambda v: v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: F.pow(0.9 * x.cast("double") + 0.1 * y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, t: s + t), 5).alias("norm")))(table(spark, sf_dir, "embeddings"))
)
register("j25_mask_iou_batch")(lambda spark, sf_dir: M.window_iou(pieces(spark, sf_dir), ("a", "b", "inter", "both")).select("a", "b", F.round("iou", 6).alias("iou")))
