"""Queries over polygons of many forms, windows, and the merging and evaluation of masks, keypoints and rotated boxes."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.functions import polygons as P
from tessel.functions import rings as R
from tessel.operators import datasets as D
from tessel.operators import evaluation as E
from tessel.operators import masks as M
from tessel.operators import nms, tiles
from tessel.operators.graph import components
from tessel.operators.spatial import box_join, others
from tessel.plans.detection import _MERGE, _TILE, IMG_SQL, images, merge_boxes
from tessel.plans.evaluation import _CURVE, _MATCH
from tessel.plans.geometry import boundary_filter
from tessel.plans.more import _PX
from tessel.plans.registry import register
from tessel.plans.results import _MM, _WIN, pixels
from tessel.session import materialize, ship, work_path
from tessel.sources.derived import _GT, DET_SQL, detections, ground_truth, table

# Polygons: triangles whose third corner and turn depend on the detection.

_P = "x1, y1, x2, y2, conf, cls, det_id"


def shapes(df: DataFrame, f, fields: str, *cols: str) -> DataFrame:
    """det_id and the fields of f(row), by batches of an Arrow function; f gets a row's values by name."""
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(int(r.det_id), *f(r)) for r in pdf.itertuples(index=False)], columns=["det_id", *(x.split()[0] for x in fields.split(", "))])

    return df.select("det_id", *cols).mapInPandas(run, f"det_id long, {fields}")


def many_shapes(df: DataFrame, f, field: str, *cols: str) -> DataFrame:
    """det_id and a double, of f(rows), for the rows of an Arrow batch at once; f gets the columns by name, as arrays."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            rows = SimpleNamespace(**{c: b.column(c).to_numpy(zero_copy_only=False) for c in cols})
            yield pa.record_batch({"det_id": b.column("det_id"), field: pa.array(f(rows), pa.float64())})

    return df.select("det_id", *cols).mapInArrow(run, f"det_id long, {field} double")


def _corner(r) -> np.ndarray:
    """A triangle in the box: two corners on the upper side, the third on the lower one, at a place that cls says."""
    return np.array([[r.x1, r.y1], [r.x2, r.y1], [r.x1 + (r.x2 - r.x1) * r.cls / 4, r.y2]])


_BOX = ("x1", "y1", "x2", "y2", "conf", "cls")


def turned(r) -> tuple:
    """The least rectangle around the corners of a rotated box: its sides, and its angle's double angles."""
    w, h, t = r.x2 - r.x1, r.y2 - r.y1, r.conf * 3
    u, v = np.array([np.cos(t), np.sin(t)]) * w / 2, np.array([-np.sin(t), np.cos(t)]) * h / 2
    c = np.array([(r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2])
    x, y, a, b, k = P.min_area_rect(np.array([c + u + v, c - u + v, c - u - v, c + u - v]))
    return round(x, 4) + 0.0, round(y, 4) + 0.0, round(a, 4), round(b, 4), (round(float(np.cos(2 * k)), 4) + 0.0 if a - b > 1e-6 else 0.0)


register("p17_xyxyxyxy2xywhr", f"SELECT det_id, round((x1 + x2) / 2, 4) + 0.0 AS cx, round((y1 + y2) / 2, 4) + 0.0 AS cy, round(greatest(x2 - x1, y2 - y1), 4) AS long, round(least(x2 - x1, y2 - y1), 4) AS short, CASE WHEN abs((x2 - x1) - (y2 - y1)) > 1e-6 THEN round(cos(2 * (conf * 3 + CASE WHEN x2 - x1 < y2 - y1 THEN pi() / 2 ELSE 0 END)), 4) + 0.0 ELSE 0.0 END AS turn FROM ({DET_SQL})")(
    lambda spark, sf_dir: shapes(detections(spark, sf_dir), turned, "cx double, cy double, long double, short double, turn double", *_BOX)
)


def _parts(r) -> tuple[np.ndarray, np.ndarray]:
    """Two triangles of a label: the second lies right of the first, turned by cls places and lower by its height."""
    p = _corner(r)
    return p, np.roll(p + [60 + r.conf * 100, (r.y2 - r.y1) * r.cls / 2], int(r.cls), axis=0)


_CORNERS = "[{'x': x1, 'y': y1}, {'x': x2, 'y': y1}, {'x': x1 + (x2 - x1) * cls / 4, 'y': y2}]"
_PARTS = f"SELECT *, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS p FROM (SELECT det_id, cls, conf, x1, y1, x2, y2, {_CORNERS} AS c FROM ({DET_SQL}))"
_NEAREST = f"WITH v AS ({_PARTS}), q AS (SELECT det_id, (i + cls) % 3 AS j, p.x + 60 + conf * 100 AS x, p.y + (y2 - y1) * cls / 2 AS y FROM v), n AS (SELECT v.det_id, v.i, q.j, (v.p.x - q.x) ** 2 + (v.p.y - q.y) ** 2 AS d FROM v JOIN q USING (det_id))"
register("p32_min_index", f"{_NEAREST} SELECT det_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY round(d, 6), i, j) AS r FROM n) WHERE r = 1")(
    lambda spark, sf_dir: shapes(detections(spark, sf_dir), lambda r: P.nearest(*_parts(r)), "i long, j long", *_BOX)
)
register("p31_merge_multi_segment", f"SELECT det_id, CAST(8 AS BIGINT) AS points, round((x2 - x1) * (y2 - y1), 4) AS area FROM ({DET_SQL})")(  # two triangles and the way between
    lambda spark, sf_dir: shapes(detections(spark, sf_dir), lambda r: (lambda j: (len(j), round(P.area(j), 4)))(P.join_rings(list(_parts(r)))), "points long, area double", *_BOX)
)
register("p54_validate_polygon", f"SELECT det_id, det_id % 5 > 1 AS ok FROM ({DET_SQL})")(
    lambda spark, sf_dir: (lambda p: detections(spark, sf_dir).withColumn("ring", F.expr(f"CASE det_id % 5 WHEN 0 THEN array({p('x1', 'y1')}, {p('x2', 'y1')}) WHEN 1 THEN array({p('x1', 'y1')}, {p('x2', 'y2')}, {p('(x1 + x2) / 2', '(y1 + y2) / 2')}) WHEN 2 THEN array({p('x1', 'y1')}, {p('x2', 'y1')}, {p('x1', 'y2')}) ELSE array({p('x1', 'y1')}, {p('x2', 'y1')}, {p('x2', 'y2')}, {p('x1', 'y2')}) END")).select("det_id", R.valid(F.col("ring")).alias("ok")))(lambda x, y: f"named_struct('x', {x}, 'y', {y})")
)


def bumped(r) -> np.ndarray:
    """A box with a point on each side, cls pixels off it in turn."""
    x, y = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2
    return np.array([[r.x1, r.y1], [x, r.y1 - r.cls], [r.x2, r.y1], [r.x2, y], [r.x2, r.y2], [x, r.y2 + r.cls], [r.x1, r.y2], [r.x1, y]])


for _n, _t in (("p57_fix_and_simplify_polygon", 0.5), ("p58_simplify_polygon", 1.5)):  # points off by more than the tolerance stay, on both sides
    register(_n, f"SELECT det_id, CAST(4 + CASE WHEN cls > {_t} THEN 2 ELSE 0 END AS BIGINT) AS points, round((x2 - x1) * (y2 - y1 + CASE WHEN cls > {_t} THEN cls ELSE 0 END), 4) AS area FROM ({DET_SQL})")(
        lambda spark, sf_dir, t=_t: shapes(detections(spark, sf_dir), lambda r: (lambda s: (len(s), round(P.area(s), 4)))(P.simplify(bumped(r), t)), "points long, area double", *_BOX)
    )


def _shifted(r) -> tuple[np.ndarray, np.ndarray]:
    """A right triangle in the box and the same, (cls + 1) quarters of its width further; for one row or for arrays."""
    p = np.stack([np.stack(c, -1) for c in ((r.x1, r.y1), (r.x2, r.y1), (r.x1, r.y2))], -2)
    return p, p + np.stack([(r.x2 - r.x1) * (r.cls + 1) / 4, 0 * r.x1], -1)[..., None, :]


_SHARED = "(x2 - x1) * (y2 - y1) / 2 * (1 - (cls + 1) / 4) ** 2"  # a smaller triangle of the same form
register("j30_calculate_polygon_iou", f"SELECT det_id, round({_SHARED} / ((x2 - x1) * (y2 - y1) - {_SHARED}), 5) AS iou FROM ({DET_SQL})")(
    lambda spark, sf_dir: shapes(detections(spark, sf_dir), lambda r: (round(P.convex_iou(*_shifted(r)), 5),), "iou double", *_BOX)
)
register("a21_merge_two_polygons", f"SELECT det_id, round((x2 - x1) * (y2 - y1) - {_SHARED}, 4) AS area FROM ({DET_SQL})")(
    lambda spark, sf_dir: many_shapes(detections(spark, sf_dir), lambda r: np.round(P.union_areas(list(_shifted(r))), 4), "area", *_BOX)
)

# Windows: crops of objects, of labelled sets at several rates, and of test images.
_RATE = "(VALUES (0.5::DOUBLE, 300, 80), (1.0, 150, 40), (2.0, 75, 20)) v(rate, size, gap)"
RATES = (0.5, 1.0, 2.0)


def crops(spark, sf_dir, size: float = 150.0, gap: float = 40.0):
    """Objects with 0.7 of their area in a window of images of 480 by 480, in its normalized coordinates."""
    step, n = size - gap, int(np.ceil((480 - size) / (size - gap))) + 1
    win = spark.range(n * n).select(F.col("id").alias("win"), ((F.col("id") % n) * step).alias("ox1"), (F.floor(F.col("id") / n) * step).alias("oy1"))
    win = win.withColumns({"ox2": F.col("ox1") + size, "oy2": F.col("oy1") + size})
    d = box_join(detections(spark, sf_dir), win, [], size, B.inter_area(B.col_box(), nms.other_box()) / B.area(B.col_box()) >= 0.7)
    b = B.xyxy_to_xywhn(B.clip_box(B.Box(F.col("x1") - F.col("ox1"), F.col("y1") - F.col("oy1"), F.col("x2") - F.col("ox1"), F.col("y2") - F.col("oy1")), size, size), size, size)
    return d.select("image_id", "det_id", "win", *[F.round(c, 6).alias(n) for c, n in zip(b, ("cx", "cy", "w", "h"), strict=True)])


def _crop_sql(size: int, gap: int) -> str:
    step, n = size - gap, int(np.ceil((480 - size) / (size - gap))) + 1
    return f"d AS ({DET_SQL}), w AS (SELECT i AS win, (i % {n} * {step})::DOUBLE AS a, (i // {n} * {step})::DOUBLE AS b FROM range(0, {n * n}) t(i)), c AS (SELECT *, least({size}, greatest(0, x1 - a)) AS p, least({size}, greatest(0, y1 - b)) AS q, least({size}, greatest(0, x2 - a)) AS r, least({size}, greatest(0, y2 - b)) AS s FROM d, w WHERE greatest(0, least(x2, a + {size}) - greatest(x1, a)) * greatest(0, least(y2, b + {size}) - greatest(y1, b)) / ((x2 - x1) * (y2 - y1)) >= 0.7)"


register("t17_split_images_and_labels", f"WITH {_crop_sql(150, 40)} SELECT image_id, win, count(*) AS objects, round(sum((r - p) * (s - q)) / 22500, 4) AS filled FROM c GROUP BY ALL")(
    lambda spark, sf_dir: crops(spark, sf_dir).groupBy("image_id", "win").agg(F.count("*").alias("objects"), F.round(F.sum(F.col("w") * F.col("h")), 4).alias("filled"))
)


def at_rates(spark, sf_dir):
    """Train and val split of the images, cropped at each rate: sizes and gaps are those of rate 1 by the rate."""
    out = None
    for rate in RATES:
        c = crops(spark, sf_dir, 150 / rate, 40 / rate).select(F.lit(rate).alias("rate"), F.when(F.col("image_id") % 4 == 0, "val").otherwise("train").alias("split"), "win")
        out = c if out is None else out.unionByName(c)
    return out.groupBy("rate", "split", "win").agg(F.count("*").alias("objects"))


register("t18_split_trainval", " UNION ALL ".join(f"SELECT * FROM (WITH {_crop_sql(int(150 / r), int(40 / r))} SELECT {r}::DOUBLE AS rate, CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, win, count(*) AS objects FROM c GROUP BY ALL)" for r in RATES))(at_rates)


def _window_sql(size: str = "size", gap: str = "gap", source: str = "i") -> str:
    """Windows of images, by the rule of T13; source has image_id, height, width and what else is kept in k."""
    start = lambda n, i: f"CASE WHEN {i} > 0 AND {i} * ({size} - {gap}) + {size} > {n} THEN {n} - {size} ELSE {i} * ({size} - {gap}) END"
    steps = lambda n: f"range(0, greatest(ceil(({n} - {size}) / ({size} - {gap})::DOUBLE), 0)::INT + 1)"
    return f"x AS (SELECT *, unnest({steps('width')}) AS a FROM {source}), y AS (SELECT *, unnest({steps('height')}) AS b FROM x), z AS (SELECT DISTINCT k, image_id, height, width, {size} AS s, CAST({start('width', 'a')} AS INT) AS x1, CAST({start('height', 'b')} AS INT) AS y1 FROM y), r AS (SELECT *, (least(width, x1 + s) - greatest(x1, 0)) * (least(height, y1 + s) - greatest(y1, 0)) / (s * s)::DOUBLE AS rate FROM z), m AS (SELECT *, max(rate) OVER (PARTITION BY k, image_id) AS best FROM r), wins AS (SELECT k, image_id, x1, y1, CAST(x1 + s AS INT) AS x2, CAST(y1 + s AS INT) AS y2 FROM m WHERE rate > 0.6 OR (best <= 0.6 AND rate >= best - 0.01))"


register("t13_get_windows", f"WITH i AS (SELECT *, 0 AS k, 128 AS size, 32 AS gap FROM ({IMG_SQL})), {_window_sql()} SELECT image_id, x1, y1, x2, y2 FROM wins")(lambda spark, sf_dir: tiles.windows(images(spark, sf_dir), 128, 32))


def rate_windows(spark, sf_dir):
    """The windows of test images at each rate, which have no labels."""
    out = None
    for rate in RATES:
        w = tiles.windows(images(spark, sf_dir), int(150 / rate), int(40 / rate)).withColumn("rate", F.lit(rate))
        out = w if out is None else out.unionByName(w)
    return out.select("rate", "image_id", "x1", "y1")


register("t19_split_test", f"WITH i AS (SELECT *, rate AS k FROM ({IMG_SQL}), {_RATE}), {_window_sql()} SELECT k AS rate, image_id, x1, y1 FROM wins")(rate_windows)


def tile_iou(spark, sf_dir):
    """The IoU of the rectangles of neighbouring tiles."""
    corners = lambda p: [F.col(f"{p}col_off").alias(f"{p[:1]}x1"), F.col(f"{p}row_off").alias(f"{p[:1]}y1"), (F.col(f"{p}col_off") + F.col(f"{p}w")).alias(f"{p[:1]}x2"), (F.col(f"{p}row_off") + F.col(f"{p}h")).alias(f"{p[:1]}y2")]
    n = tiles.neighbours(images(spark, sf_dir), 128, 0.25).select("image_id", "tile_id", "other_id", *corners(""), *corners("o_"))
    return n.select("image_id", "tile_id", "other_id", F.round(B.iou(B.col_box(), nms.other_box(), 0), 6).alias("iou"))


_TI = "(greatest(0, least(a.col_off + a.w, b.col_off + b.w) - greatest(a.col_off, b.col_off)) * greatest(0, least(a.row_off + a.h, b.row_off + b.h) - greatest(a.row_off, b.row_off)))::DOUBLE"
register("j21_mask_bbox_iou_of_tiles", f"WITH {_TILE} SELECT a.image_id, a.tile_id, b.tile_id AS other_id, round({_TI} / (a.w * a.h + b.w * b.h - {_TI}), 6) AS iou FROM t a JOIN t b ON a.image_id = b.image_id AND a.tile_id <> b.tile_id AND abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1")(tile_iou)

# Masks merged over tiles: which pairs link depends on the variant, what merges is their pixels.
WIDE = 1 << 31  # columns of tiles: a tile's row and column are one number
STRIP = "((x1 < 256 AND x2 > 192) OR (y1 < 256 AND y2 > 192))"


def mask_groups(spark, sf_dir, least: float | None, near: bool, same: bool, strip: bool = False) -> DataFrame:
    """group_id, members, cls (the commonest, the smaller on ties) and size (of the union) of merged masks.

    Masks of an image that share a pixel link, where asked only those with a window IoU above least, in neighbouring
    tiles, of the same class; with strip only masks that touch the strip that tiles share merge, the others stay alone.
    """
    det = detections(spark, sf_dir, False).withColumns({"tile": (F.floor((F.col("y1") + F.col("y2")) / 200) + WIDE // 2) * WIDE + F.floor((F.col("x1") + F.col("x2")) / 200) + WIDE // 2, "strip": F.expr(STRIP)})
    also = ["cls", "conf", *["tile"] * near, *["strip"] * strip]

    def test(a, b, iou):
        ok = (iou > (-1.0 if least is None else least)) & ((a("cls") == b("cls")) | (not same))
        if near:
            c = a("tile") % WIDE - b("tile") % WIDE
            r = (a("tile") - b("tile") - c) / WIDE
            ok = ok & (r >= -1) & (r <= 1) & (c >= -1) & (c <= 1) & ((r != 0) | (c != 0))
        return ok & a("strip") & b("strip") if strip else ok

    return M.merge_pieces(M.packed_pieces(det, *also), test, True, False).select("group_id", "members", "cls", "size")


def _mask_sql(least: float | None, near: bool, same: bool, strip: bool = False) -> str:
    test = " AND ".join([f"iou > {least}"] * (least is not None) + ["x.cls = y.cls"] * same + ["abs(x.tr - y.tr) <= 1 AND abs(x.tc - y.tc) <= 1 AND (x.tr <> y.tr OR x.tc <> y.tc)"] * near + ["x.strip AND y.strip"] * strip) or "true"
    links = _WIN.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + f", t AS (SELECT det_id, cls, floor((y1+y2)/200) AS tr, floor((x1+x2)/200) AS tc, {STRIP} AS strip FROM d), i AS (SELECT a, b, inter / (n2 - inter) AS iou FROM w JOIN o USING (a, b)), l AS (SELECT a AS u, b AS v FROM i JOIN t x ON x.det_id = a JOIN t y ON y.det_id = b WHERE {test})"
    groups = ", s AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), r AS (SELECT det_id AS a, det_id AS b FROM d UNION SELECT r.a, s.v FROM r JOIN s ON r.b = s.u), c AS (SELECT a AS det_id, min(b) AS group_id FROM r GROUP BY a)"
    told = ", k AS (SELECT group_id, cls, count(*) AS n FROM c JOIN d USING (det_id) GROUP BY ALL), v AS (SELECT group_id, CAST(sum(n) AS BIGINT) AS members, arg_max(cls, n * 10 - cls) AS cls FROM k GROUP BY group_id), z AS (SELECT group_id, count(DISTINCT (row, col)) AS size FROM px JOIN c USING (det_id) GROUP BY group_id)"
    return f"{links}{groups}{told} SELECT group_id, members, cls, size FROM v JOIN z USING (group_id)"


for _n, _a in (
    ("a11_find_spatially_connected_groups", (None, True, False)), ("a12_merge_masks_by_overlap_region", (0.2, False, True, True)), ("a13_merge_overlapping_masks_only", (0.2, True, True)),
    ("a14_merge_masks_with_iou", (0.2, False, True)), ("a15_merge_masks_with_iou_optimized", (0.2, True, False)),
):
    register(_n, _mask_sql(*_a))(lambda spark, sf_dir, a=_a: mask_groups(spark, sf_dir, *a))
register("a7_merge_segmentation", _MM.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + ", s AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), r AS (SELECT det_id AS a, det_id AS b FROM d UNION SELECT r.a, s.v FROM r JOIN s ON r.b = s.u), c AS (SELECT a AS det_id, min(b) AS group_id FROM r GROUP BY a) SELECT group_id, row, col FROM px JOIN c USING (det_id) GROUP BY ALL")(
    lambda spark, sf_dir: M.merged_pixels(pixels(spark, sf_dir)).select("group_id", "row", "col")
)
register("a19_compact_instance_map", f"{_PX}, i AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS k FROM d), m AS (SELECT image_id, row, col, max(k) AS k FROM px JOIN i USING (image_id, det_id) GROUP BY ALL), s AS (SELECT image_id, k, dense_rank() OVER (PARTITION BY image_id ORDER BY k) AS instance FROM (SELECT DISTINCT image_id, k FROM m)) SELECT image_id, CAST(instance AS INT) AS instance, count(*) AS pixels, CAST(min(row) AS INT) AS top, CAST(max(col) AS INT) AS right_ FROM m JOIN s USING (image_id, k) GROUP BY ALL")(
    lambda spark, sf_dir: M.compact_instances(M.box_pieces(detections(spark, sf_dir, False)))
)


def merged_shapes(spark, sf_dir, det: DataFrame | None = None) -> DataFrame:
    """The groups of A10 with the union of their boxes as parts, and its area: filtered at the image's edge."""
    ship(spark)
    det = boundary_filter(detections(spark, sf_dir), 400, 400) if det is None else det
    links = box_join(det, others(det, "det_id", keys=("image_id", "cls")), ["image_id", "cls"], 64.0, (F.col("det_id") < F.col("odet_id")) & (B.coverage(B.col_box(), nms.other_box()) >= 0.3)).select("det_id", "odet_id")
    of = det.join(components(links, "det_id", "odet_id"), F.col("det_id") == F.col("node"), "left").withColumn("group_id", F.coalesce("comp", "det_id"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = P.union([np.array([[a, b], [c, b], [c, d], [a, d]]) for a, b, c, d in pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)])
        return pd.DataFrame({"image_id": [int(key[0])], "cls": [int(key[1])], "group_id": [int(key[2])], "members": [len(pdf)], "conf": [float(pdf.conf.max())], "area": [P.area_of(parts)], "parts": [[p.tolist() for p in parts]]})

    sizes = of.groupBy("group_id").agg(F.count("*").alias("members"))
    of = materialize(of.join(sizes, "group_id").select("image_id", "cls", "group_id", "members", "conf", "x1", "y1", "x2", "y2"), "groups")
    ring = F.expr("array(array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)))")
    alone = of.where("members = 1").select("image_id", "cls", "group_id", "members", "conf", B.area(B.col_box()).alias("area"), ring.alias("parts"))
    return alone.unionByName(of.where("members > 1").groupBy("image_id", "cls", "group_id").applyInPandas(run, "image_id long, cls int, group_id long, members long, conf double, area double, parts array<array<array<double>>>"))


register("a9_merge_polygons_vector")(merged_shapes)
register("a17_build_merged_results", _MERGE + " SELECT group_id, count(*) AS members, max(conf) AS conf, count(*) > 1 AS merged FROM d JOIN c USING (det_id) GROUP BY group_id")(
    lambda spark, sf_dir: merge_boxes(detections(spark, sf_dir)).select("group_id", "members", "conf", (F.col("members") > 1).alias("merged"))
)

# Evaluation of masks, keypoints and rotated boxes, by the one-to-one rule at ten thresholds.


def mask_pairs(spark, sf_dir) -> DataFrame:
    """det_id, oid, conf and the mask IoU of detections and labels of an image and class."""
    det = detections(spark, sf_dir, False)
    buckets = M.pack_buckets(det)
    d = M.packed_pieces(det, "cls", "conf", buckets=buckets)
    t = M.packed_pieces(det.where("det_id % 3 = 0").selectExpr(*_GT).withColumnRenamed("gt_id", "det_id"), "cls", buckets=buckets)
    return M.piece_pairs(d, t, ("cls",), False).select(F.col("a").alias("det_id"), F.col("b").alias("oid"), F.col("a_conf").alias("conf"), (F.col("inter") / (F.col("a_n") + F.col("b_n") - F.col("inter"))).alias("iou"))


_SIGMA = (0.05, 0.1, 0.2)
_KEYS = [("x1", "y1"), ("x2", "y2"), ("cx", "cy")]


def oks_pairs(spark, sf_dir) -> DataFrame:
    """The similarity of keypoints of overlapping detections and labels: corners and centre, by the label's area."""
    g = ground_truth(spark, sf_dir).withColumnRenamed("gt_id", "id")
    p = box_join(detections(spark, sf_dir), others(g, "id", keys=("image_id", "cls")), ["image_id", "cls"], 64.0)
    at = lambda s: {"x1": F.col(f"{s}x1"), "y1": F.col(f"{s}y1"), "x2": F.col(f"{s}x2"), "y2": F.col(f"{s}y2"), "cx": (F.col(f"{s}x1") + F.col(f"{s}x2")) / 2, "cy": (F.col(f"{s}y1") + F.col(f"{s}y2")) / 2}
    a, b = at(""), at("o")
    area = (F.col("ox2") - F.col("ox1")) * (F.col("oy2") - F.col("oy1")) * 0.53
    part = [F.exp(-((a[x] - b[x]) ** 2 + (a[y] - b[y]) ** 2) / ((2 * s) ** 2 * (area + 1e-7) * 2)) for (x, y), s in zip(_KEYS, _SIGMA, strict=True)]
    return p.select("det_id", "oid", "conf", ((part[0] + part[1] + part[2]) / 3).alias("iou"))


def rotated(p: str) -> B.Rotated:
    x1, y1, x2, y2 = (F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))
    return B.Rotated((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, (x1 + y1) / 100)


def obb_pairs(spark, sf_dir) -> DataFrame:
    """The probabilistic IoU of rotated boxes of detections and labels, each with an angle of its own."""
    g = ground_truth(spark, sf_dir).withColumnRenamed("gt_id", "id")
    p = box_join(detections(spark, sf_dir), others(g, "id", keys=("image_id", "cls")), ["image_id", "cls"], 64.0)
    return p.select("det_id", "oid", "conf", B.prob_iou(rotated(""), rotated("o")).alias("iou"))


def _rule_sql(pairs: str) -> str:
    """The matches m as of boxes, from other pairs p (det_id, gt_id, conf, iou)."""
    a, b = _MATCH.index(", p AS ("), _MATCH.index(",\n  q AS")
    return _MATCH[:a] + pairs + _MATCH[b:]


def _curve_sql(pairs: str) -> str:
    return _rule_sql(pairs) + _CURVE[len(_MATCH) :]


_GCELL = "px AS (SELECT det_id, image_id, cls, conf, row, unnest(range(floor(x1/8)::INT, floor(x2/8)::INT + 1)) AS col FROM (SELECT *, unnest(range(floor(y1/8)::INT, floor(y2/8)::INT + 1)) AS row FROM d)), gx AS (SELECT gt_id, image_id, cls, row, unnest(range(floor(x1/8)::INT, floor(x2/8)::INT + 1)) AS col FROM (SELECT *, unnest(range(floor(y1/8)::INT, floor(y2/8)::INT + 1)) AS row FROM g))"
_MASKP = f", {_GCELL}, nd AS (SELECT det_id, conf, count(*) AS n FROM px GROUP BY ALL), ng AS (SELECT gt_id, count(*) AS n FROM gx GROUP BY ALL), ii AS (SELECT px.det_id, gx.gt_id, count(*) AS i FROM px JOIN gx USING (image_id, cls, row, col) GROUP BY ALL), p AS (SELECT det_id, gt_id, conf, i / (nd.n + ng.n - i) AS iou FROM ii JOIN nd USING (det_id) JOIN ng USING (gt_id) WHERE i / (nd.n + ng.n - i) >= 0.5)"
_ON = "a.image_id = b.image_id AND a.cls = b.cls AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_OKS = "(" + " + ".join(f"exp(-(({x('a')} - {x('b')}) ** 2 + ({y('a')} - {y('b')}) ** 2) / ({(2 * s) ** 2!r} * ((b.x2 - b.x1) * (b.y2 - b.y1) * 0.53 + 1e-7) * 2))" for (x, y), s in zip([(lambda t: f"{t}.x1", lambda t: f"{t}.y1"), (lambda t: f"{t}.x2", lambda t: f"{t}.y2"), (lambda t: f"({t}.x1 + {t}.x2) / 2", lambda t: f"({t}.y1 + {t}.y2) / 2")], _SIGMA, strict=True)) + ") / 3"
_OKSP = f", p AS (SELECT * FROM (SELECT a.det_id, b.gt_id, a.conf, {_OKS} AS iou FROM d a JOIN g b ON {_ON}) WHERE iou >= 0.5)"
for _n, _m, _pairs, _sql in (("j43_segment_process_batch", "a30_segment_metrics_process", mask_pairs, _MASKP), ("j44_pose_process_batch", "a31_pose_metrics_process", oks_pairs, _OKSP), ("j45_obb_process_batch", None, obb_pairs, None)):
    register(_n, _sql and f"{_rule_sql(_sql)} SELECT det_id, gt_id, thr FROM m")(lambda spark, sf_dir, f=_pairs: E.one_to_one(f(spark, sf_dir)))
    if _m:
        register(_m, f"{_curve_sql(_sql)} SELECT cls, thr, CAST(sum(tp) AS BIGINT) AS tp, count(*) AS n, round(sum(tp) / any_value(labels), 6) AS recall FROM tp JOIN n USING (cls) GROUP BY cls, thr")(
            lambda spark, sf_dir, f=_pairs: E.recalls(E.flagged(detections(spark, sf_dir), E.one_to_one(f(spark, sf_dir))), ground_truth(spark, sf_dir)).withColumn("recall", F.round("recall", 6))
        )

# Smoothing, sources in memory, cached labels.


def gaussian(df: DataFrame, keys: list[str], order: str, value: str, sigma: int = 3) -> DataFrame:
    """Value filtered with a Gaussian of sigma within keys, cut at four sigma; beyond the ends it is mirrored."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    at = rows.select("*", F.explode(F.sequence(F.lit(-4 * sigma), F.lit(4 * sigma))).alias("__d")).withColumn("__m", F.pmod(F.col("__i") + F.col("__d"), 2 * F.col("__n")))
    at = at.select(*keys, order, F.exp(-F.col("__d") * F.col("__d") / (2.0 * sigma * sigma)).alias("__k"), F.least("__m", 2 * F.col("__n") - 1 - F.col("__m")).alias("__j"))
    near = rows.select(*keys, F.col("__i").alias("__j"), F.col(value).alias("__v"))
    return at.join(near, [*keys, "__j"]).groupBy(*keys, order).agg((F.sum(F.col("__k") * F.col("__v")) / F.sum("__k")).alias("smooth"))


register("w12_plot_results", "WITH e AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), a AS (SELECT user_id, event_id, n, exp(-d * d / 18.0::DOUBLE) AS k, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS m FROM e, range(-12, 13) t(d)) SELECT a.event_id, round(sum(k * value) / sum(k), 5) AS s FROM a JOIN e ON e.user_id = a.user_id AND e.i = least(m, 2 * a.n - 1 - m) GROUP BY a.event_id")(
    lambda spark, sf_dir: gaussian(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("event_id", F.round("smooth", 5).alias("s"))
)


def in_memory(spark, rows: list, schema: str) -> DataFrame:
    """A bounded list that the driver holds, as a source: an entry a row, named by its place."""
    return spark.createDataFrame([(i, f"image{i}.jpg", r) for i, r in enumerate(rows)], f"id long, path string, value {schema}")


register("s12_load_in_memory", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id, 'image' || (row_number() OVER (ORDER BY n_nationkey) - 1) || '.jpg' AS path, n_name AS value FROM nation")(
    lambda spark, sf_dir: in_memory(spark, [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()], "string")
)
register("s13_load_tensor", "SELECT i AS id, 'image' || i || '.jpg' AS path, v[1] AS first, len(v) AS n FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, [n_nationkey * 1.5::DOUBLE, n_regionkey + 0.5::DOUBLE] AS v FROM nation)")(
    lambda spark, sf_dir: in_memory(spark, np.array([[r[0] * 1.5, r[1] + 0.5] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()]).tolist(), "array<double>").select("id", "path", F.col("value")[0].alias("first"), F.size("value").cast("long").alias("n"))
)


def cached(spark, sf_dir) -> DataFrame:
    """Labels by three runs: a first one that scans, one with the same hash, which reads the first one's snapshot though
    its own source is empty, and one with another hash, which scans again."""
    from tessel.plans.more import snapshot

    path, d = work_path(spark, "labels"), detections(spark, sf_dir)
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("size"))
    old, new = D.file_hash(files).first()[0], D.file_hash(files.limit(1)).first()[0]
    runs = [snapshot(d, path, old), snapshot(d.where("false"), path, old), snapshot(d.where("cls = 0"), path, new)]
    out = None
    for i, r in enumerate(runs):
        r = r.groupBy("cls").agg(F.count("*").alias("n")).select(F.lit(i).alias("run"), "cls", "n")
        out = r if out is None else out.unionByName(r)
    return out


register("s20_get_labels", f"WITH d AS ({DET_SQL}), n AS (SELECT cls, count(*) AS n FROM d GROUP BY cls) SELECT 0 AS run, cls, n FROM n UNION ALL SELECT 1, cls, n FROM n UNION ALL SELECT 2, cls, n FROM n WHERE cls = 0")(cached)
