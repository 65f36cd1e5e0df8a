"""Queries over box algebra: one projection each, pushed into the scan's stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import boxes as B
from tessel.plans.registry import register
from tessel.sources.derived import DET_SQL, detections

W, H = 400.0, 400.0
GEO = (500000.0, 0.5, 0.1, 4000000.0, -0.2, -0.5)


def _scalar(name: str, cols, sql: str, where: str | None = None) -> None:
    """A query of det_id and rounded expressions over the detections, and its statement."""

    def run(spark, sf_dir):
        det = detections(spark, sf_dir)
        det = det.where(where) if where else det
        return det.select("det_id", *[(F.round(c, 6) + 0.0).alias(n) if n[0] != "_" else c.alias(n[1:]) for n, c in cols().items()])

    outs = ", ".join(f"round({e}, 6) + 0.0 AS {n}" if n[0] != "_" else f"{e} AS {n[1:]}" for n, e in (x.split(" := ") for x in sql.strip().split(" ;; ")))
    register(name, f"WITH det AS ({DET_SQL}) SELECT det_id, {outs} FROM det" + (f" WHERE {where}" if where else ""))(run)


def _box(name: str, box, sql: str) -> None:
    _scalar(name, lambda: dict(zip("abcd", box(B.col_box()), strict=True)), " ;; ".join(f"{n} := {e}" for n, e in zip("abcd", sql.split(" | "), strict=True)))


XYWH = "(x1 + x2) / 2 | (y1 + y2) / 2 | x2 - x1 | y2 - y1"
_box("p9_xyxy2xywh", B.xyxy_to_xywh, XYWH)
_box("p10_xywh2xyxy", lambda b: B.xywh_to_xyxy(b), "x1 - x2 / 2 | y1 - y2 / 2 | x1 + x2 / 2 | y1 + y2 / 2")
_box("p11_xywhn2xyxy", lambda b: B.xywhn_to_xyxy(B.scale(b, 1 / W, 1 / H), W, H, 3, 5), "x1 - x2 / 2 + 3 | y1 - y2 / 2 + 5 | x1 + x2 / 2 + 3 | y1 + y2 / 2 + 5")
_box("p12_xyxy2xywhn", lambda b: B.xyxy_to_xywhn(b, W, H, True), "(x1 + least(x2, 400)) / 800 | (y1 + least(y2, 400)) / 800 | (least(x2, 400) - x1) / 400 | (least(y2, 400) - y1) / 400")
_box("p13_xywh2ltwh", B.xywh_to_ltwh, "x1 - x2 / 2 | y1 - y2 / 2 | x2 | y2")
_box("p14_xyxy2ltwh", B.xyxy_to_ltwh, "x1 | y1 | x2 - x1 | y2 - y1")
_box("p15_ltwh2xywh", B.ltwh_to_xywh, "x1 + x2 / 2 | y1 + y2 / 2 | x2 | y2")
_box("p16_ltwh2xyxy", B.ltwh_to_xyxy, "x1 | y1 | x1 + x2 | y1 + y2")
_box("p23_scale_boxes", lambda b: B.unletterbox(b, 320, 240, 400, 400), "greatest(0, least(320, x1 / 1.25)) | greatest(0, least(240, (y1 - 50) / 1.25)) | greatest(0, least(320, x2 / 1.25)) | greatest(0, least(240, (y2 - 50) / 1.25))")
_box("p25_clip_boxes", lambda b: B.clip_box(b, W, H), "least(x1, 400) | least(y1, 400) | least(x2, 400) | least(y2, 400)")
_box("p36_convert", lambda b: B.convert(B.convert(b, "xyxy", "ltwh"), "ltwh", "xywh"), XYWH)
_box("p40_fliplr", lambda b: B.flip_lr(b, W), "400 - x2 | y1 | 400 - x1 | y2")
_box("p41_flipud", lambda b: B.flip_ud(b, H), "x1 | 400 - y2 | x2 | 400 - y1")
_box("p42_normalize", lambda b: B.scale(b, 1 / W, 1 / H), "x1 / 400 | y1 / 400 | x2 / 400 | y2 / 400")
_box("p43_denormalize", lambda b: B.scale(b, 2.0, 3.0), "x1 * 2 | y1 * 3 | x2 * 2 | y2 * 3")
_box("p44_add_padding", lambda b: B.shift(b, 7.0, 9.0), "x1 + 7 | y1 + 9 | x2 + 7 | y2 + 9")
_box("p46_apply_bboxes", lambda b: B.project(b, [[0.5, -0.25, 10], [0.125, 0.75, 4], [0, 0, 1]]), "0.5 * x1 - 0.25 * y2 + 10 | 0.125 * x1 + 0.75 * y1 + 4 | 0.5 * x2 - 0.25 * y1 + 10 | 0.125 * x2 + 0.75 * y2 + 4")
_box("p50_letterbox", lambda b: B.shift(B.scale(b, 1.25, 1.25), *B.letterbox(320, 240, 400, 400)[1:]), "x1 * 1.25 | y1 * 1.25 + 50 | x2 * 1.25 | y2 * 1.25 + 50")
_box("p60_uncrop_boxes", lambda b: B.shift(b, 100.0, 50.0), "x1 + 100 | y1 + 50 | x2 + 100 | y2 + 50")
_scalar("p27_make_divisible", lambda: {"_n": B.make_divisible(F.col("x2"), 32).cast("long")}, "_n := CAST(ceil(x2 / 32) * 32 AS BIGINT)")
_scalar("p37_areas", lambda: {"area": B.area(B.col_box())}, "area := (x2 - x1) * (y2 - y1)")
_scalar(
    "p49_box_candidates",
    lambda: {"_keep": B.box_candidate(B.col_box(), B.clip_box(B.col_box(), 300.0, 380.0))},
    "_keep := least(x2, 300) - least(x1, 300) > 2 AND least(y2, 380) - least(y1, 380) > 2 AND (least(x2, 300) - least(x1, 300)) * (least(y2, 380) - least(y1, 380)) / ((x2 - x1) * (y2 - y1) + 1e-16) > 0.1"
    " AND greatest((least(x2, 300) - least(x1, 300)) / (least(y2, 380) - least(y1, 380) + 1e-16), (least(y2, 380) - least(y1, 380)) / (least(x2, 300) - least(x1, 300) + 1e-16)) < 100",
)
_scalar(
    "p59_is_box_near_crop_edge",
    lambda: {"_near": B.near_crop_edge(B.col_box(), (100.0, 100.0, 300.0, 300.0), (0.0, 0.0, 400.0, 400.0))},
    "_near := (x1 <= 20 AND NOT abs(x1 + 100) <= 20) OR (y1 <= 20 AND NOT abs(y1 + 100) <= 20) OR (abs(x2 - 200) <= 20 AND NOT abs(x2 - 300) <= 20) OR (abs(y2 - 200) <= 20 AND NOT abs(y2 - 300) <= 20)",
)
_scalar("p55_pixel_to_geo", lambda: dict(zip(("gx", "gy"), B.pixel_to_geo(F.col("x1"), F.col("y1"), GEO), strict=True)), "gx := 500000 + x1 * 0.5 + y1 * 0.1 ;; gy := 4000000 - x1 * 0.2 - y1 * 0.5")
_scalar(
    "p56_geo_to_pixel",
    lambda: dict(zip(("px", "py"), B.geo_to_pixel(*B.pixel_to_geo(F.col("x1"), F.col("y1"), GEO), GEO), strict=True)),
    "px := x1 ;; py := y1",
)
_R = lambda: B.Rotated(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("conf") * 6)
_scalar(
    "p18_xywhr2xyxyxyxy",
    lambda: dict(zip(("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"), B.corners(_R()), strict=True)),
    " ;; ".join(
        f"{n} := {p} + ({i}) * (x2 - x1) / 2 * {f}(conf * 6) + ({j}) * (y2 - y1) / 2 * {g}"
        for n, p, i, j, f, g in (
            ("ax", "x1", 1, -1, "cos", "sin(conf * 6)"), ("ay", "y1", 1, 1, "sin", "cos(conf * 6)"), ("bx", "x1", 1, 1, "cos", "sin(conf * 6)"), ("by", "y1", 1, -1, "sin", "cos(conf * 6)"),
            ("cx", "x1", -1, 1, "cos", "sin(conf * 6)"), ("cy", "y1", -1, -1, "sin", "cos(conf * 6)"), ("dx", "x1", -1, -1, "cos", "sin(conf * 6)"), ("dy", "y1", -1, 1, "sin", "cos(conf * 6)"),
        )
    ),
)
_scalar(
    "p19_regularize_rboxes",
    lambda: dict(zip(("w", "h", "r"), B.regularize(_R())[2:], strict=True)),
    "w := CASE WHEN fmod(conf * 6, pi()) >= pi() / 2 THEN y2 - y1 ELSE x2 - x1 END ;; h := CASE WHEN fmod(conf * 6, pi()) >= pi() / 2 THEN x2 - x1 ELSE y2 - y1 END ;; r := fmod(conf * 6, pi() / 2)",
)
_scalar(
    "j8_get_covariance_matrix",
    lambda: dict(zip("abc", B.covariance(_R()), strict=True)),
    "a := (x2-x1)**2/12*cos(conf*6)**2 + (y2-y1)**2/12*sin(conf*6)**2 ;; b := (x2-x1)**2/12*sin(conf*6)**2 + (y2-y1)**2/12*cos(conf*6)**2 ;; c := ((x2-x1)**2/12 - (y2-y1)**2/12)*cos(conf*6)*sin(conf*6)",
)
_scalar("j33_fuse_score", lambda: {"cost": B.fuse_score(F.col("x1") / 400, F.col("conf"))}, "cost := 1 - (1 - x1 / 400) * conf")
_I = "(greatest(0, least(x2, y2) - greatest(x1, y1)) * greatest(0, least(x2, 300) - greatest(y1, 100)))"


def _pair():
    b = B.col_box()
    return b, B.Box(b.b, F.lit(100.0), b.d, F.lit(300.0))


_OTHER = "y1 AS ox1, CAST(100 AS DOUBLE) AS oy1, y2 AS ox2, CAST(300 AS DOUBLE) AS oy2"


def _family(kind: str) -> str:
    inter = "greatest(0, least(x2, y2) - greatest(x1, y1)) * greatest(0, least(y2, 300) - greatest(y1, 100))"
    eps = "1e-7"
    base = f"(SELECT *, {inter} AS i, (x2-x1) AS w1, (y2-y1+{eps}) AS h1, (y2-y1) AS w2, (200+{eps}) AS h2, greatest(x2,y2)-least(x1,y1) AS cw, greatest(y2,300)-least(y1,100) AS ch, ((y1+y2-x1-x2)**2 + (400-y1-y2)**2)/4 AS rho FROM det)"
    base = f"(SELECT *, w1*h1 + w2*h2 - i + {eps} AS u FROM {base})"
    value = {"iou": "i/u", "giou": f"i/u - (cw*ch+{eps}-u)/(cw*ch+{eps})", "diou": f"i/u - rho/(cw*cw+ch*ch+{eps})"}
    v = "(4/pi()**2*(atan(w2/h2)-atan(w1/h1))**2)"
    value["ciou"] = f"i/u - (rho/(cw*cw+ch*ch+{eps}) + {v}*({v}/({v}-i/u+(1+{eps}))))"
    return f"WITH det AS ({DET_SQL}) SELECT det_id, round({value[kind]}, 6) AS v FROM {base}"


for _kind in ("iou", "giou", "diou", "ciou"):
    register(f"j3_bbox_iou_{_kind}", _family(_kind))(lambda spark, sf_dir, k=_kind: detections(spark, sf_dir).select("det_id", F.round(B.iou_family(*_pair(), k), 6).alias("v")))
register(
    "j1_bbox_ioa",
    f"WITH det AS ({DET_SQL}) SELECT det_id, round(greatest(0, least(x2, y2) - greatest(x1, y1)) * greatest(0, least(y2, 300) - greatest(y1, 100)) / ((y2 - y1) * 200 + 1e-7), 6) AS v FROM det",
)(lambda spark, sf_dir: detections(spark, sf_dir).select("det_id", F.round(B.ioa(*_pair()), 6).alias("v")))
register(
    "p39_remove_zero_area_boxes",
    f"WITH det AS ({DET_SQL}) SELECT det_id, least(x1, 390) AS x1, least(y1, 390) AS y1, least(x2, 390) AS x2, least(y2, 390) AS y2 FROM det WHERE x1 < 390 AND y1 < 390",
)(lambda spark, sf_dir: (lambda d: d.where(B.area(B.col_box()) > 0))(detections(spark, sf_dir).select("det_id", *B.named(B.clip_box(B.col_box(), 390.0, 390.0)))))
register("p8_update_labels", f"WITH det AS ({DET_SQL}) SELECT det_id, 0 AS cls FROM det WHERE cls IN (0, 2)")(
    lambda spark, sf_dir: detections(spark, sf_dir).where(F.col("cls").isin(0, 2)).select("det_id", F.lit(0).alias("cls"))
)
register("p45_concatenate", f"WITH det AS ({DET_SQL}), u AS (SELECT 'a' AS part, det_id, cls FROM det WHERE cls = 0 UNION ALL SELECT 'b', det_id, cls FROM det WHERE conf > 0.3) SELECT * FROM u")(
    lambda spark, sf_dir: (lambda d: d.where("cls = 0").select(F.lit("a").alias("part"), "det_id", "cls").unionByName(d.where("conf > 0.3").select(F.lit("b").alias("part"), "det_id", "cls")))(detections(spark, sf_dir))
)
register("p53_filter_results_by_tile", f"WITH det AS ({DET_SQL}) SELECT det_id FROM det WHERE x1 <= 200 AND x2 >= 100 AND y1 <= 220 AND y2 >= 120 AND conf >= 0.25")(
    lambda spark, sf_dir: detections(spark, sf_dir).where("x1 <= 200 AND x2 >= 100 AND y1 <= 220 AND y2 >= 120 AND conf >= 0.25").select("det_id")
)
register(
    "p51_filter_boundary_detections",
    f"WITH det AS ({DET_SQL}), c AS (SELECT * FROM det WHERE (x1+x2)/2 >= 0 AND (x1+x2)/2 < 400 AND (y1+y2)/2 >= 0 AND (y1+y2)/2 < 400) SELECT det_id, least(x1, 399) AS x1, least(y1, 399) AS y1, least(x2, 399) AS x2, least(y2, 399) AS y2 FROM c WHERE least(x2, 399) > least(x1, 399) AND least(y2, 399) > least(y1, 399)",
)(lambda spark, sf_dir: boundary_filter(detections(spark, sf_dir), 400, 400).select("det_id", "x1", "y1", "x2", "y2"))


def boundary_filter(det, w: int, h: int):
    """Boxes with their centre in the image, clipped to its pixels, that keep an area."""
    b = B.col_box()
    c = B.xyxy_to_xywh(b)
    det = det.where((c.a >= 0) & (c.a < w) & (c.b >= 0) & (c.b < h))
    clipped = B.clip_box(b, float(w - 1), float(h - 1))
    return det.withColumns(dict(zip(("x1", "y1", "x2", "y2"), clipped, strict=True))).where("x2 > x1 AND y2 > y1")
