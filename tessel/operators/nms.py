"""Non-maximum suppression in its three variants, and detection merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.boxes import Box, col_box, iou
from tessel.operators.spatial import box_join, others
from tessel.session import materialize, ship

MOST = 4096  # touching boxes of an image and class up to which one task settles them


def other_box() -> Box:
    return Box(*(F.col(c) for c in ("ox1", "oy1", "ox2", "oy2")))


def ahead():
    """Whether the other box stands before this one: a higher score, the smaller id on ties."""
    return (F.col("oconf") > F.col("conf")) | ((F.col("oconf") == F.col("conf")) & (F.col("odet_id") < F.col("det_id")))


def fast_nms(det: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id", "cls"), cell: float = 64.0) -> DataFrame:
    """A3: drop a box if any box of the same keys with a higher score, kept or not, has an IoU of at least threshold.

    A left anti join by id with the suppressed ones, which come from a gridded self join: no group is gathered.
    """
    hit = box_join(det, others(det, "conf", "det_id", keys=keys), list(keys), cell, ahead() & (iou(col_box(), other_box()) >= threshold))
    return det.join(hit.select("det_id").distinct(), "det_id", "left_anti").select(det.columns)


def greedy(boxes: np.ndarray, threshold: float, strict: bool) -> list[int]:
    """Rows kept by the greedy rule from boxes in order of score: those whose IoU with every kept box before stays in bounds."""
    kept: list[int] = []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i, b in enumerate(boxes):
        k = boxes[kept]
        inter = np.maximum(np.minimum(k[:, 2], b[2]) - np.maximum(k[:, 0], b[0]), 0) * np.maximum(np.minimum(k[:, 3], b[3]) - np.maximum(k[:, 1], b[1]), 0)
        value = inter / np.maximum(area[kept] + area[i] - inter, 1e-12)
        if (value < threshold).all() if strict else (value <= threshold).all():
            kept.append(i)
    return kept


def _greedy(threshold: float, strict: bool, key: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        conf, ids = table["conf"].to_numpy(), table["det_id"].to_numpy()
        order = np.lexsort((ids, -conf))
        boxes = np.stack([table[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)[order]
        return table.select(["det_id"]).take(pa.array(order[greedy(boxes, threshold, strict)]))

    return run


def _suppressed(pairs: DataFrame) -> DataFrame:
    """det_id of the boxes that the greedy rule drops, from all pairs (worse, better) beyond the bound.

    A box with no better one left is kept and drops its neighbours, which then drop nobody; what is left goes to the next
    round. For scores in no special order the rounds grow with the logarithm of the boxes; boxes that overlap in a row of
    falling scores (or equal ones, which ids order) take a round for two of them. A round is a few joins by id: no group
    is gathered.
    """
    pairs = materialize(pairs.select("worse", "better"), "overlaps")
    lost = pairs.select(F.col("worse").alias("det_id")).limit(0)
    while pairs.take(1):
        free = pairs.select("better").distinct().join(pairs.select(F.col("worse").alias("better")).distinct(), "better", "left_anti")
        gone = materialize(pairs.join(free, "better", "left_semi").select("worse").distinct(), "suppressed")
        lost = lost.unionByName(gone.select(F.col("worse").alias("det_id")))
        left = pairs.join(gone, "worse", "left_anti").join(gone.select(F.col("worse").alias("better")), "better", "left_anti")
        pairs = materialize(left, "overlaps")
    return lost


def greedy_nms(det: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id", "cls"), strict: bool = False, cell: float = 64.0, most: int = MOST) -> DataFrame:
    """A2, A4 (strict False: keep an IoU of at most threshold) and A5 (strict True: keep one below it).

    Boxes that touch no other beyond the bound are kept outright by a gridded join, whose pairs are written once. The rest
    run through the sequential rule by keys, where a suppressed box suppresses nobody; keys that have more than most of
    them (one raster that holds all boxes) go in rounds over the pairs, with the same result, so that no task holds them.
    """
    ship(det.sparkSession)
    over = iou(col_box(), other_box(), 0) >= threshold if strict else iou(col_box(), other_box(), 0) > threshold
    met = box_join(det, others(det, "conf", "det_id", keys=keys), list(keys), cell, ahead() & (F.col("odet_id") != F.col("det_id")) & over)
    pairs = materialize(met.select(*keys, F.col("det_id").alias("worse"), F.col("odet_id").alias("better")), "touching")
    touched = pairs.select(*keys, F.explode(F.array("worse", "better")).alias("det_id")).distinct()
    large = materialize(touched.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys), "large")
    touched = touched.join(large, list(keys), "left_anti").select("det_id")
    hard = det.join(touched, "det_id", "left_semi").select(*keys, "det_id", "conf", "x1", "y1", "x2", "y2")
    kept = hard.groupBy(*keys).applyInArrow(_greedy(threshold, strict, "det_id"), "det_id long")
    lost = touched.join(kept, "det_id", "left_anti").unionByName(_suppressed(pairs.join(large, list(keys), "left_semi")))
    return det.join(lost, "det_id", "left_anti").select(det.columns)


def non_max_suppression(scores: DataFrame, conf: float, threshold: float, classes: list[int] | None = None, agnostic: bool = False, max_boxes: int = 30000, max_det: int = 300) -> DataFrame:
    """A1: confidence and class filters, the best max_boxes of an image, greedy NMS, the best max_det of an image.

    Ranks are by score and id. agnostic leaves the class out of the keys.
    """
    det = scores.where(F.col("conf") > conf)
    det = det.where(F.col("cls").isin(classes)) if classes is not None else det
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id"))
    det = det.withColumn("__r", rank).where(F.col("__r") <= max_boxes).drop("__r")
    det = greedy_nms(det, threshold, ("image_id",) if agnostic else ("image_id", "cls"))
    return det.withColumn("__r", rank).where(F.col("__r") <= max_det).drop("__r")
