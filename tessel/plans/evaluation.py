"""Queries over detection evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import evaluation as E
from tessel.plans.registry import register
from tessel.sources.derived import DET_SQL, GT_SQL, detections, ground_truth, table

_THR = ", ".join(f"({t})" for t in E.THRESHOLDS)
_I = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_IOU = f"({_I} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_I} + 1e-7))"
_BASE = f"WITH d AS ({DET_SQL}), g AS ({GT_SQL}), thr AS (SELECT CAST(t AS DOUBLE) AS thr FROM (VALUES {_THR}) v(t))"
_MATCH = f"""{_BASE}, p AS (SELECT a.det_id, b.gt_id, a.conf, {_IOU} AS iou FROM d a JOIN g b ON a.image_id = b.image_id AND a.cls = b.cls WHERE {_IOU} >= 0.5),
  q AS (SELECT *, row_number() OVER (PARTITION BY det_id, thr ORDER BY iou DESC, gt_id) AS r FROM p, thr WHERE iou >= thr),
  m AS (SELECT det_id, gt_id, thr FROM (SELECT *, row_number() OVER (PARTITION BY gt_id, thr ORDER BY conf DESC, det_id) AS s FROM q WHERE r = 1) WHERE s = 1)"""
_CURVE = f"""{_MATCH}, tp AS (SELECT d.det_id, d.cls, d.conf, t.thr, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM d CROSS JOIN thr t LEFT JOIN m ON m.det_id = d.det_id AND m.thr = t.thr),
  n AS (SELECT cls, count(*) AS labels FROM g GROUP BY cls),
  c AS (SELECT cls, thr, det_id, conf, row_number() OVER w AS rank, sum(tp) OVER w / (labels + 1e-16) AS recall, sum(tp) OVER w / row_number() OVER w AS precision FROM tp JOIN n USING (cls)
        WINDOW w AS (PARTITION BY cls, thr ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING))"""
_AP = f"""{_CURVE}, pts AS (SELECT cls, thr, rank, recall, precision FROM c UNION ALL SELECT DISTINCT cls, thr, 0, 0.0, 1.0 FROM c UNION ALL SELECT cls, thr, max(rank) + 1, 1.0, 0.0 FROM c GROUP BY ALL),
  env AS (SELECT cls, thr, rank, recall, max(precision) OVER (PARTITION BY cls, thr ORDER BY rank DESC) AS e FROM pts),
  seg AS (SELECT *, lead(recall) OVER w AS r2, lead(e) OVER w AS e2 FROM env WINDOW w AS (PARTITION BY cls, thr ORDER BY rank)),
  x AS (SELECT CAST(i AS DOUBLE) / 100 AS x FROM range(0, 101) t(i)),
  y AS (SELECT cls, thr, x, arg_max(CASE WHEN r2 IS NULL OR r2 <= recall THEN e ELSE e + (e2 - e) * (x - recall) / (r2 - recall) END, rank) AS y FROM x JOIN seg ON recall <= x GROUP BY cls, thr, x),
  ap AS (SELECT cls, thr, sum((y + n) / 2) / 100 AS ap FROM (SELECT *, lead(y) OVER (PARTITION BY cls, thr ORDER BY x) AS n FROM y) WHERE n IS NOT NULL GROUP BY cls, thr)"""


def matched(spark, sf_dir):
    return E.match_predictions(detections(spark, sf_dir), ground_truth(spark, sf_dir))


def curve(spark, sf_dir):
    truth = ground_truth(spark, sf_dir)
    pred = detections(spark, sf_dir)
    return E.precision_recall(pred, truth, E.match_predictions(pred, truth))


def confused(spark, sf_dir):
    return E.confusion(detections(spark, sf_dir), ground_truth(spark, sf_dir))


for _name in ("j35_match_predictions", "j42_process_batch"):
    register(_name, f"{_MATCH} SELECT det_id, gt_id, thr FROM m")(matched)
register("a28_update_stats", f"{_CURVE} SELECT thr, cls, sum(tp) AS tp, count(*) AS n FROM tp GROUP BY ALL")(
    lambda spark, sf_dir: E.true_positives(detections(spark, sf_dir), ground_truth(spark, sf_dir)).groupBy("thr", "cls").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
)
register("w1_ap_per_class", f"{_CURVE} SELECT cls, thr, det_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM c WHERE thr IN (0.5, 0.75)")(
    lambda spark, sf_dir: curve(spark, sf_dir).where("thr IN (0.5, 0.75)").select("cls", "thr", "det_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
)
register("w2_compute_ap", f"{_AP} SELECT cls, thr, round(ap, 6) AS ap FROM ap")(lambda spark, sf_dir: E.average_precision(curve(spark, sf_dir)).select("cls", "thr", F.round("ap", 6).alias("ap")))
register("a33_mean_results", f"{_AP} SELECT round(avg(ap) FILTER (thr = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95, round(avg(ap), 6) AS fitness FROM ap")(
    lambda spark, sf_dir: E.mean_ap(E.average_precision(curve(spark, sf_dir))).select(*[F.round(c, 6).alias(c) for c in ("map50", "map50_95", "fitness")])
)
register("a35_fitness", f"{_AP} SELECT round(avg(ap), 6) AS fitness FROM ap")(lambda spark, sf_dir: E.mean_ap(E.average_precision(curve(spark, sf_dir))).select(F.round("fitness", 6).alias("fitness")))
register("a34_maps", f"{_AP}, k AS (SELECT cls, avg(ap) AS ap FROM ap GROUP BY cls) SELECT CAST(i AS INT) AS cls, round(coalesce(k.ap, (SELECT avg(ap) FROM k)), 6) AS ap FROM range(0, 5) t(i) LEFT JOIN k ON k.cls = i")(
    lambda spark, sf_dir: maps(E.average_precision(curve(spark, sf_dir)), 5)
)
register("a29_process", f"WITH g AS ({GT_SQL}) SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images FROM g GROUP BY cls")(
    lambda spark, sf_dir: ground_truth(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
)


def maps(ap, classes: int):
    """Each class's mean AP, that of all where it has none."""
    own = ap.groupBy("cls").agg(F.avg("ap").alias("ap"))
    mean = own.agg(F.avg("ap").alias("mean"))
    every = ap.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(own, "cls", "left").join(F.broadcast(mean)).select("cls", F.round(F.coalesce("ap", "mean"), 6).alias("ap"))


_CM = f"""{_BASE}, p AS (SELECT a.det_id, b.gt_id, a.cls AS pc, b.cls AS ac, {_IOU} AS iou FROM d a JOIN g b ON a.image_id = b.image_id WHERE a.conf > 0.25 AND {_IOU} > 0.45),
  q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS r FROM p) WHERE r = 1),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, det_id) AS s FROM q) WHERE s = 1),
  cm AS (SELECT predicted, actual, count(*) AS n FROM (SELECT pc AS predicted, ac AS actual FROM k UNION ALL SELECT cls, -1 FROM d WHERE conf > 0.25 AND det_id NOT IN (SELECT det_id FROM k) UNION ALL SELECT -1, cls FROM g WHERE gt_id NOT IN (SELECT gt_id FROM k)) GROUP BY ALL)"""
for _name in ("j36_confusion_process_batch", "a25_matrix"):
    register(_name, f"{_CM} SELECT * FROM cm")(confused)
register("a26_tp_fp", f"{_CM} SELECT predicted, sum(CASE WHEN predicted = actual THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN predicted = actual THEN 0 ELSE n END)::BIGINT AS fp FROM cm WHERE predicted >= 0 GROUP BY predicted")(
    lambda spark, sf_dir: E.tp_fp(confused(spark, sf_dir))
)
register("a27_confusion_summary", f"{_CM} SELECT predicted, actual, round(n / (sum(n) OVER (PARTITION BY actual) + 1e-9), 5) AS share FROM cm")(
    lambda spark, sf_dir: E.normalized(confused(spark, sf_dir)).select("predicted", "actual", F.round("share", 5).alias("share"))
)
register("a24_process_cls_preds", "SELECT l_linenumber AS predicted, CAST(l_suppkey % 7 + 1 AS INT) AS target, count(*) AS n FROM lineitem GROUP BY ALL")(
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("predicted"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("target")).agg(F.count("*").alias("n"))
)
_RANKED = "[l_suppkey % 7, l_partkey % 7, l_linenumber % 7, (l_suppkey + 3) % 7, (l_partkey + 2) % 7, l_orderkey % 7]"
register("a32_classify_metrics", f"WITH p AS (SELECT {_RANKED} AS r, CAST(l_quantity AS BIGINT) % 7 AS t FROM lineitem) SELECT round(avg(CASE WHEN r[1] = t THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN list_contains(r[1:5], t) THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM p")(
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").selectExpr(f"array{_RANKED.replace('[', '(').replace(']', ')')} AS r", "CAST(l_quantity AS BIGINT) % 7 AS t").agg(
        F.round(F.avg(E.top_k_accuracy(F.col("r"), F.col("t"), 1)), 6).alias("top1"), F.round(F.avg(E.top_k_accuracy(F.col("r"), F.col("t"), 5)), 6).alias("top5")
    )
)
register("a36_det_metrics_summary", f"{_AP}, s AS (SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images FROM g GROUP BY cls) SELECT s.cls, images, instances, round(avg(ap) FILTER (thr = 0.5), 6) AS ap50, round(avg(ap), 6) AS ap FROM s JOIN ap USING (cls) GROUP BY ALL")(
    lambda spark, sf_dir: summary(spark, sf_dir)
)


def summary(spark, sf_dir):
    """A row per class with its images, instances and AP."""
    truth = ground_truth(spark, sf_dir)
    counts = truth.groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    ap = E.average_precision(curve(spark, sf_dir)).groupBy("cls").agg(F.round(F.avg(F.when(F.col("thr") == 0.5, F.col("ap"))), 6).alias("ap50"), F.round(F.avg("ap"), 6).alias("ap"))
    return counts.join(ap, "cls").select("cls", "images", "instances", "ap50", "ap")


_FC = f"""{_CURVE}, a AS (SELECT cls, rank, conf, recall, precision FROM c WHERE thr = 0.5),
  gr AS (SELECT DISTINCT cls, CAST(k AS INT) AS k, k / 999.0::DOUBLE AS x FROM a, range(0, 1000) t(k)),
  hi AS (SELECT gr.cls, k, x, max(rank) AS ra FROM gr LEFT JOIN a ON a.cls = gr.cls AND floor(a.conf * 999) >= k GROUP BY ALL),
  fc AS (SELECT hi.cls, k, CASE WHEN l.rank IS NULL THEN 1.0 WHEN h.rank IS NULL OR l.conf = x THEN l.precision ELSE l.precision + (h.precision - l.precision) * (l.conf - x) / (l.conf - h.conf) END AS precision,
    CASE WHEN l.rank IS NULL THEN 0.0 WHEN h.rank IS NULL OR l.conf = x THEN l.recall ELSE l.recall + (h.recall - l.recall) * (l.conf - x) / (l.conf - h.conf) END AS recall
    FROM hi LEFT JOIN a l ON l.cls = hi.cls AND l.rank = ra LEFT JOIN a h ON h.cls = hi.cls AND h.rank = coalesce(ra, 0) + 1)"""
register("w1_f1_curve", f"{_FC} SELECT cls, k, round(2 * precision * recall / (precision + recall + 1e-16), 5) AS f1 FROM fc")(
    lambda spark, sf_dir: E.curves(curve(spark, sf_dir)).select("cls", "k", F.round("f1", 5).alias("f1"))
)
register(
    "w3_smooth",
    "WITH v AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round((s + greatest(4 - i, 0) * f + greatest(i + 3 - n, 0) * l) / 7, 5) AS smooth FROM v",
)(lambda spark, sf_dir: E.smooth(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 3).select("event_id", F.round("smooth", 5).alias("smooth")))
register("k4_top5", "SELECT doc_id, list_slice(list_reverse(list_sort([[doc_id % 7, 0], [doc_id % 5, -1], [doc_id % 3, -2], [n_chars % 11, -3], [n_chars % 13, -4], [doc_id % 2, -5]])), 1, 5)[1][2] * -1 AS top1, list_sum(list_transform(list_slice(list_reverse(list_sort([[doc_id % 7, 0], [doc_id % 5, -1], [doc_id % 3, -2], [n_chars % 11, -3], [n_chars % 13, -4], [doc_id % 2, -5]])), 1, 5), lambda p: p[1]))::BIGINT AS mass FROM documents")(
    lambda spark, sf_dir: top5(table(spark, sf_dir, "documents"))
)


def top5(docs):
    """K4, K5: the classes of the five largest of an array, and its greatest; ties to the smaller class."""
    p = F.array(*[F.struct(F.expr(f"CAST({e} AS BIGINT)").alias("p"), F.lit(-i).alias("c")) for i, e in enumerate(("doc_id % 7", "doc_id % 5", "doc_id % 3", "n_chars % 11", "n_chars % 13", "doc_id % 2"))])
    best = docs.select("doc_id", F.slice(F.sort_array(p, asc=False), 1, 5).alias("best"))
    return best.select("doc_id", (-F.col("best")[0]["c"]).cast("long").alias("top1"), F.aggregate("best", F.lit(0).cast("long"), lambda t, x: t + x["p"]).alias("mass"))


register("k3_select_topk_candidates", f"WITH d AS ({DET_SQL}) SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS r FROM d) WHERE r <= 13")(
    lambda spark, sf_dir: detections(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id"))).where("r <= 13").select("image_id", "det_id")
)
