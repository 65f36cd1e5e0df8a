"""Detection evaluation: matching, confusion matrix, precision and recall, average precision, top-k accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.boxes import Box, col_box, iou
from tessel.operators.spatial import box_join, others

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
GRID = 100
EPS = 1e-16


def _pairs(pred: DataFrame, truth: DataFrame, keys: list[str], cell: float, also_pred: tuple[str, ...], also_truth: tuple[str, ...]) -> DataFrame:
    """Overlapping pairs with their IoU."""
    a = pred.select("image_id", *[c for c in ("det_id", "conf", "x1", "y1", "x2", "y2", *also_pred)])
    joined = box_join(a, others(truth, *also_truth, keys=tuple(keys)), keys, cell)
    return joined.withColumn("iou", iou(col_box(), Box(*(F.col(c) for c in ("ox1", "oy1", "ox2", "oy2")))))


def match_predictions(pred: DataFrame, truth: DataFrame, cell: float = 64.0) -> DataFrame:
    """det_id, gt_id, thr of all matches.

    The rule is that of one_to_one, on boxes of an image and class.
    """
    p = _pairs(pred.select("*"), truth.withColumnRenamed("gt_id", "id"), ["image_id", "cls"], cell, ("cls",), ("id",))
    return one_to_one(p)


def one_to_one(p: DataFrame) -> DataFrame:
    """det_id, gt_id, thr of the matches among pairs (det_id, oid, conf, iou), by any similarity.

    For each threshold: a detection takes the label it is most similar to (the smaller id on ties), then a label keeps
    the first detection by score and id. The first choice is the same at every threshold that the similarity reaches, so
    it is made once; the second has a column for each. Both are min/max aggregates: no group is sorted or gathered.
    """
    p = p.where(F.col("iou") >= THRESHOLDS[0])
    best = p.groupBy("det_id").agg(F.max(F.struct("iou", (-F.col("oid")).alias("g"), "conf")).alias("b")).select("det_id", "b.*")
    own = F.struct("conf", (-F.col("det_id")).alias("d"))
    first = best.groupBy((-F.col("g")).alias("gt_id")).agg(*[F.max(F.when(F.col("iou") >= t, own)).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)])
    found = first.select("gt_id", F.explode(F.array(*[F.struct(F.col(f"t{i}.d").alias("d"), F.lit(t).alias("thr")) for i, t in enumerate(THRESHOLDS)])).alias("m"))
    return found.where("m.d IS NOT NULL").select((-F.col("m.d")).alias("det_id"), "gt_id", "m.thr")


def true_positives(pred: DataFrame, truth: DataFrame, cell: float = 64.0) -> DataFrame:
    """Every detection at every threshold with tp 0 or 1."""
    return flagged(pred, match_predictions(pred, truth, cell))


def flagged(pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Every detection at every threshold with tp 0 or 1, by the matches given."""
    grid = pred.select("det_id", "cls", "conf", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("thr"))
    hit = matches.select("det_id", "thr", F.lit(1).alias("tp"))
    return grid.join(hit, ["det_id", "thr"], "left").fillna(0, ["tp"])


def confusion(pred: DataFrame, truth: DataFrame, conf: float = 0.25, least: float = 0.45, cell: float = 64.0) -> DataFrame:
    """Predicted, actual, n; -1 is the background.

    Detections above conf, any class: a detection takes the label it overlaps most beyond least, then a label the
    detection that overlaps it most. What stays alone is a false positive or a miss.
    """
    pred = pred.where(F.col("conf") > conf)
    p = _pairs(pred, truth.withColumnRenamed("gt_id", "id"), ["image_id"], cell, ("cls",), ("id", "cls")).where(F.col("iou") > least)
    best = p.groupBy("det_id").agg(F.max(F.struct("iou", (-F.col("oid")).alias("g"), "cls", "ocls")).alias("b")).select("det_id", "b.*")
    kept = best.groupBy("g").agg(F.max(F.struct("iou", (-F.col("det_id")).alias("d"), "cls", "ocls")).alias("k")).select("g", "k.*")
    matched = kept.select(F.col("cls").alias("predicted"), F.col("ocls").alias("actual"))
    extra = pred.join(kept.select((-F.col("d")).alias("det_id")), "det_id", "left_anti").select(F.col("cls").alias("predicted"), F.lit(-1).alias("actual"))
    missed = truth.join(kept.select((-F.col("g")).alias("gt_id")), "gt_id", "left_anti").select(F.lit(-1).alias("predicted"), F.col("cls").alias("actual"))
    return matched.unionByName(extra).unionByName(missed).groupBy("predicted", "actual").agg(F.count("*").alias("n"))


def normalized(matrix: DataFrame) -> DataFrame:
    """The share of each actual class, by its column's sum."""
    return matrix.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("actual")) + 1e-9))


def tp_fp(matrix: DataFrame) -> DataFrame:
    """For each predicted class its diagonal and the rest of its row."""
    return matrix.where("predicted >= 0").groupBy("predicted").agg(F.sum(F.expr("if(predicted = actual, n, 0)")).alias("tp"), F.sum(F.expr("if(predicted = actual, 0, n)")).alias("fp"))


def running(df: DataFrame, keys: list[str], score: str, tie: str, values: list[str], buckets: int = 256) -> DataFrame:
    """df with running sums r_<value> and a running count r_n in descending order of score (0 to 1), ties by tie.

    In two levels: sums run within buckets of the score, and a bucket starts from the totals of those before it, of
    which a key has at most buckets. So a class with a third of all rows is dealt to many tasks, not sorted in one.
    """
    df = df.withColumn("__b", F.greatest(F.least(F.floor(F.col(score) * buckets), F.lit(buckets)), F.lit(0)))
    totals = df.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values], F.count("*").alias("__t_n"))
    before = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__p_{v}") for v in (*values, "n")])
    own = Window.partitionBy(*keys, "__b").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__o_{v}": F.sum(v).over(own) for v in values} | {"__o_n": F.count(F.lit(1)).over(own)})
    df = df.join(totals, [*keys, "__b"])
    return df.withColumns({f"r_{v}": F.col(f"__o_{v}") + F.col(f"__p_{v}") for v in (*values, "n")}).drop("__b", *[f"__{k}_{v}" for k in "op" for v in (*values, "n")])


def recalls(tp: DataFrame, truth: DataFrame) -> DataFrame:
    """Tp, n and recall by class and threshold."""
    labels = truth.groupBy("cls").agg(F.count("*").alias("labels"))
    found = tp.groupBy("cls", "thr").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    return found.join(F.broadcast(labels), "cls").select("cls", "thr", "tp", "n", (F.col("tp") / F.col("labels")).alias("recall"))


def precision_recall(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Cls, thr, rank, conf, recall and precision at every detection, by the matches given.

    A detection goes through the sort once, with one bit for each threshold at which it matches; the thresholds become
    rows only behind it.
    """
    labels = truth.groupBy("cls").agg(F.count("*").alias("labels"))
    at = F.array_position(F.array(*map(F.lit, THRESHOLDS)), F.col("thr")).cast("int") - 1
    bits = matches.select("det_id", at.alias("at")).groupBy("det_id").agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("bits"))
    hits = [f"h{i}" for i in range(len(THRESHOLDS))]
    d = pred.select("det_id", "cls", "conf").join(bits, "det_id", "left")
    d = d.select("det_id", "cls", "conf", *[F.expr(f"coalesce(shiftright(bits, {i}) & 1, 0)").alias(h) for i, h in enumerate(hits)])
    r = running(d, ["cls"], "conf", "det_id", hits).join(F.broadcast(labels), "cls")
    r = r.select("cls", "det_id", "conf", "labels", F.col("r_n").alias("rank"), F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.col(f"r_{h}").alias("tp")) for h, t in zip(hits, THRESHOLDS, strict=True)])).alias("at"))
    return r.select("cls", "at.thr", "det_id", "rank", "conf", (F.col("at.tp") / (F.col("labels") + EPS)).alias("recall"), (F.col("at.tp") / F.col("rank")).alias("precision"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Cls, thr, ap by 101-point interpolation of the precision envelope.

    Recall 0 has precision 1 and, behind the last point, recall 1 has 0. A point only counts through the grid cell of
    its recall: each cell keeps its first and last point and its greatest precision, so what is ordered is 101 cells.
    At a repeated recall the last point holds.
    """
    near = F.floor(F.col("recall") * GRID)  # the least grid point that isn't below the recall, by the comparison itself
    cell = F.when(F.col("recall") <= near / GRID, near).when(F.col("recall") <= (near + 1) / GRID, near + 1).otherwise(near + 2).cast("int")
    cells = curve.groupBy("cls", "thr", cell.alias("c")).agg(
        F.max("precision").alias("top"), F.max(F.struct("rank", "recall", "precision")).alias("last"), F.min(F.struct("rank", "recall")).alias("first")
    )
    keys = cells.select("cls").distinct().withColumn("thr", F.explode(F.array(*map(F.lit, THRESHOLDS))))  # of cells, not of the curve
    grid = keys.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(GRID)))).join(cells, ["cls", "thr", "c"], "left")
    up = Window.partitionBy("cls", "thr").orderBy("c")
    down = Window.partitionBy("cls", "thr").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    g = grid.select(
        "cls", "thr", "c", F.last("last", ignorenulls=True).over(up).alias("left"),
        F.max("top").over(down).alias("later"), F.last("first", ignorenulls=True).over(down).alias("right"),
    )
    lx = F.coalesce("left.recall", F.lit(0.0))  # what stands behind the left point is what stands in later cells
    ly = F.when(F.col("left").isNull(), F.lit(1.0)).otherwise(F.greatest("left.precision", F.coalesce("later", F.lit(0.0))))
    rx, ry = F.coalesce("right.recall", F.lit(1.0)), F.coalesce("later", F.lit(0.0))
    x = F.col("c") / GRID
    y = F.when(F.col("left").isNotNull() & F.col("right").isNull() & (lx >= 1), F.lit(0.0)).when(F.col("right").isNull() & (x >= 1), F.lit(0.0)).when(rx <= lx, ly).otherwise(ly + (ry - ly) * (x - lx) / (rx - lx))
    g = g.select("cls", "thr", "c", y.alias("y"))
    g = g.withColumn("next", F.lead("y").over(up))
    return g.where("next IS NOT NULL").groupBy("cls", "thr").agg((F.sum((F.col("y") + F.col("next")) / 2) / GRID).alias("ap"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """map50, map50_95 and fitness."""
    return ap.agg(F.avg(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95")).withColumn("fitness", F.col("map50_95"))


def curves(curve: DataFrame, points: int = 1000) -> DataFrame:
    """Precision, recall and F1 of each class on a grid of confidences, interpolated between detections, at IoU 0.5.

    Above the highest confidence recall is 0 and precision 1; below the lowest both stay. Each grid cell keeps its last
    detection above and its first one at or below, so no class is ordered as a whole.
    """
    n = points - 1
    c = curve.where("thr = 0.5").withColumn("k", F.least(F.floor(F.col("conf") * n), F.lit(n)).cast("int"))
    cells = c.groupBy("cls", "k").agg(F.max(F.struct("rank", "conf", "recall", "precision")).alias("low"), F.min(F.struct("rank", "conf", "recall", "precision")).alias("high"))
    grid = curve.select("cls").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).join(cells, ["cls", "k"], "left")
    down = Window.partitionBy("cls").orderBy(F.desc("k"))
    g = grid.select("cls", "k", F.last("low", ignorenulls=True).over(down).alias("a"), F.first("high", ignorenulls=True).over(Window.partitionBy("cls").orderBy(F.desc("k")).rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    x = F.col("k") / n
    mix = lambda f, none: F.when(F.col("a").isNull(), none).when(F.col("b").isNull() | (F.col("a.conf") == x), F.col(f"a.{f}")).otherwise(F.col(f"a.{f}") + (F.col(f"b.{f}") - F.col(f"a.{f}")) * (F.col("a.conf") - x) / (F.col("a.conf") - F.col("b.conf")))
    g = g.select("cls", "k", mix("precision", F.lit(1.0)).alias("precision"), mix("recall", F.lit(0.0)).alias("recall"))
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def smooth(df: DataFrame, keys: list[str], at: str, value: str, half: int) -> DataFrame:
    """The mean over half points on either side, where the ends are repeated beyond the range."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-half, half)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    low, high = F.greatest(half - i + 1, F.lit(0)), F.greatest(i + half - n, F.lit(0))
    total = F.sum(value).over(near) + low * F.first(value).over(whole) + high * F.last(value).over(whole)
    return df.withColumn("smooth", total / (2 * half + 1))


def top_k_accuracy(ranked: Column, target: Column, k: int) -> Column:
    """Whether the first k of a ranked array hold the target, as 0 or 1."""
    return F.array_contains(F.slice(ranked, 1, k), target).cast("int")
