"""Analytics over tracks (track_id, cls, frame, x, y): counting, speed, occupancy, heat, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_track() -> Window:
    return Window.partitionBy("track_id").orderBy("frame")


def history(tracks: DataFrame, last: int = 30) -> DataFrame:
    """The last centres of each track, oldest first. Ranks cut before the lists are made, so a list has at most last."""
    r = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("frame")))
    kept = tracks.withColumn("__r", r).where(F.col("__r") <= last)
    return kept.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("path"))


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(px: Column, py: Column, x: Column, y: Column, line: tuple[float, float, float, float]) -> Column:
    """Whether the step from (px, py) to (x, y) crosses a line segment, ends included."""
    ax, ay, bx, by = map(F.lit, line)
    d1, d2 = _side(px, py, x, y, ax, ay), _side(px, py, x, y, bx, by)
    d3, d4 = _side(ax, ay, bx, by, px, py), _side(ax, ay, bx, by, x, y)
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0) | (d3 != 0) | (d4 != 0))


def line_counts(tracks: DataFrame, line: tuple[float, float, float, float]) -> DataFrame:
    """Each track's first crossing of a line and its direction; a track counts once.

    For a line that is taller than wide, to the right is "in"; for others, downwards is.
    """
    w = _by_track()
    steps = tracks.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px IS NOT NULL")
    steps = steps.where(crosses(F.col("px"), F.col("py"), F.col("x"), F.col("y"), line))
    upright = abs(line[2] - line[0]) < abs(line[3] - line[1])
    move = F.col("x") > F.col("px") if upright else F.col("y") > F.col("py")
    steps = steps.withColumn("direction", F.when(move, "in").otherwise("out"))
    first = steps.groupBy("track_id").agg(F.min(F.struct("frame", "direction", "cls")).alias("f"))
    return first.select("track_id", F.col("f.frame").alias("frame"), F.col("f.direction").alias("direction"), F.col("f.cls").alias("cls"))


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon, by the even-odd rule: edges that a ray to the right crosses."""
    hits = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ay != by:
            hits = hits + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return hits % 2 == 1


def zone_counts(tracks: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """W6 with a polygon: the first frame at which a track with a step before is inside."""
    steps = tracks.withColumn("px", F.lag("x").over(_by_track())).where("px IS NOT NULL").where(inside(F.col("x"), F.col("y"), polygon))
    first = steps.groupBy("track_id").agg(F.min(F.struct("frame", F.when(F.col("x") > F.col("px"), "in").otherwise("out").alias("direction"))).alias("f"))
    return first.select("track_id", "f.*")


def speeds(tracks: DataFrame, hist: int = 5, fps: float = 30.0, metres_per_pixel: float = 0.05, top: int = 120) -> DataFrame:
    """km/h from a track's first and hist-th centre, whole, at most top; tracks with fewer centres have none."""
    r = tracks.withColumn("r", F.row_number().over(_by_track())).where(F.col("r").isin(1, hist))
    ends = r.groupBy("track_id").agg(F.min_by(F.struct("frame", "x", "y"), "r").alias("a"), F.max_by(F.struct("frame", "x", "y"), "r").alias("b"), F.count("*").alias("n")).where("n = 2")
    way = F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2) * metres_per_pixel
    time = (F.col("b.frame") - F.col("a.frame")) / fps
    return ends.select("track_id", F.least((way / time * 3.6).cast("int"), F.lit(top)).alias("kmh"))


def angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The angle at b in degrees, at most 180."""
    d = F.abs(F.degrees(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx)))
    return F.when(d > 180, 360 - d).otherwise(d)


def repetitions(poses: DataFrame, up: float, down: float) -> DataFrame:
    """track_id, frame, stage and reps from angles: a change from up to down counts one.

    The stage is that of the last angle beyond either bound; both are window functions over the track.
    """
    w = _by_track()
    told = F.when(F.col("angle") < down, "down").when(F.col("angle") > up, "up")
    s = poses.withColumn("stage", F.last(told, ignorenulls=True).over(w))
    s = s.withColumn("one", ((F.col("stage") == "down") & (F.lag("stage").over(w) == "up")).cast("int"))
    return s.withColumn("reps", F.sum(F.coalesce("one", F.lit(0))).over(w)).drop("one")


def class_series(tracks: DataFrame, every: int = 30) -> DataFrame:
    """The boxes of each class in every so-manieth frame."""
    return tracks.where(F.col("frame") % every == 0).groupBy("frame", "cls").agg(F.count("*").alias("n"))


def tail_series(series: DataFrame, key: str, at: str, points: int = 45) -> DataFrame:
    """The last points of each series."""
    return series.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("__r") <= points).drop("__r")


def shares(counts: DataFrame, key: str, value: str) -> DataFrame:
    """W11, pie: each key's part of all, in percent."""
    total = counts.agg(F.sum(value).alias("__t"))
    return counts.join(F.broadcast(total)).select(key, F.round(F.col(value) * 100.0 / F.col("__t"), 4).alias("percent"))


def region_counts(tracks: DataFrame, regions: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """The centres in each region by frame, with zeros; regions are few and become columns of one aggregate."""
    counts = tracks.groupBy("frame").agg(*[F.sum(inside(F.col("x"), F.col("y"), p).cast("int")).alias(n) for n, p in regions.items()])
    return counts.select("frame", F.explode(F.create_map(*[x for n in regions for x in (F.lit(n), F.col(n))])).alias("region", "n"))


def queue_counts(tracks: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """By frame, the tracks with a step before that are in a polygon."""
    return tracks.withColumn("r", F.row_number().over(_by_track())).where("r > 1").where(inside(F.col("x"), F.col("y"), polygon)).groupBy("frame").agg(F.count("*").alias("n"))


def parking(tracks: DataFrame, slots: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """By frame, the rectangular slots with a whole-number centre in them or on their border, and those without."""
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    taken = [F.max(((x >= a) & (x <= c) & (y >= b) & (y <= d)).cast("int")) for a, b, c, d in slots.values()]
    total = taken[0]
    for t in taken[1:]:
        total = total + t
    return tracks.groupBy("frame").agg(total.alias("occupied")).withColumn("free", len(slots) - F.col("occupied"))


def heat(tracks: DataFrame, radius: int = 3, gain: int = 2) -> DataFrame:
    """Gain for every pixel within radius of a centre, summed over all boxes."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j < radius * radius])
    px = tracks.select(F.floor("x").alias("cx"), F.floor("y").alias("cy"), F.explode(steps).alias("s"))
    return px.groupBy((F.col("cx") + F.col("s.i")).alias("px"), (F.col("cy") + F.col("s.j")).alias("py")).agg((F.count("*") * gain).alias("heat"))


def track_distance(tracks: DataFrame, a: int, b: int) -> DataFrame:
    """The distance of two tracks by frame."""
    p, q = tracks.where(F.col("track_id") == a).select("frame", "x", "y"), tracks.where(F.col("track_id") == b).select("frame", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return p.join(q, "frame").select("frame", F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2).alias("distance"))


def first_alarm(tracks: DataFrame, records: int) -> DataFrame:
    """The first frame with at least so many boxes."""
    return tracks.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= records).agg(F.min("frame").alias("frame"))


def union_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of a, and of b what a hasn't, by track id."""
    return a.unionByName(b.join(a.select("track_id"), "track_id", "left_anti").select(a.columns))


def minus_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2."""
    return a.join(b.select("track_id"), "track_id", "left_anti")


def drop_doubles(a: DataFrame, b: DataFrame, near: float) -> DataFrame:
    """Side and track_id of what stays where tracks of a and b are closer than near: the longer-lived, b on a tie.

    Tracks have x, y and age. Places are dealt to a grid of side near, so candidates come from nine cells.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = a.select(F.col("track_id").alias("a_id"), "x", "y", F.col("age").alias("a_age"), F.explode(steps).alias("s"))
    p = p.withColumns({"cx": cell("x") + F.col("s.i"), "cy": cell("y") + F.col("s.j")})
    q = b.select(F.col("track_id").alias("b_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("age").alias("b_age"), cell("x").alias("cx"), cell("y").alias("cy"))
    close = p.join(q, ["cx", "cy"]).where(F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2) < near)
    lost_b = close.where("a_age > b_age").select(F.col("b_id").alias("track_id")).distinct()
    lost_a = close.where("a_age <= b_age").select(F.col("a_id").alias("track_id")).distinct()
    return a.join(lost_a, "track_id", "left_anti").select(F.lit("a").alias("side"), "track_id").unionByName(b.join(lost_b, "track_id", "left_anti").select(F.lit("b").alias("side"), "track_id"))
