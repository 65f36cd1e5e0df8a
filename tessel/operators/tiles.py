"""Tile grids and windows as generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def step_of(size: int, overlap: float) -> int:
    return size - int(size * overlap)


def tile_grid(images: DataFrame, size: int, overlap: float, *also: str) -> DataFrame:
    """The tiles of each image (image_id, height, width), ids by row, with their unpadded shape.

    Tiles start at every step, so narrow ones occur at the far edges. An image without pixels has no tile. also: columns
    of the images that their tiles keep.
    """
    step = step_of(size, overlap)
    cols = F.ceil(F.col("width") / step).cast("int")
    df = images.where("height > 0 AND width > 0").select("*", F.posexplode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))).alias("grid_row", "row_off"))
    df = df.select("*", F.posexplode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))).alias("grid_col", "col_off"))
    return df.select(
        "image_id", (F.col("grid_row") * cols + F.col("grid_col")).alias("tile_id"), "grid_row", "grid_col", "row_off", "col_off",
        F.least(F.lit(size), F.col("height") - F.col("row_off")).alias("h"), F.least(F.lit(size), F.col("width") - F.col("col_off")).alias("w"), *also,
    )


def tile_origin(g: tuple[float, ...]) -> tuple[Column, Column]:
    """The origin of a tile's georeference; rotation terms don't move it."""
    return g[0] + F.col("col_off") * g[1], g[3] + F.col("row_off") * g[5]


def neighbours(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """image_id, tile_id and the id of each of up to eight tiles around it in the grid of T1, with both tiles' bounds.

    A grid is whole, so what lies around a tile follows from its place and its image's size: no row meets another. Bounds
    are row_off, col_off, h and w, those of the other tile with an o_ before them. Images have an id, each its own.
    """
    step = step_of(size, overlap)
    n = lambda c: F.ceil(F.col(c) / step).cast("int")
    t = tile_grid(images.where("image_id IS NOT NULL").withColumns({"rows": n("height"), "cols": n("width")}), size, overlap, "height", "width", "rows", "cols")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    t = t.select("*", F.explode(steps).alias("s")).withColumns({"r": F.col("grid_row") + F.col("s.i"), "c": F.col("grid_col") + F.col("s.j")})
    t = t.where("r >= 0 AND c >= 0 AND r < rows AND c < cols").withColumns({"o_row_off": F.col("r") * step, "o_col_off": F.col("c") * step})
    return t.select(
        "image_id", "tile_id", (F.col("r") * F.col("cols") + F.col("c")).alias("other_id"), "row_off", "col_off", "h", "w", "o_row_off", "o_col_off",
        F.least(F.lit(size), F.col("height") - F.col("o_row_off")).alias("o_h"), F.least(F.lit(size), F.col("width") - F.col("o_col_off")).alias("o_w"),
    )


def overlap_strips(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """T5: the rectangles that neighbouring tiles share (half-open pixel bounds)."""
    r1, c1 = F.greatest("row_off", "o_row_off"), F.greatest("col_off", "o_col_off")
    r2, c2 = F.least(F.col("row_off") + F.col("h"), F.col("o_row_off") + F.col("o_h")), F.least(F.col("col_off") + F.col("w"), F.col("o_col_off") + F.col("o_w"))
    return neighbours(images, size, overlap).select("image_id", "tile_id", "other_id", r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2")).where("r1 < r2 AND c1 < c2")


def edge_weight(i: Column, size: Column, border: int) -> Column:
    """T10 along one axis: 1 inside, falling in equal steps towards 0 over border pixels at either end."""
    return F.least(F.lit(1.0), (i + 1) / border, (size - i) / border)


def mosaic(pixels: DataFrame, weight: Column | None = None) -> DataFrame:
    """T9 with a weight, T12 without: each image pixel as the mean of the tiles' values v that cover it."""
    w = weight if weight is not None else F.lit(1.0)
    return pixels.groupBy("image_id", "row", "col").agg((F.sum(F.col("v") * w) / (F.sum(w) + 1e-8)).alias("v"))


def windows(images: DataFrame, size: int, gap: int, rate: float = 0.6) -> DataFrame:
    """Windows at steps of size - gap, the last ones pulled back to the edge, that lie in the image to more than rate.

    If none of an image does, those with its largest share.
    """
    step = size - gap
    starts = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(n) - size) / step), F.lit(0)).cast("int")), lambda i: F.when((i > 0) & (i * step + size > F.col(n)), F.col(n) - size).otherwise(i * step))
    df = images.select("image_id", "height", "width", F.explode(starts("width")).alias("x1")).select("*", F.explode(starts("height")).alias("y1"))
    inside = (F.least("width", F.col("x1") + size) - F.greatest("x1", F.lit(0))) * (F.least("height", F.col("y1") + size) - F.greatest("y1", F.lit(0))) / float(size * size)
    df = df.select("image_id", "x1", "y1", (F.col("x1") + size).alias("x2"), (F.col("y1") + size).alias("y2"), inside.alias("rate")).distinct()
    best = df.groupBy("image_id").agg(F.max("rate").alias("best"))
    return df.join(best, "image_id").where((F.col("rate") > rate) | ((F.col("best") <= rate) & (F.col("rate") >= F.col("best") - 0.01))).select("image_id", "x1", "y1", "x2", "y2")


def crop_boxes(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """2^layer by 2^layer crops of each layer, widened so that neighbours overlap; layer 0 is the image."""
    df = images.select("image_id", "height", "width", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer"))
    n = F.pow(F.lit(2), F.col("layer")).cast("int")
    over = F.floor(overlap * F.least("height", "width") * (2 / n))
    df = df.withColumns({"n": n, "over": F.when(F.col("layer") == 0, 0).otherwise(over)})
    length = lambda d: F.ceil((F.col("over") * (F.col("n") - 1) + F.col(d)) / F.col("n"))
    df = df.withColumns({"cw": length("width"), "ch": length("height"), "i": F.explode(F.sequence(F.lit(0), F.col("n") - 1))}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x0, y0 = F.floor((F.col("cw") - F.col("over")) * F.col("i")), F.floor((F.col("ch") - F.col("over")) * F.col("j"))
    return df.select("image_id", "layer", x0.alias("x1"), y0.alias("y1"), F.least(x0 + F.col("cw"), F.col("width")).alias("x2"), F.least(y0 + F.col("ch"), F.col("height")).alias("y2"))


def point_grid(spark, n: int) -> DataFrame:
    """The centres of n by n equal cells of the unit square, by row."""
    i = spark.range(n * n)
    return i.select("id", ((F.col("id") % n + 0.5) / n).alias("x"), ((F.floor(F.col("id") / n) + 0.5) / n).alias("y"))


def layer_grids(spark, n: int, layers: int, per_layer: int) -> DataFrame:
    """A grid of n / per_layer^i points a side for each layer i."""
    df = spark.range(layers + 1).select(F.col("id").cast("int").alias("layer"), F.floor(n / F.pow(F.lit(per_layer), "id")).cast("int").alias("n"))
    df = df.select("layer", "n", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1)).alias("i"))
    return df.select("layer", ((F.col("i") % F.col("n") + 0.5) / F.col("n")).alias("x"), ((F.floor(F.col("i") / F.col("n")) + 0.5) / F.col("n")).alias("y"))
