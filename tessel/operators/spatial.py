"""Spatial joins on a grid: an equi join on cells and a residual test, in place of a nested loop over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.boxes import Box, overlaps


def _cells(df: DataFrame, cell: float, names: tuple[str, ...]) -> DataFrame:
    """A row for each grid cell that a box covers."""
    x1, y1, x2, y2 = (F.floor(F.col(n) / cell).cast("int") for n in names)
    return df.withColumn("__cx", F.explode(F.sequence(x1, x2))).withColumn("__cy", F.explode(F.sequence(y1, y2)))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, residual: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose boxes overlap and pass the residual test.

    left has corners x1..y2; right has them as ox1..oy2. Boxes are dealt to grid cells of side cell, and a pair is given
    only in the cell of its overlap's upper left corner, so it comes once without a distinct. how: inner, or leftsemi or
    leftanti for the rows of left (by all their columns, which must tell rows apart). A cell about as large as a common
    box keeps both the copies (about four a box) and the candidates few.
    """
    a, b = Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), Box(*(F.col(c) for c in ("ox1", "oy1", "ox2", "oy2")))
    cells_a, cells_b = _cells(left, cell, ("x1", "y1", "x2", "y2")), _cells(right, cell, ("ox1", "oy1", "ox2", "oy2"))
    pairs = cells_a.join(cells_b, [*keys, "__cx", "__cy"]).where(overlaps(a, b))
    pairs = pairs.where((F.floor(F.greatest("x1", "ox1") / cell) == F.col("__cx")) & (F.floor(F.greatest("y1", "oy1") / cell) == F.col("__cy")))
    pairs = pairs.where(residual) if residual is not None else pairs
    pairs = pairs.drop("__cx", "__cy")
    return pairs if how == "inner" else left.join(pairs.select(left.columns).distinct(), left.columns, how)


def others(df: DataFrame, *also: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with its corners as ox1..oy2, the columns also with an o before them, and the keys as they are."""
    return df.select(*keys, *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2", *also)])
