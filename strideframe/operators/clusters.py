"""Where weighted points lie thickest, for each key: the heaviest cell of a grid, and from there a mean shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest_cells(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """(key, cx, cy, mass): the square of side `radius` which with the eight around it weighs most; ties: the smallest.

    Cells are sums before the shuffle; a cell adds its weight to its neighbours, not points to cells.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    cells = points.groupBy(key, cell(x).alias("cx"), cell(y).alias("cy")).agg(F.sum(w).alias("own"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(i == 0 and j == 0).alias("self")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = cells.withColumn("o", near).groupBy(key, (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).agg(F.sum("own").alias("mass"), F.bool_or("o.self").alias("real"))
    best = spread.where("real").groupBy(key).agg(F.min(F.struct((-F.round("mass", 9)).alias("m"), "cx", "cy")).alias("b"))
    return best.select(key, "b.cx", "b.cy", (-F.col("b.m")).alias("mass"))


def thickest(points: DataFrame, key: str, radius: float, rounds: int = 8, x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """(key, x, y, inside): the centre that a Gaussian mean shift of bandwidth `radius` reaches from the heaviest cell, and the
    weight within radius of it.

    Each round is a join of the points with their key's centre (one row a key) and a sum. Points with nulls take no part, nor do
    those without positive weight; a key without any has no row.
    """
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0)).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    cell = lambda c: F.floor(F.col(c) / radius)
    mean = lambda pull: [(F.sum(pull * F.col(c)) / F.sum(pull)).alias(n) for c, n in (("x", "mx"), ("y", "my"))]
    near = own.join(heaviest_cells(own, key, radius), key).where((F.abs(cell("x") - F.col("cx")) <= 1) & (F.abs(cell("y") - F.col("cy")) <= 1))
    centre = near.groupBy(key).agg(*mean(F.col("w")))
    d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    for _ in range(rounds):
        centre = own.join(centre, key).groupBy(key).agg(*mean(F.col("w") * F.exp(-0.5 * d2 / (radius * radius))))
    inside = F.sum(F.when(d2 <= radius * radius, F.col("w")).otherwise(0.0)).alias("inside")
    return own.join(centre, key).groupBy(key).agg(F.first("mx").alias("x"), F.first("my").alias("y"), inside)


def weighted_moments(points: DataFrame, key: str, x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """(key, mean_x, mean_y, cov_xx, cov_xy, cov_yy) of weighted points, the covariances about the means, so that clouds far
    from the origin lose no digits. Points with nulls or without positive weight take no part."""
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0)).select(key, F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("w"))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    centre = own.groupBy(key).agg(mean(F.col("x")).alias("mx"), mean(F.col("y")).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return own.join(centre, key).groupBy(key).agg(F.first("mx").alias("mean_x"), F.first("my").alias("mean_y"), mean(dx * dx).alias("cov_xx"), mean(dx * dy).alias("cov_xy"), mean(dy * dy).alias("cov_yy"))
