"""Streams of points tagged with the cell that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.operators import join


def tag(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (x, y) of a stream or table with cell_id; stateless, against static cells.

    Up to join.BROADCAST_ROWS cells are broadcast. More must be tree cells of the world box (depth, path) and are joined on
    their path: each point looks once at each depth that cells have."""
    b = [F.col(f"cell_{c}") for c in ("min_x", "min_y", "max_x", "max_y")]
    named = [F.col(c).alias(f"cell_{c}") for c in ("min_x", "min_y", "max_x", "max_y")]
    held = boxes.inside(F.col("x"), F.col("y"), b)
    if cells.limit(join.BROADCAST_ROWS + 1).count() <= join.BROADCAST_ROWS:
        return points.join(F.broadcast(cells.select("cell_id", *named)), held).select(*points.columns, "cell_id")
    depths = sorted(r["depth"] for r in cells.select("depth").distinct().collect())  # boxes.DEPTH + 1 at most
    whole = boxes.tree_path(F.col("x"), F.col("y"), boxes.world())
    looking = points.withColumn("__depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("__path", whole)
    looking = looking.withColumn("__path", F.expr(f"shiftright(__path, 2 * ({boxes.DEPTH} - __depth))"))
    own = cells.select("cell_id", F.col("depth").alias("__depth"), F.col("path").alias("__path"), *named)
    return looking.join(own, ["__depth", "__path"]).where(held).select(*points.columns, "cell_id")


def sums(points: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, n, w of the points (x, y, w) in each cell, as tag finds them. cells: tree cells of the world box. The points are summed
    on the grid of the deepest cells, and the grid's cells, by their lower left corner, are tagged: each is in one cell or in none."""
    deepest = cells.agg(F.max("depth").alias("d")).first()["d"]
    if deepest is None:
        return tag(points, cells).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    x0, y0, _, _ = boxes.WORLD
    ix, iy = boxes.places(F.col("x"), F.col("y"), boxes.world(), deepest)
    held = boxes.inside(F.col("x"), F.col("y"), boxes.world())  # places outside the world are those of its sides; not a filter, which a join of boxes would test for every comparison
    dealt = points.select(ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), F.when(held, F.col("w")).alias("w"))
    grid = dealt.groupBy("ix", "iy").agg(F.count("w").alias("n"), F.sum("w").alias("w")).where("n > 0")
    wide, high = 360.0 / (1 << deepest), 180.0 / (1 << deepest)
    corners = grid.select((F.col("ix") * wide + x0).alias("x"), (F.col("iy") * high + y0).alias("y"), "n", "w")
    return tag(corners, cells).groupBy("cell_id").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
