"""Joins of boxes by overlap, as equi-joins on grid bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import boxes

#: Rows of a table of cells or stripes that may be broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000
#: Grids, each twice as coarse as the one before, and the bins' sides that a box may extend over (it meets one bin more at
#: most); a box beyond those of the last grid meets more.
GRIDS, SIDES = 24, 2.0


def small(rows: DataFrame) -> DataFrame:
    """The table, broadcast if it is small, for a join that works either way."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def bin_size(*layers: DataFrame) -> tuple[float, list[int]]:
    """The side of the finest grid's bins, and the grids that the boxes need. One pass over the boxes.

    The side is the median extent, or that which gives each box a bin of its own if they were spread evenly, if that is
    larger (points have no extent)."""
    b = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    rows = layers[0].select(*b)
    for other in layers[1:]:
        rows = rows.unionByName(other.select(*b))
    extent = F.greatest(b[2] - b[0], b[3] - b[1])
    r = rows.agg(F.count("*").alias("n"), F.percentile_approx(extent, 0.5, 200).alias("median"), F.max(extent).alias("most"),
                 ((F.max(b[2]) - F.min(b[0])) * (F.max(b[3]) - F.min(b[1]))).alias("area")).first()
    size = max(r["median"] or 0.0, ((r["area"] or 0.0) / max(1, r["n"])) ** 0.5) or 1.0
    last = 0
    while last < GRIDS - 1 and SIDES * size * 2**last < (r["most"] or 0.0):
        last += 1
    return size, list(range(last + 1))


def level(b: list[Column], size: float) -> Column:
    """The finest grid of whose bins' sides a box extends over SIDES at most."""
    extent = F.greatest(b[2] - b[0], b[3] - b[1]) / SIDES
    return F.when(extent <= size, 0).otherwise(F.least(F.ceil(F.log2(extent / size)), F.lit(GRIDS - 1))).cast("int")


def binned(rows: DataFrame, levels: list[int], size: float) -> DataFrame:
    """Each row once for each bin that it meets on each grid of `levels` that isn't finer than its own; own: whether the grid
    is the row's own, first_x, first_y: whether the bin is the first of an axis that it meets."""
    b = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    rows = rows.withColumn("own_level", level(b, size)).withColumn("grid", F.explode(F.array(*[F.lit(x) for x in levels]))).where("grid >= own_level")
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("grid"))
    rows = rows.withColumn("own", F.col("grid") == F.col("own_level"))
    for g, low, high, origin in (("x", b[0], b[2], -180.0), ("y", b[1], b[3], -90.0)):
        rows = rows.withColumn("__low", F.floor((low - origin) / step)).withColumn(f"g{g}", F.explode(F.sequence("__low", F.floor((high - origin) / step))))
        rows = rows.withColumn(f"first_{g}", F.col(f"g{g}") == F.col("__low"))
    return rows.drop("__low", "own_level")


def overlap_join(r: DataFrame, s: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of r and s (id, box, weight; and `keys`, equal in both) whose boxes intersect, each once.

    Rows r_*, s_*. A pair is looked for on the coarser grid of its two boxes, so no box meets more than SIDES + 1 bins of an
    axis there, and is kept in the bin that holds the lower left corner of its intersection: the one that is the first of each axis
    for one of the two. What is compared for each pair was computed for each row. Dense bins are split by adaptive
    execution's skew join."""
    size, levels = bin_size(r, s)
    helpers = ("own", "grid", "gx", "gy", "first_x", "first_y")
    left, right = (binned(t, levels, size).select(*[F.col(c).alias(f"{p}_{c}") for c in t.columns], *[F.col(c).alias(f"__{p}_{c}") for c in helpers]) for t, p in ((r, "r"), (s, "s")))
    a = [F.col(f"r_{c}") for c in ("min_x", "min_y", "max_x", "max_y")]
    c = [F.col(f"s_{c}") for c in ("min_x", "min_y", "max_x", "max_y")]
    same = (F.col("__r_grid") == F.col("__s_grid")) & (F.col("__r_gx") == F.col("__s_gx")) & (F.col("__r_gy") == F.col("__s_gy"))
    for k in keys:
        same = same & (F.col(f"r_{k}") == F.col(f"s_{k}"))
    for h in ("first_x", "first_y", "own"):
        same = same & (F.col(f"__r_{h}") | F.col(f"__s_{h}"))
    pairs = left.join(right, same & boxes.intersects(a, c))
    return pairs.drop(*[f"__{p}_{h}" for p in "rs" for h in helpers])


def candidates(r: DataFrame, s: DataFrame, product: bool = False, keys: tuple[str, ...] = (), only: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, r_id, s_id, x, y, w: the centre of each pair's intersection and its cost (product: of vertex counts). only: a
    condition on the pairs' r_ and s_ columns. carry: further columns of r."""
    pairs = overlap_join(r, s, keys=keys)
    pairs = pairs if only is None else pairs.where(only)
    a, c = ([F.col(f"{p}_{n}") for n in ("min_x", "min_y", "max_x", "max_y")] for p in "rs")
    i = boxes.intersection(a, c)
    w = F.col("r_weight") * F.col("s_weight") if product else boxes.pair_weight(F.col("r_weight"), F.col("s_weight"))
    return pairs.select(*[F.col(f"r_{k}").alias(k) for k in (*keys, *carry)], "r_id", "s_id", boxes.centre(i[0], i[2]).alias("x"), boxes.centre(i[1], i[3]).alias("y"), w.alias("w"))


#: Boxes that every row may be compared with.
COMPARED = 1000


def touching(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """The rows (box and others) that touch one of the areas (box); all rows if there are many areas."""
    few = areas.limit(COMPARED + 1).collect()
    if len(few) > COMPARED:
        return rows
    given = rows.sparkSession.createDataFrame(few, areas.schema).select(*[F.col(c).alias(f"__{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    a, c = ([F.col(f"{p}{n}") for n in ("min_x", "min_y", "max_x", "max_y")] for p in ("", "__"))
    return rows.join(F.broadcast(given), boxes.intersects(a, c), "left_semi")


def assign(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """cell_id, and the columns of rows (id, box, weight and others): each box goes to every cell that it touches. Up to COMPARED
    cells are compared with every row, without a shuffle; more are joined on bins."""
    own = cells.select(F.col("cell_id").alias("id"), "min_x", "min_y", "max_x", "max_y", F.lit(0).cast("long").alias("weight"))
    if cells.limit(COMPARED + 1).count() <= COMPARED:
        a, c = ([F.col(f"{p}{n}") for n in ("min_x", "min_y", "max_x", "max_y")] for p in ("", "__cell_"))
        given = own.select(F.col("id").alias("cell_id"), *[F.col(n).alias(f"__cell_{n}") for n in ("min_x", "min_y", "max_x", "max_y")])
        return rows.join(F.broadcast(given), boxes.intersects(a, c)).select("cell_id", *rows.columns)
    return overlap_join(own, rows).select(F.col("r_id").alias("cell_id"), *[F.col(f"s_{c}").alias(c) for c in rows.columns])
