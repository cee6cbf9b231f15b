"""Weighted quadtrees over candidate points, in passes of aggregates, and best-first trees."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.operators import join

# Fixed values of the partitioner: cost factor of a leaf, points below which a node stops, depth.
COEF, MIN_N, DEPTH = 3, 100, boxes.DEPTH
#: Depth of the first pass: at most 4 ** SHALLOW cells for each tree; depths that a further pass adds.
SHALLOW, MORE = 8, 5


def levels(cells: DataFrame, keys: list[str], path: str, at: int, first: int, last: int) -> DataFrame:
    """keys, depth, path, w, n of the nodes from depth first to last above cells of depth `at`."""
    rows = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
    up = F.expr(f"shiftright({path}, 2 * ({at} - depth))")
    return rows.withColumn("path", up).groupBy(*keys, "depth", "path").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def grid_sums(points: DataFrame, root: list[Column], depth: int, keys: list[str]) -> DataFrame:
    """keys, cell (its path), w, n of the cells of a depth that hold points. Each point is only dealt to a column and row."""
    ix, iy = boxes.places(F.col("x"), F.col("y"), root, depth)
    dealt = points.select(*keys, ix.cast("int").alias("__ix"), iy.cast("int").alias("__iy"), "w")
    sums = dealt.groupBy(*keys, "__ix", "__iy").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return sums.select(*keys, boxes.path_of(F.col("__ix").cast("long"), F.col("__iy").cast("long"), depth).alias("cell"), "w", "n")


def tree_levels(points: DataFrame, root: list[Column], last: int = SHALLOW, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, depth, path, w, n of every node down to depth `last`."""
    return levels(grid_sums(points, root, last, list(keys)), list(keys), "cell", last, 0, last)


def leaves(points: DataFrame, trees: DataFrame, keys: tuple[str, ...] = (), coef: int = COEF, min_n: int = MIN_N, depth: int = DEPTH, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys, depth, path, box, w, n of the leaves of each tree.

    points: keys, x, y, w. trees: keys, target (leaves wanted) and root box root_min_x ... of each tree, one row for
    each. A node stops at the last depth, at a weight of coef * (W div target) or less, or with min_n points or fewer.
    The first depth with at least `target` leaves above it turns all its live nodes into leaves. The first pass
    aggregates to SHALLOW levels; while nodes are live at the last depth that is known, a pass over the points in them adds MORE. Points
    are never kept: each pass makes them again, the further ones by `near`, which gets boxes of areas and gives at least the
    points in them, or else from `points`. What is kept are the sums of the passes' cells."""
    keys, spark = list(keys), points.sparkSession
    corners = ["root_min_x", "root_min_y", "root_max_x", "root_max_y"]
    given = trees.select(*keys, "target", *corners)
    rows_of_trees = given.collect()  # one row for each tree
    own = spark.createDataFrame(rows_of_trees, given.schema)
    roots = {tuple(r[c] for c in corners) for r in rows_of_trees}
    root = [F.lit(v) for v in next(iter(roots))] if len(roots) == 1 else [F.col(c) for c in corners]

    def by_tree(rows: DataFrame, small: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(small), keys) if keys else rows.crossJoin(F.broadcast(small))

    def summed(rows: DataFrame, to: int) -> DataFrame:
        rows = rows.select(*keys, "x", "y", "w")
        return grid_sums(rows if len(roots) == 1 else by_tree(rows, own.select(*keys, *corners)), root, to, keys)

    top = min(SHALLOW, depth)
    shallow = summed(points, top)
    if keys:
        shallow = shallow.join(F.broadcast(own.select(*keys)), keys, "left_semi")
    shallow = shallow.persist()
    kept = [shallow]
    whole = shallow.groupBy(*keys).agg(F.sum("w").alias("all"))
    limits = own.join(whole, keys) if keys else own.crossJoin(whole)
    limits = limits.select(*keys, "target", *corners, F.expr(f"(all div target) * {coef}").alias("least"))
    limits = spark.createDataFrame(limits.collect(), limits.schema)  # one row for each tree

    def stopped(rows: DataFrame) -> DataFrame:
        rows = by_tree(rows, limits.select(*keys, "least", "target"))
        return rows.withColumn("stop", (F.col("depth") >= depth) | (F.col("w") <= F.col("least")) | (F.col("n") <= min_n)).drop("least")

    nodes = last = stopped(levels(shallow, keys, "cell", top, 0, top)).persist()  # at most 4 ** SHALLOW * 4 / 3 a tree
    kept.append(nodes)
    while top < depth:
        # a live node weighs more than coef * (W div target), so there are fewer than target / coef + 1 (min_n, if coef is 0) of a depth
        live = last.where(f"depth = {top} and not stop").select(*keys, F.col("path").alias("cell"))
        if live.isEmpty():
            break
        below = min(top + MORE, depth)
        rows = points
        if near is not None:
            rows = near(areas(by_tree(live, own.select(*keys, *corners)), top))
        cell = boxes.path_of(*boxes.places(F.col("x"), F.col("y"), root, top), top)
        rows = rows.select(*keys, "x", "y", "w")
        rows = rows if len(roots) == 1 else by_tree(rows, own.select(*keys, *corners))
        rows = rows.withColumn("cell", cell).join(join.small(live), [*keys, "cell"], "left_semi")
        deep = grid_sums(rows, root, below, keys).persist()
        last = stopped(levels(deep, keys, "cell", below, top + 1, below)).persist()
        kept += [deep, last]
        nodes, top = nodes.union(last), below
    above = nodes.where("not stop").select(*keys, (F.col("depth") + 1).alias("depth"), F.col("path").alias("over"))
    below = nodes.where("depth > 0").withColumn("over", F.shiftright("path", 2)).join(above, [*keys, "depth", "over"], "left_semi").drop("over")
    alive = nodes.where("depth = 0").unionByName(below).persist()
    made = alive.where("stop and w <> 0").groupBy(*keys, "target", "depth").count().collect()  # a row for each tree and depth
    caps = {}
    for r in sorted(made, key=lambda r: r["depth"]):
        tree = tuple(r[k] for k in keys)
        n, cap = caps.get(tree, (0, None))
        n += r["count"]
        caps[tree] = (n, r["depth"] + 1 if cap is None and n >= r["target"] else cap)
    schema = ", ".join([*[f"{k} {dict(points.dtypes)[k]}" for k in keys], "cap int"])
    capped = by_tree(alive, spark.createDataFrame([(*k, c) for k, (_, c) in caps.items()], schema))
    found = capped.where("w <> 0").where("(stop and (cap is null or depth <= cap)) or (cap is not null and depth = cap)")
    found = by_tree(found.select(*keys, "depth", "path", "w", "n"), own)
    b = boxes.node_box(F.col("depth"), F.col("path"), [F.col(c) for c in corners])
    found = found.select(*keys, "depth", "path", *[e.alias(n) for e, n in zip(b, ("min_x", "min_y", "max_x", "max_y"), strict=True)], "w", "n")
    if not coef:  # leaves aren't bounded by the target
        return found
    out = spark.createDataFrame(found.collect(), found.schema)  # at most some times the trees' targets (see above)
    for t in (alive, *kept):
        t.unpersist()
    return out


def areas(cells: DataFrame, depth: int) -> DataFrame:
    """min_x, min_y, max_x, max_y of cells (cell: the path; root_*) of a depth; those on a side of the root go on for ever, as
    points outside the root count in them."""
    root = [F.col(c) for c in ("root_min_x", "root_min_y", "root_max_x", "root_max_y")]
    world = F.lit((1 << depth) - 1)
    ix, iy = boxes.unspread(F.col("cell")), world - boxes.unspread(F.shiftright("cell", 1))
    b = boxes.node_box(F.lit(depth), F.col("cell"), root)
    far = F.lit(float("inf"))
    return cells.select(F.when(ix == 0, -far).otherwise(b[0]).alias("min_x"), F.when(iy == 0, -far).otherwise(b[1]).alias("min_y"),
                        F.when(ix == world, far).otherwise(b[2]).alias("max_x"), F.when(iy == world, far).otherwise(b[3]).alias("max_y"))


def one_tree(spark, target: int, root: tuple[float, float, float, float] = boxes.WORLD) -> DataFrame:
    return spark.createDataFrame([(target, *root)], "target long, root_min_x double, root_min_y double, root_max_x double, root_max_y double")


def closed_cells(rows: DataFrame, first: int, last: int, weight: Column, over: tuple[int, int, int] = (0, 0, 0)) -> dict[tuple[int, int, int], int]:
    """Weights of the world's cells of depths first to last under the cell `over` (at most 4 ** (last - over's depth + 1)
    of them); a box counts in each cell that it touches. One pass: each box is dealt to its cells of every depth."""
    top, ox, oy = over
    n = F.pow(F.lit(2.0), F.col("d"))
    x0, y0, x1, y1 = boxes.WORLD
    wide, high = (x1 - x0) / n, (y1 - y0) / n

    def touched(low: str, up: str, start: float, step: Column, at: int) -> Column:
        count = F.pow(F.lit(2.0), F.col("d") - top).cast("long")
        begin = F.lit(at) * count
        a = F.greatest(F.ceil((F.col(low) - start) / step).cast("long") - 1, begin)
        b = F.least(F.floor((F.col(up) - start) / step).cast("long"), begin + count - 1)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))

    dealt = rows.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last))))
    cell = dealt.withColumn("ix", F.explode(touched("min_x", "max_x", x0, wide, ox))).withColumn("iy", F.explode(touched("min_y", "max_y", y0, high, oy)))
    return {(r["d"], r["ix"], r["iy"]): r["w"] for r in cell.groupBy("d", "ix", "iy").agg(F.sum(weight).alias("w")).collect()}


#: Depths that are counted at a time, and the depth below which a cell is not split: its sides are at the limit of doubles
#: there, and without it boxes in one point would be split for ever.
AT_ONCE, DEEPEST = 4, 48
#: Depths that are counted at a time for points, which are summed on a grid first.
POINTS_AT_ONCE = 8


def closed_point_cells(points: DataFrame, first: int, last: int, over: tuple[int, int, int] = (0, 0, 0)) -> dict[tuple[int, int, int], int]:
    """As closed_cells, for points x, y, w. One pass: each point is dealt to a place of the deepest grid only, an edge (even) or the
    inside of a cell (odd) of each axis; the sums of places give the cells of all depths."""
    top, ox, oy = over
    x0, y0, x1, y1 = boxes.WORLD
    n = 1 << last

    def place(v: str, low: float, high: float) -> Column:
        at = (F.col(v) - low) / ((high - low) / n)
        return F.floor(at) + F.ceil(at)  # twice the edge, or the odd number between two

    if top:  # one cell more on each side: what is kept is decided by the places
        wide, high = (x1 - x0) / (1 << top), (y1 - y0) / (1 << top)
        points = points.where(F.col("x").between(x0 + (ox - 1) * wide, x0 + (ox + 2) * wide) & F.col("y").between(y0 + (oy - 1) * high, y0 + (oy + 2) * high))
    sums = points.select(place("x", x0, x1).alias("px"), place("y", y0, y1).alias("py"), "w")
    sums = sums.groupBy("px", "py").agg(F.sum("w").alias("w")).withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last))))

    def touched(p: str, at: int) -> Column:
        side = F.expr(f"shiftleft(2L, {last} - d)")  # places of a cell of depth d
        own, cells = F.expr(f"{p} div shiftleft(2L, {last} - d)"), F.expr(f"shiftleft(1L, d - {top})")
        begin, end = F.lit(at) * cells, F.lit(at + 1) * cells - 1
        both = F.when(F.col(p) % side == 0, F.array(own - 1, own)).otherwise(F.array(own))
        return F.filter(both, lambda i: (i >= begin) & (i <= end))

    cell = sums.withColumn("ix", F.explode(touched("px", ox))).withColumn("iy", F.explode(touched("py", oy)))
    return {(r["d"], r["ix"], r["iy"]): r["w"] for r in cell.groupBy("d", "ix", "iy").agg(F.sum("w").alias("w")).collect()}


def world_area(spark, cell: tuple[int, int, int]) -> DataFrame:
    """The box of a cell of the world: one row."""
    d, ix, iy = cell
    x0, y0, x1, y1 = boxes.WORLD
    wide, high = (x1 - x0) / (1 << d), (y1 - y0) / (1 << d)
    return spark.createDataFrame([(x0 + ix * wide, y0 + iy * high, x0 + (ix + 1) * wide, y0 + (iy + 1) * high)], "min_x double, min_y double, max_x double, max_y double")


def best_first(rows: DataFrame, weight: Column, target: int, first: int, count_rows: int | None = None) -> list[tuple]:
    """(min_x, min_y, max_x, max_y, weight): the heaviest cell, the oldest of equals, is split until there are `target`.

    rows: boxes; a cell weighs the sum of `weight` over the boxes it touches, so one on a shared edge counts in both. Children
    come in the order BL, TL, BR, TR; those of weight 0 are dropped. count_rows: a cell that weighs less than count_rows // target
    is taken as 1. Weights are counted for AT_ONCE depths below the cell that is split where they aren't known yet, so a
    hot spot is split as deep as it takes."""
    return split_heaviest(lambda begin, end, over: closed_cells(rows, begin, end, weight, over), AT_ONCE, target, first, count_rows)


def best_first_points(points: DataFrame, target: int, first: int, near: Callable[[DataFrame], DataFrame]) -> list[tuple]:
    """As best_first, for points x, y, w, which aren't kept: near makes those (at least) in areas again, for the cells that need
    depths beyond POINTS_AT_ONCE."""
    def count(begin: int, end: int, over: tuple[int, int, int]) -> dict[tuple[int, int, int], int]:
        return closed_point_cells(near(world_area(points.sparkSession, over)) if over[0] else points, begin, end, over)

    return split_heaviest(count, POINTS_AT_ONCE, target, first)


def split_heaviest(count: Callable, at_once: int, target: int, first: int, count_rows: int | None = None) -> list[tuple]:
    """The cells of best_first. count: the weights of the cells of depths begin to end under a cell."""
    known, counted = count(1, at_once, (0, 0, 0)), {(0, 0, 0)}

    def under(cell: tuple[int, int, int]) -> tuple[int, int, int]:
        d, ix, iy = cell
        up = d % at_once
        return d - up, ix >> up, iy >> up

    heap, done, seq = [(-first, 0, (0, 0, 0))], [], 0
    while heap and len(heap) + len(done) < target:
        w, at, cell = heapq.heappop(heap)
        d, ix, iy = cell
        if d >= DEEPEST:
            done.append((-w, at, cell))
            continue
        base = under(cell)
        if base not in counted:
            counted.add(base)
            known.update(count(base[0] + 1, base[0] + at_once, base))
        for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)):
            child = (d + 1, 2 * ix + dx, 2 * iy + dy)
            own = known.get(child, 0)
            if count_rows is not None and own < count_rows // target:
                own = 1
            if own:
                seq += 1
                heapq.heappush(heap, (-own, seq, child))
    out = []
    for w, _, (d, ix, iy) in [(-w, a, c) for w, a, c in heap] + done:
        x0, y0, x1, y1 = boxes.WORLD
        wide, high = (x1 - x0) / (1 << d), (y1 - y0) / (1 << d)
        out.append((x0 + ix * wide, y0 + iy * high, x0 + (ix + 1) * wide, y0 + (iy + 1) * high, w))
    return out


def saturated(weight: str) -> Column:
    """The sum of a LONG column, the largest LONG where it is beyond that."""
    return F.least(F.sum(F.col(weight).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def by_weight(cells: DataFrame) -> DataFrame:
    """The cells in order of their weight, the heaviest last; ties in order of depth and path."""
    return cells.orderBy("w", "depth", "path")
