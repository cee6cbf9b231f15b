"""What the spatial queries must not do on large tables, and the plain definitions that their short cuts are held against."""

from pyspark.sql import functions as F

from quadrille import registry
from quadrille.operators import join, quadtree, stripes
from quadrille.sources import layers
from quadrille.streaming import tagging

SF = "/root/testdata/sf0.001"
LAYER = "id long, min_x double, min_y double, max_x double, max_y double, weight long"
POINT = "x double, y double, w long"


def kept_rows(monkeypatch, made):
    """The most rows that a table has that is kept while something is made."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [0], DataFrame.persist
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "persist", lambda self, *a, **k: (seen.append(self.count()), plain(self, *a, **k))[1])
        made()
    return max(seen)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_points(points, target, first):
    cells, seq = [((-180.0, -90.0, 180.0, 90.0), first, 0)], 0
    while len(cells) < target:
        cell = max(cells, key=lambda c: (c[1], -c[2]))
        cells.remove(cell)
        x0, y0, x1, y1 = cell[0]
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        for b in ((x0, y0, cx, cy), (x0, cy, cx, y1), (cx, y0, x1, cy), (cx, cy, x1, y1)):
            w = sum(p[2] for p in points if b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3])
            if w:
                seq += 1
                cells.append((b, w, seq))
    return sorted((c[0], c[1]) for c in cells)


def test_trees_keep_no_points(spark, monkeypatch):
    points = spark.range(20000).select((F.col("id") % 10 * 30.0 - 170).alias("x"), (F.col("id") % 7 * 20.0 - 80).alias("y"), F.lit(1).cast("long").alias("w"))
    assert kept_rows(monkeypatch, lambda: quadtree.leaves(points, quadtree.one_tree(spark, 8))) < 2000


def test_a_deep_hot_spot_of_a_tree(spark):
    rows = [(1.0 + i / 4096, 1.0 + i / 8192, 1) for i in range(400)] + [(180.0, 90.0, 40), (200.0, -95.0, 40), (-180.0, -90.0, 1)]
    points = spark.createDataFrame(rows, POINT)
    asked = []

    def near(areas):
        boxes = [tuple(a) for a in areas.collect()]
        asked.append(len(boxes))
        return spark.createDataFrame([p for p in rows if any(a[0] <= p[0] <= a[2] and a[1] <= p[1] <= a[3] for a in boxes)], POINT)

    plain = sorted(tuple(r) for r in quadtree.leaves(points, quadtree.one_tree(spark, 64), min_n=2).collect())
    assert plain == sorted(tuple(r) for r in quadtree.leaves(points, quadtree.one_tree(spark, 64), min_n=2, near=near).collect())
    assert len(asked) > 0 and max(r[0] for r in plain) > quadtree.SHALLOW and sum(r[-1] for r in plain) == len(rows)


def test_stripes_keep_no_points(spark, monkeypatch):
    points = spark.range(20000).select((F.col("id") % 2).cast("int").alias("stripe"), (F.col("id") % 10 * 30.0 - 170).alias("x"), F.lit(1.0).alias("y"), F.lit(1).cast("long").alias("w"))
    parts = spark.createDataFrame([(0, -180.0, -90.0, 0.0, 90.0), (1, 0.0, -90.0, 180.0, 90.0)], "stripe int, min_x double, min_y double, max_x double, max_y double")
    assert kept_rows(monkeypatch, lambda: stripes.striped_leaves(points, parts, 8)) < 2000


def test_best_first_of_points(spark, monkeypatch):
    rows = [(0.0, 0.0, 1), (-90.0, 10.0, 1), (45.0, -45.0, 1), (180.0, 90.0, 1), (-180.0, -90.0, 1)] + [(10 + i / 4096, 10 + i / 8192, 2) for i in range(90)]
    points = spark.createDataFrame(rows, POINT)
    for target in (4, 24, 40):
        made = quadtree.best_first_points(points, target, 1000, lambda areas: points)
        assert sorted((c[:4], c[4]) for c in made) == brute_points(rows, target, 1000)
    assert kept_rows(monkeypatch, lambda: registry.QUERIES["bestfirst_points"](spark, SF)) == 0


def test_slices_come_with_the_boxes(spark):
    assert "r_id" not in plan(registry.QUERIES["gpu_slices"](spark, SF))


def test_sliced_trees_keep_no_points(spark, monkeypatch):
    assert 0 < kept_rows(monkeypatch, lambda: registry.QUERIES["sliced_leaves"](spark, "/root/testdata/sf0.01")) < 20000


def test_few_cells_need_no_shuffle(spark, monkeypatch):
    cells = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 2.0), (8, 2.0, 0.0, 4.0, 2.0), (9, -180.0, -90.0, 180.0, 90.0)], "cell_id long, min_x double, min_y double, max_x double, max_y double")
    rows = spark.createDataFrame([(i, i / 4, 0.0, i / 4 + i % 3, 2.0, 1) for i in range(30)], LAYER)
    made = join.assign(cells, rows)
    assert "Exchange hashpartitioning" not in plan(made)
    got = sorted(tuple(r) for r in made.collect())
    monkeypatch.setattr(join, "COMPARED", 0)
    assert got == sorted(tuple(r) for r in join.assign(cells, rows).collect()) and len(got) > 30


def test_sums_of_cells(spark):
    points = [(float(i * 7 % 360 - 180), float(i * 11 % 180 - 90), i % 5) for i in range(400)] + [(180.0, 0.0, 9), (0.0, 90.0, 9), (500.0, 0.0, 9)]
    df = spark.createDataFrame(points, POINT)
    cells = quadtree.leaves(df, quadtree.one_tree(spark, 8), min_n=5).selectExpr("*", "depth * 1000000 + path as cell_id")
    plain = tagging.tag(df, cells).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    made = tagging.sums(df, cells)
    assert sorted(tuple(r) for r in made.collect()) == sorted(tuple(r) for r in plain.collect())
    assert made.agg(F.sum("n")).first()[0] == 400


def test_offsets_in_one_pass(spark):
    n = 30000
    rows = spark.range(n).select(F.col("id").alias("geom_id"), F.lit(0).alias("part"), F.expr("transform(sequence(0, cast(id % 3 as int)), i -> struct(cast(id as double) as x, 1D as y))").alias("coords"),
                                 *[F.lit(0.0).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], F.lit(1).alias("key"))
    made = layers.geometry_arrays(rows, ["key"])
    assert "aggregate(" not in plan(made)  # an array that grows by an element takes time with the square
    expected = [0]
    for i in range(n):
        expected.append(expected[-1] + i % 3 + 1)
    assert made.select("offsets").first()["offsets"] == expected


def test_arrays_in_pieces(spark):
    rows = [(key, i // 3, i % 2, [(float(i), 1.0)] * (i % 4 + 1), *[float(i)] * 4) for key in (None, 1, 2) for i in range(50 if key == 2 else 7)]
    rows = spark.createDataFrame(rows, "key int, geom_id long, part int, coords array<struct<x double, y double>>, min_x double, min_y double, max_x double, max_y double")
    whole = {r["key"]: r for r in layers.geometry_arrays(rows, ["key"]).collect()}
    made = layers.geometry_arrays(rows, ["key"], 7).orderBy("key", "piece").collect()
    assert [(r["key"], r["piece"], len(r["offsets"]) - 1) for r in made] == [(None, 0, 7), (1, 0, 7), *[(2, i, 7) for i in range(7)], (2, 7, 1)]
    for key, r in whole.items():
        own = [x for x in made if x["key"] == key]
        assert all([v for x in own for v in x[c]] == r[c] for c in ("xs", "ys", "envs"))
        assert [0, *[v for x in own for v in x["offsets"][1:]]] == r["offsets"]
        assert all(a["offsets"][-1] == b["offsets"][0] for a, b in zip(own, own[1:], strict=False))


def test_no_row_holds_a_bucket(spark, monkeypatch):
    plain, most = layers.geometry_arrays, []

    def seen(*a):
        made = plain(*a)
        most.append(made.agg(F.max(F.size("offsets") - 1)).first()[0])
        return made

    monkeypatch.setattr(layers, "geometry_arrays", seen)
    got = registry.QUERIES["geometry_csr"](spark, "/root/testdata/sf0.01")
    assert got.agg(F.min("parts")).first()[0] > 1500 and max(most) <= 1024
