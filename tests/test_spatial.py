"""Every spatial query against its DuckDB SQL, and edge cases against brute force."""

import duckdb
import pytest

from quadrille import registry
from quadrille.operators import join, order, quadtree, sinks, stripes
from quadrille.sources import layers
from quadrille.streaming import tagging

SF = "/root/testdata/sf0.001"
LAYER = "id long, min_x double, min_y double, max_x double, max_y double, weight long"


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got.columns, [tuple(r) for r in got.collect()]) == values(expected.columns, expected.fetchall())


def brute(r, s):
    return sorted((a[0], b[0]) for a in r for b in s if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])


def test_overlap_join_edges(spark):
    r = [(1, 0.0, 0.0, 1.0, 1.0, 1), (2, 1.0, 1.0, 1.0, 1.0, 0), (3, -180.0, -90.0, 180.0, 90.0, 5), (4, 179.0, 89.0, 180.0, 90.0, 1), (5, -3.0, -3.0, 0.0, 0.0, 2)]
    s = [(1, 1.0, 1.0, 2.0, 2.0, 1), (2, 0.0, 0.0, 1.0, 1.0, 0), (3, -60.0, -2.0, 70.0, 2.0, 1), (4, 180.0, 90.0, 180.0, 90.0, 1)]
    a, b = spark.createDataFrame(r, LAYER), spark.createDataFrame(s, LAYER)
    assert sorted(tuple(x) for x in join.overlap_join(a, b).select("r_id", "s_id").collect()) == brute(r, s)
    assert join.overlap_join(a.limit(0), b).count() == 0
    weights = {(x["r_id"], x["s_id"]): x["w"] for x in join.candidates(a, b).collect()}
    assert weights[2, 1] == 0 and weights[1, 1] == 2 and weights[3, 1] == 12


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512])
def test_blocks_and_chunks(spark, n):
    rows = spark.createDataFrame([(i, float(i % 7), 0.0, float(i % 7), 1.0, 1) for i in range(n)], LAYER)
    assert sorted(x["n"] for x in order.blocks(rows).collect()) == sorted([256] * (n // 256) + [n % 256] * (n % 256 > 0))
    sizes = [x["count"] for x in order.chunks(rows, "max_x", 4).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [n // 4 + (i < n % 4) for i in range(4) if n // 4 + (i < n % 4)]


def tree(points, target, min_n, coef=3, depth=17):
    """The level-wise definition on plain lists: (depth, weight, points) of the leaves."""
    least = sum(p[2] for p in points) // target * coef
    live, out = [(points, (-180.0, -90.0, 180.0, 90.0))], []
    for d in range(depth + 1):
        full, nxt = len(out) >= target, []
        for own, (x0, y0, x1, y1) in live:
            w = sum(p[2] for p in own)
            if d >= depth or w <= least or full or len(own) <= min_n:
                if w:
                    out.append((d, w, len(own)))
                continue
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            for left in (True, False):
                for low in (True, False):
                    part = [p for p in own if (p[0] < cx) == left and (p[1] < cy) == low]
                    if part:
                        nxt.append((part, (x0 if left else cx, y0 if low else cy, cx if left else x1, cy if low else y1)))
        live = nxt
    return sorted(out)


@pytest.mark.parametrize(("target", "coef", "min_n"), [(1, 3, 100), (4, 3, 2), (8, 0, 1), (3, 0, 0)])
def test_quadtree_against_lists(spark, target, coef, min_n):
    points = [((i * 37 % 360) - 180.0, (i * 53 % 181) - 90.0, i % 5) for i in range(300)] + [(180.0, 90.0, 3), (0.0, 0.0, 2)] + [(1.5, 1.5, 4)] * 101
    df = spark.createDataFrame(points, "x double, y double, w long")
    got = quadtree.leaves(df, quadtree.one_tree(spark, target), coef=coef, min_n=min_n)
    assert sorted((r["depth"], r["w"], r["n"]) for r in got.collect()) == tree(points, target, min_n, coef)


def test_empty_layers(spark):
    empty = spark.createDataFrame([], LAYER)
    points = join.candidates(empty, empty)
    assert quadtree.leaves(points.select("x", "y", "w"), quadtree.one_tree(spark, 4)).count() == 0
    assert stripes.budgets(points.selectExpr("0 as stripe", "w"), 4).count() == 0
    assert order.blocks(empty).count() == 0


def brute_best_first(rows, target, first, floor=0):
    """Q2 to Q4 on plain lists: (box, weight) of the cells."""
    cells, seq = [((-180.0, -90.0, 180.0, 90.0), first, 0)], 0
    while len(cells) < target:
        cell = max(cells, key=lambda c: (c[1], -c[2]))
        cells.remove(cell)
        x0, y0, x1, y1 = cell[0]
        cx, cy = x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2
        for b in ((x0, y0, cx, cy), (x0, cy, cx, y1), (cx, y0, x1, cy), (cx, cy, x1, y1)):
            w = sum(r[5] for r in rows if r[1] <= b[2] and r[3] >= b[0] and r[2] <= b[3] and r[4] >= b[1])
            w = 1 if w < floor else w
            if w:
                seq += 1
                cells.append((b, w, seq))
    return sorted((c[0], c[1]) for c in cells)


def test_best_first(spark):
    from pyspark.sql import functions as F

    rows = [(i, x, y, x, y, 1) for i, (x, y) in enumerate([(-90.0, -45.0), (-90.0, 45.0), (0.0, 0.0), (90.0, 45.0), (91.0, 46.0)])]
    rows += [(10 + i, 10 + i / 1024, 10 + i / 4096, 10 + i / 1024 + 1 / 2048, 10 + i / 4096, 1) for i in range(60)]  # a hot spot: deeper than two counts of depths
    df = spark.createDataFrame(rows, LAYER)
    for target in (1, 4, 24, 40):
        made = quadtree.best_first(df, F.lit(1), target, len(rows))
        assert sorted((c[:4], c[4]) for c in made) == brute_best_first(rows, target, len(rows))
        made = quadtree.best_first(df, F.lit(1), target, len(rows), len(rows))
        assert sorted((c[:4], c[4]) for c in made) == brute_best_first(rows, target, len(rows), len(rows) // target)
    one = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0, 1)] * 3, LAYER)
    assert [c[4] for c in quadtree.best_first(one, F.lit(1), 4, 3)] == [3]  # a point can't be split for ever


def test_ranks_of_values_that_fill_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    rows = [(i, float(i % 3 if i % 2 else 7), 0.0, 1.0, 1.0, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, LAYER)
    got = {r["id"]: r["rank"] for r in order.ranked(df, "min_x").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    got = {r["id"]: r["rank"] for r in order.ranked(df, "min_x", within=("weight",)).collect()}
    assert got == {r[0]: k for g in range(4) for k, r in enumerate(sorted((r for r in rows if r[5] == g), key=lambda r: (r[1], r[0])))}


def test_env_and_wkt(spark, tmp_path):
    lines = ["0 10 0 10", "1 2 3 4 5", "1 2 3", "a b c d e", "1 2 3 4 5 6", "5 1 2 3 4", "12345"]
    for i in range(3):  # small files share a partition, each with its header
        (tmp_path / f"env{i}.txt").write_text("\n".join(lines) + "\n")
    head, rows = layers.read_env(spark, f"file://{tmp_path}/env*.txt")
    assert [tuple(x) for x in head.collect()] == [(0.0, 0.0, 10.0, 10.0)] * 3
    assert sorted(tuple(x) for x in rows.collect()) == [(1.0, 2.0, 5.0, 3.0, 4)] * 3 + [(1.0, 3.0, 2.0, 4.0, 5)] * 3
    texts = ["POINT (1 2)", "POLYGON ((0 0, 0 4, 4 4, 0 0), (1 1, 1 2, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))",
             "MULTIPOINT ((1 1), (2 2))", "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 2 2))", "POLYGON ((nonsense))", "x", "POINT EMPTY", "POINT Z (1 2 3)", "MULTIPOINT (1 1, 2 2, 3 3)",
             "GEOMETRYCOLLECTION (MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5))), GEOMETRYCOLLECTION (POINT (3 3)), POINT EMPTY)", "LINESTRING (" + ", ".join(f"{i} {i}" for i in range(20000)) + ")"]
    got = layers.geometries(spark.createDataFrame(list(enumerate(texts)), "geom_id long, value string")).collect()
    assert sorted((r["geom_id"], r["part"], r["n_points"]) for r in got) == [
        (0, 0, 1), (1, 0, 8), (2, 0, 4), (2, 1, 4), (3, 0, 2), (4, 0, 1), (4, 1, 2), (8, 0, 1), (9, 0, 3), (10, 0, 8), (10, 1, 1), (11, 0, 20000)]


def test_write_arrays(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "cell_id long, min_x double, min_y double, max_x double, max_y double")
    shapes = layers.geometries(spark.createDataFrame([(1, "POINT (1 2)"), (2, "LINESTRING (3 4, 5 6)")], "geom_id long, value string")).withColumn("cell_id", layers.F.lit(1).cast("long"))
    sinks.write_arrays(layers.geometry_arrays(shapes, ["cell_id"]), cells, "cell_id", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/cell_id=1")).collect()] == [
        "1.000000 3.000000 5.000000", "2.000000 4.000000 6.000000", "0 1 3", "1.000000 1.000000 2.000000 2.000000 3.000000 5.000000 4.000000 6.000000", "0.000000 9.000000 0.000000 9.000000"]


def test_tagging_by_path(spark, monkeypatch):
    monkeypatch.setattr(join, "BROADCAST_ROWS", 2)
    points = [(float(i * 7 % 360 - 180), float(i * 11 % 180 - 90), 1) for i in range(400)]
    df = spark.createDataFrame(points, "x double, y double, w long")
    cells = quadtree.leaves(df, quadtree.one_tree(spark, 8), min_n=5).selectExpr("*", "depth * 1000000 + path as cell_id")
    tagged = {(r["cell_id"], r["count"]) for r in tagging.tag(df, cells).groupBy("cell_id").count().collect()}
    assert tagged == {(r["cell_id"], r["n"]) for r in cells.collect()}


def test_sinks_and_stream(spark, tmp_path):
    cells = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 2.0), (8, 2.0, 0.0, 4.0, 2.0)], "cell_id long, min_x double, min_y double, max_x double, max_y double")
    sinks.write_partitions(cells, spark.createDataFrame([(7, "POINT (1 1)")], "cell_id long, wkt string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/cell_id=7")).collect()] == ["0.000000 2.000000 0.000000 2.000000", "POINT (1 1)"]
    spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (9.0, 9.0)], "x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").parquet(str(tmp_path / "in"))
    q = tagging.tag(stream, cells).writeStream.format("memory").queryName("tagged").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("tagged").collect()) == [(1.0, 1.0, 7), (2.0, 1.0, 8)]
