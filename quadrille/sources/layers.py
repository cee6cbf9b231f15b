"""Layers of weighted boxes: fixture layers over the test tables, box files and WKT files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fixture layers' SQL, for Spark and DuckDB; coordinates are multiples of 1/64 degree.
LAYER = """
SELECT id, x0 AS min_x, y0 AS min_y, least(x0+w,180e0) AS max_x, least(y0+h,90e0) AS max_y, weight FROM (
  SELECT {key} AS id,
    floor(CAST((({key}*{a})%23040)*(({key}*{a})%23040) AS DOUBLE)/23040e0)*0.015625e0-180e0 AS x0,
    floor(CAST((({key}*{b})%11520)*(({key}*{b})%11520) AS DOUBLE)/11520e0)*0.015625e0-90e0 AS y0,
    CAST({key}%{c} AS DOUBLE)*0.03125e0 AS w, CAST({key}%{d} AS DOUBLE)*0.03125e0 AS h,
    CAST(4+{key}%61 AS BIGINT) AS weight
  FROM {table}) t"""
R_SQL = LAYER.format(key="o_orderkey", a=7919, b=6151, c=97, d=53, table="{orders}")
S_SQL = LAYER.format(key="event_id", a=5227, b=7853, c=89, d=59, table="{events}")
#: Lines of a box file up to this length hold no row.
SHORT_LINE = 5


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture layer R or S: id, min_x, min_y, max_x, max_y, weight."""
    sql, table = (R_SQL, "orders") if name == "r" else (S_SQL, "events")
    return spark.sql(sql.replace("{" + table + "}", "{rows}"), rows=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def env_lines(lines: DataFrame) -> DataFrame:
    """Rows of `value` lines `minx maxx miny maxy weight`: short lines and lines without exactly five numbers are left out;
    bounds in the wrong order are put right."""
    parts = F.split("value", " ")
    number = lambda i: F.get(parts, i).try_cast("double")
    rows = lines.where(F.length("value") > SHORT_LINE).where(F.size(parts) == 5).select(*[number(i).alias(f"v{i}") for i in range(4)], F.get(parts, 4).try_cast("long").alias("weight")).dropna()
    return rows.select(F.least("v0", "v1").alias("min_x"), F.least("v2", "v3").alias("min_y"), F.greatest("v0", "v1").alias("max_x"), F.greatest("v2", "v3").alias("max_y"), "weight")


def read_env(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The headers of box files (a row for each file that has one: the box of all) and their rows. A header is a file's first
    line, of four numbers; a row has five, so no reader but the first of a file needs to know. Spark's splits, which begin
    at line ends, are the parallel readers."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "k").alias("value"))
    parts = F.split("value", " ")
    header = first.where(F.size(parts) == 4).select(*[F.get(parts, i).try_cast("double").alias(n) for i, n in ((0, "min_x"), (2, "min_y"), (1, "max_x"), (3, "max_y"))])
    return header.dropna(), env_lines(lines.select("value"))


_NUMBER = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?"
_POINT = rf"\s*+{_NUMBER}(?:\s++{_NUMBER}){{1,3}}+\s*+"
_SEQUENCE = rf"\({_POINT}(?:,{_POINT})*+\)"
_RINGS = rf"\(\s*+{_SEQUENCE}(?:\s*+,\s*+{_SEQUENCE})*+\s*+\)"
_POINTS = rf"\((?:{_POINT}|\s*+\({_POINT}\)\s*+)(?:,(?:{_POINT}|\s*+\({_POINT}\)\s*+))*+\)"
_POLYGONS = rf"\(\s*+{_RINGS}(?:\s*+,\s*+{_RINGS})*+\s*+\)"
_DIMENSION = r"(?:\s++(?:ZM|Z|M))?+\s*+"
#: What stands in brackets, nested up to seven deep.
_NESTED = r"\([^()]*+\)"
for _ in range(6):
    _NESTED = rf"\((?:[^()]++|{_NESTED})*+\)"


def wkt_parts(wkt: str) -> Column:
    """The geometries of a WKT text: the members of MULTIPOLYGON, MULTILINESTRING and GEOMETRYCOLLECTION (each direct member of
    a collection as it is), else itself; a MULTIPOINT is one geometry."""
    w = F.trim(F.upper(F.col(wkt)))
    body = F.regexp_extract(w, r"(?s)^[A-Z]+(?:\s++(?:ZM|Z|M))?\s*\((.*)\)$", 1)
    polygons = F.transform(F.regexp_extract_all(body, F.lit(f"({_RINGS})"), F.lit(1)), lambda p: F.concat(F.lit("POLYGON "), p))
    lines = F.transform(F.regexp_extract_all(body, F.lit(f"({_SEQUENCE})"), F.lit(1)), lambda p: F.concat(F.lit("LINESTRING "), p))
    members = F.regexp_extract_all(body, F.lit(rf"([A-Z]++{_DIMENSION}(?:EMPTY|{_NESTED}))"), F.lit(1))
    return F.when(w.startswith("MULTIPOLYGON"), polygons).when(w.startswith("MULTILINESTRING"), lines).when(w.startswith("GEOMETRYCOLLECTION"), members).otherwise(F.array(w))


def coordinates(wkt: str) -> Column:
    """The coordinates of a WKT text as an array of (x, y); further dimensions are left out."""
    pairs = F.regexp_extract_all(wkt, F.lit(rf"({_NUMBER}\s++{_NUMBER})(?:\s++{_NUMBER})*+"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.get(F.split(p, r"\s+"), 0).try_cast("double").alias("x"), F.get(F.split(p, r"\s+"), 1).try_cast("double").alias("y")))


def valid_wkt(wkt: str) -> Column:
    """Well-formed and not empty (an empty geometry has no envelope)."""
    kinds = [("POINT", rf"\({_POINT}\)"), ("LINESTRING", _SEQUENCE), ("POLYGON", _RINGS), ("MULTIPOINT", _POINTS), ("MULTILINESTRING", _RINGS), ("MULTIPOLYGON", _POLYGONS),
             ("GEOMETRYCOLLECTION", _NESTED)]
    every = "|".join(f"{name}{_DIMENSION}{body}" for name, body in kinds)
    return F.trim(F.upper(F.col(wkt))).rlike(rf"^(?:{every})$")


def geometries(lines: DataFrame) -> DataFrame:
    """geom_id, part, wkt, n_points, min_x, min_y, max_x, max_y, coords of the valid geometries of lines (geom_id, value)."""
    rows = lines.where(F.length("value") > SHORT_LINE).select("geom_id", F.posexplode(wkt_parts("value")).alias("part", "wkt")).where(valid_wkt("wkt"))
    rows = rows.withColumn("coords", coordinates("wkt")).where(F.size("coords") > 0)
    axis = lambda c: F.transform("coords", lambda p: p[c])
    return rows.select("geom_id", "part", "wkt", F.size("coords").cast("long").alias("n_points"), F.array_min(axis("x")).alias("min_x"), F.array_min(axis("y")).alias("min_y"),
                       F.array_max(axis("x")).alias("max_x"), F.array_max(axis("y")).alias("max_y"), "coords")


def geometry_arrays(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, xs, ys, offsets, envs: the geometries of each key as flat arrays; offsets end with the total, envs hold min_x, max_x,
    min_y, max_y of each. A key's geometries become one row by definition of the format; the offsets are running sums of its sorted rows.
    most: a row for each piece of so many geometries of a key instead, numbered in column `piece` from 0, so that no row grows with the key; a
    piece's offsets begin where those of the piece before end."""
    box = F.array("min_x", "max_x", "min_y", "max_y")
    rows = rows.select(*keys, "geom_id", "part", "coords", box.alias("box"))
    order = Window.partitionBy(*keys).orderBy("geom_id", "part", "coords", "box").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = rows.withColumn("end", F.sum(F.size("coords").cast("long")).over(order))
    if most is not None:
        ended, keys = ended.withColumn("piece", F.floor((F.count(F.lit(1)).over(order) - 1) / most)), [*keys, "piece"]
    parts = F.array_sort(F.collect_list(F.struct("geom_id", "part", "coords", "box", "end")))
    made = ended.groupBy(*keys).agg(parts.alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["coords"]))
    begin = F.expr("parts[0].end - size(parts[0].coords)")
    offsets = F.concat(F.array(begin), F.transform("parts", lambda p: p["end"]))
    return made.select(*keys, F.transform(flat, lambda p: p["x"]).alias("xs"), F.transform(flat, lambda p: p["y"]).alias("ys"), offsets.alias("offsets"),
                       F.flatten(F.transform("parts", lambda p: p["box"])).alias("envs"))
