"""Terrain rasters (contours, first connections), tiled bands, packed images and rendered pixels, with DuckDB SQL.

Stand-ins: an order is a cell of a raster with rows of 120, its customer gives the height, the bands, the colours and the
bytes of an image; a customer is a point that is asked for. Contour lines, connection stages and the sink have no SQL; tests
hold them against plain versions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import connection as C
from ..operators import contours as L
from ..sources import blobs, images
from ..sources.tables import scratch, table

WIDE = 120
INTERVAL = 5.0
FRAME = B.Frame(west=-74.0, south=40.4 - 20000 * 5 / B.FEET_PER_DEGREE, east=-74.0 + WIDE * 6.5 / B.FEET_PER_DEGREE, north=40.4, width=WIDE, height=20000)


def raster(spark, sf):
    """Ridges with noise; some cells have no height."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    y, x = F.floor(k / WIDE), k % WIDE
    z = F.abs(x % 40 - 20) * 0.8 + F.abs(y % 30 - 15) * 0.6 + (c % 40) / 10
    return table(spark, sf, "orders").select(y.alias("y"), x.alias("x"), F.when(c % 53 != 0, z).alias("z"))


_G = "g AS (SELECT o_orderkey // 120 AS y, o_orderkey % 120 AS x, CASE WHEN o_custkey % 53 <> 0 THEN abs(o_orderkey % 120 % 40 - 20) * 0.8::DOUBLE + abs(o_orderkey // 120 % 30 - 15) * 0.6::DOUBLE + (o_custkey % 40) / 10.0::DOUBLE END AS z FROM orders)"
_PIECE = {"bl": "sqrt(bx ** 2 + (1 - ly) ** 2)", "br": "sqrt((1 - bx) ** 2 + (1 - ry) ** 2)", "lr": "sqrt(1 + (ly - ry) ** 2)", "tr": "sqrt((1 - tx) ** 2 + ry ** 2)", "tb": "sqrt(1 + (tx - bx) ** 2)", "tl": "sqrt(tx ** 2 + ly ** 2)"}
_PIECES_SQL = f"""WITH {_G}, q AS (SELECT a.z AS a, b.z AS b, c.z AS c, d.z AS d FROM g a JOIN g b ON b.y = a.y AND b.x = a.x + 1 JOIN g c ON c.y = a.y + 1 AND c.x = a.x + 1 JOIN g d ON d.y = a.y + 1 AND d.x = a.x
  WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND c.z IS NOT NULL AND d.z IS NOT NULL),
v AS (SELECT a, b, c, d, l * 5.0::DOUBLE AS level FROM q, range(0, 20) r(l) WHERE least(a, b, c, d) <= l * 5.0::DOUBLE AND greatest(a, b, c, d) > l * 5.0::DOUBLE),
p AS (SELECT *, (CASE WHEN a > level THEN 8 ELSE 0 END + CASE WHEN b > level THEN 4 ELSE 0 END + CASE WHEN c > level THEN 2 ELSE 0 END + CASE WHEN d > level THEN 1 ELSE 0 END) AS bits, (a + b + c + d) / 4 > level AS higher,
  (level - a) / nullif(b - a, 0) AS tx, (level - b) / nullif(c - b, 0) AS ry, (level - d) / nullif(c - d, 0) AS bx, (level - a) / nullif(d - a, 0) AS ly FROM v)
SELECT level, sum(CASE WHEN bits IN (5, 10) THEN 2 ELSE 1 END)::BIGINT AS pieces, round(sum(CASE WHEN bits IN (1, 14) THEN {_PIECE['bl']} WHEN bits IN (2, 13) THEN {_PIECE['br']} WHEN bits IN (3, 12) THEN {_PIECE['lr']} WHEN bits IN (4, 11) THEN {_PIECE['tr']}
  WHEN bits IN (6, 9) THEN {_PIECE['tb']} WHEN bits IN (7, 8) THEN {_PIECE['tl']} WHEN (bits = 5) = higher THEN {_PIECE['tl']} + {_PIECE['br']} ELSE {_PIECE['tr']} + {_PIECE['bl']} END), 4) AS length FROM p GROUP BY level"""


def pieces(spark, sf):
    """Pieces of contours by level, and how long they are."""
    length = F.sqrt(F.pow(F.col("q.x") - F.col("p.x"), F.lit(2)) + F.pow(F.col("q.y") - F.col("p.y"), F.lit(2)))
    return L.segments(raster(spark, sf), [], INTERVAL).groupBy("level").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(length), 4).alias("length"))


def lines(spark, sf):
    return L.contours(raster(spark, sf), INTERVAL)


def l20(spark, sf):
    return lines(spark, sf).select("level", "start", "index", "closed", F.size("xs").cast("long").alias("points"), F.round("length", 3).alias("length"))


def a24(spark, sf):
    """Contours written by level and read again."""
    path = scratch(spark, "contours")
    L.write_contours(lines(spark, sf), path, {"schemaVersion": "1", "verticalUnits": "feet", "intervalFt": "5", "indexIntervalFt": "25"})
    back = spark.read.schema("`index` boolean, coordinates array<array<double>>, level double").json(f"{path}/lines")
    return back.groupBy("level", "index").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("coordinates")).alias("points"))


def l19(spark, sf):
    """Stages up to 20 feet at which cells connect to low ground of five cells or more."""
    cells = raster(spark, sf)
    return C.connection_stages(cells, C.sources(cells, 4.0, 5), 20.0).select("y", "x", F.round("stage", 6).alias("stage"))


def pixels(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    elevation = F.when(c % 17 == 0, -2000.0).when(c % 19 != 0, (c % 400) / 10 - 5)
    return table(spark, sf, "orders").select(
        F.floor(k / WIDE).alias("y"), (k % WIDE).alias("x"), elevation.alias("elevation"), (c % 7).cast("double").alias("zone"), ((c % 200) / 10).alias("connection"), (c % 2).cast("double").alias("source"),
        F.when(c % 11 == 0, 1.0).otherwise(0.0).alias("hard"), F.when(c % 13 == 0, 1.0).otherwise(0.0).alias("grate"), (k % 3 == 0).cast("double").alias("developed"),
    )


def a16(spark, sf):
    """Band values at customers' places, from tiles."""
    path, (dx, dy), k = scratch(spark, "tiles"), FRAME.steps, F.col("c_custkey")
    B.write_tiles(pixels(spark, sf), path, FRAME)
    at = table(spark, sf, "customer").select(k.alias("k"), (FRAME.north - (k * 37 % 12007 / 10 + 0.05) * dy).alias("lat"), (FRAME.west + ((k * 53 % 1250) / 10 - 1.95) * dx).alias("lon"))
    out = B.snapped(at, spark.read.parquet(path), FRAME)
    return out.select("k", "y", "x", *B.BANDS, F.round("feature_ft", 6).alias("feature_ft"))


_DX, _DY = FRAME.steps
_A16 = f"""WITH f AS (SELECT o_orderkey // 120 AS y, o_orderkey % 120 AS x, CASE WHEN o_custkey % 17 = 0 THEN -2000.0::DOUBLE WHEN o_custkey % 19 <> 0 THEN (o_custkey % 400) / 10.0::DOUBLE - 5 END AS elevation, (o_custkey % 7)::DOUBLE AS zone, (o_custkey % 200) / 10.0::DOUBLE AS connection, (o_custkey % 2)::DOUBLE AS source,
  CASE WHEN o_custkey % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hard, CASE WHEN o_custkey % 13 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grate, (o_orderkey % 3 = 0)::INT::DOUBLE AS developed FROM orders),
c AS (SELECT c_custkey AS k, {FRAME.north!r}::DOUBLE - (c_custkey * 37 % 12007 / 10.0::DOUBLE + 0.05::DOUBLE) * {_DY!r}::DOUBLE AS lat, {FRAME.west!r}::DOUBLE + ((c_custkey * 53 % 1250) / 10.0::DOUBLE - 1.95::DOUBLE) * {_DX!r}::DOUBLE AS lon FROM customer),
p AS (SELECT k, floor((lon - {FRAME.west!r}::DOUBLE) / {_DX!r}::DOUBLE)::BIGINT AS px, floor(({FRAME.north!r}::DOUBLE - lat) / {_DY!r}::DOUBLE)::BIGINT AS py, cos(radians(lat)) * ({_DX!r}::DOUBLE * 364000) AS wide FROM c),
h AS (SELECT k, min(off) AS off, arg_min(f, (off, f.y, f.x)) AS near FROM (SELECT k, f, ((f.x - px) * wide) ** 2 + ((f.y - py) * ({_DY!r}::DOUBLE * 364000)) ** 2 AS off FROM p JOIN f ON f.x BETWEEN px - 9 AND px + 9 AND f.y BETWEEN py - 9 AND py + 9
  WHERE px BETWEEN 0 AND 119 AND py >= 0 AND f.elevation > -100 AND f.elevation < 100 AND (f.hard = 1 OR f.grate = 1)) WHERE off <= 256 GROUP BY k),
b AS (SELECT p.k, py AS y, px AS x, coalesce(near, f) AS v, round(sqrt(off), 6) AS feature_ft FROM p LEFT JOIN f ON f.y = py AND f.x = px LEFT JOIN h ON h.k = p.k WHERE px BETWEEN 0 AND 119 AND py >= 0)
SELECT k, y, x, {', '.join(f'v.{c}' for c in B.BANDS)}, feature_ft FROM b WHERE abs(v.elevation) < 1000"""

SIDE = (24, 25)  # rows and columns of an image
SPOILT = 11


def query_images(spark, sf):
    """Images of 600 orders as files: every filter by row, and one file in ``SPOILT`` with a wrong byte."""
    height, wide = SIDE
    path = scratch(spark, "images")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        image = int(pdf["image"].iloc[0])
        values = np.zeros((height, wide, 4), np.int64)
        c = pdf["c"].to_numpy()
        values[pdf["i"] // wide, pdf["i"] % wide] = np.column_stack([c % 256, c * 3 % 256, c * 7 % 256, 255 - c % 16])
        data = bytearray(images.packed(values, (np.arange(height) + image) % 5))
        if image % SPOILT == SPOILT - 1:
            data[60] ^= 1
        return pd.DataFrame({"name": [f"{image}.png"], "content": [bytes(data)]})

    size = height * wide
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / size).alias("image"), (F.col("o_orderkey") % size).alias("i"), F.col("o_custkey").alias("c"))
    blobs.write_files(rows.groupBy("image").applyInPandas(pack, "name string, content binary"), path)
    return images.image_files(spark, path)


def a15(spark, sf):
    """Pixels of the images, and the files that could not be read."""
    got = query_images(spark, sf).withColumn("image", F.regexp_extract("name", r"^(\d+)", 1).cast("long"))
    each = got.where("fault IS NULL").select("image", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.slice("pixels", x * F.col("channels") + 1, 4))).alias("x", "p"))
    rows = each.select("image", "y", "x", *(F.get("p", F.lit(n)).alias(c) for n, c in enumerate("rgba")), F.lit(None).cast("string").alias("fault")).where("a > 0")
    none = [F.lit(-1).alias(c) for c in ("y", "x", *"rgba")]
    return rows.unionByName(got.where("fault IS NOT NULL").select("image", *none, "fault"))


_A15 = f"""WITH o AS (SELECT o_orderkey // 600 AS image, CAST(o_orderkey % 600 // 25 AS INT) AS y, CAST(o_orderkey % 25 AS INT) AS x, CAST(o_custkey % 256 AS INT) AS r, CAST(o_custkey * 3 % 256 AS INT) AS g, CAST(o_custkey * 7 % 256 AS INT) AS b, CAST(255 - o_custkey % 16 AS INT) AS a FROM orders)
SELECT image, y, x, r, g, b, a, CAST(NULL AS VARCHAR) AS fault FROM o WHERE image % {SPOILT} <> {SPOILT - 1} UNION ALL SELECT DISTINCT image, -1, -1, -1, -1, -1, -1, 'checksum' FROM o WHERE image % {SPOILT} = {SPOILT - 1}"""


def l6(spark, sf):
    """Classes of rendered pixels: colours near the palette, near the colour of cut-off water, and others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    known = [*B.DEPTH_COLOURS, B.GREEN, (200, 100, 50)]
    base = F.element_at(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(rgb, "rgb"))) for rgb in known)), (c % 13 + 1).cast("int"))
    moved = lambda n, m: F.greatest(F.lit(0), F.least(F.lit(255), base[n] + k % m - m // 2)).cast("long").alias(n)
    px = table(spark, sf, "orders").select(k.alias("cell"), moved("r", 9), moved("g", 7), moved("b", 5), F.when(k % 7 == 0, 0).otherwise(255).alias("a"))
    palette = spark.createDataFrame([(e, *rgb) for e, rgb in enumerate(B.DEPTH_COLOURS)], "entry int, pr int, pg int, pb int")
    low, high = B.band_feet(F.col("entry"))
    return B.rendered_class(px, ["cell"], palette).select("cell", "visible", "green", "flooded", low.alias("from_ft"), high.alias("below_ft"))


_KNOWN = [*B.DEPTH_COLOURS, B.GREEN, (200, 100, 50)]
_MOVED = {n: f"greatest(0, least(255, [{', '.join(str(rgb[i]) for rgb in _KNOWN)}][o_custkey % 13 + 1] + o_orderkey % {m} - {m // 2}))" for i, (n, m) in enumerate(zip("rgb", (9, 7, 5)))}
_L6 = f"""WITH p(entry, pr, pg, pb) AS (VALUES {', '.join(f'({e}, {r}, {g}, {b})' for e, (r, g, b) in enumerate(B.DEPTH_COLOURS))}),
c AS (SELECT o_orderkey AS cell, {', '.join(f'{v} AS {n}' for n, v in _MOVED.items())}, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 255 END AS a FROM orders),
e AS (SELECT cell, min(entry) AS entry FROM c, p WHERE abs(r - pr) <= 3 AND abs(g - pg) <= 3 AND abs(b - pb) <= 3 GROUP BY cell),
d AS (SELECT *, a > 0 AND abs(r - 99) <= 4 AND abs(g - 212) <= 4 AND abs(b - 113) <= 4 AS green FROM c LEFT JOIN e USING (cell))
SELECT cell, a > 0 AS visible, green, a > 0 AND NOT green AS flooded, CASE WHEN entry = 0 THEN 0.0::DOUBLE WHEN entry > 0 THEN {B.DEPTH_BREAKS_FT}[entry]::DOUBLE END AS from_ft, CASE WHEN entry < 10 THEN {B.DEPTH_BREAKS_FT}[entry + 1]::DOUBLE END AS below_ft FROM d"""

_ENTRIES = {
    "L20_contour_pieces": (pieces, _PIECES_SQL),
    "L20_contours": (l20, None),
    "A24_contour_sink": (a24, None),
    "L19_connection_stages": (l19, None),
    "A16_snapped_bands": (a16, _A16),
    "A15_query_images": (a15, _A15),
    "L6_rendered_class": (l6, _L6),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1]}
