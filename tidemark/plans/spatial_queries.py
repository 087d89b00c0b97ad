"""Joins by place, footprints and rasters over the driver's tables (sections I, F, L and M of the survey), with DuckDB SQL.

Stand-ins: customers are points and parcels, suppliers structures, orders raster cells; a parcel is a square of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import scalars as S
from ..operators import grids as R
from ..operators import spatial as X
from ..sources.tables import checkpoints, table
from .grid_queries import _C, _K, _RING_SQL, _inside_sql, TH, cells, rings

SIDE = 0.002


def customers(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), (40 + (k * 37 % 1009) / 20000).alias("lat"), (-74 + (k * 53 % 1013) / 20000).alias("lon"))


def structures(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), (40 + (k * 31 % 997) / 20000).alias("lat"), (-74 + (k * 71 % 991) / 20000).alias("lon"), F.round(F.col("s_acctbal") / 1000, 3).alias("floor"), (k % 40).alias("footprint"))


_CU = "cu AS (SELECT c_custkey AS k, 40 + (c_custkey * 37 % 1009) / 20000.0::DOUBLE AS lat, -74 + (c_custkey * 53 % 1013) / 20000.0::DOUBLE AS lon FROM customer)"
_ST = "st AS (SELECT s_suppkey AS id, 40 + (s_suppkey * 31 % 997) / 20000.0::DOUBLE AS plat, -74 + (s_suppkey * 71 % 991) / 20000.0::DOUBLE AS plon, round(s_acctbal / 1000, 3) AS floor, s_suppkey % 40 AS footprint FROM supplier)"
_M = "sqrt(((plat - lat) * 111320.0::DOUBLE) ** 2 + ((plon - lon) * 111320.0::DOUBLE * cos(radians(lat))) ** 2)"


def parcels(spark, sf):
    """A square of SIDE degrees around every seventh customer."""
    c = customers(spark, sf).where("k % 7 = 0")
    corner = lambda i, j: F.struct((F.col("lon") + i * SIDE / 2).alias("x"), (F.col("lat") + j * SIDE / 2).alias("y"))
    return c.select(F.col("k").alias("parcel"), "lat", "lon", F.array(F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))).alias("polygons"))


_IN = f"(c.lon >= p.lon - {SIDE / 2} AND c.lon < p.lon + {SIDE / 2} AND c.lat >= p.lat - {SIDE / 2} AND c.lat < p.lat + {SIDE / 2})"


def i6(spark, sf):
    """The lowest structure inside of each parcel."""
    s = structures(spark, sf).select(F.col("id").alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"), "floor")
    return X.lowest_inside(s, parcels(spark, sf), "parcel", SIDE, "floor").select("parcel", "k", "floor")


_I6 = f"WITH {_CU}, {_ST}, p AS (SELECT k AS parcel, lat, lon FROM cu WHERE k % 7 = 0), c AS (SELECT id AS k, plat AS lat, plon AS lon, floor FROM st) SELECT parcel, c.k, floor FROM p JOIN c ON {_IN} QUALIFY row_number() OVER (PARTITION BY parcel ORDER BY floor, c.k) = 1"


def i8(spark, sf):
    p = parcels(spark, sf)
    at = customers(spark, sf).where("k % 3 = 1").select("k", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return X.shape_or_nearest(at, p, p.select("parcel", "lat", "lon"), "parcel", SIDE, 200.0)


_I8 = f"""WITH {_CU}, p AS (SELECT k AS parcel, lat, lon, lat AS plat, lon AS plon FROM cu WHERE k % 7 = 0), c AS (SELECT * FROM cu WHERE k % 3 = 1), i AS (SELECT c.k, min(parcel) AS parcel FROM c JOIN p ON {_IN} GROUP BY 1),
n AS (SELECT c.k, p.parcel, {_M.replace('lat)', 'c.lat)').replace('- lat', '- c.lat').replace('- lon', '- c.lon')} AS off FROM c, p WHERE c.k NOT IN (SELECT k FROM i))
SELECT k, parcel, 'inside' AS how FROM i UNION ALL (SELECT k, parcel, 'near' FROM n WHERE off <= 200 QUALIFY row_number() OVER (PARTITION BY k ORDER BY off, parcel) = 1)"""


def i12(spark, sf):
    checkpoints(spark)
    s = structures(spark, sf).select("id", "lat", "lon", F.col("floor").alias("ground"))
    return X.ring_search(customers(spark, sf).where("k % 5 = 2").select("k", "lat", "lon"), s, 0.001, 3)


_I12 = f"""WITH {_CU}, {_ST}, c AS (SELECT k, lat, lon, CAST(floor(lat / 0.001::DOUBLE) AS BIGINT) AS cy, CAST(floor(lon / 0.001::DOUBLE) AS BIGINT) AS cx FROM cu WHERE k % 5 = 2), g AS (SELECT *, CAST(floor(plat / 0.001::DOUBLE) AS BIGINT) AS gy, CAST(floor(plon / 0.001::DOUBLE) AS BIGINT) AS gx FROM st),
j AS (SELECT k, id, floor AS ground, greatest(abs(cy - gy), abs(cx - gx)) AS ring, (plat - lat) ** 2 + ((plon - lon) * cos(radians(lat))) ** 2 AS off FROM c JOIN g ON abs(cy - gy) <= 3 AND abs(cx - gx) <= 3), b AS (SELECT k, ground FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY ring, off, id) = 1)
SELECT c.k, coalesce(b.ground, (SELECT list_sort(list(floor))[count(*) // 2 + 1] FROM st)) AS ground FROM c LEFT JOIN b USING (k)"""


def i14(spark, sf):
    """Parcels whose every vertex is inside of the town."""
    town = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-74.0, 40.0), (-73.96, 40.0), (-73.96, 40.03), (-74.0, 40.03))))
    return parcels(spark, sf).where(G.all_inside(F.flatten(F.flatten("polygons")), town)).select("parcel")


def raster(spark, sf):
    c = F.col("cell")
    return cells(spark, sf).where("y < 11 AND x < 14").select("y", "x", (c % 13 != 0).alias("covered"), (F.col("ground") < 25).alias("wet"), F.when(c % 9 != 0, (c % 6).cast("int")).alias("band"))


def f19(spark, sf):
    spans = R.rasterised(rings(spark, sf).where("k % 4 = 0").select(F.col("k").alias("shape_id"), F.array("ring").alias("rings")), 14, 11)
    return X.zonal(spans, raster(spark, sf))


_EDGES = " UNION ALL ".join(f"SELECT k, ({ax})::DOUBLE AS ax, ({ay})::DOUBLE AS ay, ({bx})::DOUBLE AS bx, ({by})::DOUBLE AS b_y FROM k WHERE k % 4 = 0" for (ax, ay), (bx, by) in zip(_RING_SQL, [*_RING_SQL[1:], _RING_SQL[0]]))
_F19 = f"""WITH {_C}, {_K}, e AS ({_EDGES}), g AS (SELECT y, x FROM range(11) a(y), range(14) b(x)),
i AS (SELECT k, g.y, g.x, count(*) FILTER ((ay > g.y + 0.5) <> (b_y > g.y + 0.5) AND g.x + 0.5 < (bx - ax) * (g.y + 0.5 - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inside FROM e, g GROUP BY 1, 2, 3),
r AS (SELECT y, x, cell % 13 <> 0 AS covered, ground < 25 AS wet, CASE WHEN cell % 9 <> 0 THEN cell % 6 END AS band FROM c WHERE y < 11 AND x < 14)
SELECT k AS shape_id, count(*) AS total, count(*) FILTER (covered) AS covered, count(*) FILTER (covered AND wet) AS wet, CAST(coalesce(max(CASE WHEN covered AND wet THEN coalesce(band, -1) END), -1) AS INT) AS deepest, coalesce(bool_or(covered AND wet AND band IS NULL), false) AS unresolved FROM i LEFT JOIN r USING (y, x) WHERE inside GROUP BY 1"""


def f22(spark, sf):
    c = cells(spark, sf)
    return c.groupBy("phase").agg(F.count(F.when(G.flood_class(F.col("ground"), F.col("stage"), TH).isNotNull(), 1)).alias("wet"), F.count(F.when(F.col("connection") > 200, 1)).alias("uncertain"))


def l13(spark, sf):
    """The order in which the cells of a raster of ninety rows fill."""
    c = cells(spark, sf)
    frame = c.select(F.floor(F.col("y") / 90).alias("frame"), (F.col("y") % 90).alias("y"), "x", (F.col("ground") < 3).alias("lower_wet"), F.col("ground").between(3, 22).alias("candidate"), (F.col("ground") > 12).alias("shallow"))
    return R.filling_order(frame, "frame")


def l24(spark, sf):
    """Depth and state of a point: nothing where it isn't covered, uncertain where the mask says so."""
    c = cells(spark, sf)
    depth = F.greatest(F.lit(0.0), F.col("stage") - F.col("ground"))
    state = F.when(F.col("connection") == 255, "unavailable").when(F.col("connection") > 200, "uncertain").otherwise("modeled")
    return c.select("cell", state.alias("state"), F.when(state == "modeled", F.round(depth, 4)).alias("depth"))


def m7(spark, sf):
    """Features of two kinds of rings: clockwise ones are outer, the others holes."""
    r = rings(spark, sf).where("k % 3 <> 2").select("k", F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(p["x"], p["y"])).alias("c"))
    return r.select("k", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array("c").alias("coordinates")).alias("geometry"))).alias("geojson")).select("k", F.get_json_object("geojson", "$.geometry.type").alias("kind"), F.size(F.from_json(F.get_json_object("geojson", "$.geometry.coordinates[0]"), "array<array<double>>")).alias("points"))


def m18(spark, sf):
    """The first usable boundary of each nation among its customers (candidates in order)."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("town"), F.col("c_custkey").alias("place"), (F.col("c_custkey") % 4 == 1).alias("usable"))
    return X.first_usable(c, "town").select("town", "place")


_ENTRIES = {
    "E15_road_sections": (lambda s, p: R.wet_runs(table(s, p, "orders").select((F.col("o_custkey") % 700).alias("k"), F.col("o_orderkey").alias("i"), "o_totalprice"), "k", "i", (F.col("o_totalprice") > 50000) & (F.col("i") % 9 != 0)), "WITH z AS (SELECT o_custkey % 700 AS k, o_orderkey AS i, o_totalprice > 50000 AND o_orderkey % 9 <> 0 AS w, sum(CASE WHEN o_totalprice > 50000 AND o_orderkey % 9 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey % 700 ORDER BY o_orderkey) AS g FROM orders) SELECT k, min(i) AS first, max(i) AS last, count(*) AS steps FROM z WHERE w GROUP BY k, g"),
    "F17_lowest_floors": (lambda s, p: X.lowest(structures(s, p), "footprint", "floor", "id").select("footprint", "id", "floor"), f"WITH {_ST} SELECT footprint, id, floor FROM st QUALIFY row_number() OVER (PARTITION BY footprint ORDER BY floor, id) = 1"),
    "F19_zonal": (f19, _F19),
    "F22_pixel_counts": (f22, f"WITH {_C} SELECT phase, count(*) FILTER (ground < stage - 0.005::DOUBLE) AS wet, count(*) FILTER (connection > 200) AS uncertain FROM c GROUP BY 1"),
    "H10_rings_by_area": (lambda s, p: rings(s, p).select("k", F.array("ring", F.transform("ring", lambda q: F.struct((q["x"] * (F.col("k") % 3)).alias("x"), q["y"].alias("y")))).alias("rings")).select("k", X.by_area(F.col("rings"), S.ring_area).alias("o"), "rings").select("k", (F.get("o", F.lit(0)) == F.get("rings", F.lit(0))).alias("first_stays")), "SELECT c_custkey AS k, c_custkey % 3 < 2 AS first_stays FROM customer"),
    "I5_certified_floors": (lambda s, p: structures(s, p).join(structures(s, p).where("id % 3 = 0").select("id", (F.col("footprint") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("own"), (F.col("floor") + 1).alias("certified")), "id", "left").select("id", F.round(F.when(F.col("own") == F.col("footprint"), F.col("certified")).otherwise(F.col("floor")), 3).alias("floor")), f"WITH {_ST} SELECT id, round(CASE WHEN id % 6 = 0 THEN floor + 1 ELSE floor END, 3) AS floor FROM st"),
    "I6_lowest_inside": (i6, _I6),
    "I7_nearest_structure": (lambda s, p: X.nearest_within(customers(s, p), structures(s, p), 120.0, "id").select("k", "id"), f"WITH {_CU}, {_ST}, j AS (SELECT k, id, {_M} AS off FROM cu, st) SELECT k, id FROM j WHERE off <= 120 QUALIFY row_number() OVER (PARTITION BY k ORDER BY off, id) = 1"),
    "I8_inside_or_near": (i8, _I8),
    "I12_ring_search": (i12, _I12),
    "I14_inside_town": (i14, f"WITH {_CU} SELECT k AS parcel FROM cu WHERE k % 7 = 0 AND lon - {SIDE / 2} >= -74.0 AND lon + {SIDE / 2} < -73.96 AND lat - {SIDE / 2} >= 40.0 AND lat + {SIDE / 2} < 40.03"),
    "L13_filling_order": (l13, None),
    "L22_town_points": (lambda s, p: cells(s, p).select("cell", F.when(F.col("connection") != 0, F.struct(F.round(F.col("ground"), 1).alias("g"), F.col("developed").alias("d"))).alias("q")).select("cell", F.col("q.g").alias("ground"), F.col("q.d").alias("developed")), f"WITH {_C} SELECT cell, CASE WHEN connection <> 0 THEN round(ground, 1) END AS ground, CASE WHEN connection <> 0 THEN developed END AS developed FROM c"),
    "L24_point_state": (l24, f"WITH {_C}, z AS (SELECT *, CASE WHEN connection = 255 THEN 'unavailable' WHEN connection > 200 THEN 'uncertain' ELSE 'modeled' END AS state FROM c) SELECT cell, state, CASE WHEN state = 'modeled' THEN round(greatest(0.0::DOUBLE, stage - ground), 4) END AS depth FROM z"),
    "M5_structure_floors": (lambda s, p: structures(s, p).where(F.col("lat").between(40.005, 40.04)).select("id", F.round(F.col("floor") + F.greatest(F.lit(0.0), F.col("id") % 5 - 1.0), 3).alias("floor")), f"WITH {_ST} SELECT id, round(floor + greatest(0.0::DOUBLE, id % 5 - 1), 3) AS floor FROM st WHERE plat BETWEEN 40.005 AND 40.04"),
    "M7_features": (m7, "SELECT c_custkey AS k, 'Polygon' AS kind, 5 AS points FROM customer WHERE c_custkey % 3 <> 2"),
    "M18_first_usable": (m18, "SELECT c_nationkey AS town, min(c_custkey) AS place FROM customer WHERE c_custkey % 4 = 1 GROUP BY 1"),
    "M19_complement": (lambda s, p: rings(s, p).select("k", F.concat(F.array(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0))))), F.array("ring")).alias("mask")).select("k", G.in_polygon((F.col("k") % 17 + 0.37), (F.col("k") % 13 + 0.41), F.array("mask")).alias("outside")), f"WITH {_K} SELECT k, NOT {_inside_sql('(k % 17 + 0.37::DOUBLE)', '(k % 13 + 0.41::DOUBLE)', _RING_SQL)} AS outside FROM k"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
