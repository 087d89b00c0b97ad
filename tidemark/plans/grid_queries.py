"""Raster cells and geometry over the driver's tables (sections L and M), with their DuckDB SQL.

Stand-ins: an order is a cell (its key dealt over rows of 120), its customer gives ground, connection and colour; a
customer is a point, a ring, a road or a building.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import scalars as S
from ..operators import grids as O
from ..sources.tables import spread, table

TH = S.Thresholds(5.0, 11.0, 22.0)
WIDTH = 120
BOUNDS = (40.1, -74.4, 40.9, -73.6)
CORNERS = ((0.0, 1000.0), (1000.0, 1100.0), (-150.0, 0.0))
PALETTES = [[(99, 212, 113), (170, 230, 180)], [(190, 220, 255), (90, 150, 240), (10, 50, 160)]]
PHASES = ("filling", "slack", "draining-release-15", "draining-release-30", "draining")


def cells(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("cell"), F.floor(k / WIDTH).alias("y"), (k % WIDTH).alias("x"), ((c % 400) / 10).alias("ground"), (c % 256).alias("connection"), (k % 3 == 0).alias("developed"),
        ((c * 7 % 300) / 10 + 0.03).alias("stage"), F.element_at(F.array(*(F.lit(p) for p in PHASES)), (k % 5 + 1).cast("int")).alias("phase"),
        F.when(c % 5 != 0, c % 5 > 2).alias("rendered"), F.struct((c % 256).alias("r"), (c * 3 % 256).alias("g"), (c * 11 % 256).alias("b")).alias("pixel"),
    )


_C = "c AS (SELECT o_orderkey AS cell, o_orderkey // 120 AS y, o_orderkey % 120 AS x, (o_custkey % 400) / 10.0::DOUBLE AS ground, o_custkey % 256 AS connection, o_orderkey % 3 = 0 AS developed, (o_custkey * 7 % 300) / 10.0::DOUBLE + 0.03::DOUBLE AS stage, ['filling', 'slack', 'draining-release-15', 'draining-release-30', 'draining'][o_orderkey % 5 + 1] AS phase, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 5 > 2 END AS rendered, o_custkey % 256 AS r, o_custkey * 3 % 256 AS g, o_custkey * 11 % 256 AS b FROM orders)"


def _pen(s):
    return f"(CASE WHEN {s} < 5 OR {s} >= 22 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({s} - 11) * ({s} - 22) * (0.75::DOUBLE / ((5 - 11) * (5 - 22))) + ({s} - 5) * ({s} - 22) * (0.25::DOUBLE / ((11 - 5) * (11 - 22)))) END)"


def _left(s):
    return f"(CASE WHEN {_pen(s)} <= 0 THEN 0.0::DOUBLE WHEN phase IN ('filling', 'slack') THEN 1.0 WHEN phase = 'draining-release-15' THEN CASE WHEN {s} < 11 THEN 2.0::DOUBLE / 3 ELSE 0.5 END WHEN phase = 'draining-release-30' THEN CASE WHEN {s} < 11 THEN 1.0::DOUBLE / 3 ELSE 0.0 END ELSE 0.0 END)"


_OVERLAY = "round(floor((greatest(0.0::DOUBLE, least(20.0::DOUBLE, stage)) + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)"


def points(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), (40 + (k * 37 % 1009) / 1009).alias("lat"), (-74.5 + (k * 53 % 1013) / 1013).alias("lng"))


_P = "p AS (SELECT c_custkey AS k, 40 + (c_custkey * 37 % 1009) / 1009.0::DOUBLE AS lat, -74.5::DOUBLE + (c_custkey * 53 % 1013) / 1013.0::DOUBLE AS lng FROM customer)"


def _xy(p):
    return [F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y")]


def _pixel_sql(width, height):
    top, bottom = (math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (BOUNDS[2], BOUNDS[0]))
    return f"u AS (SELECT k, (lng - {BOUNDS[1]}::DOUBLE) / {BOUNDS[3] - BOUNDS[1]!r}::DOUBLE AS u, ({top!r}::DOUBLE - ln(tan({math.pi / 4!r}::DOUBLE + radians(lat) / 2))) / {top - bottom!r}::DOUBLE AS v FROM p), px AS (SELECT k, CASE WHEN ok THEN CAST(floor(u * {width}) AS BIGINT) END AS x, CASE WHEN ok THEN CAST(floor(v * {height}) AS BIGINT) END AS y FROM (SELECT *, u >= 0 AND u < 1 AND v >= 0 AND v < 1 AS ok FROM u))"


def _merc_pixel(width, height):
    return G.mercator_pixel(F.col("lat"), F.col("lng"), BOUNDS, width, height)


def l4(spark, sf):
    at = points(spark, sf).select("k", _merc_pixel(WIDTH, 10).alias("p")).select("k", *_xy("p"))
    return at.join(cells(spark, sf).select("x", "y", "ground", "connection"), ["x", "y"], "left").select("k", "x", "y", "ground", "connection")


def _plane(lat, lng):
    e2 = G.FLATTENING * (2 - G.FLATTENING)
    ep2 = e2 / (1 - e2)
    k = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    d = "::DOUBLE"
    arc = lambda p: f"{G.AXIS}{d} * ({k[0]!r}{d} * {p} - {k[1]!r}{d} * sin(2 * {p}) + {k[2]!r}{d} * sin(4 * {p}) - {k[3]!r}{d} * sin(6 * {p}))"
    base = f"b AS (SELECT k, radians(lat) AS p, {G.AXIS}{d} / sqrt(1 - {e2!r}{d} * sin(radians(lat)) ** 2) AS n, tan(radians(lat)) ** 2 AS t, {ep2!r}{d} * cos(radians(lat)) ** 2 AS c, radians(lng + 74.5{d}) * cos(radians(lat)) AS a FROM p)"
    east = f"({G.SCALE}{d} * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep2!r}{d}) * a ** 5 / 120) + 150000) / (1200.0{d} / 3937)"
    north = f"({G.SCALE}{d} * ({arc('p')} - {arc(f'radians({G.LAT0!r}{d})')} + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {ep2!r}{d}) * a ** 6 / 720))) / (1200.0{d} / 3937)"
    return base, east, north


_B, _EAST, _NORTH = _plane("lat", "lng")


WEST_FT, NORTH_FT, CELL_FT = 492125.0, 790000.0, 2300.0


def l23(spark, sf):
    """Cells under points by their place in the state plane; points outside of the raster give no row."""
    plane = points(spark, sf).select("k", G.state_plane(F.col("lat"), F.col("lng")).alias("p"))
    at = plane.select("k", F.floor((F.col("p.east") - WEST_FT) / CELL_FT).alias("x"), F.floor((NORTH_FT - F.col("p.north")) / CELL_FT).alias("y"))
    return at.join(cells(spark, sf).select("x", "y", "ground", "connection"), ["x", "y"]).select("k", "x", "y", "ground", "connection")


def _ring():
    """Four corners of a customer's ring, as in _RING_SQL."""
    k = F.col("c_custkey")
    pts = [(k % 10, k % 7), (k % 10 + 5, k % 7), (k % 10 + 5 + k % 3, k % 7 + 4), (k % 10, k % 7 + 6)]
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in pts))


_RING_SQL = [("k % 10", "k % 7"), ("k % 10 + 5", "k % 7"), ("k % 10 + 5 + k % 3", "k % 7 + 4"), ("k % 10", "k % 7 + 6")]
_TOWN = [(2.0, 1.0), (14.0, 0.5), (16.5, 9.0), (5.0, 13.5)]
_HOLE = [(6.0, 4.0), (9.0, 4.0), (9.0, 7.0), (6.0, 7.0)]


def _literal(ring):
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring))


def _inside_sql(x, y, ring):
    """Crossings of a ring of expressions, even-odd."""
    parts = []
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        parts.append(f"CASE WHEN (({ay}) > {y}) <> (({by}) > {y}) AND {x} < (({bx}) - ({ax})) * ({y} - ({ay})) / nullif(({by}) - ({ay}), 0)::DOUBLE + ({ax}) THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def rings(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _ring().alias("ring"))


_K = "k AS (SELECT c_custkey AS k FROM customer)"


def _k(columns):
    return lambda spark, sf: rings(spark, sf).select("k", *[c.alias(n) for n, c in columns().items()])


def _ksql(**columns):
    return f"WITH {_K} SELECT k, " + ", ".join(f"{v} AS {n}" for n, v in columns.items()) + " FROM k"


def _cell(column):
    return lambda spark, sf: cells(spark, sf).select("cell", column().alias("out"))


def _cell_sql(text):
    return f"WITH {_C} SELECT cell, {text} AS out FROM c"


def _px():
    return F.col("k") % 17 + 0.37, F.col("k") % 13 + 0.41


_X, _Y = "(k % 17 + 0.37::DOUBLE)", "(k % 13 + 0.41::DOUBLE)"


def l9(spark, sf):
    c = cells(spark, sf)
    stages = c.select("cell", G.flood_class(F.col("ground"), F.col("stage"), TH).alias("stage_class"))
    doubt = c.where("connection > 200").select("cell", F.lit(9).alias("doubt"))
    return stages.join(doubt, "cell", "left").select("cell", F.coalesce("doubt", "stage_class").alias("out"))


def l12(spark, sf):
    c = cells(spark, sf).withColumn("lower", S.catalog_floor(F.col("stage")))
    cand = G.newly_wet(F.col("ground") < F.col("lower") - 4, F.col("ground") < F.col("stage"), F.col("developed"))
    blend = S.transition_blend(S.step_fraction(F.col("stage"), F.col("lower")))
    return c.where(cand).select("cell", F.round(blend * G.transition_depth(F.col("ground"), F.col("connection"), F.col("developed"), F.col("stage"), TH), 4).alias("out"))


_CAND = "NOT (ground < round(floor((stage + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2) - 4) AND ground < stage AND developed"
_TDEPTH = f"CASE WHEN connection <> 255 AND ground <= stage - CASE WHEN developed THEN {_pen('stage')} ELSE 0.0 END + 1e-9 THEN greatest(0.005::DOUBLE, stage - CASE WHEN developed THEN {_pen('stage')} ELSE 0.0 END - ground) END"
_FRAC = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (stage - round(floor((stage + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)) / 0.1::DOUBLE))"


def l13(spark, sf):
    found = O.components(cells(spark, sf).where("ground < 18").select("y", "x"))
    return found.groupBy("component").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("y").alias("y"))


def l14(spark, sf):
    c = cells(spark, sf)
    now = c.select("cell", "ground", (F.col("ground") < 12).alias("wet"))
    past = c.select("cell", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"), "ground", "connection")
    past = past.select("cell", "frame", (F.col("connection") < 180).alias("shown"), (F.col("ground") < 16 - 2 * F.col("frame")).alias("wet"))
    return O.retained(now, past, F.lit(14.0)).select("cell", "wet", F.round("depth", 4).alias("depth"))


def l17(spark, sf):
    """Requests for a frame, in two modes and all phases, with the history of L14."""
    c = cells(spark, sf)
    now = c.select("cell", "ground", "connection", "developed", "stage", "phase", F.when(F.col("cell") % 2 == 0, "depth").otherwise("dynamic").alias("mode"))
    past = c.select("cell", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"), "ground", "connection")
    past = past.select("cell", "frame", (F.col("connection") < 180).alias("shown"), (F.col("ground") < 16 - 2 * F.col("frame")).alias("wet"))
    out = O.overlay_composite(now, past, TH)
    return out.select("cell", "wet", F.coalesce(F.round("depth", 4), F.lit(-1.0)).alias("depth"), F.coalesce("flood_class", F.lit(-1)).alias("flood_class"))


def l16(spark, sf):
    """Requests (stage, phase) against the files that exist: the phase's own first, then the base set; null where none."""
    wanted = cells(spark, sf).select("cell", S.stage_code(S.catalog_stage(F.col("stage"))).alias("code"), "phase")
    have = cells(spark, sf).where("cell % 7 = 0").select(S.stage_code(S.catalog_stage(F.col("ground"))).alias("code"), F.when(F.col("cell") % 2 == 0, F.col("phase")).otherwise("base").alias("root")).distinct()
    tries = wanted.select("cell", "code", F.posexplode(F.array(F.col("phase"), F.lit("base"))).alias("rank", "root"))
    return tries.join(have, ["code", "root"]).groupBy("cell").agg(F.min(F.struct("rank", "root", "code")).alias("b")).select("cell", F.concat_ws("/", "b.root", "b.code").alias("out"))


_CODE = "'p' || lpad(CAST(CAST(round({0} * 10) AS INT) AS VARCHAR), 3, '0')"
_GROUND_CODE = _CODE.format(_OVERLAY.replace("stage", "ground"))


def l18(spark, sf):
    return O.rasterised(rings(spark, sf).select(F.col("k").alias("shape_id"), F.array("ring").alias("rings")), 14, 11)


_EDGES = " UNION ALL ".join(f"SELECT k, ({ax})::DOUBLE AS ax, ({ay})::DOUBLE AS ay, ({bx})::DOUBLE AS bx, ({by})::DOUBLE AS b_y FROM k" for (ax, ay), (bx, by) in zip(_RING_SQL, [*_RING_SQL[1:], _RING_SQL[0]]))


def l26(spark, sf):
    """Listed cells only: depth where the ground is at or below the adjusted stage."""
    listed = cells(spark, sf).where("cell % 4 = 1").select("cell")
    depth = G.transition_depth(F.col("ground"), F.lit(0), F.col("developed"), F.col("stage"), TH)
    return cells(spark, sf).join(listed, "cell").select("cell", F.round(depth, 4).alias("out")).where("out IS NOT NULL")


def _road():
    x, y = -74 + (F.col("k") % 97) / 1000, 40 + (F.col("k") % 89) / 1000
    return F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + (F.col("k") % 5) / 10000).alias("x"), (y + 0.00021).alias("y")), F.struct((x + 0.0009).alias("x"), (y + 0.00021).alias("y")))


def m10(spark, sf):
    return O.densified_points(rings(spark, sf), "k", _road()).select("k", "i", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


def _piece_sql(a, b, i):
    length = f"sqrt((({b[0]}) - ({a[0]})) * cos(radians((({a[1]}) + ({b[1]})) / 2)) * (({b[0]}) - ({a[0]})) * cos(radians((({a[1]}) + ({b[1]})) / 2)) + (({b[1]}) - ({a[1]})) ** 2) * 111320"
    return f"SELECT k, {i} AS piece, s, ({a[0]}) + (({b[0]}) - ({a[0]})) * (s / n::DOUBLE) AS x, ({a[1]}) + (({b[1]}) - ({a[1]})) * (s / n::DOUBLE) AS y FROM (SELECT *, unnest(generate_series(1, n)) AS s FROM (SELECT *, greatest(1, CAST(ceil({length} / 5) AS BIGINT)) AS n FROM r))"


_RD = [("x0", "y0"), ("x0 + (k % 5) / 10000.0::DOUBLE", "y0 + 0.00021::DOUBLE"), ("x0 + 0.0009::DOUBLE", "y0 + 0.00021::DOUBLE")]
_M10 = f"WITH {_K}, r AS (SELECT k, -74 + (k % 97) / 1000.0::DOUBLE AS x0, 40 + (k % 89) / 1000.0::DOUBLE AS y0 FROM k), d AS (SELECT k, 0 AS piece, 0 AS s, x0 AS x, y0 AS y FROM r UNION ALL {_piece_sql(_RD[0], _RD[1], 1)} UNION ALL {_piece_sql(_RD[1], _RD[2], 2)}), o AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY piece, s) - 1 AS INT) AS i, x, y FROM d)"


def m11(spark, sf):
    pts = m10(spark, sf)
    wet = (F.col("k") * 31 + F.col("i") * 17) % 11 < 8
    return O.wet_runs(pts.where("i > 0"), "k", "i", wet)


def l21(spark, sf):
    """Zigzags of up to 42 points, one a customer."""
    n = (F.col("k") % 40 + 2).cast("int")
    xs = F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("double"))
    ys = F.transform(F.sequence(F.lit(0), n), lambda i: ((i * i * F.col("k")) % 7 / 10).cast("double"))
    return O.simplified(spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k").select("k", xs.alias("xs"), ys.alias("ys")))


def m16(spark, sf):
    lines = rings(spark, sf).select((F.col("k") % 12).alias("elevation"), F.size("ring").alias("n"), "k")
    return lines.groupBy("elevation").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("points"), F.min("k").alias("first"))


_MEAN = {c: " + ".join(f"({p[i]})" for p in _RING_SQL) for i, c in enumerate("xy")}
_AREA = " + ".join(f"({ax}) * ({by}) - ({bx}) * ({ay})" for (ax, ay), (bx, by) in zip(_RING_SQL, [*_RING_SQL[1:], _RING_SQL[0]]))
_SURFACE = f"CASE WHEN phase LIKE 'draining%' THEN used ELSE used - CASE WHEN developed THEN {_pen('used')} ELSE 0.0 END * {_left('used')} END"

_LOWER = "round(floor((stage + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)"
_AT = "greatest(0.0::DOUBLE, {} - ground)"
_L17 = f"""WITH {_C}, o AS (SELECT *, {_AT.format(_SURFACE)} AS whole FROM (SELECT *, {_OVERLAY} AS used FROM c)), l AS (SELECT * EXCLUDE used, {_AT.format(_SURFACE)} AS d1 FROM (SELECT * EXCLUDE used, {_LOWER} AS used FROM o)), u AS (SELECT * EXCLUDE used, {_AT.format(_SURFACE)} AS d2 FROM (SELECT *, {_LOWER} + 0.1::DOUBLE AS used FROM l)),
z AS (SELECT *, connection <> 255 AND whole > 0.005::DOUBLE AS base, CASE WHEN phase = 'filling' AND developed AND NOT (connection <> 255 AND d1 > 0.005::DOUBLE) AND connection <> 255 AND d2 > 0.005::DOUBLE THEN {_TDEPTH} END AS t, least(1.0::DOUBLE, 2 * {_FRAC}) AS f FROM u),
y AS (SELECT *, f * f * (3 - 2 * f) * t AS part, connection < 180 AS in_crest, ground < 16 AS was_wet FROM z),
w AS (SELECT *, CASE WHEN phase LIKE 'draining%' THEN in_crest AND (base OR (was_wet AND stage - ground > 0.005::DOUBLE)) ELSE base OR part IS NOT NULL END AS wet FROM y)
SELECT cell, wet, coalesce(CASE WHEN cell % 2 = 0 THEN round(CASE WHEN phase LIKE 'draining%' THEN CASE WHEN wet THEN stage - ground END WHEN base THEN whole ELSE part END, 4) END, -1) AS depth,
  coalesce(CASE WHEN cell % 2 = 1 AND wet AND ground < stage - 0.005::DOUBLE THEN CASE WHEN ground < 5 THEN 0 WHEN ground < 11 THEN 1 ELSE 2 END END, -1) AS flood_class FROM w"""

_ENTRIES = {
    "L1_mercator_pixel": (lambda spark, sf: points(spark, sf).select("k", _merc_pixel(1000, 800).alias("p")).select("k", *_xy("p")), f"WITH {_P}, {_pixel_sql(1000, 800)} SELECT * FROM px"),
    "L2_affine_pixel": (
        lambda spark, sf: points(spark, sf).select("k", G.affine_pixel((F.col("k") * 29 % 1201).cast("double"), (F.col("k") * 31 % 1301).cast("double"), CORNERS, 64, 48).alias("p")).select("k", *_xy("p")),
        f"WITH {_P}, u AS (SELECT k, ((k * 29 % 1201) * -1000.0::DOUBLE - ((k * 31 % 1301) - 1000) * -150.0::DOUBLE) / -985000.0::DOUBLE AS u, (((k * 31 % 1301) - 1000) * 1000.0::DOUBLE - (k * 29 % 1201) * 100.0::DOUBLE) / -985000.0::DOUBLE AS v FROM p), o AS (SELECT *, u >= 0 AND u < 1 AND v >= 0 AND v < 1 AS ok FROM u) SELECT k, CASE WHEN ok THEN CAST(floor(u * 64) AS BIGINT) END AS x, CASE WHEN ok THEN CAST(floor(v * 48) AS BIGINT) END AS y FROM o",
    ),
    "L3_state_plane": (lambda spark, sf: points(spark, sf).select("k", G.state_plane(F.col("lat"), F.col("lng")).alias("p")).select("k", F.round("p.east", 2).alias("east"), F.round("p.north", 2).alias("north")), f"WITH {_P}, {_B} SELECT k, round({_EAST}, 2) AS east, round({_NORTH}, 2) AS north FROM b"),
    "L23_plane_sample": (l23, f"WITH {_C}, {_P}, {_B}, e AS (SELECT k, floor(({_EAST} - {WEST_FT}::DOUBLE) / {CELL_FT}::DOUBLE)::BIGINT AS x, floor(({NORTH_FT}::DOUBLE - {_NORTH}) / {CELL_FT}::DOUBLE)::BIGINT AS y FROM b) SELECT k, x, y, ground, connection FROM e JOIN c USING (x, y)"),
    "L4_packed_sample": (l4, f"WITH {_C}, {_P}, {_pixel_sql(120, 10)} SELECT k, px.x, px.y, ground, connection FROM px LEFT JOIN c ON px.x = c.x AND px.y = c.y"),
    "L5_depth_verdict": (
        lambda spark, sf: cells(spark, sf).select("cell", F.round(G.depth_verdict(F.col("ground"), F.col("connection") / 10, F.when(F.col("cell") % 11 != 0, F.col("developed")), F.col("rendered"), F.col("cell") % 2 == 0, F.col("stage"), F.col("phase"), TH), 4).alias("out")),
        f"WITH {_C}, a AS (SELECT cell, ground, connection, phase, rendered, stage, CASE WHEN cell % 11 <> 0 THEN developed END AS developed, {_OVERLAY} AS overlay FROM c), b AS (SELECT *, CASE WHEN phase = 'filling' THEN stage ELSE overlay END AS used FROM a), d AS (SELECT *, {_SURFACE} AS surface FROM b), e AS (SELECT *, greatest(0.0::DOUBLE, surface - ground) AS depth, coalesce(rendered, ground < surface - 0.005::DOUBLE AND connection / 10.0::DOUBLE <= CASE WHEN phase LIKE 'draining%' THEN surface ELSE overlay END + 1e-4) AS conn FROM d) SELECT cell, round(CASE WHEN developed IS NULL THEN CASE WHEN NOT rendered THEN 0.0::DOUBLE END WHEN conn THEN CASE WHEN depth <= 0.005::DOUBLE AND coalesce(rendered, false) THEN CASE WHEN cell % 2 = 0 THEN 0.05::DOUBLE END ELSE depth END ELSE 0.0::DOUBLE END, 4) AS out FROM e",
    ),
    "L7_physics_depth": (_cell(lambda: F.when(F.col("pixel.b") % 2 == 1, (F.col("pixel.r") * 256 + F.col("pixel.g")) / 1000)), _cell_sql("CASE WHEN b % 2 = 1 THEN (r * 256 + g) / 1000.0::DOUBLE END")),
    "L8_flood_class": (_cell(lambda: G.flood_class(G.ground_feet(F.when(F.col("cell") % 9 == 0, 0).otherwise(32768 + F.round(F.col("ground") * 10))), F.col("stage"), TH)), _cell_sql("CASE WHEN cell % 9 <> 0 AND ground < stage - 0.005::DOUBLE THEN CASE WHEN ground < 5 THEN 0 WHEN ground < 11 THEN 1 ELSE 2 END END")),
    "L9_uncertainty": (l9, _cell_sql("CASE WHEN connection > 200 THEN 9 WHEN ground < stage - 0.005::DOUBLE THEN CASE WHEN ground < 5 THEN 0 WHEN ground < 11 THEN 1 ELSE 2 END END")),
    "L10_newly_wet": (lambda spark, sf: cells(spark, sf).where(G.newly_wet(F.col("ground") < F.col("stage") - 3, F.col("ground") < F.col("stage"), F.col("developed"))).select("cell"), f"WITH {_C} SELECT cell FROM c WHERE NOT ground < stage - 3 AND ground < stage AND developed"),
    "L11_transition_depth": (_cell(lambda: F.round(G.transition_depth(F.col("ground"), F.col("connection"), F.col("developed"), F.col("stage"), TH), 4)), _cell_sql(f"round({_TDEPTH}, 4)")),
    "L12_transition_cells": (l12, f"WITH {_C}, k AS (SELECT *, least(1.0::DOUBLE, 2 * {_FRAC}) AS z FROM c WHERE {_CAND}) SELECT cell, round(z * z * (3 - 2 * z) * {_TDEPTH}, 4) AS out FROM k"),
    "L14_retention": (l14, f"WITH {_C}, w AS (SELECT cell, ground, connection < 180 AND (ground < 12 OR (ground < 16 AND 14 - ground > 0.005::DOUBLE)) AS wet FROM c) SELECT cell, wet, CASE WHEN wet THEN round(14 - ground, 4) END AS depth FROM w"),
    "L15_composite": (_cell(lambda: F.round(S.connected_depth(F.col("stage"), F.col("ground"), F.col("developed"), F.col("phase"), TH)["depth"], 4)), f"WITH {_C}, a AS (SELECT *, stage AS used FROM c) SELECT cell, round(greatest(0.0::DOUBLE, {_SURFACE} - ground), 4) AS out FROM a"),
    "L17_overlay_composite": (l17, _L17),
    "L16_catalog_selection": (l16, f"WITH {_C}, h AS (SELECT DISTINCT {_GROUND_CODE} AS code, CASE WHEN cell % 2 = 0 THEN phase ELSE 'base' END AS root FROM c WHERE cell % 7 = 0), w AS (SELECT cell, {_CODE.format(_OVERLAY)} AS code, phase FROM c) SELECT cell, coalesce(a.root, b.root) || '/' || w.code AS out FROM w LEFT JOIN h a ON a.code = w.code AND a.root = w.phase LEFT JOIN h b ON b.code = w.code AND b.root = 'base' WHERE coalesce(a.root, b.root) IS NOT NULL"),
    "L18_rasterised": (
        l18,
        f"WITH {_K}, e AS ({_EDGES}), x AS (SELECT k, y, ax + (y + 0.5::DOUBLE - ay) * (bx - ax) / (b_y - ay) AS a FROM e, range(11) g(y) WHERE ay <> b_y AND (ay <= y + 0.5) <> (b_y <= y + 0.5)), n AS (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY a) - 1 AS i FROM x), s AS (SELECT k, y, i // 2 AS j, greatest(0, CAST(ceil(min(a) - 0.5::DOUBLE) AS BIGINT)) AS first, least(13, CAST(ceil(max(a) - 0.5::DOUBLE) AS BIGINT) - 1) AS last FROM n GROUP BY 1, 2, 3) SELECT k AS shape_id, y, first, last FROM s WHERE first <= last",
    ),
    "L25_nearest_colour": (
        lambda spark, sf: cells(spark, sf).select("cell", G.nearest_colour(F.col("pixel"), PALETTES).alias("p")).select("cell", "p.palette", "p.entry"),
        f"WITH {_C}, q(palette, entry, pr, pg, pb) AS (VALUES {', '.join(f'({i}, {j}, {r}, {g}, {b})' for i, p in enumerate(PALETTES) for j, (r, g, b) in enumerate(p))}) SELECT cell, palette, entry FROM c, q QUALIFY row_number() OVER (PARTITION BY cell ORDER BY (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2, palette, entry) = 1",
    ),
    "L26_sparse_cells": (l26, f"WITH {_C}, o AS (SELECT cell, round({_TDEPTH.replace('connection', '0')}, 4) AS out FROM c WHERE cell % 4 = 1) SELECT * FROM o WHERE out IS NOT NULL"),
    "L13_components": (l13, None),
    "L21_simplified": (l21, None),
    "M1_point_in_ring": (_k(lambda: {"inside": S.in_ring(*_px(), F.col("ring"))}), _ksql(inside=_inside_sql(_X, _Y, _RING_SQL))),
    "M2_point_in_polygon": (_k(lambda: {"inside": G.in_polygon(*_px(), F.array(F.array(_literal(_TOWN), _literal(_HOLE)), F.array(F.col("ring"))))}), _ksql(inside=f"(({_inside_sql(_X, _Y, _TOWN)} AND NOT {_inside_sql(_X, _Y, _HOLE)}) OR {_inside_sql(_X, _Y, _RING_SQL)})")),
    "M3_ring_area": (_k(lambda: {"area": F.round(S.ring_area(F.col("ring")), 6)}), _ksql(area=f"abs({_AREA}) / 2.0::DOUBLE")),
    "M4_degrees": (_k(lambda: {n: F.round(G.degrees_of(-8240000.0 + F.col("k"), 4900000.0 + 2 * F.col("k"))[n], 7) for n in ("lat", "lng")}), _ksql(lat="round(degrees(2 * atan(exp((4900000.0::DOUBLE + 2 * k) / 6378137.0::DOUBLE)) - pi() / 2), 7)", lng="round(degrees((-8240000.0::DOUBLE + k) / 6378137.0::DOUBLE), 7)")),
    "M6_clean_ring": (_k(lambda: {"n": F.size(G.clean_ring(F.when(F.col("k") % 3 == 0, F.concat("ring", F.slice("ring", 1, 1))).when(F.col("k") % 3 == 1, F.slice("ring", 1, 2)).otherwise(F.concat("ring", F.array(F.struct(F.lit(float("nan")).alias("x"), F.lit(1.0).alias("y")))))))}), _ksql(n="CASE WHEN k % 3 = 1 THEN NULL ELSE 4 END")),
    "M9_in_town": (_k(lambda: {"inside": _px()[0].between(2, 17) & _px()[1].between(0, 14) & S.in_ring(*_px(), _literal(_TOWN))}), _ksql(inside=f"({_X} BETWEEN 2 AND 17 AND {_Y} BETWEEN 0 AND 14 AND {_inside_sql(_X, _Y, _TOWN)})")),
    "M10_densified": (m10, _M10 + " SELECT k, i, round(x, 8) AS x, round(y, 8) AS y FROM o"),
    "M11_wet_runs": (m11, _M10 + ", f AS (SELECT k, i, (k * 31 + i * 17) % 11 < 8 AS wet FROM o WHERE i > 0), g AS (SELECT *, sum(CASE WHEN wet THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS island FROM f) SELECT k, min(i) AS first, max(i) AS last, count(*) AS steps FROM g WHERE wet GROUP BY k, island"),
    "M12_distance": (lambda spark, sf: points(spark, sf).select("k", F.round(S.metres(F.col("lat"), F.col("lng"), F.lit(40.4), F.lit(-74.0)), 3).alias("m")), f"WITH {_P} SELECT k, round(sqrt(((40.4::DOUBLE - lat) * 111320) ** 2 + ((-74.0::DOUBLE - lng) * 111320 * cos(radians(lat))) ** 2), 3) AS m FROM p"),
    "M13_box_centre": (_k(lambda: {c: G.box_centre(F.col("ring"))[c] for c in "xy"}), _ksql(x="(k % 10 + k % 10 + 5 + k % 3) / 2.0::DOUBLE", y="(k % 7 + k % 7 + 6) / 2.0::DOUBLE")),
    "M14_all_inside": (_k(lambda: {"inside": G.all_inside(F.col("ring"), _literal([(-1.0, -1.0), (15.5, -1.0), (14.2, 11.3), (-1.0, 9.4)]))}), _ksql(inside=" AND ".join(_inside_sql(f"({x})", f"({y})", [(-1.0, -1.0), (15.5, -1.0), (14.2, 11.3), (-1.0, 9.4)]) for x, y in _RING_SQL))),
    "M15_vertex_mean": (_k(lambda: {c: G.vertex_mean(F.col("ring"))[c] for c in "xy"}), _ksql(**{c: f"({v}) / 4.0::DOUBLE" for c, v in _MEAN.items()})),
    "M16_contours_by_elevation": (m16, f"WITH {_K} SELECT k % 12 AS elevation, count(*) AS lines, 4 * count(*) AS points, min(k) AS first FROM k GROUP BY 1"),
    "M17_building_height": (_k(lambda: {"m": F.round(G.building_height(F.when(F.col("k") % 3 == 0, (F.col("k") % 40).cast("double")), F.when(F.col("k") % 3 == 1, (F.col("k") % 9).cast("double")).otherwise(2.0)), 4)}), _ksql(m="round(CASE WHEN k % 3 = 0 THEN greatest(3.2::DOUBLE, least(30.0::DOUBLE, k % 40)) ELSE greatest(3.2::DOUBLE, least(19.5::DOUBLE, greatest(1, least(6, CASE WHEN k % 3 = 1 THEN k % 9 ELSE 2 END)) * 3.05::DOUBLE + 1.2::DOUBLE)) END, 4)")),
    "M20_valid_box": (_k(lambda: {"valid": G.valid_box(F.col("k") % 5 - 2.0, F.col("k") % 7 - 3.0, F.when(F.col("k") % 4 != 0, F.lit(0.5)), F.lit(1.0))}), _ksql(valid="k % 4 <> 0 AND k % 5 - 2 < 0.5 AND k % 7 - 3 < 1")),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1]}
