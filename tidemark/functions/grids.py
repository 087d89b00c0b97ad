"""Column expressions over raster cells and plane geometry. Rings are arrays of struct(x, y) without a closing point."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Thresholds, attenuation, catalog_stage, connected_depth, in_ring

EARTH = 6378137.0

# The state plane zone in US survey feet (ellipsoid, origin, scale, false easting).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LAT0, LON0, SCALE, EAST_M = 38 + 50 / 60, -74.5, 0.9999, 150000.0
FOOT = 1200 / 3937


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_pixel(lat: Column, lng: Column, bounds: tuple[float, float, float, float], width: int, height: int) -> Column:
    """struct(x, y) of the pixel, or null outside; ``bounds`` are south, west, north, east, the far ends open."""
    south, west, north, east = bounds
    top, bottom = (math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (north, south))
    u, v = (lng - west) / (east - west), (top - mercator_y(lat)) / (top - bottom)
    inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    return F.when(inside, F.struct(F.floor(u * width).alias("x"), F.floor(v * height).alias("y")))


def affine_pixel(x: Column, y: Column, corners: tuple[tuple[float, float], ...], width: int, height: int) -> Column:
    """The same for a sheared image: ``corners`` are its top left, top right and bottom left points in the plane."""
    (ox, oy), (ax, ay), (bx, by) = corners
    ux, uy, vx, vy = ax - ox, ay - oy, bx - ox, by - oy
    det = ux * vy - uy * vx
    u, v = ((x - ox) * vy - (y - oy) * vx) / det, ((y - oy) * ux - (x - ox) * uy) / det
    inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    return F.when(inside, F.struct(F.floor(u * width).alias("x"), F.floor(v * height).alias("y")))


def state_plane(lat: Column, lng: Column) -> Column:
    """struct(east, north) in feet: the transverse Mercator series to the sixth power of the longitude difference."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    k = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    p0 = math.radians(LAT0)
    arc0 = AXIS * (k[0] * p0 - k[1] * math.sin(2 * p0) + k[2] * math.sin(4 * p0) - k[3] * math.sin(6 * p0))
    p = F.radians(lat)
    arc = AXIS * (k[0] * p - k[1] * F.sin(2 * p) + k[2] * F.sin(4 * p) - k[3] * F.sin(6 * p))
    n = AXIS / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    t, c = F.tan(p) * F.tan(p), ep2 * F.cos(p) * F.cos(p)
    a = F.radians(lng - LON0) * F.cos(p)
    east = SCALE * n * (a + (1 - t + c) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, F.lit(5)) / 120) + EAST_M
    north = SCALE * (arc - arc0 + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, F.lit(6)) / 720))
    return F.struct((east / FOOT).alias("east"), (north / FOOT).alias("north"))


def degrees_of(x: Column, y: Column) -> Column:
    """struct(lat, lng) of a Web Mercator point."""
    return F.struct(F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2).alias("lat"), F.degrees(x / EARTH).alias("lng"))


def ground_feet(code: Column) -> Column:
    """Tenths of a foot around 32768; code 0 has no ground."""
    return F.when(code != 0, (code - 32768) / 10)


def flood_class(ground: Column, stage: Column, th: Thresholds) -> Column:
    """0, 1 or 2 by the ground's own band where it is below the stage; null where dry or unknown."""
    return F.when(ground < stage - 0.005, F.when(ground < th.minor, 0).when(ground < th.moderate, 1).otherwise(2))


def newly_wet(lower: Column, upper: Column, developed: Column) -> Column:
    return ~lower & upper & developed


def transition_depth(ground: Column, connection: Column, developed: Column, stage: Column, th: Thresholds) -> Column:
    """Depth of a cell that connects within the step: at least 0.005; null above the adjusted stage or unconnected (255)."""
    adjusted = stage - F.when(developed, attenuation(stage, th)).otherwise(0.0)
    return F.when((connection != 255) & (ground <= adjusted + 1e-9), F.greatest(F.lit(0.005), adjusted - ground))


def depth_verdict(ground: Column, connection_stage: Column, developed: Column, rendered: Column, shallow: Column, stage: Column, phase: Column, th: Thresholds) -> Column:
    """Depth at a point: 0 where dry, null where it can't be told. ``developed`` and ``rendered`` may be null."""
    overlay = catalog_stage(stage)
    used = F.when(phase == "filling", stage).otherwise(overlay)
    told = connected_depth(used, ground, developed, phase, th)
    limit = F.when(phase.startswith("draining"), told["surface"]).otherwise(overlay)
    connected = F.coalesce(rendered, (ground < told["surface"] - 0.005) & (connection_stage <= limit + 1e-4))
    wet = F.when((told["depth"] <= 0.005) & F.coalesce(rendered, F.lit(False)), F.when(shallow, 0.05)).otherwise(told["depth"])
    known = F.when(developed.isNull(), F.when(~rendered, 0.0)).when(connected, wet).otherwise(0.0)
    return F.when(ground.isNotNull() & stage.isNotNull(), known)


def nearest_colour(pixel: Column, palettes: list[list[tuple[int, int, int]]]) -> Column:
    """struct(palette, entry) with the least squared distance; the first palette and entry on ties. Constants only."""
    tries = [F.struct(sum(((pixel[c] - rgb[i]) * (pixel[c] - rgb[i]) for i, c in enumerate("rgb")), F.lit(0)).alias("far"), F.lit(p).alias("palette"), F.lit(e).alias("entry")) for p, colours in enumerate(palettes) for e, rgb in enumerate(colours)]
    best = F.array_min(F.array(*tries))
    return F.struct(best["palette"].alias("palette"), best["entry"].alias("entry"))


def in_polygon(x: Column, y: Column, polygons: Column) -> Column:
    """In the first ring of a polygon and in none of its others; ``polygons`` is array of array of rings."""
    return F.exists(polygons, lambda rings: in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, F.lit(2), F.size(rings)), lambda hole: in_ring(x, y, hole)))


def clean_ring(ring: Column) -> Column:
    """Finite points without the closing one; null below three."""
    finite = F.filter(ring, lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    closed = (F.size(finite) > 1) & (F.get(finite, F.lit(0)) == F.element_at(finite, -1))
    opened = F.when(closed, F.slice(finite, F.lit(1), F.size(finite) - 1)).otherwise(finite)
    return F.when(F.size(opened) >= 3, opened)


def box(points: Column) -> Column:
    """struct(west, south, east, north)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def box_centre(points: Column) -> Column:
    b = box(points)
    return F.struct(((b["west"] + b["east"]) / 2).alias("x"), ((b["south"] + b["north"]) / 2).alias("y"))


def vertex_mean(points: Column) -> Column:
    def mean(axis):
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def all_inside(points: Column, ring: Column) -> Column:
    return F.forall(points, lambda p: in_ring(p["x"], p["y"], ring))


def valid_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    finite = [F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for v in (south, west, north, east)]
    return finite[0] & finite[1] & finite[2] & finite[3] & F.coalesce((south < north) & (west < east), F.lit(False))


def building_height(tagged: Column, stories: Column) -> Column:
    """Metres: the tagged height within 3.2 to 30, else by one to six stories, within 3.2 to 19.5."""
    floors = F.greatest(F.lit(1.0), F.least(F.lit(6.0), stories))
    return F.when(tagged.isNotNull(), F.greatest(F.lit(3.2), F.least(F.lit(30.0), tagged))).when(stories.isNotNull(), F.greatest(F.lit(3.2), F.least(F.lit(19.5), floors * 3.05 + 1.2)))


def densified(points: Column, step_m: float = 5.0) -> Column:
    """Points of a line with none of its steps above ``step_m``; x is the longitude, y the latitude."""
    n = F.size(points)

    def piece(i):
        a, b = F.get(points, i), F.get(points, i + 1)
        middle = F.radians((a["y"] + b["y"]) / 2)
        length = F.sqrt(F.pow((b["x"] - a["x"]) * F.cos(middle), F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))) * 111320.0
        steps = F.greatest(F.lit(1), F.ceil(length / step_m)).cast("int")
        return F.transform(F.sequence(F.lit(1), steps), lambda s: F.struct((a["x"] + (b["x"] - a["x"]) * (s / steps)).alias("x"), (a["y"] + (b["y"] - a["y"]) * (s / steps)).alias("y")))

    rest = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)), piece))).otherwise(F.slice(points, 1, 0))
    return F.concat(F.slice(points, 1, 1), rest)


