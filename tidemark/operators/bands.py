"""Point samples of rasters: tiled bands with a snap to features nearby, and classes of rendered pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feet in a degree of latitude, the reach of a feature, the colours of depth bands and their breaks.
FEET_PER_DEGREE = 364000.0
FEATURE_FT = 16.0
DEPTH_BREAKS_FT = [0.10, 0.25, 0.50, 1.00, 1.50, 2.00, 2.50, 3.00, 4.00, 5.00]
DEPTH_COLOURS = [(125, 249, 255), (93, 231, 255), (56, 211, 255), (27, 183, 245), (22, 140, 235), (21, 107, 224), (24, 83, 198), (23, 62, 168), (19, 47, 132), (11, 30, 91), (5, 14, 51)]
GREEN, GREEN_OFF, COLOUR_OFF = (99, 212, 113), 4, 3
BANDS = ["elevation", "zone", "connection", "source", "hard", "grate", "developed"]


@dataclass(frozen=True)
class Frame:
    """Where a raster lies: its box in degrees and its size in pixels."""

    west: float
    south: float
    east: float
    north: float
    width: int
    height: int

    @property
    def steps(self) -> tuple[float, float]:
        return (self.east - self.west) / self.width, (self.north - self.south) / self.height

    def pixel(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        dx, dy = self.steps
        return F.floor((lon - self.west) / dx), F.floor((self.north - lat) / dy)

    def step_feet(self, lat: Column) -> tuple[Column, float]:
        """Width of a pixel at a latitude, and its height."""
        dx, dy = self.steps
        return F.cos(F.radians(lat)) * (dx * FEET_PER_DEGREE), dy * FEET_PER_DEGREE

    @property
    def bucket(self) -> int:
        """Pixels that a feature's reach is at most, anywhere in the frame: the side of a bucket in which neighbours meet."""
        dx, dy = self.steps
        narrow = dx * FEET_PER_DEGREE * math.cos(math.radians(max(abs(self.south), abs(self.north))))
        return max(1, math.ceil(FEATURE_FT / narrow), math.ceil(FEATURE_FT / (dy * FEET_PER_DEGREE)))

    def tile(self, buckets: int = 16) -> int:
        """The side of a tile, a whole number of buckets."""
        return self.bucket * buckets


def write_tiles(pixels: DataFrame, path: str, frame: Frame) -> None:
    """Pixels (y, x and BANDS) as Parquet, dealt by ranges of tiles and sorted by tile within a file, so that the statistics of row
    groups tell which tiles they hold. There are as many files as tasks, not one or more for each tile."""
    side = frame.tile()
    tiled = pixels.withColumns({"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")})
    tiled.repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx").write.mode("overwrite").parquet(path)


def snapped(points: DataFrame, tiles: DataFrame, frame: Frame) -> DataFrame:
    """(k, y, x, BANDS, feature_ft) of points (k, lat, lon): the values of the nearest feature pixel within ``FEATURE_FT`` and how
    far it is, else those of the point's own pixel. Features are hard structures and storm grates of plausible height; the
    first by row, then column, on ties. Points outside of the frame, or without a usable height, give no row.

    ``tiles`` is what ``write_tiles`` wrote. Points and features meet by tile and bucket: a point asks for its own bucket and
    the eight around it, so only pixels nearby are compared, and row groups outside of the rows of tiles that windows touch are
    not read. Both joins with tiles are merge joins: Spark takes packed files for small and does not count the nine buckets of a
    point, and would send millions of rows through the driver to all tasks."""
    side, bucket = frame.tile(), frame.bucket
    y, x = "y", "x"
    px, py = frame.pixel(F.col("lat"), F.col("lon"))
    wide, tall = frame.step_feet(F.col("lat"))
    here = points.select("k", py.alias("py"), px.alias("px"), wide.alias("wide")).where(F.col("px").between(0, frame.width - 1) & F.col("py").between(0, frame.height - 1))
    place = lambda r, c, n: {"ty": F.floor(r / n).cast("int"), "tx": F.floor(c / n).cast("int")}
    own = here.withColumns(place(F.col("py"), F.col("px"), side)).join(tiles.withColumnsRenamed({y: "py", x: "px"}).hint("merge"), ["ty", "tx", "py", "px"], "left")
    own = own.select("k", "py", "px", F.struct(*BANDS).alias("mine"))

    flag = lambda c: F.coalesce(F.col(c).between(0.5, 1.5), F.lit(False))
    features = tiles.where((F.col("elevation") > -100) & (F.col("elevation") < 100) & (flag("hard") | flag("grate")))
    features = features.withColumns({"by": F.floor(F.col(y) / bucket), "bx": F.floor(F.col(x) / bucket)})
    around = F.explode(F.array(*(F.struct((F.floor(F.col("py") / bucket) + i).alias("by"), (F.floor(F.col("px") / bucket) + j).alias("bx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("b")
    asked = here.select("k", "py", "px", "wide", around).select("k", "py", "px", "wide", "b.*")
    asked = asked.withColumns(place(F.col("by"), F.col("bx"), side // bucket))
    features = features.where(F.col("ty").between(-1, (frame.height - 1) // side + 1))  # the frame's own rows of tiles and those beside
    off = F.pow((F.col(x) - F.col("px")) * F.col("wide"), F.lit(2)) + F.pow((F.col(y) - F.col("py")) * tall, F.lit(2))
    found = asked.join(features.hint("merge"), ["ty", "tx", "by", "bx"]).withColumn("off", off).where(F.col("off") <= FEATURE_FT**2)
    best = found.groupBy("k").agg(F.min_by(F.struct("off", F.struct(*BANDS).alias("near")), F.struct("off", y, x)).alias("m")).select("k", "m.off", "m.near")
    both = own.join(best, "k", "left").select("k", F.col("py").alias("y"), F.col("px").alias("x"), F.coalesce("near", "mine").alias("v"), F.sqrt("off").alias("feature_ft"))
    usable = F.col("v.elevation").isNotNull() & ~F.isnan("v.elevation") & (F.abs("v.elevation") < 1000)
    return both.where(usable).select("k", "y", "x", "v.*", "feature_ft")


def rendered_class(pixels: DataFrame, key: list[str], palette: DataFrame, off: int = COLOUR_OFF) -> DataFrame:
    """(key, visible, green, flooded, entry) of pixels (key, r, g, b, a): shown at all, in the colour of cut-off water, flooded, and
    the first palette entry (entry, pr, pg, pb) that no channel is more than ``off`` away from.

    Colours meet by cubes of off + 1: an entry stands in its own cube and the 26 around it."""
    cube = lambda c: F.floor(F.col(c) / (off + 1))
    near = F.explode(F.array(*(F.struct((cube("pr") + i).alias("qr"), (cube("pg") + j).alias("qg"), (cube("pb") + k).alias("qb")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))).alias("q")
    entries = palette.select("entry", "pr", "pg", "pb", near).select("entry", "pr", "pg", "pb", "q.*")
    asked = pixels.select("r", "g", "b").distinct().withColumns({"qr": cube("r"), "qg": cube("g"), "qb": cube("b")})
    close = lambda c: F.abs(F.col(c) - F.col(f"p{c}")) <= off
    known = asked.join(entries, ["qr", "qg", "qb"]).where(close("r") & close("g") & close("b")).groupBy("r", "g", "b").agg(F.min("entry").alias("entry"))
    green = (F.col("a") > 0) & (F.abs(F.col("r") - GREEN[0]) <= GREEN_OFF) & (F.abs(F.col("g") - GREEN[1]) <= GREEN_OFF) & (F.abs(F.col("b") - GREEN[2]) <= GREEN_OFF)
    return pixels.join(known, ["r", "g", "b"], "left").select(*key, (F.col("a") > 0).alias("visible"), green.alias("green"), ((F.col("a") > 0) & ~green).alias("flooded"), "entry")


def band_feet(entry: Column) -> tuple[Column, Column]:
    """The depths that a palette entry stands for: from, below (null above the last break)."""
    breaks = F.array(*map(F.lit, DEPTH_BREAKS_FT))
    return F.when(entry == 0, 0.0).otherwise(F.get(breaks, entry - 1)), F.get(breaks, entry)
