"""Contours of a raster: marching squares over quads, lines by blocks and list ranking, length filter and simplification.

A crossing is named by the grid edge that it lies on, so the pieces of a line meet by key and not by coordinates. Each piece
runs with the higher ground on its left; a crossing then has at most one piece that leads to it. A block of quads puts its own
pieces together; a line that stays inside is done then. The stretches that reach a block's border are ordered by a list ranking
over their ends: each doubles its way back until it has met the start of its line, or, on a closed line, until the least end
that it has seen no longer falls. Rounds are logarithmic in the stretches of a line; each is an equal-key join with a checkpoint.
Closed lines start at their least crossing. No frame is held in one task, only a block and the points of one line.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoints, saved
from .blocks import key_schema
from .grids import simplified

_ROW = 2**31  # columns of a row, as crossings are numbered
SIDE = 128  # quads of a block's side
#: Sides of a quad: top, right, bottom, left; the corners at their ends, in the order of the raster.
SIDES = {"top": ("a", "b"), "right": ("b", "c"), "bottom": ("d", "c"), "left": ("a", "d")}
#: Corner bits (a 8, b 4, c 2, d 1: higher than the level) to pieces (from side, to side), higher ground on the left as y goes down.
PIECES = {
    1: [("bottom", "left")], 2: [("right", "bottom")], 3: [("right", "left")], 4: [("top", "right")], 6: [("top", "bottom")], 7: [("top", "left")],
    8: [("left", "top")], 9: [("bottom", "top")], 11: [("right", "top")], 12: [("left", "right")], 13: [("bottom", "right")], 14: [("left", "bottom")],
}
#: The two quads with opposite corners higher, when the mean of the corners is higher than the level and when it isn't.
SADDLES = {(5, True): [("top", "left"), ("bottom", "right")], (5, False): [("top", "right"), ("bottom", "left")], (10, True): [("left", "bottom"), ("right", "top")], (10, False): [("left", "top"), ("right", "bottom")]}


def quads(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, a, b, c, d) of each quad whose four corners have finite values; a is the corner (y, x), then clockwise.
    ``cells`` has key, y, x and z. A cell tells the quads that it belongs to, so all corners meet in one shuffle."""
    known = cells.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf")))
    corners = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(n).alias("n")) for n, dy, dx in (("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0))))
    each = known.select(*key, F.explode(corners).alias("q"), F.col("z").cast("double").alias("z")).select(*key, "q.y", "q.x", "q.n", "z")
    one = each.groupBy(*key, "y", "x").agg(F.count(F.lit(1)).alias("corners"), *(F.max(F.when(F.col("n") == n, F.col("z"))).alias(n) for n in "abcd"))
    return one.where("corners = 4").drop("corners")


def _crossing(side: str) -> Column:
    """The number of the grid edge of a side, and where the level crosses it."""
    p, q = SIDES[side]
    y, x = F.col("y") + int(side == "bottom"), F.col("x") + int(side == "right")
    upright = side in ("left", "right")
    at = (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
    return F.struct((2 * (y * F.lit(_ROW) + x) + int(upright)).alias("e"), (x if upright else x + at).cast("double").alias("x"), (y + at if upright else y).cast("double").alias("y"))


def segments(cells: DataFrame, key: list[str], interval: float) -> DataFrame:
    """(key, level, p, q) of the pieces of all contours whose level is a multiple of ``interval``; p and q are crossings (e the
    grid edge, x and y in cells), higher ground on the left. A quad is looked at only for the levels between its corners."""
    return _placed_segments(cells, key, interval).drop("y", "x")


def _placed_segments(cells: DataFrame, key: list[str], interval: float) -> DataFrame:
    """``segments`` with the y and x of the quad."""
    square = quads(cells, key)
    low, high = F.ceil(F.least(*"abcd") / interval), F.ceil(F.greatest(*"abcd") / interval) - 1
    each = square.where(low <= high).withColumn("level", F.explode(F.transform(F.sequence(low, high), lambda k: k * F.lit(interval))))
    bits = reduce(lambda s, n: s + F.when(F.col(n[0]) > F.col("level"), n[1]).otherwise(0), (("b", 4), ("c", 2), ("d", 1)), F.when(F.col("a") > F.col("level"), 8).otherwise(0))
    pieces = lambda found: F.array(*(F.struct(_crossing(p).alias("p"), _crossing(q).alias("q")) for p, q in found))
    centre = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 > F.col("level")
    told = F.when(F.lit(False), pieces(PIECES[1]))
    for n, found in PIECES.items():
        told = told.when(F.col("bits") == n, pieces(found))
    for (n, higher), found in SADDLES.items():
        told = told.when((F.col("bits") == n) & (centre if higher else ~centre), pieces(found))
    return each.withColumn("bits", bits).select(*key, "level", "y", "x", F.explode(told).alias("s")).select(*key, "level", "y", "x", "s.p", "s.q")


def _back(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line of each crossing, its place in it and whether it is closed, from the crossing before each (itself where none is). A
    line is named by its first crossing, a closed one by its least."""
    rounds = max(1, int(len(prev)).bit_length())
    to, low = prev, np.minimum(np.arange(len(prev)), prev)
    for _ in range(rounds):
        low, to = np.minimum(low, low[to]), to[to]
    closed = prev[to] != to
    line = np.where(closed, low, to)
    to = prev.copy()
    to[line[closed]] = line[closed]  # a closed line is cut before its least crossing
    place = (to != np.arange(len(to))).astype(np.int64)
    for _ in range(rounds):
        place, to = place + place[to], to[to]
    return line, place, closed


def stretches(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(key, p, q, n, closed, border, es, xs, ys) of pieces (key, y, x, p, q): what the pieces of a block of quads make, from crossing
    p to q with n pieces, its crossings and points in order. ``border``: an end may go on in another block."""
    side = SIDE

    def run(table: pa.Table) -> pa.Table:
        p, q = ({f: table.column(c).combine_chunks().field(f).to_numpy(zero_copy_only=False) for f in ("e", "x", "y")} for c in ("p", "q"))
        e, first = np.unique(np.concatenate([p["e"], q["e"]]), return_index=True)
        x, y = (np.concatenate([p[c], q[c]])[first] for c in ("x", "y"))
        prev = np.arange(len(e))
        prev[np.searchsorted(e, q["e"])] = np.searchsorted(e, p["e"])
        line, place, closed = _back(prev)
        order = np.lexsort((place, line))
        head = np.flatnonzero(np.append(True, line[order][1:] != line[order][:-1]))
        ends = np.append(head, len(order))
        start, last, ring = order[head], order[ends[1:] - 1], closed[order[head]]
        last = np.where(ring, start, last)
        edge = e // 2
        rim = np.where(e % 2 == 1, edge % _ROW, edge // _ROW) % side == 0
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v[order])) for v in (e, x, y)]
        own = [table.column(c).take(pa.array(np.zeros(len(start), np.int64))) for c in key]
        size = np.diff(ends) - ~ring
        return pa.table([*own, pa.array(e[start]), pa.array(e[last]), pa.array(size.astype(np.int64)), pa.array(ring), pa.array(~ring & (rim[start] | rim[last])), *lists], names=[*key, "p", "q", "n", "closed", "border", "es", "xs", "ys"])

    block = [F.floor(F.col(c) / side).alias(f"block_{c}") for c in ("y", "x")]
    schema = f"{key_schema(pieces, key)}p long, q long, n long, closed boolean, border boolean, es array<long>, xs array<double>, ys array<double>"
    return pieces.groupBy(*key, *block).applyInArrow(run, schema)


def ranked(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(key, e, start, rank, closed) of each end of directed stretches (key, p, q by number, n pieces): the first end of its line
    and how many pieces lie between, on a closed line the least end."""
    checkpoints(pieces.sparkSession)
    nodes = pieces.select(*key, F.explode(F.array(F.struct(F.col("q").alias("e"), F.struct(F.col("p").alias("to"), "n").alias("way")), F.struct(F.col("p").alias("e"), F.lit(None).cast("struct<to:long,n:long>").alias("way")))).alias("m"))
    nodes = nodes.groupBy(*key, F.col("m.e").alias("e")).agg(F.max("m.way").alias("way")).select(*key, "e", F.col("way.to").alias("to"), F.coalesce("way.n", F.lit(0).cast("long")).alias("n"))
    seen = F.struct(F.least("e", F.coalesce("to", "e")).alias("e"), F.when(F.col("to") < F.col("e"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("back"))
    # back: pieces to ``to``; ended: ``to`` starts the line; low: the least end seen so far and the pieces back to it
    state = nodes.select(*key, "e", F.coalesce("to", "e").alias("to"), F.col("n").alias("back"), F.col("to").isNull().alias("ended"), seen.alias("low")).checkpoint()
    done = None
    while True:
        ahead = state.select(*key, F.col("e").alias("to"), F.col("to").alias("to2"), F.col("back").alias("back2"), F.col("ended").alias("ended2"), F.col("low").alias("low2"))
        walking = state.where("NOT ended").join(ahead, [*key, "to"])
        reached = F.struct(F.col("low2.e").alias("e"), (F.col("back") + F.col("low2.back")).alias("back"))
        nearer = F.when(F.col("low2.e") < F.col("low.e"), reached).otherwise(F.col("low"))
        walked = walking.select(*key, "e", F.col("to2").alias("to"), (F.col("back") + F.col("back2")).alias("back"), F.col("ended2").alias("ended"), nearer.alias("low"), (F.col("low2.e") < F.col("low.e")).alias("fell"))
        after = state.where("ended").withColumn("fell", F.lit(False)).unionByName(walked).checkpoint()
        moves = after.agg(F.max(F.col("fell") & ~F.col("ended")), F.count_if(~F.col("ended"))).first()
        before, open_ = (done or -1), moves[1] or 0
        done, state = open_, after.drop("fell")
        if not open_ or (open_ == before and not moves[0]):  # no more line has met its start, and nothing smaller is met on closed ones
            line = F.when(F.col("ended"), F.struct(F.col("to").alias("e"), "back")).otherwise(F.col("low"))
            return state.select(*key, "e", (~F.col("ended")).alias("closed"), line.alias("line")).select(*key, "e", F.col("line.e").alias("start"), F.col("line.back").alias("rank"), "closed")


def whole_lines(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, closed, xs, ys) of the lines of ``stretches``. A closed line ends with its first point."""
    point = ("es", "xs", "ys")
    inside = found.where("NOT border").select(*by, "closed", *point)
    parts = found.where("border")
    order = ranked(parts.select(*by, "p", "q", "n"), by).select(*by, F.col("e").alias("p"), "start", "rank", F.col("closed").alias("ring"))
    told = parts.join(order, [*by, "p"]).groupBy(*by, "start", "ring").agg(F.array_sort(F.collect_list(F.struct("rank", *point))).alias("s"))
    last = lambda c: F.when(F.col("ring"), F.array().cast(found.schema[c].dataType)).otherwise(F.slice(F.element_at("s", -1)[c], -1, 1))
    short = lambda c: F.flatten(F.transform("s", lambda r: F.slice(r[c], F.lit(1), F.size(r[c]) - 1)))
    across = told.select(*by, F.col("ring").alias("closed"), *(F.concat(short(c), last(c)).alias(c) for c in point))
    least = F.array_position("es", F.array_min("es")).cast("int")
    turned = lambda c: F.when(F.col("closed"), F.concat(F.slice(c, F.col("at"), F.size(c)), F.slice(c, F.lit(1), F.col("at") - 1), F.slice(c, F.col("at"), F.lit(1)))).otherwise(F.col(c)).alias(c)
    return inside.unionByName(across).withColumn("at", least).select(*by, "closed", *(turned(c) for c in point)).select(*by, F.get("es", F.lit(0)).alias("start"), "closed", "xs", "ys")


def contours(cells: DataFrame, interval: float = 5.0, index_interval: float = 25.0, least_length: float = 1.0, tolerance: float = 0.1, key: list[str] | None = None, cell_size: float = 1.0) -> DataFrame:
    """(key, level, start, index, closed, length, xs, ys) of the contour lines of rasters (key, y, x, z).

    A level counts as below (only higher corners are inside); of a saddle the mean of the corners decides; quads with a corner
    that has no value are left out. Lines shorter than ``least_length`` go, the others are simplified, and those that are
    one point then go too. A closed line ends with its first point. ``start`` names a line within its level.
    """
    key = key or []
    by = [*key, "level"]
    lines = whole_lines(saved(stretches(_placed_segments(cells, key, interval), by), "stretches"), by)
    lines = lines.select(*by, "start", "closed", F.transform("xs", lambda v: v * cell_size).alias("xs"), F.transform("ys", lambda v: v * cell_size).alias("ys"))
    step = lambda i: F.sqrt(F.pow(F.get("xs", i) - F.get("xs", i - 1), F.lit(2)) + F.pow(F.get("ys", i) - F.get("ys", i - 1), F.lit(2)))
    length = F.aggregate(F.sequence(F.lit(1), F.size("xs") - 1), F.lit(0.0), lambda s, i: s + step(i))
    long = lines.withColumn("length", length).where(F.col("length") >= least_length)
    kept = simplified(long, tolerance)
    moves = F.exists(F.arrays_zip("xs", "ys"), lambda p: (p["xs"] != F.get("xs", F.lit(0))) | (p["ys"] != F.get("ys", F.lit(0))))
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 2)).alias(c)
    return kept.where((F.size("xs") >= 2) & moves).select(*by, "start", (F.pmod("level", F.lit(index_interval)) == 0).alias("index"), "closed", F.round("length", 6).alias("length"), rounded("xs"), rounded("ys"))


def write_contours(lines: DataFrame, path: str, about: dict[str, str]) -> None:
    """The sink of contours: JSON lines in a folder for each level, then what they are (``about``) beside them; the description is
    written last, so a folder without it isn't complete."""
    coordinates = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    body = saved(lines.select("level", "index", coordinates.alias("coordinates")), "lines")  # ranges look at the rows twice
    body.repartitionByRange("level", F.xxhash64("coordinates")).write.partitionBy("level").mode("overwrite").json(f"{path}/lines")
    told = lines.sparkSession.createDataFrame([about]) if about else None
    if told is not None:
        told.coalesce(1).write.mode("overwrite").json(f"{path}/about")
