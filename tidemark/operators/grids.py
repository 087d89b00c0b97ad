"""Operators over raster cells and lines: components, drainage history, rasterised rings, simplified lines, wet runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import flood_class, newly_wet, transition_depth
from ..functions.scalars import Thresholds, catalog_floor, catalog_stage, connected_depth, step_fraction, transition_blend
from ..sources.tables import saved
from .blocks import ROW, adjacent, block, extent, key_schema, least_labels

POINTS = 1 << 18  # points of lines that are simplified together


def components(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, y, x, component, size) of the 4-neighbour components; a component is named by its least y * 2^32 + x.

    Each block names its own components, larger blocks join the names on the rims of the smaller ones (``blocks``), and
    the names are followed up to the largest block. No step takes longer where components wind.
    """
    key = key or []
    frame = extent(cells)
    base = cells.select(*key, frame.node().alias("n")).where("n IS NOT NULL").distinct()
    schema = key_schema(base, key)

    def own(table: pa.Table) -> pa.Table:
        table = table.select([*key, "n"]).sort_by("n")
        n = table.column("n").to_numpy()
        return table.append_column("label", pa.array(n[least_labels(len(n), *adjacent(n))]))

    def joined(table: pa.Table) -> pa.Table:
        table = table.select([*key, "n", "label"]).sort_by("n")
        names, at = np.unique(table.column("label").to_numpy(), return_inverse=True)
        a, b = adjacent(table.column("n").to_numpy())
        return table.append_column("name", pa.array(names[least_labels(len(names), at[a], at[b])][at]))

    def on_rim(rows: DataFrame, side: int, label: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(frame.rim(batch.column("n").to_numpy(), side)))

        return rows.select(*key, "n", F.col(label).alias("label")).mapInArrow(run, f"{schema}n long, label long")

    sides = frame.sides
    labels = saved(base.groupBy(*key, block("n", sides[0])).applyInArrow(own, f"{schema}n long, label long"), "components")
    steps, now, name = [], labels, "label"
    for inner, side in zip(sides, sides[1:], strict=False):
        now, name = saved(on_rim(now, inner, name).groupBy(*key, block("n", side)).applyInArrow(joined, f"{schema}n long, label long, name long"), "components"), "name"
        steps.append(now.select(*key, "label", "name").distinct())
    counts = labels.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("size")).withColumn("name", F.col("label"))
    for step in steps:
        counts = counts.join(step.select(*key, F.col("label").alias("name"), F.col("name").alias("next")), [*key, "name"], "left").select(*key, "label", "size", F.coalesce("next", "name").alias("name"))
    named = saved(counts, "components")
    size = named.groupBy(*key, "name").agg(F.sum("size").alias("size"))
    told = named.drop("size").join(size, [*key, "name"])
    return labels.join(told, [*key, "label"]).select(*key, *frame.place(), (F.col("name") + F.lit(frame.y * ROW + frame.x)).alias("component"), "size")


def retained(current: DataFrame, history: DataFrame, stage: Column) -> DataFrame:
    """(cell, wet, depth) of a falling frame: only cells of the crest footprint, those wet in any frame of the history
    stay wet while the stage is above their ground by more than 0.005.

    ``current`` has cell, ground and wet; ``history`` has cell, frame (0 is the crest), shown and wet.
    """
    past = history.groupBy("cell").agg(F.max(F.when(F.col("frame") == 0, F.col("shown")).otherwise(False)).alias("in_crest"), F.max("wet").alias("was_wet"))
    depth = stage - F.col("ground")
    both = current.join(past, "cell", "left").withColumn("in_crest", F.coalesce("in_crest", F.lit(False)))
    kept = F.col("in_crest") & (F.col("wet") | (F.coalesce("was_wet", F.lit(False)) & F.coalesce(depth > 0.005, F.lit(False))))
    return both.select("cell", kept.alias("wet"), F.when(kept, depth).alias("depth"))


def overlay_composite(current: DataFrame, history: DataFrame, th: Thresholds) -> DataFrame:
    """(cell, wet, depth, flood_class) of requests for a frame, each by its phase and mode.

    ``current`` has cell, ground, connection, developed, stage, phase and mode; ``history`` as in ``retained``. The catalog
    stage decides what is wet. While filling, developed cells that only the next catalog stage wets come in with the share of
    the step that the stage has made. While draining, what the crest and the frames since have kept stays. Mode ``dynamic``
    gives the class of the ground, mode ``depth`` the depth.
    """
    stage, ground, phase = F.col("stage"), F.col("ground"), F.col("phase")
    lower = catalog_floor(stage)
    depth_at = lambda at: connected_depth(at, ground, F.col("developed"), phase, th)["depth"]
    wet_at = lambda at: (F.col("connection") != 255) & (depth_at(at) > 0.005)
    comes = newly_wet(wet_at(lower), wet_at(lower + 0.1), F.col("developed")) & (phase == "filling")
    step = transition_blend(step_fraction(stage, lower)) * transition_depth(ground, F.col("connection"), F.col("developed"), stage, th)
    overlay = catalog_stage(stage)
    own = current.withColumns({"wet": F.coalesce(wet_at(overlay), F.lit(False)), "full": depth_at(overlay), "part": F.when(comes, step)})
    own = own.select("cell", "mode", "ground", "stage", "phase", F.col("wet").alias("base"), (F.col("wet") | F.col("part").isNotNull()).alias("wet"), F.when(F.col("wet"), F.col("full")).otherwise(F.col("part")).alias("depth"))
    drains = F.coalesce(phase.startswith("draining"), F.lit(False))
    kept = retained(own.where(drains).select("cell", "ground", "stage", F.col("base").alias("wet")), history, stage).select("cell", F.col("wet").alias("kept"), F.col("depth").alias("kept_depth"))
    both = own.join(kept, "cell", "left")
    wet, depth = F.when(drains, F.col("kept")).otherwise(F.col("wet")), F.when(drains, F.col("kept_depth")).otherwise(F.col("depth"))
    out = both.select("cell", wet.alias("wet"), depth.alias("depth"), "mode", "ground", "stage")
    return out.select("cell", "wet", F.when(F.col("mode") == "depth", F.col("depth")).alias("depth"), F.when((F.col("mode") == "dynamic") & F.col("wet"), flood_class(ground, stage, th)).alias("flood_class"))


def rasterised(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(shape_id, y, first, last) spans of the cells whose centres are inside by the even-odd rule.

    ``shapes`` has shape_id and rings (array of rings). Edges meet only the rows that they cross; the crossings of one row
    of one shape are sorted and paired.
    """
    n = F.size("ring")
    edges = shapes.select("shape_id", F.explode("rings").alias("ring")).select("shape_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", F.pmod(i + 1, n)).alias("q")))).alias("e"))
    low, high = F.least("e.p.y", "e.q.y"), F.greatest("e.p.y", "e.q.y")
    first, last = F.greatest(F.lit(0), F.ceil(low - 0.5)), F.least(F.lit(height - 1), F.ceil(high - 0.5) - 1)
    rows = edges.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    at = F.col("e.p.x") + (F.col("y") + 0.5 - F.col("e.p.y")) * (F.col("e.q.x") - F.col("e.p.x")) / (F.col("e.q.y") - F.col("e.p.y"))
    crossings = rows.select("shape_id", "y", at.alias("at")).groupBy("shape_id", "y").agg(F.array_sort(F.collect_list("at")).alias("xs"))
    pairs = crossings.select("shape_id", "y", F.explode(F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2)), lambda i: F.struct(F.get("xs", (2 * i - 2).cast("int")).alias("a"), F.get("xs", (2 * i - 1).cast("int")).alias("b")))).alias("s"))
    spans = pairs.select("shape_id", "y", F.greatest(F.lit(0), F.ceil(F.col("s.a") - 0.5)).alias("first"), F.least(F.lit(width - 1), F.ceil(F.col("s.b") - 0.5) - 1).alias("last"))
    return spans.where("first <= last")


def kept_points(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of a line's points: between two kept ones the point that is farthest from the piece of line between these (its
    ends included) stays as well, if it is more than ``tolerance`` away."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    spans = [(0, len(xy) - 1)]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < 2:
            continue
        along, own = xy[hi] - xy[lo], xy[lo + 1 : hi] - xy[lo]
        squared = along @ along
        share = np.minimum(np.maximum(own @ along / squared, 0), 1) if squared else np.zeros(len(own))
        away = np.hypot(*(own - share[:, None] * along).T)
        at = lo + 1 + int(np.argmax(away))
        if away[at - lo - 1] > tolerance:
            keep[at] = True
            spans.extend([(lo, at), (at, hi)])
    return keep


def kept_of_lines(x: np.ndarray, y: np.ndarray, first: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points of many lines, as ``kept_points`` tells for each; line i has the points from first[i] to first[i + 1]. The
    pieces of all lines are cut at once, as often as the rule goes deep."""
    keep = np.zeros(len(x), bool)
    some = first[1:] > first[:-1]
    lo, hi = first[:-1][some], first[1:][some] - 1
    keep[lo] = keep[hi] = True
    while True:
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return keep
        inside = hi - lo - 1
        start = np.cumsum(inside) - inside
        of = np.repeat(np.arange(len(lo)), inside)
        at = lo[of] + 1 + np.arange(len(of)) - start[of]
        ax, ay = x[hi] - x[lo], y[hi] - y[lo]
        squared = (ax * ax + ay * ay)[of]
        ax, ay, ox, oy = ax[of], ay[of], x[at] - x[lo][of], y[at] - y[lo][of]
        share = np.minimum(np.maximum(np.divide(ox * ax + oy * ay, squared, out=np.zeros(len(of)), where=squared != 0), 0), 1)
        away = np.hypot(ox - share * ax, oy - share * ay)
        most = np.maximum.reduceat(away, start)
        hit = np.flatnonzero((away == most[of]) & (away > tolerance))
        piece, nth = np.unique(of[hit], return_index=True)  # the first of the farthest ones
        cut = at[hit[nth]]
        keep[cut] = True
        lo, hi = np.concatenate([lo[piece], cut]), np.concatenate([cut, hi[piece]])


def simplified(lines: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """``lines`` (with xs and ys) with the points that Douglas and Peucker's rule keeps; empty and null lines stay so. Lines are
    looked at together, about ``POINTS`` points at a time."""

    def batches(frames):
        for batch in frames:
            known = pc.and_(batch.column("xs").is_valid(), batch.column("ys").is_valid())
            size = np.where(known.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(batch.column("xs")), 0).to_numpy(zero_copy_only=False), 0)
            group = np.cumsum(size) // POINTS
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(size)]
            for a, b in zip(edges, edges[1:]):
                yield cut(batch.slice(a, b - a), known.slice(a, b - a), np.append(0, np.cumsum(size[a:b])))

    def cut(part, known, first):
        own = [pc.if_else(known, part.column(c), pa.scalar(None, part.column(c).type)) for c in ("xs", "ys")]
        x, y = (pc.cast(pc.list_flatten(c), pa.float64()).to_numpy(zero_copy_only=False) for c in own)
        keep = kept_of_lines(x, y, first, tolerance)
        ends = pa.array(np.append(0, np.cumsum(keep))[first].astype(np.int32))
        for c, column, v in zip(("xs", "ys"), own, (x, y)):
            left = pa.ListArray.from_arrays(ends, pa.array(v[keep]), mask=pc.invert(known)).cast(column.type)
            part = part.set_column(part.schema.get_field_index(c), c, pc.if_else(known, left, part.column(c)))
        return part

    return lines.mapInArrow(batches, lines.schema)


def densified_points(lines: DataFrame, key: str, points: Column, step_m: float = 5.0) -> DataFrame:
    """(key, i, x, y) of the points of lines with no step above ``step_m``; x is the longitude, y the latitude. Pieces become
    rows before their points do, so a length is worked out once."""
    pts = lines.select(key, points.alias("p"))
    start = pts.where(F.size("p") > 0).select(key, F.lit(0).alias("i"), F.get("p", F.lit(0))["x"].alias("x"), F.get("p", F.lit(0))["y"].alias("y"))
    each = pts.where(F.size("p") > 1).select(key, F.posexplode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("piece", "s"))
    each = each.select(key, "piece", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("b_y"))
    length = F.sqrt(F.pow((F.col("bx") - F.col("ax")) * F.cos(F.radians((F.col("ay") + F.col("b_y")) / 2)), F.lit(2)) + F.pow(F.col("b_y") - F.col("ay"), F.lit(2))) * 111320.0
    each = each.withColumn("steps", F.greatest(F.lit(1), F.ceil(length / step_m)).cast("int"))
    before = F.coalesce(F.sum("steps").over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", before).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("step") / F.col("steps"))
    return start.unionByName(each.select(key, (F.col("before") + F.col("step")).cast("int").alias("i"), at("ax", "bx").alias("x"), at("ay", "b_y").alias("y")))


def filling_order(cells: DataFrame, by: str) -> DataFrame:
    """(by, cell, place): the order in which the candidates of a frame fill. ``cells`` has by, y, x, lower_wet, candidate and
    shallow; a frame is a raster of fixed size, which a task takes whole.

    Shallow 4-neighbour components that touch water come first: the shortest path from water to their farthest cell, of
    the largest component first, then their other cells from water inwards, then all other candidates from water outwards.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        height, width = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        flag = {}
        for name in ("lower_wet", "candidate", "shallow"):
            flag[name] = np.zeros((height + 2, width + 2), bool)
            flag[name][pdf["y"].to_numpy() + 1, pdf["x"].to_numpy() + 1] = pdf[name].to_numpy(bool)
        wide = width + 2
        candidate, shallow = flag["candidate"].reshape(-1), (flag["candidate"] & flag["shallow"]).reshape(-1)
        water = flag["lower_wet"]
        touches = (np.roll(water, 1, 0) | np.roll(water, -1, 0) | np.roll(water, 1, 1) | np.roll(water, -1, 1)).reshape(-1)
        around = (-1, 1, -wide, wide)

        def spread(seeds: list[int], open_: np.ndarray) -> tuple[list[int], dict[int, int]]:
            """Cells reached from the seeds in breadth-first order, and where each came from; ``open_`` is used up."""
            came = dict.fromkeys(seeds, -1)
            open_[seeds] = False
            reached = list(seeds)
            for cell in reached:
                for d in around:
                    if open_[cell + d]:
                        open_[cell + d] = False
                        came[cell + d] = cell
                        reached.append(cell + d)
            return reached, came

        left, found = shallow.copy(), []
        for first in np.flatnonzero(shallow):
            if left[first]:
                members, _ = spread([int(first)], left)
                seeds = [c for c in members if touches[c]]
                if seeds:
                    inside = np.zeros(len(left), bool)
                    inside[members] = True
                    reached, came = spread(seeds, inside)
                    depth = {}
                    for c in reached:
                        depth[c] = depth[came[c]] + 1 if came[c] >= 0 else 1
                    path, at = [], min(reached, key=lambda c: (-depth[c], c))
                    while at >= 0:
                        path.append(at)
                        at = came[at]
                    found.append((-len(members), int(first), path[::-1], reached))
        found.sort(key=lambda f: f[:2])
        outer, _ = spread([int(c) for c in np.flatnonzero(candidate & touches)], candidate.copy())
        cells_ = list(dict.fromkeys([c for f in found for c in f[2]] + [c for f in found for c in f[3]] + outer))
        own = np.array(cells_, np.int64)
        return pd.DataFrame({by: pdf[by].iloc[0], "y": own // wide - 1, "x": own % wide - 1, "place": np.arange(len(own))})

    return cells.groupBy(by).applyInPandas(order, f"{by} long, y long, x long, place long")


def wet_runs(steps: DataFrame, by: str, seq: str, wet: Column) -> DataFrame:
    """(by, first, last, steps) of each unbroken run of wet steps of a line."""
    w = Window.partitionBy(by).orderBy(seq)
    runs = steps.withColumn("wet", wet).withColumn("island", F.sum(F.when(F.col("wet"), 0).otherwise(1)).over(w)).where("wet")
    return runs.groupBy(by, "island").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("steps")).drop("island")
