"""Contours and first-connection stages against plain versions."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands, blocks, connection, contours
from tidemark.operators.grids import kept_points


def raster(seed, height, width, holes=0.05, step=None):
    """A smooth surface with noise; a few cells have no value."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    z = 12 + 9 * np.sin(x / 4.1) * np.cos(y / 3.3) + rng.normal(0, 1.5, (height, width))
    if step:
        z = np.round(z / step) * step  # many values equal a level
    z[rng.random(z.shape) < holes] = np.nan
    return z


def cells_of(spark, *frames):
    rows = [(f, y, x, None if math.isnan(v) and (y + x) % 2 else float(v)) for f, z in enumerate(frames) for (y, x), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "frame long, y long, x long, z double").repartition(5)


def plain_lines(z, interval):
    """Contours by walking from piece to piece: {level: [(points, closed)]}."""
    height, width = z.shape
    out = {}
    top = np.nanmax(z)
    level = math.ceil(np.nanmin(z) / interval) * interval
    while level <= top:
        after, at = {}, {}

        def crossing(y0, x0, y1, x1):
            t = (level - z[y0, x0]) / (z[y1, x1] - z[y0, x0])
            name = (y0, x0, y1, x1)
            at[name] = (x0 + t if x1 > x0 else float(x0), y0 + t if y1 > y0 else float(y0))
            return name

        for y in range(height - 1):
            for x in range(width - 1):
                corners = [z[y, x], z[y, x + 1], z[y + 1, x + 1], z[y + 1, x]]
                if any(map(math.isnan, corners)):
                    continue
                up = [c > level for c in corners]
                names = [(y, x, y, x + 1), (y, x + 1, y + 1, x + 1), (y + 1, x, y + 1, x + 1), (y, x, y + 1, x)]
                # going round the quad clockwise, a side leaves the higher ground (out) or enters it (in)
                enters = [k for k in range(4) if not up[k] and up[(k + 1) % 4]]
                leaves = [k for k in range(4) if up[k] and not up[(k + 1) % 4]]
                if len(enters) == 2:
                    joined = sum(corners) / 4 > level
                    pairs = [(e, min(leaves, key=lambda o, e=e: (e - o) % 4 if joined else (o - e) % 4)) for e in enters]
                else:
                    pairs = list(zip(enters, leaves))
                for e, o in pairs:
                    after[crossing(*names[e])] = crossing(*names[o])
        lines, starts = [], set(after) - set(after.values())
        for s in sorted(starts):
            line = [s]
            while line[-1] in after:
                line.append(after.pop(line[-1]))
            lines.append(([at[n] for n in line], False))
        while after:
            s = min(after, key=lambda n: (n[0] * 2**31 + n[1], n[2] > n[0]))
            line = [s]
            while line[-1] in after:
                line.append(after.pop(line[-1]))
            lines.append(([at[n] for n in line], True))
        out[level] = lines
        level += interval
    return out


def filtered(lines, tolerance, least):
    out = []
    for points, closed in lines:
        xy = np.array(points)
        if np.linalg.norm(np.diff(xy, axis=0), axis=1).sum() < least:
            continue
        kept = xy[kept_points(xy, tolerance)]
        if len(kept) >= 2 and (kept != kept[0]).any():
            out.append((closed, tuple(map(tuple, np.round(kept, 2).tolist()))))
    return sorted(out)


@pytest.mark.parametrize("seed, shape, step", [(1, (24, 31), None), (2, (17, 40), 2.5), (3, (2, 2), None), (4, (1, 9), None)])
def test_contours_match_a_plain_tracer(spark, seed, shape, step):
    frames = [raster(seed, *shape, step=step), raster(seed + 10, *shape, holes=0.0)]
    got = contours.contours(cells_of(spark, *frames), key=["frame"]).collect()
    for f, z in enumerate(frames):
        want = {k: filtered(v, 0.1, 1.0) for k, v in plain_lines(z, 5.0).items()} if np.isfinite(z).any() else {}
        mine = {}
        for r in got:
            if r.frame == f:
                mine.setdefault(r.level, []).append((r.closed, tuple(zip(r.xs, r.ys))))
                assert r["index"] == (r.level % 25 == 0)
        assert {k: sorted(v) for k, v in mine.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("side", [3, 8])
def test_lines_over_many_blocks_match_a_plain_tracer(spark, monkeypatch, side):
    monkeypatch.setattr(contours, "SIDE", side)
    y, x = np.mgrid[0:26, 0:33]
    cone = 14.0 - np.hypot(y - 12, x - 15)  # closed lines over many blocks
    frames = [raster(6, 26, 33), cone, raster(7, 26, 33, step=2.5)]
    got = contours.contours(cells_of(spark, *frames), key=["frame"]).collect()
    for f, z in enumerate(frames):
        want = {k: v for k, v in ((k, filtered(v, 0.1, 1.0)) for k, v in plain_lines(z, 5.0).items()) if v}
        mine = {}
        for r in got:
            if r.frame == f:
                mine.setdefault(r.level, []).append((r.closed, tuple(zip(r.xs, r.ys))))
        assert {k: sorted(v) for k, v in mine.items()} == want
    assert sum(r.closed for r in got if r.frame == 1) >= 2


def test_rings_are_closed_lines(spark):
    z = np.zeros((9, 9))
    z[3:6, 3:6] = 8.0
    got = contours.contours(cells_of(spark, z), key=["frame"]).collect()
    assert [(r.level, r.closed, (r.xs[0], r.ys[0]) == (r.xs[-1], r.ys[-1])) for r in got] == [(5.0, True, True), (0.0, True, True)] or {r.level for r in got} == {0.0, 5.0} and all(r.closed for r in got)
    assert contours.contours(cells_of(spark, z).limit(0), key=["frame"]).count() == 0


def test_contour_sink(spark, tmp_path):
    z = raster(5, 12, 14)
    lines = contours.contours(cells_of(spark, z), key=["frame"]).drop("frame")
    contours.write_contours(lines, str(tmp_path / "out"), {"verticalUnits": "feet"})
    back = spark.read.json(str(tmp_path / "out/lines"))
    assert back.count() == lines.count() and {r.level for r in back.collect()} == {r.level for r in lines.collect()}
    assert spark.read.json(str(tmp_path / "out/about")).first().verticalUnits == "feet"
    assert len(list((tmp_path / "out/lines").glob("level=*"))) == len({r.level for r in back.collect()})


def flood(z, wet, most):
    """Stages by a heap: the lowest cell of the rim next."""
    stage = np.full(z.shape, np.nan)
    heap = [(z[p], p) for p in wet if z[p] <= most]
    heapq.heapify(heap)
    while heap:
        h, (y, x) = heapq.heappop(heap)
        if not math.isnan(stage[y, x]):
            continue
        stage[y, x] = h
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= p[0] < z.shape[0] and 0 <= p[1] < z.shape[1] and math.isnan(stage[p]) and z[p] <= most:
                heapq.heappush(heap, (max(h, z[p]), p))
    return stage


@pytest.mark.parametrize("seed, shape, step", [(1, (14, 17), None), (2, (20, 9), 1.0), (3, (1, 12), None)])
def test_connection_stages_match_a_heap_flood(spark, seed, shape, step):
    frames = [raster(seed, *shape, step=step), raster(seed + 7, *shape, step=step)]
    cells = cells_of(spark, *frames)
    wet = connection.sources(cells, 4.0, 3, ["frame"]).checkpoint(False)
    got = {(r.frame, r.y, r.x): r.stage for r in connection.connection_stages(cells, wet, 18.0, ["frame"]).collect()}
    seen = {(r.frame, r.y, r.x) for r in wet.collect()}
    for f, z in enumerate(frames):
        want = flood(np.where(np.isnan(z), np.inf, z), [(y, x) for g, y, x in seen if g == f], 18.0)
        assert {k[1:]: v for k, v in got.items() if k[0] == f} == {p: None if math.isnan(want[p]) else want[p] for p, v in np.ndenumerate(z) if not math.isnan(v)}


def test_stages_and_components_over_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 4)
    monkeypatch.setattr(blocks, "STEP", 2)
    frames = [raster(3, 37, 22, holes=0.15, step=1.0), raster(4, 37, 22, holes=0.3)]
    cells = cells_of(spark, *frames).withColumns({"y": F.col("y") - 9, "x": F.col("x") + 5})
    spark.sparkContext.setJobGroup("stages", "stages")
    wet = connection.sources(cells, 9.0, 3, ["frame"]).checkpoint(False)
    got = {(r.frame, r.y + 9, r.x - 5): r.stage for r in connection.connection_stages(cells, wet, 18.0, ["frame"]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stages"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = {(r.frame, r.y + 9, r.x - 5) for r in wet.collect()}
    for f, z in enumerate(frames):
        low = z <= 9.0
        own = {p for p, v in np.ndenumerate(low) if v}
        named = {}
        for p in sorted(own):
            todo, members = [p] if p not in named else [], []
            while todo:
                q = todo.pop()
                if q in own and q not in named:
                    named[q] = p
                    members.append(q)
                    todo += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
        large = {p for p in own if sum(c == named[p] for c in named.values()) >= 3}
        assert {p[1:] for p in seen if p[0] == f} == large
        want = flood(np.where(np.isnan(z), np.inf, z), sorted(large), 18.0)
        assert {k[1:]: v for k, v in got.items() if k[0] == f} == {p: None if math.isnan(want[p]) else want[p] for p, v in np.ndenumerate(z) if not math.isnan(v)}
    assert len({v for v in got.values()}) > 20 and jobs <= 60  # levels, not rounds


def test_no_sources_and_no_cells(spark):
    cells = cells_of(spark, raster(1, 3, 3))
    none = cells.select("y", "x").limit(0)
    assert {r.stage for r in connection.connection_stages(cells.drop("frame"), none, 20.0).collect()} == {None}
    assert connection.connection_stages(cells.drop("frame").limit(0), none, 20.0).count() == 0
    assert connection.sources(cells.where(F.lit(False)), 2.0, 1, ["frame"]).count() == 0


def test_tiles_are_as_many_files_as_tasks(spark, tmp_path):
    frame = bands.Frame(west=-74.0, south=40.4 - 4000 * 5 / bands.FEET_PER_DEGREE, east=-74.0 + 120 * 6.5 / bands.FEET_PER_DEGREE, north=40.4, width=120, height=4000)
    pixels = spark.range(0, 4000 * 120, 40).select(F.floor(F.col("id") / 120).alias("y"), (F.col("id") % 120).alias("x"), *(F.lit(1.0).alias(b) for b in bands.BANDS))
    bands.write_tiles(pixels, str(tmp_path / "tiles"), frame)
    files = list((tmp_path / "tiles").rglob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert len(files) <= 4 < back.select("ty", "tx").distinct().count() and back.count() == 12000


def test_points_and_tiles_are_not_broadcast(spark, tmp_path):
    """Packed files look small and the nine buckets of a point aren't counted, so the plan itself must send neither to all tasks."""
    height, wide, k = 200, 120, F.col("id")
    frame = bands.Frame(west=-74.0, south=40.4 - height * 5 / bands.FEET_PER_DEGREE, east=-74.0 + wide * 6.5 / bands.FEET_PER_DEGREE, north=40.4, width=wide, height=height)
    values = {b: F.lit(0.0) for b in bands.BANDS} | {"elevation": (k % 50).cast("double"), "hard": F.when(k % 101 == 0, 1.0).otherwise(0.0)}
    bands.write_tiles(spark.range(height * wide).select(F.floor(k / wide).alias("y"), (k % wide).alias("x"), *(v.alias(b) for b, v in values.items())), str(tmp_path / "tiles"), frame)
    dx, dy = frame.steps
    points = spark.range(0, height * wide, 7).select(k.alias("k"), (frame.north - (F.floor(k / wide) + 0.5) * dy).alias("lat"), (frame.west + (k % wide + 0.5) * dx).alias("lon"))
    got = bands.snapped(points, spark.read.parquet(str(tmp_path / "tiles")), frame)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    hard = [divmod(i, wide) for i in range(0, height * wide, 101)]
    want = {}
    for i in range(0, height * wide, 7):
        y, x = divmod(i, wide)
        across = math.cos(math.radians(frame.north - (y + 0.5) * dy)) * dx * bands.FEET_PER_DEGREE
        off, near = min((math.hypot((b - x) * across, (a - y) * 5), a * wide + b) for a, b in hard)
        want[i] = (near % 50, round(off, 6)) if off <= bands.FEATURE_FT else (i % 50, None)
    assert {r.k: (r.elevation, r.feature_ft and round(r.feature_ft, 6)) for r in got.collect()} == want
