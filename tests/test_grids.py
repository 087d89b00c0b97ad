"""Raster and line operators against plain loops."""

import math

import numpy as np
import pytest

from tidemark.operators import grids as O
from tidemark.plans import catalog


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(5)
    wet = {(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((30, 30)) < 0.55))} | {(40, x) for x in range(60)}
    want, left = {}, set(wet)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            seen.add((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left:
                    left.discard(n), todo.append(n)
        for c in seen:
            want[c] = (min(y * 2**32 + x for y, x in seen), len(seen))
    got = O.components(spark.createDataFrame(sorted(wet), "y long, x long")).collect()
    assert {(r.y, r.x): (r.component, r.size) for r in got} == want
    assert O.components(spark.createDataFrame([], "y long, x long")).count() == 0


def to_piece(p, a, b):
    """Distance of a point to a piece of line: to its ends where the foot lies beyond them."""
    length = math.dist(a, b)
    if not length:
        return math.dist(p, a)
    along = sum((q - o) * (e - o) for q, o, e in zip(p, a, b)) / length
    return math.dist(p, a) if along < 0 else math.dist(p, b) if along > length else math.sqrt(max(math.dist(p, a) ** 2 - along**2, 0))


def slow(xy, tolerance):
    if len(xy) < 3:
        return list(map(tuple, xy))
    far = [to_piece(p, xy[0], xy[-1]) for p in xy[1:-1]]
    i = int(np.argmax(far)) + 1
    return slow(xy[: i + 1], tolerance)[:-1] + slow(xy[i:], tolerance) if far[i - 1] > tolerance else [tuple(xy[0]), tuple(xy[-1])]


def test_points_beyond_the_ends_stay():
    assert O.kept_points(np.array([[0.0, 0], [-5, 0.05], [1, 0]]), 0.1).all()


def plain_filling(frame):
    """Breadth-first filling, cell by cell."""
    cells = {(r["y"], r["x"]): r for r in frame}
    around = lambda c: [(c[0], c[1] - 1), (c[0], c[1] + 1), (c[0] - 1, c[1]), (c[0] + 1, c[1])]
    wet = lambda c: any(cells[n]["lower_wet"] for n in around(c) if n in cells)
    candidate = {c for c, r in cells.items() if r["candidate"]}
    shallow = {c for c in candidate if cells[c]["shallow"]}

    def spread(seeds, open_):
        came, reached = dict.fromkeys(seeds), list(seeds)
        for c in reached:
            for n in around(c):
                if n in open_ and n not in came:
                    came[n] = c
                    reached.append(n)
        return reached, came

    parts, done = [], set()
    for c in sorted(shallow):
        if c not in done:
            members, _ = spread([c], shallow)
            done |= set(members)
            seeds = [m for m in members if wet(m)]
            if seeds:
                reached, came = spread(seeds, set(members))
                depth = {}
                for m in reached:
                    depth[m] = depth[came[m]] + 1 if came[m] else 1
                end, path = min(reached, key=lambda m: (-depth[m], m)), []
                while end:
                    path.insert(0, end)
                    end = came[end]
                parts.append((-len(members), c, path, reached))
    parts.sort(key=lambda p: p[:2])
    outer, _ = spread([c for c in sorted(candidate) if wet(c)], candidate)
    return list(dict.fromkeys([c for p in parts for c in p[2]] + [c for p in parts for c in p[3]] + outer))


def test_filling_order(spark):
    rng = np.random.default_rng(12)
    rows = [{"frame": f, "y": y, "x": x, "lower_wet": bool(a < 0.12), "candidate": bool(a > 0.3), "shallow": bool(b < 0.6)} for f in (1, 2) for y in range(14) for x in range(17) for a, b in [rng.random(2)]]
    got = O.filling_order(spark.createDataFrame(rows), "frame").toPandas()
    for f, g in got.groupby("frame"):
        assert [tuple(c) for c in g.sort_values("place")[["y", "x"]].to_numpy().tolist()] == plain_filling([r for r in rows if r["frame"] == f])


def test_simplified_lines(spark):
    rng = np.random.default_rng(2)
    lines = [np.column_stack([np.arange(n), np.cumsum(rng.normal(0, 0.1, n))]).round(3) for n in (1, 2, 3, 40, 200)] + [np.array([[0.0, 0], [1, 1], [0, 0]])]
    rows = [(i, x[:, 0].tolist(), x[:, 1].tolist()) for i, x in enumerate(lines)] + [(90, None, None), (91, [], [])]
    got = {r.k: r for r in O.simplified(spark.createDataFrame(rows, "k long, xs array<double>, ys array<double>")).collect()}
    for i, line in enumerate(lines):
        assert list(zip(got[i].xs, got[i].ys)) == (slow(line, 0.1) if len(line) > 1 else list(map(tuple, line)))
    assert got[90].xs is None and got[91].xs == []


def test_lines_are_simplified_together(spark, monkeypatch):
    rng = np.random.default_rng(7)
    lines = [np.column_stack([np.arange(n) % 9, np.cumsum(rng.normal(0, 0.3, n))]).round(1) for n in rng.integers(0, 60, 300)]
    lines += [np.zeros((5, 2)), np.array([[0.0, 0], [1, np.nan], [2, 0], [3, 5], [4, 0]]), np.array([[0.0, 0], [4, 3], [0, 0]])]
    xy, first = np.concatenate(lines), np.append(0, np.cumsum([len(v) for v in lines]))
    got = O.kept_of_lines(xy[:, 0], xy[:, 1], first, 0.1)
    assert [got[a:b].tolist() for a, b in zip(first, first[1:])] == [O.kept_points(v, 0.1).tolist() if len(v) else [] for v in lines]
    monkeypatch.setattr(O, "POINTS", 50)
    rows = [(i, v[:, 0].tolist(), v[:, 1].tolist()) for i, v in enumerate(lines)]
    out = {r.k: list(zip(r.xs, r.ys)) for r in O.simplified(spark.createDataFrame(rows, "k long, xs array<double>, ys array<double>").coalesce(1)).collect()}
    assert [repr(out[i]) for i in range(len(lines))] == [repr([tuple(p) for p in lines[i][got[first[i] : first[i + 1]]].tolist()]) for i in range(len(lines))]


@pytest.mark.parametrize("name", ["L21_simplified", "A8_quarter_days", "A9_hour_days"])
def test_rows_of_small_files_are_dealt_over_tasks(spark, name):
    out = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= 4


def test_spans_cover_the_centres_inside(spark):
    ring, hole = [(1.2, 0.7), (9.6, 2.1), (7.3, 9.9), (2.4, 7.7)], [(4.0, 3.0), (6.0, 3.0), (5.0, 6.0)]
    df = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in (ring, hole)])], "shape_id long, rings array<array<struct<x double, y double>>>")
    got = {(r.y, x) for r in O.rasterised(df, 9, 12).collect() for x in range(r["first"], r["last"] + 1)}

    def inside(x, y):
        hits = 0
        for r in (ring, hole):
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                hits += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return hits % 2 == 1

    assert got == {(y, x) for y in range(12) for x in range(9) if inside(x + 0.5, y + 0.5)}
