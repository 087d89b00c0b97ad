"""First-connection stages: the lowest level at which water from a source reaches a cell, over any path of neighbours.

The height of a path is its highest cell. Of a block of cells others need to know only how high water must rise between any two
cells of its rim, or from a source in it to one of them: a tree of as many ways as the rim has cells tells that. So blocks are
cut down to the trees of their rims, blocks of blocks are put together from these (``blocks``), and from the largest block,
where the stages on its blocks' rims are known, the way leads down again to the cells of each. The sources are one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved
from .blocks import Extent, adjacent, block, extent, key_schema
from .grids import components

SOURCE = -1  # the place of all sources


def sources(cells: DataFrame, stage: float, least_cells: int, key: list[str] | None = None) -> DataFrame:
    """(key, y, x) of the cells at or below ``stage`` in 4-neighbour components of ``least_cells`` or more."""
    key = key or []
    return components(cells.where(F.col("z") <= stage), key).where(F.col("size") >= least_cells).select(*key, "y", "x")


class Ways:
    """The cells of a block (sorted numbers, heights) and all ways between them, lowest first; the sources are the last place."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        cell = a == b
        order = np.lexsort((w[cell], a[cell]))
        n, z = a[cell][order], w[cell][order]
        new = np.concatenate([[True], n[1:] != n[:-1]]) if len(n) else np.zeros(0, bool)
        self.n, self.z = n[new], z[new]
        u, v = adjacent(self.n) if len(self.n) else (np.zeros(0, int), np.zeros(0, int))
        place = lambda ends: np.where(ends == SOURCE, len(self.n), np.searchsorted(self.n, ends))
        ends = np.concatenate([u, place(a[~cell])]), np.concatenate([v, place(b[~cell])])
        high = np.concatenate([np.maximum(self.z[u], self.z[v]), w[~cell]])
        low = np.argsort(high, kind="stable")
        self.ways = ends[0][low].tolist(), ends[1][low].tolist(), high[low].tolist()

    def joined(self, meet: Callable[[int, int, float], None]) -> None:
        """Tells ``meet`` of each way that joins two groups: the group that stays, the one that goes into it, how high the way is."""
        parent, size = list(range(len(self.n) + 1)), [1] * (len(self.n) + 1)
        for a, b, w in zip(*self.ways, strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                if size[a] < size[b]:
                    a, b = b, a
                parent[b] = a
                size[a] += size[b]
                meet(a, b, w)

    def tree(self, rim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ways (from, to, height) between the cells of the rim and the sources; the highest one between two of them in this
        tree is as high as water must rise in the block."""
        stands = np.append(np.where(rim, np.arange(len(rim)), -1), len(rim)).tolist()  # a cell of the rim in each group
        out = []

        def meet(a: int, b: int, w: float) -> None:
            if stands[a] >= 0 and stands[b] >= 0:
                out.append((max(stands[a], stands[b]), min(stands[a], stands[b]), w))  # the sources, if any, are the first end
            stands[a] = max(stands[a], stands[b])

        self.joined(meet)
        ids = np.append(self.n, SOURCE)
        a, b = (np.array([e[k] for e in out], np.int64) for k in (0, 1))
        return ids[a], ids[b], np.array([e[2] for e in out], float)

    def stages(self) -> np.ndarray:
        """How high water must rise to reach each cell; NaN where there is no way."""
        out, last = np.full(len(self.n) + 1, np.nan), len(self.n)
        members = [[k] for k in range(last + 1)]
        wet = [False] * last + [True]

        def meet(a: int, b: int, w: float) -> None:
            if wet[a] != wet[b]:
                out[members[a] if wet[b] else members[b]] = w
                wet[a] = True
            members[a] += members[b]
            members[b] = []

        self.joined(meet)
        return out[:-1]


def _table(own: pa.Table, **columns: np.ndarray) -> pa.Table:
    """The columns, with the (equal) key of the rows of ``own`` before them."""
    n = len(next(iter(columns.values())))
    return pa.table({c: own.column(c).take(pa.array(np.zeros(n, np.int64))) for c in own.column_names} | {c: pa.array(v) for c, v in columns.items()})


def _stages(rows: DataFrame, frame: Extent, key: list[str]) -> DataFrame:
    """(key, n, stage) of cells (a and b the cell, w its height) and ways from sources (a is SOURCE)."""
    schema = key_schema(rows, key)
    ways = lambda t: Ways(*(t.column(c).to_numpy() for c in "abw"))

    def up(side: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            w = ways(table)
            rim = frame.rim(w.n, side)
            a, b, high = w.tree(rim)
            return _table(table.select(key), a=np.concatenate([w.n[rim], a]), b=np.concatenate([w.n[rim], b]), w=np.concatenate([w.z[rim], high]))

        return run

    def down(table: pa.Table) -> pa.Table:
        w = ways(table)
        stage = w.stages()
        some = ~np.isnan(stage)
        return _table(table.select(key), n=w.n[some], stage=stage[some])

    levels, sides = [rows], frame.sides
    for side in sides[:-1]:
        levels.append(saved(levels[-1].groupBy(*key, block("b", side)).applyInArrow(up(side), f"{schema}a long, b long, w double"), "ways"))
    known = None
    for side, own in zip(reversed(sides), reversed(levels), strict=True):
        if known is not None:
            own = own.unionByName(known.select(*key, F.lit(SOURCE).cast("long").alias("a"), F.col("n").alias("b"), F.col("stage").alias("w")))
        known = saved(own.groupBy(*key, block("b", side)).applyInArrow(down, f"{schema}n long, stage double"), "stages")
    return known


def connection_stages(cells: DataFrame, wet: DataFrame, most: float, key: list[str] | None = None) -> DataFrame:
    """(key, y, x, stage): the first-connection stage of each cell of ``cells`` (key, y, x, z), null where no path stays at or
    below ``most``. ``wet`` (key, y, x) are the sources; a source's stage is its own height. Cells without a height are
    no part of any path."""
    key = key or []
    known = cells.where(F.col("z").isNotNull() & ~F.isnan("z"))
    frame = extent(known)
    marked = wet.select(*key, frame.node().alias("n")).distinct().withColumn("is_source", F.lit(True))
    base = saved(known.select(*key, frame.node().alias("n"), F.col("z").cast("double").alias("z")).join(marked, [*key, "n"], "left"), "cells")
    open_ = base.where((F.col("z") <= most) & F.col("n").isNotNull())
    ends = F.array(F.struct(F.col("n").alias("a")), F.when(F.col("is_source"), F.struct(F.lit(SOURCE).cast("long").alias("a"))))
    rows = open_.select(*key, F.explode(ends).alias("e"), F.col("n").alias("b"), F.col("z").alias("w")).where("e IS NOT NULL").select(*key, "e.a", "b", "w")
    found = _stages(rows, frame, key).withColumnRenamed("stage", "found")
    stage = F.when(F.col("z") <= most, F.greatest("found", "z"))  # rows of one cell have their own heights
    return base.join(found, [*key, "n"], "left").select(*key, *frame.place(), F.when(F.col("found").isNotNull(), stage).alias("stage"))
