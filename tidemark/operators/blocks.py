"""Rasters in blocks. What cells outside of a block can learn of it is told by the cells on its rim, so blocks are worked out each by
itself, then blocks of blocks from the rims alone, until one block is the whole raster: few levels, each with one shuffle, and
the largest group has the rims of ``STEP`` x ``STEP`` blocks, which grow as the side of the raster and not as its area.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = 2**32  # columns of a row, as cells are numbered
SIDE, STEP = 128, 8  # cells of a block's side, blocks of the next larger block's side; powers of two


@dataclass(frozen=True)
class Extent:
    """Where a raster begins, how large it is; cells are numbered from its corner."""

    y: int
    x: int
    height: int
    width: int

    @property
    def sides(self) -> list[int]:
        out = [SIDE]
        while out[-1] < max(self.height, self.width):
            out.append(out[-1] * STEP)
        return out

    def node(self) -> Column:
        return (F.col("y").cast("long") - F.lit(self.y)) * F.lit(ROW) + F.col("x").cast("long") - F.lit(self.x)

    def place(self, n: str = "n") -> list[Column]:
        return [(F.shiftright(n, 32) + F.lit(self.y)).alias("y"), (F.col(n).bitwiseAND(F.lit(ROW - 1)) + F.lit(self.x)).alias("x")]

    def rim(self, n: np.ndarray, side: int) -> np.ndarray:
        """Which cells have a neighbour in the raster that is outside of their block."""
        y, x = n // ROW, n % ROW
        return ((y % side == 0) & (y > 0)) | ((y % side == side - 1) & (y < self.height - 1)) | ((x % side == 0) & (x > 0)) | ((x % side == side - 1) & (x < self.width - 1))


def extent(cells: DataFrame) -> Extent:
    lo_y, lo_x, hi_y, hi_x = cells.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
    return Extent(int(lo_y), int(lo_x), int(hi_y - lo_y) + 1, int(hi_x - lo_x) + 1) if None not in (lo_y, lo_x) else Extent(0, 0, 1, 1)


def block(n: str, side: int) -> Column:
    """The number of a cell's block."""
    k = side.bit_length() - 1
    return (F.shiftright(n, 32 + k) * F.lit(ROW) + F.shiftright(F.col(n).bitwiseAND(F.lit(ROW - 1)), k)).alias("block")


def adjacent(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of 4-neighbours among the sorted cells ``n``."""
    a, b = [], []
    for d in (1, ROW):
        at = np.minimum(np.searchsorted(n, n + d), len(n) - 1)
        a.append(np.flatnonzero(n[at] == n + d))
        b.append(at[a[-1]])
    return np.concatenate(a), np.concatenate(b)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each component of n things that the pairs (a, b) join."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b, was[a], was[b]):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == was).all():
            return label


def key_schema(rows: DataFrame, key: list[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in key)
