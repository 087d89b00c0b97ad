"""Greedy label placement: lines in order, at most so many labels an elevation and in all, none within a box around another.

The places of a view are read in order, by line and then by distance from the middle, and a view keeps no more than its labels
(``PER_VIEW`` at most): one shuffle sorts the places, each task goes through its views as a stream, and no view is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The box around a label in which no other's centre lies, labels of an elevation and of a view.
BOX_X, BOX_Y = 85.0, 30.0
PER_ELEVATION, PER_VIEW = 2, 24


class View:
    """The labels of a view so far."""

    def __init__(self, name: object) -> None:
        self.name, self.line, self.labels = name, None, []

    def takes(self, line: object, elevation: object, px: float, py: float) -> bool:
        """Whether a line that has no label yet gets one at a place."""
        if len(self.labels) >= PER_VIEW or (self.labels and line == self.line) or sum(e == elevation for e, _, _ in self.labels) >= PER_ELEVATION:
            return False
        if any(abs(px - x) < BOX_X and abs(py - y) < BOX_Y for _, x, y in self.labels):
            return False
        self.line = line
        self.labels.append((elevation, px, py))
        return True


def placed_labels(places: DataFrame, view: str = "view") -> DataFrame:
    """(view, line, elevation, at, px, py) of the labels. ``places`` has the places that a line may take: view, line (its order),
    elevation, at (the order of a place on its line), px, py and far (distance from the middle of the view); a line takes the
    nearest to the middle that is free, the first on ties. Places without a view, line, px or py are none."""
    out = [view, "line", "elevation", "at", "px", "py"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            kept = []
            for i, (name, line, elevation, px, py) in enumerate(zip(*(batch.column(c).to_pylist() for c in (view, "line", "elevation", "px", "py")), strict=True)):
                if now is None or name != now.name:
                    now = View(name)
                if len(now.labels) < PER_VIEW and now.takes(line, elevation, px, py):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    known = places.select(*out, "far").dropna(subset=[view, "line", "px", "py"])
    ordered = known.repartition(view).sortWithinPartitions(view, "line", "far", "at", "px", "py", "elevation").select(*out)
    return ordered.mapInArrow(run, ordered.schema)
