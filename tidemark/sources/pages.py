"""Paged feature services and live windows as a data source: ``spark.read.format("tidemark_pages")``.

A service is a folder of pages (JSON, one object with ``features``) and an index that says which ids and instants each page
has. A page is a partition of its own, where there are many several
share one; bounds on ``object_id`` and ``t`` that Spark hands over leave out the pages that
can't have a row. A page that can't be read is taken from the fallback folder, and where that fails too the row of the page has
its fault. As a stream the offset is the instant up to which rows were handed out: a micro-batch reads the pages that overlap
its window, at most ``window`` of time at once, and nothing that was handed out before.

Options: ``path``, ``fallback``, and for streams ``start`` and ``window`` in microseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "object_id long, t long, value double, kind string, page string, origin string, fault string"
FORMAT = "tidemark_pages"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
MOST_PARTITIONS = 256


def _read(path: str) -> bytes:
    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(place) as file:
        return file.read()


@dataclass
class Page(InputPartition):
    name: str
    low: int
    high: int
    first: int
    last: int
    since: int | None = None  # of a stream: rows from here
    below: int | None = None  # ... and before here


@dataclass
class Bundle(InputPartition):
    pages: list[Page]


def bundled(pages: list[Page]) -> list[Bundle]:
    """Pages as partitions: one each up to ``MOST_PARTITIONS``, and beyond as many of them to a partition as it takes."""
    step = max(1, -(-len(pages) // MOST_PARTITIONS))
    return [Bundle(pages[k : k + step]) for k in range(0, len(pages), step)]


class _Bounds:
    """What is asked of a number."""

    def __init__(self) -> None:
        self.low, self.high = -(2**63), 2**63 - 1

    def take(self, f: Filter) -> bool:
        v = getattr(f, "value", None)
        if not isinstance(v, int):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, v + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high = min(self.high, v - isinstance(f, LessThan))
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def meets(self, low: int, high: int) -> bool:
        return low <= self.high and high >= self.low


class _Pages:
    def __init__(self, options: dict) -> None:
        self.path, self.fallback = options["path"].rstrip("/"), options.get("fallback", "").rstrip("/")

    def index(self) -> list[Page]:
        return [Page(p["page"], p["low"], p["high"], p["first"], p["last"]) for p in json.loads(_read(f"{self.path}/index.json"))]

    def rows(self, page: Page) -> Iterator[tuple]:
        fault = None
        for origin, root in (("service", self.path), ("fallback", self.fallback)):
            if not root:
                continue
            try:
                told = json.loads(_read(f"{root}/{page.name}.json"))
                rows = [(int(f["object_id"]), int(f["t"]), None if f.get("value") is None else float(f["value"]), f.get("kind")) for f in told["features"]]
            except (OSError, ValueError, KeyError, TypeError) as e:
                fault = fault or type(e).__name__
                continue
            for row in rows:
                if page.since is None or page.since <= row[1] < page.below:
                    yield (*row, page.name, origin, None)
            return
        yield (None, page.first if page.since is None else max(page.first, page.since), None, None, page.name, None, fault)


class PageReader(DataSourceReader, _Pages):
    def __init__(self, options: dict) -> None:
        _Pages.__init__(self, options)
        self.asked = {"object_id": _Bounds(), "t": _Bounds()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds choose pages; rows are filtered by Spark all the same."""
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if len(name) == 1 and name[0] in self.asked:
                self.asked[name[0]].take(f)
            yield f

    def partitions(self) -> list[Bundle]:
        return bundled([p for p in self.index() if self.asked["object_id"].meets(p.low, p.high) and self.asked["t"].meets(p.first, p.last)])

    def read(self, partition: Bundle | None) -> Iterator[tuple]:
        for page in partition.pages if isinstance(partition, Bundle) else ():
            yield from self.rows(page)


class PageStream(DataSourceStreamReader, _Pages):
    def __init__(self, options: dict) -> None:
        _Pages.__init__(self, options)
        self.start, self.window = int(options.get("start", 0)), int(options.get("window", 2**62))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"t": self.start}

    def latestOffset(self) -> dict:
        """The end of the next window, or of all that is there."""
        end = max((p.last for p in self.index()), default=self.start - 1) + 1
        self.at = max(self.at, min(end, self.at + self.window))
        return {"t": self.at}

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        self.at = max(self.at, end["t"])
        return bundled([Page(p.name, p.low, p.high, p.first, p.last, start["t"], end["t"]) for p in self.index() if p.first < end["t"] and p.last >= start["t"]])

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for page in partition.pages:
            yield from self.rows(page)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def write_pages(rows: DataFrame, path: str, page_rows: int, spoil: str | None = None) -> None:
    """Rows (object_id, t, value, kind) as pages of ``page_rows`` ids, and their index, which is written last. ``spoil`` is a
    condition on ``page`` (a number): such pages are written so that they can't be read."""
    from . import blobs

    paged = rows.withColumn("page", F.floor(F.col("object_id") / page_rows)).groupBy("page").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("object_id", "t", "value", "kind"))).alias("features"))).alias("text"),
        *(f(c).alias(n) for f, c, n in ((F.min, "object_id", "low"), (F.max, "object_id", "high"), (F.min, "t", "first"), (F.max, "t", "last"))),
    )
    text = F.col("text") if spoil is None else F.when(F.expr(spoil), F.substring("text", 1, 40)).otherwise(F.col("text"))
    blobs.write_files(paged.select(F.concat(F.col("page").cast("string"), F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content")), path)
    index = [r.asDict() for r in paged.select(F.col("page").cast("string").alias("page"), "low", "high", "first", "last").collect()]  # one entry a page, as services list them
    system, root = blobs._open(path)
    blobs._put(system, f"{root}/index.json", json.dumps(index).encode())


def pages(spark: SparkSession, path: str, fallback: str = "") -> DataFrame:
    """The rows of a service, with what is read on failure. Bounds reach the source where ``PUSHDOWN`` is set, as it is here."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PagedFeatures)
    return spark.read.format(FORMAT).option("path", path).option("fallback", fallback).load()


def live(spark: SparkSession, path: str, start: int, window: int, fallback: str = "") -> DataFrame:
    """The rows of a service from an instant on, as a stream."""
    spark.dataSource.register(PagedFeatures)
    return spark.readStream.format(FORMAT).option("path", path).option("fallback", fallback).option("start", start).option("window", window).load()
