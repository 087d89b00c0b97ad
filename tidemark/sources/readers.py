"""Readers of published files: JSON payloads, archives in shards, station files, pages of features, packed raster strips.

Files that hold no payload give no rows; rows that don't parse are left out, or are null where a slot has to stay.
"""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import civil, stage_number
from ..functions.times import day_shift, utc_micros

READ_ROWS, ROWS = 512, 1 << 16  # packed rows that are taken, and unpacked ones that are handed over, at once
HOURS = "array<struct<timeUtc:string,stage:double>>"
FORECAST = f"struct<scenarioForecasts:map<string,struct<hours:{HOURS}>>,forecasts:map<string,struct<hours:{HOURS}>>,hours:{HOURS}>"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document of a folder with the columns of ``schema``; what is no JSON gives none."""
    held = spark.read.schema(f"{schema}, broken_ string").option("columnNameOfCorruptRecord", "broken_").json(path)
    return held.where("broken_ IS NULL").drop("broken_")


def zone_forecast(payloads: DataFrame, zone: str) -> DataFrame:
    """(file, forecast): a zone's own forecast where a payload has zones, else the payload's."""
    return payloads.select("file", F.coalesce(F.when(F.col("zones").isNotNull(), F.try_element_at("zones", F.lit(zone))), F.col("forecast")).alias("forecast"))


def scenario_rows(forecasts: DataFrame, scenario: str) -> DataFrame:
    """(file, i, t, stage) of a scenario: of the scenario forecasts, else of the forecasts, else of the top level for the mean."""
    of = lambda c: F.try_element_at(F.col(f"forecast.{c}"), F.lit(scenario))["hours"]
    hours = F.coalesce(of("scenarioForecasts"), of("forecasts"), F.col("forecast.hours") if scenario == "mean" else F.lit(None))
    return forecasts.select("file", F.posexplode(hours).alias("i", "h")).select("file", "i", utc_micros(F.col("h.timeUtc")).alias("t"), F.col("h.stage").alias("stage"))


def shards_of_day(day: Column, source: Column) -> Column:
    """The (source, year) shards that a day's replay takes: its own and its neighbours'."""
    years = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.year(F.date_add(F.to_date(day), d))))
    return F.transform(years, lambda y: F.struct(source.alias("source"), y.alias("year")))


def archive(spark: SparkSession, path: str, schema: str, first_day: str, last_day: str, source: str | None = None, compact: DataFrame | None = None) -> DataFrame:
    """Days of an archive in folders by source and year, from one day before ``first_day`` to one after ``last_day``: only
    the folders of those years are read. Days of years that have no folder come from the ``compact`` archive."""
    held = spark.read.schema(f"{schema}, source string, year int").parquet(path)
    wanted = held.where(F.col("year").between(int(first_day[:4]) - (first_day[5:] == "01-01"), int(last_day[:4]) + (last_day[5:] == "12-31")))
    wanted = wanted if source is None else wanted.where(F.col("source") == source)
    inside = F.col("d").between(day_shift(F.lit(first_day), -1), day_shift(F.lit(last_day), 1))
    out = wanted.where(inside)
    if compact is None:
        return out
    have = held.select("source", "year").distinct()
    rest = compact.withColumn("year", F.year(F.to_date("d"))).where(inside) if source is None else compact.withColumn("year", F.year(F.to_date("d"))).where(inside & (F.col("source") == source))
    return out.unionByName(rest.join(have, ["source", "year"], "left_anti"))


def quarter_days(days: DataFrame) -> DataFrame:
    """(d, i, t, stage, quality, missing) of compact days (d, u: first second, v: hundredths by quarter hour, q: letters)."""
    each = days.select("d", "u", "q", F.posexplode("v").alias("i", "code"))
    letter = F.substring("q", F.col("i") + 1, F.lit(1))
    return each.select("d", "i", ((F.col("u") + F.col("i") * 900) * 1_000_000).alias("t"), (F.col("code") / 100).alias("stage"), F.when(letter != "", letter).otherwise("unknown").alias("quality"), F.col("code").isNull().alias("missing"))


def hour_days(days: DataFrame) -> DataFrame:
    """(d, i, t, stage, minutes) of hourly surrogate days, of which some hours (x) were read at six minutes."""
    each = days.select("d", "u", "x", F.posexplode("v").alias("i", "code"))
    return each.select("d", "i", ((F.col("u") + F.col("i") * 3600) * 1_000_000).alias("t"), (F.col("code") / 100).alias("stage"), F.when(F.array_contains(F.coalesce("x", F.array().cast("array<int>")), F.col("i")), 6).otherwise(60).alias("minutes"))


def gauge_values(payloads: DataFrame) -> DataFrame:
    """(station_id, t, stage, day) of instantaneous-value payloads: finite values that aren't the series' mark for none."""
    series = payloads.select(F.explode("value.timeSeries").alias("s"))
    each = series.select(F.col("s.name").alias("station_id"), F.col("s.variable.noDataValue").alias("none"), F.explode("s.values").alias("v")).select("station_id", "none", F.explode("v.value").alias("x"))
    rows = each.select("station_id", "none", utc_micros(F.col("x.dateTime")).alias("t"), stage_number(F.col("x.value")).alias("stage"))
    kept = rows.where(F.col("t").isNotNull() & F.col("stage").isNotNull() & ~F.col("stage").eqNullSafe(F.col("none"))).drop("none")
    return kept.withColumn("day", F.date_format(civil(F.col("t")), "yyyy-MM-dd"))


def station_observations(payloads: DataFrame, station: str) -> DataFrame:
    """(t, stage) of a station's observation file, finite levels at readable times; files of another station give none."""
    own = payloads.where(F.col("metadata.id") == station).select(F.explode("data").alias("r"))
    rows = own.select(F.unix_micros(F.try_to_timestamp("r.t", F.lit("yyyy-MM-dd HH:mm"))).alias("t"), stage_number(F.col("r.v")).alias("stage"))
    return rows.where("t IS NOT NULL AND stage IS NOT NULL")


def stamped_levels(spark: SparkSession, path: str, column: str, adjustment: float = 0.0) -> DataFrame:
    """(stamp, level) of station CSVs: headers in any case with blanks around, stamps of twelve digits, finite levels; the last
    one of a stamp counts."""
    held = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = {c.strip().upper(): c for c in held.columns}
    stamp, raw = F.trim(F.col(f"`{names['TIME']}`")), stage_number(F.col(f"`{names[column]}`"))
    rows = held.select(stamp.alias("stamp"), F.when(F.abs(raw) < 50, raw + adjustment).alias("level")).where(stamp.rlike(r"^\d{12}$") & F.col("level").isNotNull())
    return rows.groupBy("stamp").agg(F.max("level").alias("level"))


def last_features(pages: DataFrame, key: str) -> DataFrame:
    """The features (page, i, key, ...) of all pages, the last one of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("page"), F.desc("i"))
    return pages.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def _handed(names: list[str], found: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, columns of a key's values), about ``ROWS`` at a time: a task never holds what all of its keys make."""
    held, rows = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in held], [len(c[0]) for _, c in held]).astype(np.int64)), *(pa.array(np.concatenate(c)) for c in zip(*(c for _, c in held)))], names=names)
    for key, columns in found:
        for at in range(0, len(columns[0]), ROWS):
            held.append((key, [c[at : at + ROWS] for c in columns]))
            rows += len(held[-1][1][0])
            if rows >= ROWS:
                yield out()
                held, rows = [], 0
    if held:
        yield out()


def parts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The columns of batches as values, ``READ_ROWS`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            yield [batch.column(c).slice(at, READ_ROWS).to_pylist() for c in names]


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    return (row for part in parts(batches, *names) for row in zip(*part, strict=True))


def strip_values(strips: DataFrame) -> DataFrame:
    """(tile, i, value) of strips of little-endian 16-bit values, gzipped and in base64; a strip of another length than its
    width times its rows gives none."""

    def decode(batches):
        def found():
            for tile, width, rows, text in _rows(batches, "tile", "width", "rows", "data"):
                values = np.frombuffer(gzip.decompress(base64.b64decode(text)), "<u2")
                if len(values) == width * rows:
                    yield tile, [np.arange(len(values)), values.astype(np.int64)]

        return _handed(["tile", "i", "value"], found())

    return strips.mapInArrow(decode, "tile long, i long, value long")


def delta_cells(indexes: DataFrame) -> DataFrame:
    """(stage, cell) of sparse indexes: each cell is the sum of the steps up to it, steps are in groups of seven bits, low ones
    first, the eighth bit set while more follow. An index that does not hold ``n`` rising cells gives none."""

    def decode(batches):
        def found():
            for stage, n, data in _rows(batches, "stage", "n", "data"):
                raw = np.frombuffer(data, np.uint8).astype(np.int64)
                last = np.flatnonzero(raw < 128)
                first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
                group = np.repeat(np.arange(len(last)), last - first + 1)
                used = raw[: len(group)]
                steps = np.bincount(group, (used & 127) * 2.0 ** (7 * (np.arange(len(group)) - first[group])), len(last)).astype(np.int64)
                if len(steps) == n and len(group) == len(raw) and (steps[1:] > 0).all():
                    yield stage, [np.cumsum(steps)]

        return _handed(["stage", "cell"], found())

    return indexes.mapInArrow(decode, "stage long, cell long")


def stripe_points(points: DataFrame, stripes: DataFrame, width: int) -> DataFrame:
    """(k, ground, developed) of points (k, x, y): a stripe (y) has a byte of ground for each x and a bit of whether it is
    developed; byte 255 is none."""
    both = points.where(F.col("x").between(0, width - 1)).join(stripes, "y")
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10).cast("int")
    ground = byte("ground", F.col("x"))
    bit = F.getbit(byte("bits", F.floor(F.col("x") / 8).cast("int")), F.col("x") % 8) == 1
    return both.select("k", F.when(ground != 255, ground / 10).alias("ground"), bit.alias("developed"))


def manifests(pointer: DataFrame, files: DataFrame, schema_name: str) -> DataFrame:
    """(scenario, file) that a pointer (cycle, scenario, file) names, of files (file, schema, cycle) of the right schema and cycle."""
    return pointer.join(files.withColumnRenamed("cycle", "own"), "file").where((F.col("schema") == schema_name) & (F.col("own") == F.col("cycle"))).select("scenario", "file")
