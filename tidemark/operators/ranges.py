"""Export ranges: what may be asked for, and the frames that a range has at each cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import civil_day
from ..sources.tables import DAY, HOUR, MINUTE
from .series import QUARTER, daily_maximum, precedence, quarter_hours

LONGEST = 84 * HOUR
# The most frames of an export by cadence.
MOST_FRAMES = {"hourly": 85, "15min": 337, "daily": 5}


def range_fault(start: Column, end: Column, first: Column, last: Column, longest: int = LONGEST) -> Column:
    """Why a range can't be exported: invalid-range, invalid-order, range-too-long, outside-data; ok if it can."""
    return (
        F.when(start.isNull() | end.isNull(), "invalid-range").when(end < start, "invalid-order").when(end - start > longest, "range-too-long")
        .when(F.coalesce((start < first) | (end > last), F.lit(False)), "outside-data").otherwise("ok")
    )


def frame_count(start: Column, end: Column, cadence: Column) -> Column:
    """How many frames a range is expected to have."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    hourly = F.greatest(F.lit(0), F.floor(hi / HOUR) - F.ceil(lo / HOUR) + 1)
    quarter = F.greatest(F.lit(1), F.floor((hi - lo) / QUARTER) + 1)
    return F.when(cadence == "daily", F.datediff(civil_day(hi), civil_day(lo)) + 1).when(cadence == "hourly", hourly).otherwise(quarter)


def needs_archive(start: Column, end: Column, now: int, observed: Column, first: Column, last: Column) -> Column:
    """Whether a range reaches beyond the forecast's readings, or asks for what has been observed."""
    return F.coalesce(observed & (start <= now), F.lit(False)) | F.coalesce((start < first) | (end > last), F.lit(True))


def selection_range(rows: DataFrame, chosen: DataFrame, by: str = "station_id", longest: int = LONGEST) -> DataFrame:
    """(by, first, last): from a chosen instant ``at`` to the last reading within ``longest`` of it, else the instant alone."""
    held = rows.join(chosen, by).where((F.col("t") >= F.col("at")) & (F.col("t") <= F.col("at") + longest)).groupBy(by).agg(F.max("t").alias("last"))
    return chosen.join(held, by, "left").select(by, F.col("at").alias("first"), F.coalesce("last", "at").alias("last"))


def capped_range(rows: DataFrame, by: str = "station_id", longest: int = LONGEST) -> DataFrame:
    """(by, first, last) of a series, cut to ``longest``."""
    ends = rows.groupBy(by).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return ends.select(by, "first", F.least(F.col("last"), F.col("first") + longest).alias("last"))


def source_rows(observed: DataFrame, forecast: DataFrame, by: list[str], prefer_observed: bool) -> DataFrame:
    """Readings of both by instant: the observed one stays where it is preferred, else the forecast's does. ``mode`` tells which."""
    both = observed.withColumn("mode", F.lit("observed")).unionByName(forecast.where("t IS NOT NULL").withColumn("mode", F.lit("forecast")))
    first = F.when(F.col("mode") == ("observed" if prefer_observed else "forecast"), 0).otherwise(1)
    return precedence(both, [*by, "t"], [first, F.col("seq")])


def quarter_frames(observed: DataFrame, forecast: DataFrame, start: int, end: int, prefer_observed: bool) -> DataFrame:
    """(station_id, slot, stage, mode) of a range's quarter hours: the observed grid decides which exist where it is preferred,
    the forecast's, interpolated over up to 75 minutes, fills others, so it never bridges a gauge's outage by readings."""
    grid = quarter_hours(observed, 30 * MINUTE)
    lo, hi = -(-start // QUARTER), end // QUARTER
    ends = forecast.select("station_id").distinct().select("station_id", F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    later = quarter_hours(forecast, 75 * MINUTE, ends=ends)
    inside = lambda df, mode: df.where(F.col("stage").isNotNull() & F.col("slot").between(start, end)).select("station_id", "slot", "stage", F.lit(mode).alias("mode"))
    both = inside(grid, "observed").unionByName(inside(later, "forecast"))
    first = F.when(F.col("mode") == ("observed" if prefer_observed else "forecast"), 0).otherwise(1)
    return precedence(both, ["station_id", "slot"], [first])


def hourly_frames(rows: DataFrame, start: int, end: int, slots) -> DataFrame:
    """Hour slots of a range: readings inside its exact bounds, dealt by ``slots`` (each used once)."""
    return slots(rows.where(F.col("t").between(start, end)))


def daily_frames(rows: DataFrame, start: int, end: int) -> DataFrame:
    """The peak reading of each civil day of a range."""
    inside = rows.where(F.col("t").between(start, end))
    return daily_maximum(inside, F.date_format(civil_day(F.col("t")), "yyyy-MM-dd"))


def limited(frames: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` frames of each series (the cap is the feature)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return frames.withColumn("n_", n).where(F.col("n_") <= most).drop("n_")


def day_span(rows: DataFrame, by: str, chosen: DataFrame) -> DataFrame:
    """(by, first, last): the unbroken span of rows of one civil day around a chosen row (``at``, its instant)."""
    w = Window.partitionBy(by, "near").orderBy("t", "seq")
    near = rows.join(chosen, by).where(F.abs(F.col("t") - F.col("at")) <= 2 * DAY).withColumns({"near": F.lit(0), "day": civil_day(F.col("t"))})
    told = near.withColumn("island", F.sum(F.when(F.col("day") == F.lag("day").over(w), 0).otherwise(1)).over(w))
    own = told.where(F.col("t") == F.col("at")).groupBy(by).agg(F.min("island").alias("island"))
    return told.join(own, [by, "island"]).groupBy(by).agg(F.min("t").alias("first"), F.max("t").alias("last"))
