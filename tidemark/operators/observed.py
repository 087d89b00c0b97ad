"""Observed days: what readings a day has, from archive, live feed, crests and indexes, and in which order these count.

A day's source letter is U (primary gauge), N (surrogate) or C (calibrated crest). Readings are joined by instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Thresholds, civil_day, severity
from ..sources.tables import DAY, HOUR, MINUTE
from .series import QUARTER, precedence, quarter_hours


def decoded_index(rows: DataFrame, th: Thresholds, primary_start: str) -> DataFrame:
    """(day, peak, letter, classification, canonical, surrogate) of positional rows (day, hundredths, letter); other keys than
    dates are left out. Crest days before the primary archive stand on the surrogate's tide."""
    peak = F.col("hundredths") / 100
    surrogate = (F.col("letter") == "N") | ((F.col("letter") == "C") & (F.col("day") < primary_start))
    return rows.where(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("day", peak.alias("peak"), "letter", severity(peak, th).alias("classification"), F.lit(True).alias("canonical"), surrogate.alias("surrogate"))


def merged_index(current: DataFrame, incoming: DataFrame, th: Thresholds, primary: bool, surrogate: bool = False) -> DataFrame:
    """``current`` (as decoded_index) with an archive's index (day, peak, classification).

    The primary gauge's index sets the peak of days it knows, as U, but for crest days; canonical days are left alone by any
    other index; other days take the higher peak. Days that are new come in as they are."""
    both = current.join(incoming.select("day", F.col("peak").alias("new"), F.col("classification").alias("new_class"), F.lit(True).alias("met")), "day", "full")
    known, told = F.col("canonical").isNotNull(), F.col("met") & F.col("new").isNotNull()
    takes = known & told & F.lit(primary)
    sets = takes & ~F.coalesce(F.col("letter") == "C", F.lit(False))
    open_ = known & F.coalesce(F.col("met"), F.lit(False)) & ~takes & ~F.col("canonical")
    higher = F.when(F.col("new").isNull(), F.col("peak")).otherwise(F.greatest("peak", "new"))
    return both.select(
        "day",
        F.when(~known, F.col("new")).when(sets, F.col("new")).when(open_, higher).otherwise(F.col("peak")).alias("peak"),
        F.when(sets, "U").otherwise(F.col("letter")).alias("letter"),
        F.when(~known, F.coalesce("new_class", F.lit("none"))).when(sets, severity(F.col("new"), th)).when(open_, F.coalesce("new_class", "classification", F.lit("none"))).otherwise(F.col("classification")).alias("classification"),
        F.coalesce("canonical", F.lit(False)).alias("canonical"),
        F.when(~known, F.lit(surrogate)).when(takes, F.lit(False)).when(open_ & F.lit(surrogate), F.lit(True)).otherwise(F.col("surrogate")).alias("surrogate"),
    )


def with_crests(days: DataFrame, crests: DataFrame, th: Thresholds) -> DataFrame:
    """Days whose peak is the official crest where there is one; crest days that the archive lacks come in as crest-only."""
    both = days.join(crests.select("day", "crest"), "day", "full")
    peak = F.coalesce("crest", "peak")
    return both.select("day", peak.alias("peak"), F.when(F.col("crest").isNotNull(), severity(peak, th)).otherwise(F.col("classification")).alias("classification"), F.col("letter"), F.col("crest").isNotNull().alias("has_crest"), F.col("canonical").isNull().alias("crest_only"))


def live_over_archive(archive: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """Readings by instant, the live ones first; ``is_live`` tells which."""
    both = archive.withColumn("is_live", F.lit(False)).unionByName(live.withColumn("is_live", F.lit(True)))
    return precedence(both, [*by, "t"], [F.desc("is_live"), F.col("seq")])


def upserted_days(days: DataFrame, live: DataFrame, th: Thresholds, by: list[str]) -> DataFrame:
    """``days`` (by, day, peak) with live readings (by, day, stage): the peak never falls below the published one or any reading."""
    fresh = live.where(F.col("stage").isNotNull()).groupBy(*by, "day").agg(F.max("stage").alias("live"), F.count(F.lit(1)).alias("n_live"))
    peak = F.greatest("peak", "live")
    return days.join(fresh, [*by, "day"], "full").select(*by, "day", peak.alias("peak"), severity(peak, th).alias("classification"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def record_scores(hours: DataFrame, record: list[str]) -> DataFrame:
    """A record's worth: a thousand for each finite stage, one for each hour."""
    return hours.groupBy(*record).agg((F.count("stage") * 1000 + F.count(F.lit(1))).alias("score"))


def merged_records(hours: DataFrame, day: list[str], record: str, hour: str = "hour") -> DataFrame:
    """One row for each hour of a day of several records: records count from the poorest up, and the first finite stage stays."""
    scored = hours.join(record_scores(hours, [*day, record]), [*day, record])
    return precedence(scored, [*day, hour], [F.when(F.col("stage").isNull(), 1).otherwise(0), F.col("score"), F.col(record), F.col("t"), F.col("seq")])


def best_records(hours: DataFrame, day: list[str], record: str) -> DataFrame:
    """The record that names a day: the richest, the last on ties."""
    return precedence(record_scores(hours, [*day, record]), day, [F.desc("score"), F.desc(record)])


def day_series(rows: DataFrame, start: DataFrame, context: int = 8 * HOUR) -> tuple[DataFrame, DataFrame]:
    """Readings of (station_id, day) with those of ``context`` before, as series of their own, and the slots that each spans.

    ``rows`` has day (a text), ``start`` has day, lo and hi: its first instant and that of its last slot."""
    name = F.concat_ws("|", "station_id", "day")
    own = rows.join(start, "day")
    early = rows.withColumn("next", F.date_format(civil_day(F.col("t") + context), "yyyy-MM-dd")).where("next <> day")
    before = early.drop("day").withColumnRenamed("next", "day").join(start, "day").where(F.col("t") >= F.col("lo") - context)
    days = rows.select("station_id", "day").distinct()
    before = before.join(days, ["station_id", "day"], "left_semi")
    every = own.select("station_id", "day", "seq", "t", "stage", "lo", "hi", F.lit(0).alias("early")).unionByName(before.select("station_id", "day", "seq", "t", "stage", "lo", "hi", F.lit(1).alias("early")))
    every = every.withColumn("series", name)
    ends = every.groupBy("series").agg((F.ceil((F.first("lo") - F.max("early") * context) / QUARTER)).alias("lo"), (F.floor(F.first("hi") / QUARTER)).alias("hi"))
    return every.select(F.col("series").alias("station_id"), "seq", "t", "stage"), ends.withColumnRenamed("series", "station_id")


def canonical_days(rows: DataFrame, start: DataFrame, max_gap: int = 30 * MINUTE) -> DataFrame:
    """(station_id, day, slot, stage, kind) on every quarter hour of each day with readings, eight hours before it included where
    the gauge has readings there."""
    series, ends = day_series(rows, start)
    grid = quarter_hours(series, max_gap, ends=ends)
    return grid.select(F.split_part("station_id", F.lit("|"), F.lit(1)).alias("station_id"), F.split_part("station_id", F.lit("|"), F.lit(2)).alias("day"), "slot", "stage", "kind")


def observed_maxima(readings: DataFrame, days: DataFrame, phased: DataFrame, by: list[str]) -> DataFrame:
    """A day's maximum at its own instant with the phase of that reading; days without readings have their published peak, of
    unknown time. ``readings`` and ``phased`` have seq, ``days`` has by, day and peak."""
    top = readings.where(F.col("stage").isNotNull()).groupBy(*by, "day").agg(F.min(F.struct((-F.col("stage")).alias("neg"), "t", "seq")).alias("m")).select(*by, "day", (-F.col("m.neg")).alias("stage"), F.col("m.t").alias("t"), F.col("m.seq").alias("seq"))
    known = top.join(phased.select("seq", "phase"), "seq", "left")
    alone = days.where(F.col("peak").isNotNull()).join(top, [*by, "day"], "left_anti").select(*by, "day", F.col("peak").alias("stage"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("phase"))
    return known.select(*alone.columns).unionByName(alone)


def with_crest_reading(rows: DataFrame, crests: DataFrame, by: str = "station_id") -> DataFrame:
    """Readings with the official crest put in at its instant's nearest row (at the peak where its time isn't known), unless
    that row is as high already. ``crests`` has by, crest and crest_t."""
    both = rows.join(crests.select(by, "crest", "crest_t"), by, "left")
    off = F.when(F.col("crest_t").isNotNull(), F.abs(F.col("t") - F.col("crest_t")).cast("double")).otherwise(-F.col("stage"))
    target = both.where(F.col("crest").isNotNull()).groupBy(by).agg(F.min(F.struct(off.alias("off"), "t", "seq")).alias("m")).select(by, F.col("m.seq").alias("target"))
    put = (F.col("seq") == F.col("target")) & ~F.coalesce(F.col("stage") >= F.col("crest"), F.lit(False))
    put = F.coalesce(put, F.lit(False))
    return both.join(target, by, "left").withColumn("is_crest", put).withColumn("stage", F.when(put, F.col("crest")).otherwise(F.col("stage"))).drop("crest", "crest_t", "target")


def milestones(rows: DataFrame, minor: float, by: str = "station_id") -> DataFrame:
    """(seq, phase, milestone): for each draining row of a crest at or above ``minor`` the highest row of each phase but filling
    between its crest and itself. ``rows`` are annotated: seq, t, stage, phase, crest_t, crest_stage.

    Rows of one fall have one crest, so they meet by (gauge, crest), not by a range of time."""
    falls = rows.where(F.col("phase").startswith("draining") & (F.col("crest_stage") >= minor))
    crests = falls.select(by, "crest_t", F.col("t").alias("until"), F.col("seq").alias("of"))
    spans = crests.groupBy(by, "crest_t").agg(F.max("until").alias("last"))
    blocks = F.explode(F.sequence(F.floor(F.col("crest_t") / (8 * HOUR)), F.floor(F.col("last") / (8 * HOUR))))
    past = rows.where((F.col("phase") != "filling") & F.col("stage").isNotNull()).withColumn("b", F.floor(F.col("t") / (8 * HOUR))).drop("crest_t", "crest_stage")
    inside = spans.withColumn("b", blocks).join(past, [by, "b"]).where((F.col("t") >= F.col("crest_t")) & (F.col("t") < F.col("last")))
    pairs = crests.join(inside.select(by, "crest_t", "t", "seq", "stage", "phase"), [by, "crest_t"]).where(F.col("t") < F.col("until"))
    best = pairs.groupBy("of", "phase").agg(F.min(F.struct((-F.col("stage")).alias("neg"), "t", "seq")).alias("m"))
    return best.select(F.col("of").alias("seq"), "phase", F.col("m.seq").alias("milestone"))


def same_clock(rows: DataFrame, by: list[str], minute: Column, wanted: Column) -> DataFrame:
    """For each group (a day) the row whose clock is nearest to ``wanted`` minutes, the first on ties."""
    return rows.groupBy(*by).agg(F.min(F.struct(F.abs(minute - wanted).alias("off"), "t", "seq")).alias("m")).select(*by, F.col("m.seq").alias("seq"))


def spine(days: DataFrame, by: list[str]) -> DataFrame:
    """(by, day) of every date from a series' first to its last."""
    return days.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(*by, F.explode(F.sequence("lo", "hi")).alias("day"))


def rebased(stage: Column, t: Column, trend_per_year: float, base_t: int) -> Column:
    """A level moved to the year of ``base_t`` by a yearly trend."""
    return stage + trend_per_year * (base_t - t) / (365.2425 * DAY)


def latest_day(days: DataFrame, by: list[str]) -> DataFrame:
    """The last day with a peak or a reading, else the last day."""
    told = F.max(F.when(F.col("peak").isNotNull() | (F.col("n") > 0), F.col("day")))
    return days.groupBy(*by).agg(F.coalesce(told, F.max("day")).alias("latest"))


def number_rows(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
