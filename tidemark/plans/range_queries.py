"""Export ranges over the driver's tables (section N of the survey, with E16, F20, H5, J1, J2), with their DuckDB SQL.

Stand-ins: a customer asks for a range of January 2024; a gauge is an event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranges as N
from ..operators import series as Q
from ..sources.tables import HOUR, MINUTE, forecast, readings, table
from .observed_queries import _LOCAL, ends_sql, grid_sql
from .series_queries import _DAYS, _F, _R

START, END = 1704412800000000 + 7 * 60_000_000, 1704412800000000 + 60 * HOUR  # a range of sixty hours in January 2024
FIRST, LAST = 1704067200000000, 1706659200000000  # bounds of the archive
_BASE = 1704067200000000


def asked(spark, sf):
    """(k, start, end, cadence): some without an end, some back to front, some too long, some out of bounds."""
    k = F.col("c_custkey")
    start = F.lit(_BASE) + (k * 37 % 760 - 10) * HOUR + k % 60 * MINUTE
    return table(spark, sf, "customer").select(k.alias("k"), start.alias("start"), F.when(k % 13 != 0, start + (k * 7 % 110 - 5) * HOUR + k % 30 * MINUTE).alias("end"), F.element_at(F.array(F.lit("hourly"), F.lit("15min"), F.lit("daily")), (k % 3 + 1).cast("int")).alias("cadence"))


_Q = f"q AS (SELECT c_custkey AS k, {_BASE} + (c_custkey * 37 % 760 - 10) * 3600000000 + c_custkey % 60 * 60000000 AS start, CASE WHEN c_custkey % 13 <> 0 THEN {_BASE} + (c_custkey * 37 % 760 - 10) * 3600000000 + c_custkey % 60 * 60000000 + (c_custkey * 7 % 110 - 5) * 3600000000 + c_custkey % 30 * 60000000 END AS stop, ['hourly', '15min', 'daily'][c_custkey % 3 + 1] AS cadence FROM customer)"


def _civil(t):
    return f"CAST(timezone('America/New_York', timezone('UTC', make_timestamp({t}))) AS DATE)"


def _slots(rows):
    return Q.hourly_slots(rows, bounds=(START, END))


def n2(spark, sf):
    return N.hourly_frames(readings(spark, sf), START, END, _slots)


_LO, _HI = -(-START // 3600000000), END // 3600000000
_N2 = f"""WITH RECURSIVE {_R}, v AS (SELECT * FROM r WHERE t BETWEEN {START} AND {END}), x AS (SELECT station_id, n * 3600000000 AS slot, abs(t - n * 3600000000) AS off, t, seq FROM (SELECT *, t // 3600000000 AS n FROM v UNION ALL SELECT *, t // 3600000000 + 1 FROM v) WHERE abs(t - n * 3600000000) <= 1860000000),
g(station_id, slot, pick) AS (SELECT DISTINCT station_id, CAST({_LO - 1} * 3600000000 AS BIGINT), CAST(NULL AS STRUCT(off BIGINT, t BIGINT, seq BIGINT)) FROM v
UNION ALL SELECT g.station_id, g.slot + 3600000000, min(CASE WHEN x.seq IS NOT NULL THEN {{'off': x.off, 't': x.t, 'seq': x.seq}} END) FROM g LEFT JOIN x ON x.station_id = g.station_id AND x.slot = g.slot + 3600000000 AND x.seq <> coalesce(g.pick.seq, -1) WHERE g.slot + 3600000000 <= {_HI} * 3600000000 GROUP BY g.station_id, g.slot),
h AS (SELECT station_id, slot, pick.seq AS seq, pick.t AS t FROM g WHERE pick IS NOT NULL)"""


def n3(spark, sf, prefer=True):
    return N.quarter_frames(readings(spark, sf).where("seq % 3 <> 0"), forecast(spark, sf), START, END, prefer).withColumn("stage", F.round("stage", 4))


def _n3(first):
    return f"""WITH {_R}, {_F}, rr AS (SELECT * FROM r WHERE seq % 3 <> 0), e AS ({ends_sql('rr')}), {grid_sql('rr', 'e', 1800000000)}, fe AS (SELECT DISTINCT station_id, {-(-START // 900000000)} AS lo, {END // 900000000} AS hi FROM f), {grid_sql('f', 'fe', 4500000000, 'p')},
u AS (SELECT station_id, slot, stage, 'observed' AS mode FROM o WHERE stage IS NOT NULL AND slot BETWEEN {START} AND {END} UNION ALL SELECT station_id, slot, stage, 'forecast' FROM p WHERE stage IS NOT NULL AND slot BETWEEN {START} AND {END})
SELECT station_id, slot, round(stage, 4) AS stage, mode FROM u QUALIFY row_number() OVER (PARTITION BY station_id, slot ORDER BY mode <> '{first}') = 1"""


def _hourly(df):
    return df.select("station_id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), "seq", F.round("stage", 6).alias("stage"))


_J1 = "WITH {0}, {1}, u AS (SELECT station_id, t // 3600000000 * 3600000000 AS t, seq, round(stage, 6) AS stage, 'observed' AS mode FROM r UNION ALL SELECT station_id, t // 3600000000 * 3600000000, seq, round(stage, 6), 'forecast' FROM f) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY mode <> '{2}', seq) = 1"


def n5(spark, sf):
    """Hourly frames of timed readings, and daily peaks (of every tenth user) that stay out of them."""
    r = readings(spark, sf)
    timed = N.hourly_frames(r.where("user_id % 10 <> 0"), START, END, _slots).select("station_id", "t", "seq", F.lit("hourly").alias("kind"))
    return timed.unionByName(N.daily_frames(r.where("user_id % 10 = 0"), START, END).select("station_id", "t", "seq", F.lit("daily").alias("kind")))


def chosen(spark, sf):
    return readings(spark, sf).groupBy("station_id").agg(F.min(F.when(F.col("seq") % 50 == 7, F.col("t"))).alias("at")).where("at IS NOT NULL")


_CH = "ch AS (SELECT station_id, min(t) AS ata FROM r WHERE seq % 50 = 7 GROUP BY 1)"

_ENTRIES = {
    "E16_day_span": (lambda s, p: N.day_span(readings(s, p), "station_id", chosen(s, p)), f"WITH {_R}, {_CH} SELECT r.station_id, min(t) AS first, max(t) AS last FROM r JOIN ch USING (station_id) WHERE {_civil('t')} = {_civil('ata')} GROUP BY 1"),
    "F20_frame_count": (lambda s, p: asked(s, p).where("end IS NOT NULL").select("k", N.frame_count(F.col("start"), F.col("end"), F.col("cadence")).alias("n")), f"WITH {_Q}, z AS (SELECT k, cadence, least(start, stop) AS lo, greatest(start, stop) AS hi FROM q WHERE stop IS NOT NULL) SELECT k, CASE cadence WHEN 'daily' THEN {_civil('hi')} - {_civil('lo')} + 1 WHEN 'hourly' THEN greatest(0, hi // 3600000000 - CAST(ceil(lo / 3600000000.0::DOUBLE) AS BIGINT) + 1) ELSE greatest(1, (hi - lo) // 900000000 + 1) END AS n FROM z"),
    "H5_row_cap": (lambda s, p: N.limited(readings(s, p).where(F.col("t") >= START), "station_id", "t", N.MOST_FRAMES["hourly"]).select("station_id", "seq"), f"WITH {_R} SELECT station_id, seq FROM r WHERE t >= {START} QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY t) <= 85"),
    "J1_forecast_first": (lambda s, p: N.source_rows(_hourly(readings(s, p)), _hourly(forecast(s, p)), ["station_id"], False), _J1.format(_R, _F, "forecast")),
    "J1_observed_first": (lambda s, p: N.source_rows(_hourly(readings(s, p)), _hourly(forecast(s, p)), ["station_id"], True), _J1.format(_R, _F, "observed")),
    "J2_quarter_union": (lambda s, p: n3(s, p, False), _n3("forecast")),
    "N1_range_fault": (lambda s, p: asked(s, p).select("k", N.range_fault(F.col("start"), F.col("end"), F.lit(FIRST), F.lit(LAST)).alias("reason")), f"WITH {_Q} SELECT k, CASE WHEN stop IS NULL THEN 'invalid-range' WHEN stop < start THEN 'invalid-order' WHEN stop - start > 302400000000 THEN 'range-too-long' WHEN start < {FIRST} OR stop > {LAST} THEN 'outside-data' ELSE 'ok' END AS reason FROM q"),
    "N2_hourly_frames": (n2, f"{_N2} SELECT * FROM h"),
    "N3_quarter_frames": (n3, _n3("observed")),
    "N5_frame_dispatch": (n5, f"{_N2.replace('FROM r WHERE', 'FROM r WHERE user_id % 10 <> 0 AND')} SELECT station_id, t, seq, 'hourly' AS kind FROM h UNION ALL (SELECT station_id, t, seq, 'daily' FROM r WHERE user_id % 10 = 0 AND t BETWEEN {START} AND {END} QUALIFY row_number() OVER (PARTITION BY station_id, {_civil('t')} ORDER BY stage DESC, t, seq) = 1)"),
    "N6_request": (lambda s, p: N.limited(n2(s, p), "station_id", "slot", 24), f"{_N2} SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY slot) <= 24"),
    "N7_needs_archive": (lambda s, p: asked(s, p).where("end IS NOT NULL").select("k", N.needs_archive(F.col("start"), F.col("end"), _BASE + 300 * HOUR, F.col("k") % 4 == 0, F.lit(_BASE + 100 * HOUR), F.lit(_BASE + 600 * HOUR)).alias("needed")), f"WITH {_Q} SELECT k, (k % 4 = 0 AND start <= {_BASE} + 300 * 3600000000) OR start < {_BASE} + 100 * 3600000000 OR stop > {_BASE} + 600 * 3600000000 AS needed FROM q WHERE stop IS NOT NULL"),
    "N8_archive_bounds": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).join(forecast(s, p).groupBy("station_id").agg(F.min("t").alias("c"), F.max("t").alias("d")), "station_id", "left").select("station_id", F.least("a", "c").alias("first"), F.greatest("b", "d").alias("last")), f"WITH {_R} SELECT station_id, min(t) AS first, max(t) + 7200000000 AS last FROM r GROUP BY 1"),
    "N9_selection_range": (lambda s, p: N.selection_range(readings(s, p), chosen(s, p)), f"WITH {_R}, {_CH} SELECT station_id, ata AS first, max(t) AS last FROM r JOIN ch USING (station_id) WHERE t BETWEEN ata AND ata + 302400000000 GROUP BY 1, 2"),
    "N10_forecast_range": (lambda s, p: N.capped_range(forecast(s, p)), f"WITH {_F} SELECT station_id, min(t) AS first, least(max(t), min(t) + 302400000000) AS last FROM f GROUP BY 1"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
