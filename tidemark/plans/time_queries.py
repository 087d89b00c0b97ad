"""Civil time operators over the driver's tables (section C of the survey), with their DuckDB SQL.

Stand-ins: texts are made from order dates and event instants; a query instant is a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import times as T
from ..sources.tables import HOUR, readings, table

NOW = 1705900000000000
_R = "r AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) AS t, value AS stage, user_id FROM events)"
_LOCAL = "timezone('America/New_York', timezone('UTC', make_timestamp({0})))"
_L = _LOCAL.format("t")


def _r(expr, name="out"):
    return lambda spark, sf: readings(spark, sf).select("seq", expr().alias(name))


def _sql(expr, name="out"):
    return f"WITH {_R} SELECT seq, {expr} AS {name} FROM r"


def _o(expr, name="out"):
    return lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", expr().alias(name))


def _osql(expr, name="out"):
    return f"SELECT o_orderkey, {expr} AS {name} FROM orders"


def _fmt(pattern):
    return F.date_format("o_orderdate", pattern)


def _pick(key, choices):
    out = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(choices))):
        out = F.when(F.col(key) % len(choices) == i, c).otherwise(out)
    return out


def _pick_sql(key, choices):
    return "CASE " + " ".join(f"WHEN {key} % {len(choices)} = {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def _iso(t, zone="'Z'"):
    return F.date_format(F.timestamp_micros(t), f"yyyy-MM-dd'T'HH:mm:ss{zone}")


def _typed():
    return _pick("o_orderkey", [_fmt("yyyy-M-d"), _fmt("M/d/yyyy"), _fmt("M/d/yy"), _fmt("M-d"), _fmt("MMMM d, yyyy"), F.concat(_fmt("MMM"), F.lit(". "), _fmt("d yyyy")), _fmt("d MMMM yyyy"), F.lit("2001-02-30"), F.lit("Sept 5, 1999"), F.lit("soon")])


_TYPED = _pick_sql("o_orderkey", ["o_orderdate::DATE", "o_orderdate::DATE", "make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate))", "make_date(2024, month(o_orderdate), day(o_orderdate))", "o_orderdate::DATE", "o_orderdate::DATE", "o_orderdate::DATE", "NULL::DATE", "DATE '1999-09-05'", "NULL::DATE"])


def _exported():
    return _pick("o_orderkey", [_fmt("yyyy/M/d"), _fmt("M-d-yyyy"), _fmt("M/d/yy"), _fmt("MMddyyyy"), F.lit("MM/DD/YYYY"), F.lit("02/30/2001"), F.lit("1/1/2300"), F.concat(_fmt("MM"), F.lit("."), _fmt("dd"), F.lit("."), _fmt("yyyy"))])


_EXPORTED = _pick_sql("o_orderkey", ["o_orderdate::DATE", "o_orderdate::DATE", "make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate))", "o_orderdate::DATE", "NULL::DATE", "NULL::DATE", "NULL::DATE", "o_orderdate::DATE"])


def _civil_text():
    return F.concat(_fmt("yyyy-MM-dd"), F.lit("T0"), (F.col("o_orderkey") % 4).cast("string"), F.lit(":30"))


_CIVIL = "CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 0' || (o_orderkey % 4) || ':30:00' AS TIMESTAMP)"
_EARLIEST = f"(SELECT min(x) FROM (SELECT epoch_us({_CIVIL} + to_hours(h)) AS x, {_CIVIL} AS l FROM (VALUES (4), (5)) v(h)) WHERE {_LOCAL.format('x')} = l)"


def _cycle_text():
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    day = _fmt("yyyy-MM-dd")
    return _pick("o_orderkey", [F.concat(day, F.lit("T"), hour, F.lit(":00:00Z")), F.concat(day, F.lit("T"), hour, F.lit(":00+02:00")), F.concat(day, F.lit("T"), hour, F.lit(":30Z")), F.concat(day, F.lit("T"), hour, F.lit(":00")), F.lit("2001-02-30T00:00Z"), F.concat(day, F.lit("T"), hour, F.lit(":30-00:30"))])


_STAMP = "(o_orderdate::TIMESTAMP + to_hours(o_orderkey % 24))"
_CYCLE = _pick_sql("o_orderkey", [f"strftime({_STAMP}, '%Y%m%dT%H00Z')", f"strftime({_STAMP} - INTERVAL 2 HOUR, '%Y%m%dT%H00Z')", "''", "''", "''", f"strftime({_STAMP} + INTERVAL 1 HOUR, '%Y%m%dT%H00Z')"])


def c5(spark, sf):
    """Fields of a row: an instant, a shown instant, a civil text or a date alone, by turns."""
    r = readings(spark, sf).withColumn("iso", _iso(F.col("t")))
    local = F.date_format(S.civil(F.col("t")), "yyyy-MM-dd'T'HH:mm")
    k = F.col("seq") % 4
    fields = [F.when(k == 0, F.col("iso")), F.when(k == 1, F.col("iso"))], [F.when(k == 2, local), F.lit(None).cast("string")]
    return r.select("seq", T.entry_instant(*fields, F.date_format(S.civil(F.col("t")), "yyyy-MM-dd"), k == 3).alias("out"))


_SECOND, _MINUTE = "t // 1000000 * 1000000", "t // 60000000 * 60000000"

_ENTRIES = {
    "C4_earliest_instant": (_o(lambda: T.local_instant(_civil_text())), _osql(_EARLIEST)),
    "C5_entry_instant": (c5, f"WITH {_R} SELECT seq, CASE WHEN seq % 4 < 2 THEN {_SECOND} WHEN seq % 4 = 2 THEN {_MINUTE} ELSE epoch_us(date_trunc('day', {_L}) + INTERVAL 5 HOUR) END AS out FROM r"),
    "C6_entry_millis": (_r(lambda: F.unix_millis(F.timestamp_micros("t"))), _sql("t // 1000")),
    "C7_day_arithmetic": (_o(lambda: T.day_shift(_fmt("yyyy-MM-dd"), -3)), _osql("strftime(CAST(o_orderdate AS DATE) - 3, '%Y-%m-%d')")),
    "C8_key_order": (_o(lambda: T.key_order(F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(_fmt("yyyy-MM-dd")), F.lit("1998-07-01"))), _osql("CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderdate::DATE < DATE '1998-07-01' THEN -1 WHEN o_orderdate::DATE > DATE '1998-07-01' THEN 1 ELSE 0 END")),
    "C9_today": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.max("t").alias("now")).select("station_id", F.date_format(S.civil_day(F.col("now")), "yyyy-MM-dd").alias("today")), f"WITH {_R}, m AS (SELECT station_id, max(t) AS t FROM r GROUP BY 1) SELECT station_id, strftime({_L}, '%Y-%m-%d') AS today FROM m"),
    "C10_month_key": (_o(lambda: T.month_key(F.col("o_orderdate"))), _osql("strftime(o_orderdate, '%Y-%m')")),
    "C12_typed_date": (_o(lambda: F.date_format(S.typed_date(_typed()), "yyyy-MM-dd")), _osql(f"strftime({_TYPED}, '%Y-%m-%d')")),
    "C13_export_date": (_o(lambda: F.date_format(S.export_date(_exported()), "yyyy-MM-dd")), _osql(f"strftime({_EXPORTED}, '%Y-%m-%d')")),
    "C14_cycle_id": (_o(lambda: T.cycle_id(_cycle_text())), _osql(_CYCLE)),
    "C15_run_cycle": (_o(lambda: T.run_cycle(F.concat(F.lit("prod/petss."), _fmt("yyyyMMdd")), F.when(F.col("o_orderkey") % 7 != 0, F.format_string("t%02dz", F.col("o_orderkey") % 4 * 6)).otherwise("later"))), _osql("CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate::TIMESTAMP + to_hours(o_orderkey % 4 * 6)) END")),
    "C16_clock_minutes": (_r(lambda: T.clock_minutes(F.col("t"))), _sql(f"hour({_L}) * 60 + minute({_L})")),
    "C17_hour_index": (_r(lambda: T.hour_index(F.when(F.col("seq") % 3 == 0, F.concat(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0"), F.lit(":00"))), F.when(F.col("seq") % 3 < 2, F.col("t")), F.col("user_id").cast("int"))), _sql(f"CASE WHEN seq % 3 = 0 AND user_id % 30 < 24 THEN user_id % 30 WHEN seq % 3 < 2 THEN hour({_L}) WHEN user_id BETWEEN 0 AND 23 THEN user_id END")),
    "C18_storm_day": (_r(lambda: T.storm_day((F.col("user_id") - 75).cast("double"))), _sql("greatest(0, CAST(floor((user_id - 75 + 42) / 24.0) AS BIGINT))")),
    "C19_same_civil_day": (_r(lambda: T.same_civil_day(F.col("t"), F.col("t") + 6 * HOUR)), _sql(f"date_trunc('day', {_L}) = date_trunc('day', {_LOCAL.format('(t + 21600000000)')})")),
    "C20_civil_label": (_r(lambda: T.civil_label(F.col("t"), True)), _sql(f"strftime({_L}, '%B %-d, %Y, %-I:%M %p') || ' EST'")),
    "C21_standard_instant": (_o(lambda: T.standard_instant(_fmt("yyyy-MM-dd"), F.format_string("%02d:15", F.col("o_orderkey") % 24))), _osql("epoch_us(o_orderdate::TIMESTAMP + to_hours(o_orderkey % 24) + INTERVAL 15 MINUTE + INTERVAL 5 HOUR)")),
    "C22_storm_offset": (_r(lambda: T.storm_offset_text(F.when(F.col("user_id") % 11 != 0, (F.col("user_id") - 75) / 4))), _sql("CASE WHEN user_id % 11 = 0 THEN 'Synthetic storm' WHEN user_id = 75 THEN 'Storm peak' ELSE regexp_replace(printf('%.2f', abs((user_id - 75) / 4.0::DOUBLE)), '\\.?0+$', '') || ' hr ' || CASE WHEN user_id < 75 THEN 'before' ELSE 'after' END || ' peak' END")),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items()}
