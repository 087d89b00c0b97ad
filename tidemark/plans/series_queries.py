"""Series, aggregates, joins and unions over the driver's tables (sections D to K, N, O, P), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import projection as P
from ..operators import series as Q
from ..streaming.upserts import LastReadings
from ..sources.tables import DAY, HOUR, MINUTE, checkpoints, daily_peaks, forecast, readings, scratch, table

TH = S.Thresholds()
_R = "r AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) AS t, value AS stage, user_id FROM events)"
_F = "f AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) + 7200000000 AS t, value * 0.9::DOUBLE AS stage, user_id FROM events)"
_D = "d AS (SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day, o_totalprice AS peak, o_custkey % 3 AS source FROM orders)"
_DAYS = "strftime(timezone('America/New_York', timezone('UTC', make_timestamp(t))), '%Y-%m-%d')"
_SEV = "CASE WHEN stage < 50 THEN 'none' WHEN stage < 113 THEN 'minor' WHEN stage < 224 THEN 'moderate' ELSE 'major' END"
_GRID = f"""WITH {_R}, e AS (SELECT station_id, CAST(ceil(min(t) / 900000000.0) AS BIGINT) AS lo, CAST(floor(max(t) / 900000000.0) AS BIGINT) AS hi FROM r GROUP BY 1),
g AS (SELECT station_id, unnest(generate_series(lo, hi)) * 900000000 AS slot FROM e),
x AS (SELECT station_id, n * 900000000 AS slot, stage FROM (SELECT *, CAST(floor(t / 900000000.0 + 0.5) AS BIGINT) AS n FROM r) QUALIFY row_number() OVER (PARTITION BY station_id, n ORDER BY abs(t - n * 900000000), t, seq) = 1),
b AS (SELECT g.station_id, g.slot, r.t AS bt, r.stage AS bs FROM g ASOF LEFT JOIN r ON g.station_id = r.station_id AND g.slot >= r.t),
a AS (SELECT b.*, r.t AS nt, r.stage AS ns FROM b ASOF LEFT JOIN r ON b.station_id = r.station_id AND b.slot <= r.t),
o AS (SELECT a.station_id, a.slot, CASE WHEN x.stage IS NOT NULL THEN x.stage WHEN nt - bt <= 4500000000 THEN round(bs + (ns - bs) * ((a.slot - bt) / (nt - bt)::DOUBLE), 4) END AS stage,
CASE WHEN x.stage IS NOT NULL THEN 'exact' WHEN nt - bt <= 4500000000 THEN 'interpolated' ELSE 'missing' END AS kind FROM a LEFT JOIN x USING (station_id, slot))"""


def _day(t="t"):
    return F.date_format(S.civil_day(F.col(t)), "yyyy-MM-dd")


def f1(spark, sf):
    top = Q.daily_maximum(readings(spark, sf), _day())
    return top.select("station_id", "day", "stage", "t", "seq", S.severity(F.col("stage"), TH).alias("severity"))


def _top_days(spark, sf):
    return daily_peaks(spark, sf)


def _grid(spark, sf):
    return Q.quarter_hours(readings(spark, sf)).select("station_id", "slot", "stage", "kind")


def h3(spark, sf):
    d = daily_peaks(spark, sf).where(~F.col("day").isin("1995-03-15", "1996-08-23"))
    one = Q.precedence(d, ["day"], [F.desc("source"), F.desc("peak"), F.col("seq")])
    top = one.orderBy(F.desc("peak"), "day").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), "day"))).select("rank", F.date_format("day", "yyyy-MM-dd").alias("day"), "peak", "source")


def j1(spark, sf):
    both = readings(spark, sf).withColumn("prio", F.lit(0)).unionByName(forecast(spark, sf).withColumn("prio", F.lit(1)))
    minute = F.floor(F.col("t") / (60 * MINUTE)) * (60 * MINUTE)
    return Q.precedence(both.withColumn("t", minute), ["station_id", "t"], [F.col("prio"), F.col("seq")]).select("station_id", "t", "prio", F.round("stage", 6).alias("stage"))


def j8(spark, sf):
    d = daily_peaks(spark, sf)
    index = d.where("source <> 2").groupBy("day").agg(F.max("peak").alias("peak"))
    crest = d.where("source = 2").groupBy("day").agg(F.max("peak").alias("crest"))
    return index.join(crest, "day", "full").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("crest", "peak").alias("peak"), F.col("crest").isNotNull().alias("is_crest"))


def f10(spark, sf):
    side = lambda df, name: df.groupBy(_day().alias("day")).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("t").alias(f"lo_{name}"), F.max("t").alias(f"hi_{name}"))
    both = side(readings(spark, sf), "observed").join(side(forecast(spark, sf), "forecast"), "day", "full")
    return both.select("day", F.col("n_observed").isNotNull().alias("observed"), F.col("n_forecast").isNotNull().alias("forecast"), (F.coalesce("n_observed", F.lit(0)) + F.coalesce("n_forecast", F.lit(0))).alias("n"), F.least("lo_observed", "lo_forecast").alias("lo"), F.greatest("hi_observed", "hi_forecast").alias("hi"))


_F10 = f"WITH {_R}, {_F}, o AS (SELECT {_DAYS} AS day, count(*) AS n, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1), p AS (SELECT {_DAYS} AS day, count(*) AS n, min(t) AS lo, max(t) AS hi FROM f GROUP BY 1), z AS (SELECT coalesce(o.day, p.day) AS day, o.n IS NOT NULL AS observed, p.n IS NOT NULL AS forecast, coalesce(o.n, 0) + coalesce(p.n, 0) AS n, least(o.lo, p.lo) AS lo, greatest(o.hi, p.hi) AS hi FROM o FULL JOIN p ON o.day = p.day)"


def p4(spark, sf):
    """Days of the archive that break its rules: more than one record of a source, or a gap before them."""
    d = daily_peaks(spark, sf).groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    span = d.groupBy("source").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = span.select("source", F.explode(F.sequence("lo", "hi")).alias("day"))
    missing = spine.join(d, ["source", "day"], "left_anti").select("source", "day", F.lit("missing").alias("fault"))
    return d.where("n > 1").select("source", "day", F.lit("repeated").alias("fault")).unionByName(missing).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def o2(spark, sf):
    """Late and corrected readings in three files of a stream: the last for a gauge and hour wins."""
    path = scratch(spark, "stream")
    r = readings(spark, sf).withColumn("hour", F.floor(F.col("t") / HOUR)).withColumn("part", F.col("seq") % 3)
    for part in range(3):
        r.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(r.drop("part").schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    held = LastReadings(spark, path, ["station_id", "hour"], ["t", "seq"], F.floor(F.col("hour") / 24))
    return held.take(stream).select("station_id", "hour", "seq", "t", "stage")


def h1(spark, sf):
    checkpoints(spark)
    r = readings(spark, sf).select("seq", "t", F.col("stage").alias("peak"))
    return Q.declustered(r, 20, 12 * HOUR)


def e3(spark, sf):
    """Outages of each gauge and UTC day: a gap that ends the latest day is not one yet."""
    g = _grid(spark, sf).withColumn("day", F.floor(F.col("slot") / DAY)).withColumn("series", F.concat_ws("|", "station_id", "day"))
    latest = g.groupBy("station_id").agg(F.max("day").alias("latest"))
    of = g.select("series", "station_id", "day").distinct().join(latest, "station_id")
    every, open_ = Q.outages(g, by="series"), Q.outages(g, by="series", trailing=False).withColumnRenamed("hours", "before_end")
    return of.join(every, "series").join(open_, "series").select("station_id", "day", F.when(F.col("day") == F.col("latest"), F.col("before_end")).otherwise(F.col("hours")).alias("hours"))


_E3 = f"""{_GRID}, m AS (SELECT station_id, slot // 86400000000 AS day, slot, stage, sum(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) OVER w AS island, max(slot) OVER (PARTITION BY station_id, slot // 86400000000) AS e, max(slot // 86400000000) OVER (PARTITION BY station_id) AS latest FROM o WINDOW w AS (PARTITION BY station_id, slot // 86400000000 ORDER BY slot)),
l AS (SELECT station_id, day, island, count(*) * 0.25 AS h, max(slot) = max(e) AND day = max(latest) AS skipped FROM m WHERE stage IS NULL GROUP BY station_id, day, island)
SELECT d.station_id, d.day, CAST(coalesce(max(h), 0) AS DOUBLE) AS hours FROM (SELECT DISTINCT station_id, day FROM m) d LEFT JOIN l ON d.station_id = l.station_id AND d.day = l.day AND NOT skipped GROUP BY 1, 2"""
_E7 = f"""WITH {_R}, h AS (SELECT a.seq, list({{'s': b.stage, 't': b.t, 'stop': false}} ORDER BY b.t DESC, b.seq DESC) AS back FROM r a JOIN r b ON a.station_id = b.station_id AND b.t BETWEEN a.t - 28800000000 AND a.t AND (b.t < a.t OR b.seq <= a.seq) GROUP BY 1),
c AS (SELECT seq, list_reduce(back, lambda a, x: CASE WHEN a.stop THEN a WHEN x.s > a.s + 1e-9::DOUBLE THEN x WHEN x.s < a.s - 0.4::DOUBLE THEN {{'s': a.s, 't': a.t, 'stop': true}} ELSE a END) AS c FROM h),
d AS (SELECT *, stage - lag(stage) OVER w AS b, lead(stage) OVER w - stage AS n FROM r WINDOW w AS (PARTITION BY station_id ORDER BY t, seq)),
e AS (SELECT d.seq, d.t, b, n, c.s AS crest_stage, c.t AS crest_t, (d.t - c.t) / 60000000.0::DOUBLE AS m, CASE WHEN n IS NOT NULL AND (b IS NULL OR abs(n) >= abs(b)) THEN n ELSE b END AS move FROM d JOIN c USING (seq)),
z AS (SELECT *, CASE WHEN b > 0.025 AND n <= 0.025 THEN 'slack' WHEN b >= 0 AND n < -0.025 THEN 'slack' WHEN b < -0.025 AND n >= -0.025 THEN 'draining' WHEN b <= 0.025 AND n > 0.025 THEN CASE WHEN b < 0 THEN 'draining' ELSE 'slack' END
WHEN b < -0.025 OR (n < -0.025 AND b < 0) THEN CASE WHEN crest_stage < 50 OR crest_stage >= 224 THEN 'draining' WHEN crest_stage >= 113 THEN CASE WHEN m <= 15 THEN 'draining-release-15' ELSE 'draining' END WHEN m <= 15 THEN 'draining-release-15' WHEN m <= 30 THEN 'draining-release-30' ELSE 'draining' END
WHEN move > 0.025 THEN 'filling' WHEN move < -0.025 THEN 'draining' ELSE 'slack' END AS phase FROM e)"""
_H1 = f"""WITH RECURSIVE {_R}, g(i, ts, pick) AS (SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(neg DOUBLE, t BIGINT, seq BIGINT))
UNION ALL SELECT i + 1, list_append(ts, n.t), n FROM (SELECT i, ts, (SELECT min({{'neg': -stage, 't': t, 'seq': seq}}) FROM r WHERE len(list_filter(ts, lambda x: abs(x - r.t) < 43200000000)) = 0) AS n FROM g WHERE i < 20) WHERE n IS NOT NULL)
SELECT pick.seq AS seq, pick.t AS t, -pick.neg AS peak FROM g WHERE i > 0"""
_I3 = f"""WITH RECURSIVE {_R}, x AS (SELECT station_id, n * 3600000000 AS slot, abs(t - n * 3600000000) AS off, t, seq FROM (SELECT *, t // 3600000000 AS n FROM r UNION ALL SELECT *, t // 3600000000 + 1 FROM r) WHERE abs(t - n * 3600000000) <= 1860000000),
e AS (SELECT station_id, CAST(ceil(min(t) / 3600000000.0::DOUBLE) AS BIGINT) * 3600000000 AS lo, max(t) AS hi FROM r GROUP BY 1),
g(station_id, slot, hi, pick) AS (SELECT station_id, lo - 3600000000, hi, CAST(NULL AS STRUCT(off BIGINT, t BIGINT, seq BIGINT)) FROM e
UNION ALL SELECT g.station_id, g.slot + 3600000000, any_value(g.hi), min(CASE WHEN x.seq IS NOT NULL THEN {{'off': x.off, 't': x.t, 'seq': x.seq}} END) FROM g LEFT JOIN x ON x.station_id = g.station_id AND x.slot = g.slot + 3600000000 AND x.seq <> coalesce(g.pick.seq, -1) WHERE g.slot + 3600000000 <= g.hi GROUP BY g.station_id, g.slot)
SELECT station_id, slot, pick.seq AS seq, pick.t AS t FROM g WHERE pick IS NOT NULL"""

_ENTRIES = {
    "F1_daily_maximum": (f1, f"WITH {_R} SELECT station_id, day, stage, t, seq, {_SEV} AS severity FROM (SELECT *, {_DAYS} AS day FROM r) QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY stage DESC, t, seq) = 1"),
    "D1_quarter_hours": (_grid, f"{_GRID} SELECT * FROM o"),
    "D7_hourly_cadence": (lambda s, p: _grid(s, p).where(F.col("slot") % HOUR == 0).select("station_id", "slot", "stage"), f"{_GRID} SELECT station_id, slot, stage FROM o WHERE slot % 3600000000 = 0"),
    "D9_resolution": (
        lambda s, p: Q.resolution(readings(s, p).withColumn("day", F.floor(F.col("t") / DAY)), ["station_id", "day"]).select("station_id", "day", F.round("minutes", 6).alias("minutes")),
        f"WITH {_R}, g AS (SELECT station_id, t // 86400000000 AS day, t - lag(t) OVER (PARTITION BY station_id, t // 86400000000 ORDER BY t) AS gap FROM r), k AS (SELECT station_id, day, list_sort(list(gap)) AS g FROM g WHERE gap > 0 GROUP BY 1, 2) SELECT station_id, day, round(g[len(g) // 2 + 1] / 60000000.0::DOUBLE, 6) AS minutes FROM k",
    ),
    "D11_synthetic_storm": (
        lambda s, p: Q.synthetic_storm(table(s, p, "part"), "p_partkey", "p_size"),
        "SELECT p_partkey, CAST(q AS INT) AS q, q / 4.0::DOUBLE AS offset_hours, round(p_size - 6 * (1 - cos(3.141592653589793::DOUBLE * q / 4.0::DOUBLE / 12)) / 2, 6) AS stage FROM (SELECT p_partkey, p_size, unnest(generate_series(-48, 48)) AS q FROM part)",
    ),
    "E1_outages": (lambda s, p: Q.outages(_grid(s, p)), f"{_GRID}, m AS (SELECT station_id, slot, stage, sum(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY slot) AS island, 0 AS day, max(slot) OVER (PARTITION BY station_id) AS e FROM o), l AS (SELECT station_id, day, island, count(*) * 0.25 AS h, max(slot) = max(e) AS trails FROM m WHERE stage IS NULL GROUP BY ALL) SELECT o.station_id, CAST(coalesce(max(h), 0) AS DOUBLE) AS hours FROM (SELECT DISTINCT station_id FROM o) o LEFT JOIN l USING (station_id) GROUP BY 1"),
    "E2_long_outage": (lambda s, p: Q.outages(_grid(s, p)).withColumn("long_outage", F.col("hours") > 12).select("station_id", "long_outage"), f"{_GRID}, m AS (SELECT station_id, slot, stage, sum(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY slot) AS island, 0 AS day, max(slot) OVER (PARTITION BY station_id) AS e FROM o), l AS (SELECT station_id, day, island, count(*) * 0.25 AS h, max(slot) = max(e) AS trails FROM m WHERE stage IS NULL GROUP BY ALL) SELECT o.station_id, coalesce(max(h), 0) > 12 AS long_outage FROM (SELECT DISTINCT station_id FROM o) o LEFT JOIN l USING (station_id) GROUP BY 1"),
    "E3_displayed_outage": (e3, _E3),
    "E4_phase": (lambda s, p: Q.phases(readings(s, p), TH.minor, TH.moderate, TH.major).select("seq", "phase"), f"{_E7} SELECT seq, phase FROM z"),
    "E5_crest": (lambda s, p: Q.phases(readings(s, p), TH.minor, TH.moderate, TH.major).select("seq", "crest_t", "crest_stage"), f"{_E7} SELECT seq, crest_t, crest_stage FROM z"),
    "E6_elapsed": (lambda s, p: Q.phases(readings(s, p), TH.minor, TH.moderate, TH.major).select("seq", F.round("elapsed_min", 3).alias("minutes")), f"{_E7} SELECT seq, round(m, 3) AS minutes FROM z"),
    "E7_phases": (lambda s, p: Q.phases(readings(s, p), TH.minor, TH.moderate, TH.major).select("seq", "phase", "crest_t", "crest_stage", F.round("elapsed_min", 4).alias("elapsed_min")), f"{_E7} SELECT seq, phase, crest_t, crest_stage, round((t - crest_t) / 60000000.0::DOUBLE, 4) AS elapsed_min FROM z"),
    "E10_segments": (lambda s, p: Q.segments(readings(s, p)).groupBy("station_id", F.col("segment").alias("start")).agg(F.max("t").alias("end"), F.count(F.lit(1)).alias("n")), f"WITH {_R}, k AS (SELECT *, CASE WHEN t - lag(t) OVER w > 5400000000 THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY station_id ORDER BY t, seq)), z AS (SELECT *, sum(cut) OVER (PARTITION BY station_id ORDER BY t, seq) AS segment FROM k) SELECT station_id, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM z GROUP BY station_id, segment"),
    "E10_segment_peaks": (lambda s, p: Q.segment_peaks(readings(s, p)), None),
    "E12_monthly_trend": (
        lambda s, p: daily_peaks(s, p).groupBy("source", "day").agg(F.avg("peak").alias("m")).groupBy("source", F.year("day").alias("y"), F.month("day").alias("mo")).agg(F.avg("m").alias("m")).withColumn("x", F.col("y") + (F.col("mo") - 0.5) / 12).groupBy("source").agg(F.count(F.lit(1)).alias("months"), F.round(F.regr_slope("m", "x"), 3).alias("slope")).where("months >= 24"),
        f"WITH {_D}, a AS (SELECT source, day, avg(peak) AS m FROM d GROUP BY 1, 2), b AS (SELECT source, year(day) AS y, month(day) AS mo, avg(m) AS m FROM a GROUP BY 1, 2, 3) SELECT source, count(*) AS months, round(regr_slope(m, y + (mo - 0.5::DOUBLE) / 12), 3) AS slope FROM b GROUP BY 1 HAVING count(*) >= 24",
    ),
    "E13_neighbour_days": (lambda s, p: daily_peaks(s, p).select("source", "day").distinct().select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format(F.lag("day").over(Window.partitionBy("source").orderBy("day")), "yyyy-MM-dd").alias("prev"), F.date_format(F.lead("day").over(Window.partitionBy("source").orderBy("day")), "yyyy-MM-dd").alias("next")), f"WITH {_D}, u AS (SELECT DISTINCT source, day FROM d) SELECT source, strftime(day, '%Y-%m-%d') AS day, strftime(lag(day) OVER w, '%Y-%m-%d') AS prev, strftime(lead(day) OVER w, '%Y-%m-%d') AS next FROM u WINDOW w AS (PARTITION BY source ORDER BY day)"),
    "F4_peak_index": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.min(F.struct((-F.col("stage")).alias("n"), "t", "seq")).alias("m")).select("station_id", F.col("m.seq").alias("seq")), f"WITH {_R} SELECT station_id, seq FROM r QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY stage DESC, t, seq) = 1"),
    "F5_worst_severity": (lambda s, p: readings(s, p).groupBy("station_id", _day().alias("day")).agg(F.max(S.severity_rank(F.col("stage"), TH)).alias("worst")), f"WITH {_R} SELECT station_id, {_DAYS} AS day, max(CASE WHEN stage < 50 THEN 0 WHEN stage < 113 THEN 1 WHEN stage < 224 THEN 2 ELSE 3 END) AS worst FROM r GROUP BY 1, 2"),
    "F6_record_score": (lambda s, p: readings(s, p).groupBy("station_id", _day().alias("day")).agg((F.count(F.when(F.col("user_id") % 3 != 0, F.col("stage"))) * 1000 + F.count(F.lit(1))).alias("score")), f"WITH {_R} SELECT station_id, {_DAYS} AS day, count(CASE WHEN user_id % 3 <> 0 THEN stage END) * 1000 + count(*) AS score FROM r GROUP BY 1, 2"),
    "F9_months": (lambda s, p: daily_peaks(s, p).select(F.date_format("day", "yyyy-MM").alias("month")).distinct(), f"WITH {_D} SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM d"),
    "F10_availability": (f10, f"{_F10} SELECT * FROM z"),
    "F11_availability_months": (lambda s, p: f10(s, p).groupBy(F.substring("day", 1, 7).alias("month")).agg(F.bool_or("observed").alias("observed"), F.bool_or("forecast").alias("forecast"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"{_F10} SELECT day[1:7] AS month, bool_or(observed) AS observed, bool_or(forecast) AS forecast, min(lo) AS lo, max(hi) AS hi FROM z GROUP BY 1"),
    "F13_archive_bounds": (lambda s, p: daily_peaks(s, p).groupBy("source").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("lo"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("hi")), f"WITH {_D} SELECT source, strftime(min(day), '%Y-%m-%d') AS lo, strftime(max(day), '%Y-%m-%d') AS hi FROM d GROUP BY 1"),
    "F16_product_range": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.min("stage").alias("lo"), F.max("stage").alias("hi"), F.round(F.min("stage") + TH.datum_offset, 4).alias("lo_mllw"), F.round(F.max("stage") + TH.datum_offset, 4).alias("hi_mllw")), f"WITH {_R} SELECT station_id, min(stage) AS lo, max(stage) AS hi, round(min(stage) + 2.13::DOUBLE, 4) AS lo_mllw, round(max(stage) + 2.13::DOUBLE, 4) AS hi_mllw FROM r GROUP BY 1"),
    "F18_exceedance": (
        lambda s, p: s.range(0, 50).withColumn("elevation", F.col("id") * 10).join(F.broadcast(readings(s, p).groupBy(F.least(F.ceil((F.col("stage") - 0.1) / 10), F.lit(50)).alias("above")).agg(F.count(F.lit(1)).alias("c"))), F.col("above") > F.col("id"), "left").groupBy("elevation").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")),
        f"WITH {_R}, e AS (SELECT unnest(generate_series(0, 490, 10)) AS elevation) SELECT elevation, count(stage) AS n FROM e LEFT JOIN r ON stage > elevation + 0.1::DOUBLE GROUP BY 1",
    ),
    "F23_upper_median": (lambda s, p: Q.upper_median(table(s, p, "customer"), ["c_nationkey"], "c_acctbal"), "SELECT c_nationkey, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS median FROM customer GROUP BY 1"),
    "G2_bandwidth": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.round(P.bandwidth("stage"), 4).alias("bandwidth")).unionByName(readings(s, p).where("seq < 2").groupBy("station_id").agg(F.round(P.bandwidth("stage"), 4).alias("bandwidth"))), f"WITH {_R} SELECT station_id, round(greatest(0.02::DOUBLE, 1.06::DOUBLE * stddev_samp(stage) * pow(count(*), -0.2::DOUBLE)), 4) AS bandwidth FROM r GROUP BY 1 UNION ALL SELECT station_id, CASE WHEN count(*) > 1 AND stddev_samp(stage) > 0 THEN round(greatest(0.02::DOUBLE, 1.06::DOUBLE * stddev_samp(stage) * pow(count(*), -0.2::DOUBLE)), 4) ELSE 0.05 END FROM r WHERE seq < 2 GROUP BY 1"),
    "H1_declustered": (h1, _H1),
    "H3_top_events": (h3, f"WITH {_D}, o AS (SELECT * FROM d WHERE day NOT IN (DATE '1995-03-15', DATE '1996-08-23') QUALIFY row_number() OVER (PARTITION BY day ORDER BY source DESC, peak DESC, seq) = 1) SELECT row_number() OVER (ORDER BY peak DESC, day) AS rank, strftime(day, '%Y-%m-%d') AS day, peak, source FROM o ORDER BY peak DESC, o.day LIMIT 10"),
    "H4_best_crest": (lambda s, p: Q.precedence(daily_peaks(s, p), ["day"], [F.desc("source"), F.desc("peak"), F.col("seq")]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "peak", "seq"), f"WITH {_D} SELECT strftime(day, '%Y-%m-%d') AS day, peak, seq FROM d QUALIFY row_number() OVER (PARTITION BY d.day ORDER BY source DESC, peak DESC, seq) = 1"),
    "H6_first_hours": (lambda s, p: forecast(s, p).join(F.broadcast(forecast(s, p).groupBy("station_id").agg(F.min("t").alias("lo"))), "station_id").where(F.col("t") <= F.col("lo") + 84 * HOUR).select("seq"), f"WITH {_F} SELECT seq FROM f QUALIFY t <= min(t) OVER (PARTITION BY station_id) + 84 * 3600000000"),
    "I1_nearest": (lambda s, p: Q.nearest(readings(s, p), forecast(s, p), "station_id", 2 * HOUR).select("seq", "match"), f"WITH {_R}, {_F} SELECT r.seq, f.seq AS match FROM r JOIN f ON r.station_id = f.station_id AND f.t BETWEEN r.t - 7200000000 AND r.t + 7200000000 QUALIFY row_number() OVER (PARTITION BY r.seq ORDER BY abs(r.t - f.t), f.t, f.seq) = 1"),
    "I2_nearest_later": (lambda s, p: Q.nearest(readings(s, p), forecast(s, p), "station_id", HOUR, True).select("seq", "match"), f"WITH {_R}, {_F} SELECT r.seq, f.seq AS match FROM r JOIN f ON r.station_id = f.station_id AND f.t BETWEEN r.t - 3600000000 AND r.t + 3600000000 QUALIFY row_number() OVER (PARTITION BY r.seq ORDER BY abs(r.t - f.t), f.t DESC, f.seq) = 1"),
    "I3_hour_slots": (lambda s, p: Q.hourly_slots(readings(s, p)), _I3),
    "I4_lookup_join": (lambda s, p: readings(s, p).withColumn("h", F.floor(F.col("t") / HOUR)).groupBy("station_id", "h").agg(F.avg("stage").alias("mean")).join(forecast(s, p).withColumn("h", F.floor(F.col("t") / HOUR)).groupBy("station_id", "h").agg(F.min("stage").alias("low")), ["station_id", "h"], "left").select("station_id", "h", F.round("mean", 4).alias("mean"), F.round("low", 4).alias("low")), f"WITH {_R}, {_F}, a AS (SELECT station_id, t // 3600000000 AS h, avg(stage) AS mean FROM r GROUP BY 1, 2), b AS (SELECT station_id, t // 3600000000 AS h, min(stage) AS low FROM f GROUP BY 1, 2) SELECT a.station_id, a.h, round(mean, 4) AS mean, round(low, 4) AS low FROM a LEFT JOIN b USING (station_id, h)"),
    "I9_without_crest_days": (lambda s, p: daily_peaks(s, p).where("source = 0").join(daily_peaks(s, p).where("source = 2").select("day"), "day", "left_anti").select("seq"), f"WITH {_D} SELECT seq FROM d WHERE source = 0 AND day NOT IN (SELECT day FROM d WHERE source = 2)"),
    "I11_window_range": (lambda s, p: forecast(s, p).join(F.broadcast(readings(s, p).groupBy("station_id").agg((F.min("t") - 2 * HOUR).alias("lo"), (F.max("t") + 2 * HOUR).alias("hi"))), "station_id").where(F.col("t").between(F.col("lo"), F.col("hi"))).groupBy("station_id").agg(F.count(F.lit(1)).alias("n")), f"WITH {_R}, {_F}, b AS (SELECT station_id, min(t) - 7200000000 AS lo, max(t) + 7200000000 AS hi FROM r GROUP BY 1) SELECT station_id, count(*) AS n FROM f JOIN b USING (station_id) WHERE t BETWEEN lo AND hi GROUP BY 1"),
    "J1_union_precedence": (j1, f"WITH {_R}, {_F}, u AS (SELECT seq, station_id, t // 3600000000 * 3600000000 AS t, stage, 0 AS prio FROM r UNION ALL SELECT seq, station_id, t // 3600000000 * 3600000000, stage, 1 FROM f) SELECT station_id, t, prio, round(stage, 6) AS stage FROM u QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY prio, seq) = 1"),
    "J5_concat": (lambda s, p: daily_peaks(s, p).where("source = 0").unionByName(daily_peaks(s, p).where("source = 1")).groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"WITH {_D} SELECT source, count(*) AS n FROM d WHERE source < 2 GROUP BY 1"),
    "J6_cutoff": (lambda s, p: daily_peaks(s, p).where((F.col("source") == 1) & (F.col("day") < "1996-01-01")).select("seq"), f"WITH {_D} SELECT seq FROM d WHERE source = 1 AND day < DATE '1996-01-01'"),
    "J8_crest_merge": (j8, f"WITH {_D}, i AS (SELECT day, max(peak) AS peak FROM d WHERE source <> 2 GROUP BY 1), c AS (SELECT day, max(peak) AS crest FROM d WHERE source = 2 GROUP BY 1) SELECT strftime(coalesce(i.day, c.day), '%Y-%m-%d') AS day, coalesce(crest, peak) AS peak, crest IS NOT NULL AS is_crest FROM i FULL JOIN c ON i.day = c.day"),
    "J9_date_spine": (lambda s, p: daily_peaks(s, p).groupBy("source").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("source", F.explode(F.sequence("lo", "hi")).alias("day")).join(daily_peaks(s, p).select("source", "day").distinct(), ["source", "day"], "left_anti").select("source", F.date_format("day", "yyyy-MM-dd").alias("day")), f"WITH {_D}, b AS (SELECT source, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), g AS (SELECT source, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT source, strftime(day, '%Y-%m-%d') AS day FROM g WHERE (source, day) NOT IN (SELECT (source, day) FROM d)"),
    "J12_last_wins": (lambda s, p: Q.precedence(readings(s, p), ["user_id"], [F.desc("seq")]).select("user_id", "seq", "stage"), f"WITH {_R} SELECT user_id, seq, stage FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1"),
    "K2_raised_cosine": (lambda s, p: Q.raised_cosine(readings(s, p), readings(s, p).groupBy("station_id").agg((F.max("stage") + 5).alias("crest"))).select("seq", F.round("stage", 3).alias("stage")), f"WITH {_R}, k AS (SELECT station_id, stage AS peak, t AS pt, seq AS ps FROM r QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY stage DESC, t, seq) = 1) SELECT r.seq, round(CASE WHEN r.seq = ps THEN peak + 5 WHEN abs(t - pt) <= 21600000000 THEN round(stage + 5 * 0.5::DOUBLE * (1 + cos(pi() * abs(t - pt) / 21600000000.0::DOUBLE)), 4) ELSE stage END, 3) AS stage FROM r JOIN k USING (station_id)"),
    "N4_daily_frames": (lambda s, p: f1(s, p).where(F.col("day").between("2024-01-05", "2024-01-09")).select("station_id", "day", "stage"), f"WITH {_R} SELECT station_id, day, max(stage) AS stage FROM (SELECT *, {_DAYS} AS day FROM r) WHERE day BETWEEN '2024-01-05' AND '2024-01-09' GROUP BY 1, 2"),
    "N11_calendar_grid": (lambda s, p: daily_peaks(s, p).groupBy(F.trunc("day", "month").alias("m")).agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.sequence("m", F.last_day("m"))).alias("day")).join(daily_peaks(s, p).groupBy("day").agg(F.max("peak").alias("peak")), "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "peak"), f"WITH {_D}, m AS (SELECT DISTINCT date_trunc('month', day) AS m FROM d), g AS (SELECT CAST(unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS DATE) AS day FROM m), k AS (SELECT day, max(peak) AS peak FROM d GROUP BY 1) SELECT strftime(g.day, '%Y-%m-%d') AS day, peak FROM g LEFT JOIN k USING (day)"),
    "O2_late_readings": (o2, f"WITH {_R} SELECT station_id, t // 3600000000 AS hour, seq, t, stage FROM r QUALIFY row_number() OVER (PARTITION BY station_id, t // 3600000000 ORDER BY t DESC, seq DESC) = 1"),
    "O3_freshness": (lambda s, p: forecast(s, p).groupBy("station_id").agg(F.min("t").alias("cycle"), F.max("t").alias("end")).select("station_id", F.when(F.col("end") < 1706400000000000, "expired").when(F.col("cycle") + 72 * HOUR < 1706400000000000, "stale").otherwise("fresh").alias("state")), f"WITH {_F}, b AS (SELECT station_id, min(t) AS c, max(t) AS e FROM f GROUP BY 1) SELECT station_id, CASE WHEN e < 1706400000000000 THEN 'expired' WHEN c + 72 * 3600000000 < 1706400000000000 THEN 'stale' ELSE 'fresh' END AS state FROM b"),
    "P1_age_gate": (lambda s, p: readings(s, p).where(~F.col("t").between(1705900000000000 - 18 * HOUR, 1705900000000000 + 30 * MINUTE)).select("seq"), f"WITH {_R} SELECT seq FROM r WHERE NOT t BETWEEN 1705900000000000 - 64800000000 AND 1705900000000000 + 1800000000"),
    "P3_digests": (lambda s, p: table(s, p, "events").select("event_id", F.sha2("props", 256).alias("sha"), F.octet_length("props").alias("bytes")), "SELECT event_id, sha256(props) AS sha, strlen(props) AS bytes FROM events"),
    "P4_archive_faults": (p4, f"WITH {_D}, k AS (SELECT source, day, count(*) AS n FROM d GROUP BY 1, 2), b AS (SELECT source, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), g AS (SELECT source, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT source, strftime(day, '%Y-%m-%d') AS day, 'repeated' AS fault FROM k WHERE n > 1 UNION ALL SELECT source, strftime(day, '%Y-%m-%d'), 'missing' FROM g WHERE (source, day) NOT IN (SELECT (source, day) FROM k)"),
    "P5_monotone_axis": (lambda s, p: table(s, p, "orders").withColumn("prev", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("o_orderdate <= prev").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderdate <= lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "R6_product_summary": (lambda s, p: readings(s, p).groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("user_id") % 3 == 0, 1)).alias("quartiles")), f"WITH {_R} SELECT station_id, count(*) AS rows, count(*) FILTER (user_id % 3 = 0) AS quartiles FROM r GROUP BY 1"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
