"""Observed days, canonical series, joins and unions (sections D to K, O of the survey), with their DuckDB SQL.

Stand-ins: a gauge is an event type, its forecast the same series two hours later at nine tenths; the daily archive comes from
orders (cents as hundredths, customer as source letter); alerts are suppliers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import times as T
from ..operators import alerts as A
from ..operators import observed as O
from ..operators import series as Q
from ..sources.tables import DAY, HOUR, MINUTE, forecast, readings, table
from .series_queries import _DAYS, _E7, _F, _R, _SEV, TH

_LOCAL = "timezone('America/New_York', timezone('UTC', make_timestamp(t)))"


def grid_sql(rows, ends, gap, name="o"):
    """CTEs of the quarter-hour grid of ``rows`` (station_id, seq, t, stage) over ``ends`` (station_id, lo, hi)."""
    n = name
    return f"""{n}g AS (SELECT station_id, unnest(generate_series(lo, hi)) * 900000000 AS slot FROM {ends} WHERE lo <= hi),
{n}x AS (SELECT station_id, n * 900000000 AS slot, stage FROM (SELECT *, CAST(floor(t / 900000000.0 + 0.5) AS BIGINT) AS n FROM {rows}) QUALIFY row_number() OVER (PARTITION BY station_id, n ORDER BY abs(t - n * 900000000), t, seq) = 1),
{n}b AS (SELECT g.station_id, g.slot, r.t AS bt, r.stage AS bs FROM {n}g g ASOF LEFT JOIN {rows} r ON g.station_id = r.station_id AND g.slot >= r.t),
{n}a AS (SELECT b.*, r.t AS nt, r.stage AS ns FROM {n}b b ASOF LEFT JOIN {rows} r ON b.station_id = r.station_id AND b.slot <= r.t),
{n} AS (SELECT a.station_id, a.slot, CASE WHEN x.stage IS NOT NULL THEN x.stage WHEN nt - bt <= {gap} THEN round(bs + (ns - bs) * ((a.slot - bt) / (nt - bt)::DOUBLE), 4) END AS stage,
CASE WHEN x.stage IS NOT NULL THEN 'exact' WHEN nt - bt <= {gap} THEN 'interpolated' ELSE 'missing' END AS kind, CASE WHEN x.stage IS NULL AND nt - bt <= {gap} THEN bt END AS before_t, CASE WHEN x.stage IS NULL AND nt - bt <= {gap} THEN nt END AS after_t FROM {n}a a LEFT JOIN {n}x x USING (station_id, slot))"""


def ends_sql(rows):
    return f"SELECT station_id, CAST(ceil(min(t) / 900000000.0) AS BIGINT) AS lo, CAST(floor(max(t) / 900000000.0) AS BIGINT) AS hi FROM {rows} GROUP BY 1"


_GRID = f"WITH {_R}, e AS ({ends_sql('r')}), {grid_sql('r', 'e', 4500000000)}"


def _day(t="t"):
    return F.date_format(S.civil_day(F.col(t)), "yyyy-MM-dd")


def days_of(spark, sf):
    return readings(spark, sf).withColumn("day", _day())


def starts(rows):
    """(day, lo, hi) of the civil days of rows: midnight and the last quarter hour."""
    d = rows.select("day").distinct()
    return d.select("day", T.local_instant(F.concat("day", F.lit("T00:00"))).alias("lo"), T.local_instant(F.concat("day", F.lit("T23:45"))).alias("hi"))


def d5(spark, sf):
    rows = days_of(spark, sf)
    return O.canonical_days(rows, starts(rows))


_D5 = f"""WITH {_R}, k AS (SELECT *, {_DAYS} AS day FROM r), st AS (SELECT DISTINCT day, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR) AS lo, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR) + 85500000000 AS hi FROM k), dd AS (SELECT DISTINCT station_id, day FROM k),
b AS (SELECT station_id || '|' || day AS station_id, seq, t, stage, lo, hi, 0 AS early FROM k JOIN st USING (day) UNION ALL SELECT k.station_id || '|' || st.day, k.seq, k.t, k.stage, st.lo, st.hi, 1 FROM k JOIN st ON k.t >= st.lo - 28800000000 AND k.t < st.lo JOIN dd ON dd.station_id = k.station_id AND dd.day = st.day),
e AS (SELECT station_id, CAST(ceil((min(lo) - max(early) * 28800000000) / 900000000.0) AS BIGINT) AS lo, CAST(floor(min(hi) / 900000000.0) AS BIGINT) AS hi FROM b GROUP BY 1), {grid_sql('b', 'e', 1800000000)}
SELECT split_part(station_id, '|', 1) AS station_id, split_part(station_id, '|', 2) AS day, slot, stage, kind FROM o"""


def _fgrid(spark, sf):
    return Q.quarter_hours(forecast(spark, sf)).where("stage IS NOT NULL")


_FGRID = f"WITH {_F}, e AS ({ends_sql('f')}), {grid_sql('f', 'e', 4500000000)}"


def d8(spark, sf):
    """The forecast at each cadence: every quarter hour, full hours, and daily maxima of its own readings."""
    g = _fgrid(spark, sf).select("station_id", F.col("slot").alias("t"), "stage")
    daily = Q.daily_maximum(forecast(spark, sf), _day()).select("station_id", "t", "stage")
    every = lambda df, m: df.withColumn("minutes", F.lit(m))
    return every(g, 15).unionByName(every(g.where(F.minute(S.civil(F.col("t"))) == 0), 60)).unionByName(every(daily, 1440)).withColumn("stage", F.round("stage", 4))


def _span(first, last):
    """All days from one to another."""
    return F.transform(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))), lambda d: F.date_format(d, "yyyy-MM-dd"))


def d12(spark, sf):
    """Frames of a run: those flagged hourly, and for each listed day its highest, the first of all frames where it has none."""
    frames = _fgrid(spark, sf).select("station_id", F.col("slot").alias("t"), F.col("slot").alias("seq"), "stage", _day("slot").alias("day"))
    hourly = frames.where(F.col("t") % HOUR == 0).select("station_id", "t", "stage", F.lit("hourly").alias("kind"))
    listed = frames.select("day").distinct().where(F.dayofmonth("day") % 2 == 0)
    first = frames.groupBy("station_id").agg(F.min(F.struct("t", "stage")).alias("f"))
    top = frames.groupBy("station_id", "day").agg(F.min(F.struct((-F.col("stage")).alias("neg"), "t")).alias("m"))
    ends = listed.agg(F.min("day"), F.max("day")).first()
    days = F.array(F.lit("2030-01-01")) if ends[0] is None else F.concat(_span(*ends), F.array(F.lit("2030-01-01")))
    each = first.select("station_id", "f", F.explode(days).alias("day"))  # each gauge takes the days of the calendar, and those listed stay
    asked = each.join(listed.unionByName(spark.createDataFrame([("2030-01-01",)], "day string")), "day", "left_semi").join(top, ["station_id", "day"], "left")
    daily = asked.select("station_id", F.coalesce("m.t", "f.t").alias("t"), F.coalesce(-F.col("m.neg"), F.col("f.stage")).alias("stage"), F.col("day").alias("kind"))
    return hourly.unionByName(daily)


_D12 = f"""{_FGRID}, u AS (SELECT station_id, slot AS t, stage FROM o WHERE stage IS NOT NULL), k AS (SELECT *, {_DAYS} AS day FROM u), l AS (SELECT DISTINCT day FROM k WHERE day(CAST(day AS DATE)) % 2 = 0 UNION ALL SELECT '2030-01-01'),
ff AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY t) = 1), m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY stage DESC, t) = 1)
SELECT station_id, t, stage, 'hourly' AS kind FROM u WHERE t % 3600000000 = 0 UNION ALL SELECT ff.station_id, coalesce(m.t, ff.t), coalesce(m.stage, ff.stage), l.day FROM ff CROSS JOIN l LEFT JOIN m ON m.station_id = ff.station_id AND m.day = l.day"""


def _hour_rows(spark, sf, keep):
    return readings(spark, sf).where(keep).select("station_id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), "seq", "stage")


def j3(spark, sf):
    return O.live_over_archive(Q.precedence(_hour_rows(spark, sf, "seq % 2 = 0"), ["station_id", "t"], [F.col("seq")]), Q.precedence(_hour_rows(spark, sf, "seq % 3 = 0"), ["station_id", "t"], [F.desc("seq")]), ["station_id"])


_J3 = f"""WITH {_R}, h AS (SELECT station_id, t // 3600000000 * 3600000000 AS t, seq, stage FROM r), a AS (SELECT *, false AS is_live FROM h WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY seq) = 1),
l AS (SELECT *, true AS is_live FROM h WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY seq DESC) = 1), j AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY is_live DESC, seq) = 1)"""


def crests(rows):
    """A crest five feet above each gauge's highest reading, of known time (mid-way) for gauges of even name length."""
    mid = F.floor((F.min("t") + F.max("t")) / 2)
    return rows.groupBy("station_id").agg((F.max("stage") + 5).alias("crest"), F.when(F.length("station_id") % 2 == 0, mid).alias("crest_t"))


def _crest_sql(rows):
    return f"""ct AS (SELECT station_id, max(stage) + 5 AS crest, CASE WHEN length(station_id) % 2 = 0 THEN (min(t) + max(t)) // 2 END AS ctt FROM {rows} GROUP BY 1),
cg AS (SELECT q.station_id, q.seq AS target FROM {rows} q JOIN ct USING (station_id) QUALIFY row_number() OVER (PARTITION BY q.station_id ORDER BY CASE WHEN ctt IS NOT NULL THEN abs(q.t - ctt)::DOUBLE ELSE -q.stage END, q.t, q.seq) = 1),
ck AS (SELECT q.*, q.seq = target AND NOT coalesce(q.stage >= crest, false) AS is_crest, CASE WHEN q.seq = target AND NOT coalesce(q.stage >= crest, false) THEN crest ELSE q.stage END AS put FROM {rows} q JOIN ct USING (station_id) JOIN cg USING (station_id))"""


def k1(spark, sf):
    rows = readings(spark, sf)
    return O.with_crest_reading(rows, crests(rows)).select("seq", "is_crest", "stage")


def k3(spark, sf):
    """Crests by the kind of source: primary gauges (odd name length) have them put in, surrogates are fitted to them."""
    rows = readings(spark, sf)
    primary, other = rows.where(F.length("station_id") % 2 == 1), rows.where(F.length("station_id") % 2 == 0)
    fitted = Q.raised_cosine(other, other.groupBy("station_id").agg((F.max("stage") + 5).alias("crest")))
    return O.with_crest_reading(primary, crests(primary)).select("seq", F.round("stage", 3).alias("stage")).unionByName(fitted.select("seq", F.round("stage", 3).alias("stage")))


_K3 = f"""WITH {_R}, p AS (SELECT * FROM r WHERE length(station_id) % 2 = 1), s AS (SELECT * FROM r WHERE length(station_id) % 2 = 0), {_crest_sql('p')},
k AS (SELECT station_id, stage AS peak, t AS pt, seq AS ps FROM s QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY stage DESC, t, seq) = 1)
SELECT seq, round(put, 3) AS stage FROM ck UNION ALL SELECT s.seq, round(CASE WHEN s.seq = ps THEN peak + 5 WHEN abs(t - pt) <= 21600000000 THEN round(stage + 5 * 0.5::DOUBLE * (1 + cos(pi() * abs(t - pt) / 21600000000.0::DOUBLE)), 4) ELSE stage END, 3) FROM s JOIN k USING (station_id)"""


def d13(spark, sf):
    """A day's source rows: archive and live readings by instant, then the official crest."""
    rows = j3(spark, sf)
    return O.with_crest_reading(rows, crests(rows)).select("station_id", "t", "seq", "is_live", "is_crest", "stage")


def positional(spark, sf):
    """(day, hundredths, letter): the first order of each day."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.struct(F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 10).alias("h"), F.element_at(F.array(*(F.lit(x) for x in "UNC")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("letter")).alias("r"))
    return o.groupBy("day").agg(F.min("r").alias("r")).select("day", F.col("r.h").alias("hundredths"), F.col("r.letter").alias("letter"))


def _sev(x):
    return f"CASE WHEN {x} IS NULL OR {x} < 50 THEN 'none' WHEN {x} < 113 THEN 'minor' WHEN {x} < 224 THEN 'moderate' ELSE 'major' END"


_IX = f"""ix AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(floor(o_totalprice / 10) AS BIGINT) / 100.0::DOUBLE AS peak, ['U', 'N', 'C'][o_custkey % 3 + 1] AS letter FROM orders QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1),
dx AS (SELECT day, peak, letter, {_sev('peak')} AS classification, true AS canonical, letter = 'N' OR (letter = 'C' AND day < '1998-01-01') AS surrogate FROM ix)"""


def j7(spark, sf):
    return O.decoded_index(positional(spark, sf), TH, "1998-01-01")


def _incoming(spark, sf):
    o = table(spark, sf, "orders").where("o_custkey % 4 = 0").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg((F.max(F.floor(F.col("o_totalprice") / 8)) / 100).alias("peak"))
    return o.withColumn("classification", S.severity(F.col("peak"), TH))


def j4(spark, sf):
    return O.merged_index(j7(spark, sf), _incoming(spark, sf), TH, primary=True)


_J4 = f"""{_IX}, nx AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(CAST(floor(o_totalprice / 8) AS BIGINT)) / 100.0::DOUBLE AS new FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1),
mx AS (SELECT coalesce(dx.day, nx.day) AS day, CASE WHEN dx.day IS NULL OR (new IS NOT NULL AND letter <> 'C') THEN new ELSE peak END AS peak, CASE WHEN dx.day IS NOT NULL AND new IS NOT NULL AND letter <> 'C' THEN 'U' ELSE letter END AS letter,
CASE WHEN dx.day IS NULL OR (new IS NOT NULL AND letter <> 'C') THEN {_sev('new')} ELSE classification END AS classification, dx.day IS NOT NULL AS canonical, CASE WHEN new IS NOT NULL THEN false ELSE surrogate END AS surrogate FROM dx FULL JOIN nx ON dx.day = nx.day)"""


def _live_days(spark, sf):
    return table(spark, sf, "orders").where("o_custkey % 6 = 1").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_totalprice") / 1000).alias("stage"))


def _crest_days(spark, sf):
    return table(spark, sf, "orders").where("o_custkey % 9 = 2").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg((F.max("o_totalprice") / 900).alias("crest"))


def j14(spark, sf):
    """The archive's order: canonical index, the primary's index, live days, official crests."""
    merged = j4(spark, sf)
    live = O.upserted_days(merged.select("day", "peak"), _live_days(spark, sf), TH, [])
    days = live.join(merged.select("day", "letter", "canonical"), "day", "left")
    return O.with_crests(days, _crest_days(spark, sf), TH).select("day", F.round("peak", 6).alias("peak"), "classification", "letter", "has_crest", "crest_only")


_J14 = f"""WITH {_J4}, lv AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_totalprice / 1000) AS live FROM orders WHERE o_custkey % 6 = 1 GROUP BY 1), up AS (SELECT coalesce(mx.day, lv.day) AS day, greatest(peak, live) AS peak, letter, canonical FROM mx FULL JOIN lv ON mx.day = lv.day),
cr AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_totalprice) / 900 AS crest FROM orders WHERE o_custkey % 9 = 2 GROUP BY 1)
SELECT coalesce(up.day, cr.day) AS day, round(coalesce(crest, peak), 6) AS peak, {_sev('coalesce(crest, peak)')} AS classification, letter, crest IS NOT NULL AS has_crest, canonical IS NULL AS crest_only FROM up FULL JOIN cr ON up.day = cr.day"""


def j10(spark, sf):
    r = days_of(spark, sf)
    days = r.where("seq % 2 = 0").groupBy("station_id", "day").agg((F.max("stage") * 0.9).alias("peak"))
    return O.upserted_days(days, r.where("seq % 2 = 1"), TH, ["station_id"]).withColumn("peak", F.round("peak", 6))


_J10 = f"""WITH {_R}, k AS (SELECT *, {_DAYS} AS day FROM r), d AS (SELECT station_id, day, max(stage) * 0.9::DOUBLE AS peak FROM k WHERE seq % 2 = 0 GROUP BY 1, 2), l AS (SELECT station_id, day, max(stage) AS live, count(*) AS n FROM k WHERE seq % 2 = 1 GROUP BY 1, 2),
z AS (SELECT station_id, day, greatest(peak, live) AS peak, coalesce(n, 0) AS n_live FROM d FULL JOIN l USING (station_id, day)) SELECT station_id, day, round(peak, 6) AS peak, {_sev('peak')} AS classification, n_live FROM z"""


def _hours(spark, sf):
    r = days_of(spark, sf).withColumn("hour", F.hour(S.civil(F.col("t")))).withColumn("record", F.col("user_id") % 3)
    return r.withColumn("stage", F.when(F.col("user_id") % 7 != 0, F.col("stage")))


_HK = f"WITH {_R}, k AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN stage END AS s, {_DAYS} AS day, hour({_LOCAL}) AS hour, user_id % 3 AS record FROM r), w AS (SELECT station_id, day, record, count(s) * 1000 + count(*) AS score FROM k GROUP BY 1, 2, 3)"


def f2(spark, sf):
    r = days_of(spark, sf).where("seq % 5 <> 0")
    known = starts(days_of(spark, sf)).select("day")
    ends = known.agg(F.min("day"), F.max("day")).first()
    each = r.select("station_id").distinct().select("station_id", F.explode(_span(*ends)).alias("day"))
    published = each.join(known, "day", "left_semi").withColumn("peak", F.when(F.dayofmonth("day") % 3 == 0, F.dayofmonth("day").cast("double")))
    phased = Q.phases(readings(spark, sf), TH.minor, TH.moderate, TH.major)
    return O.observed_maxima(r.where("day <> '2024-01-09'"), published, phased, ["station_id"])


_F2 = f"""{_E7}, k AS (SELECT *, {_DAYS} AS day FROM r), m AS (SELECT * FROM k WHERE seq % 5 <> 0 AND day <> '2024-01-09' QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY stage DESC, t, seq) = 1), p AS (SELECT s.station_id, q.day FROM (SELECT DISTINCT station_id FROM k) s CROSS JOIN (SELECT DISTINCT day FROM k) q)
SELECT m.station_id, m.day, m.stage, m.t, m.seq, z.phase FROM m JOIN z USING (seq) UNION ALL SELECT p.station_id, p.day, day(CAST(p.day AS DATE))::DOUBLE, NULL, NULL, NULL FROM p WHERE day(CAST(p.day AS DATE)) % 3 = 0 AND (p.station_id, p.day) NOT IN (SELECT (station_id, day) FROM m)"""


def e9(spark, sf):
    return O.milestones(Q.phases(readings(spark, sf), TH.minor, TH.moderate, TH.major), TH.minor)


_E9 = f"""{_E7}, y AS (SELECT z.*, r.station_id, r.stage FROM z JOIN r USING (seq))
SELECT a.seq, b.phase, b.seq AS milestone FROM y a JOIN y b ON a.station_id = b.station_id AND b.t >= a.crest_t AND b.t < a.t AND b.phase <> 'filling' WHERE a.phase LIKE 'draining%' AND a.crest_stage >= 50 QUALIFY row_number() OVER (PARTITION BY a.seq, b.phase ORDER BY b.stage DESC, b.t, b.seq) = 1"""


def f12(spark, sf):
    from .series_queries import f10

    a = f10(spark, sf)
    return a.agg(F.min(F.when(F.col("lo").isNotNull(), F.struct("day", "lo"))).alias("a"), F.max(F.when(F.col("hi").isNotNull(), F.struct("day", "hi"))).alias("b")).select(F.col("a.lo").alias("first"), F.col("b.hi").alias("last"))


def f14(spark, sf):
    r = days_of(spark, sf)
    days = r.groupBy("station_id", "day").agg(F.max(F.when(F.col("user_id") % 2 == 0, F.col("stage"))).alias("peak"), F.count(F.when(F.col("user_id") % 3 == 0, 1)).alias("n"))
    return O.latest_day(days, ["station_id"])


def h2(spark, sf):
    """Days whose peak reaches the minor threshold, with the hours of their longest outage: replayed, or crest-only above 12."""
    r = days_of(spark, sf)
    peaks = Q.daily_maximum(r, F.col("day")).where(F.col("stage") >= TH.minor)
    g = d5(spark, sf).withColumn("series", F.concat_ws("|", "station_id", "day"))
    first = starts(r)
    own = g.join(first, "day").where(F.col("slot") >= F.col("lo"))
    out = Q.outages(own, by="series")
    return peaks.withColumn("series", F.concat_ws("|", "station_id", "day")).join(out, "series").select("station_id", "day", "stage", "hours", (F.col("hours") > 12).alias("crest_only"))


_H2 = f"""{_D5.replace("SELECT split_part(station_id, '|', 1) AS station_id, split_part(station_id, '|', 2) AS day, slot, stage, kind FROM o", "")}, u AS (SELECT split_part(o.station_id, '|', 1) AS station_id, split_part(o.station_id, '|', 2) AS day, slot, o.stage FROM o), v AS (SELECT u.* FROM u JOIN st USING (day) WHERE slot >= st.lo),
i AS (SELECT *, sum(CASE WHEN stage IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, day ORDER BY slot) AS island FROM v), l AS (SELECT station_id, day, island, count(*) * 0.25 AS h FROM i WHERE stage IS NULL GROUP BY 1, 2, 3), m AS (SELECT station_id, day, max(stage) AS stage FROM k GROUP BY 1, 2 HAVING max(stage) >= 50)
SELECT m.station_id, m.day, m.stage, CAST(coalesce(max(h), 0) AS DOUBLE) AS hours, coalesce(max(h), 0) > 12 AS crest_only FROM m LEFT JOIN l USING (station_id, day) GROUP BY 1, 2, 3"""


def _alerts(spark, sf):
    k = F.col("s_suppkey")
    kinds = F.array(*(F.lit(x) for x in ("Coastal Flood Warning", "Flood Watch", "Storm Surge Watch", "Coastal Flood Advisory", "Small Craft Advisory")))
    return table(spark, sf, "supplier").select(F.concat(F.lit("id"), k % 60).alias("id"), (k % 7).alias("zone"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("event"), F.when(k % 4 != 0, k * HOUR).alias("expires"), k.alias("seq"), (k % 2).alias("cached"))


_AL = "al AS (SELECT 'id' || (s_suppkey % 60) AS id, s_suppkey % 7 AS zone, ['Coastal Flood Warning', 'Flood Watch', 'Storm Surge Watch', 'Coastal Flood Advisory', 'Small Craft Advisory'][s_suppkey % 5 + 1] AS event, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 3600000000 END AS expires, s_suppkey AS seq, s_suppkey % 2 AS cached FROM supplier), lv AS (SELECT * FROM al WHERE cached = 0 OR zone IN (2, 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cached, seq) = 1), kp AS (SELECT * FROM lv WHERE (expires IS NULL OR expires > 36000000000) AND regexp_matches(event, '(coastal flood|storm surge|lakeshore flood|flood warning|flood watch|flood advisory)', 'i'))"
_PRIO = "CASE WHEN event ILIKE '%warning%' THEN 3 WHEN event ILIKE '%watch%' THEN 2 ELSE 1 END"


def j11(spark, sf):
    a = _alerts(spark, sf)
    failed = spark.createDataFrame([(2,), (3,)], "zone long")
    return A.current_alerts(a.where("cached = 0").drop("cached"), a.where("cached = 1").drop("cached"), failed, 10 * HOUR)


def h7(spark, sf):
    return A.ordered(j11(spark, sf)).select("place", "seq", "event")


def o1(spark, sf):
    """Attempts to load live readings (an event each, failed where the user is a multiple of four)."""
    tries = readings(spark, sf).select("station_id", "seq", "t", (F.col("user_id") % 4 != 0).alias("ok"))
    w = Window.partitionBy("station_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.last(F.when(F.col("ok"), F.col("t") - DAY), True).over(w), F.lit(1704067200000000))
    return tries.select("seq", start.alias("start"), (F.col("t") + F.when(F.col("ok"), 15 * MINUTE).otherwise(MINUTE)).alias("next_try"))


def o4(spark, sf):
    """Whether a forecast of each gauge may replace the last: times rise, ends are as published, levels are finite, in every
    scenario that the last one had, and the cycle is no older."""
    f = forecast(spark, sf).withColumn("scenario", F.col("user_id") % 3)
    step = F.col("t") > F.lag("t").over(Window.partitionBy("station_id", "scenario").orderBy("seq"))
    told = f.withColumn("rises", F.coalesce(step, F.lit(True))).groupBy("station_id", "scenario").agg(F.bool_and("rises").alias("rises"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.bool_and(F.abs("stage") < 300).alias("finite"))
    ends = f.groupBy("station_id").agg(F.max("t").alias("end"))
    usable = told.join(ends, "station_id").withColumn("usable", F.col("rises") & F.col("finite") & (F.col("end") - F.col("hi") <= 2 * HOUR))
    return usable.groupBy("station_id").agg(F.bool_and("usable").alias("accepted"), F.count(F.when(F.col("usable"), 1)).alias("scenarios"))


_O4 = f"""WITH {_F}, k AS (SELECT *, user_id % 3 AS scenario, coalesce(t > lag(t) OVER (PARTITION BY station_id, user_id % 3 ORDER BY seq), true) AS rises FROM f), e AS (SELECT station_id, max(t) AS end_t FROM f GROUP BY 1),
u AS (SELECT station_id, scenario, bool_and(rises) AND bool_and(abs(stage) < 300) AND max(end_t) - max(t) <= 7200000000 AS usable FROM k JOIN e USING (station_id) GROUP BY 1, 2) SELECT station_id, bool_and(usable) AS accepted, count(*) FILTER (usable) AS scenarios FROM u GROUP BY 1"""

_ENTRIES = {
    "D2_interpolated_rows": (lambda s, p: Q.quarter_hours(readings(s, p)).where("kind = 'interpolated'").select("station_id", "slot", "stage", "before_t", "after_t"), f"{_GRID} SELECT station_id, slot, stage, before_t, after_t FROM o WHERE kind = 'interpolated'"),
    "D3_missing_rows": (lambda s, p: Q.quarter_hours(readings(s, p)).where("kind = 'missing'").select("station_id", "slot"), f"{_GRID} SELECT station_id, slot FROM o WHERE kind = 'missing'"),
    "D4_slot_fields": (lambda s, p: Q.quarter_hours(readings(s, p)).withColumn("l", S.civil(F.col("slot"))).select("station_id", "slot", F.date_format("l", "yyyy-MM-dd'T'HH:mm").alias("local"), F.hour("l").alias("hour"), F.minute("l").alias("minute")), f"{_GRID}, y AS (SELECT station_id, slot, slot AS t FROM o) SELECT station_id, slot, strftime({_LOCAL}, '%Y-%m-%dT%H:%M') AS local, hour({_LOCAL}) AS hour, minute({_LOCAL}) AS minute FROM y"),
    "D5_observed_days": (d5, _D5),
    "D6_forecast_canonical": (lambda s, p: _fgrid(s, p).select("station_id", "slot", F.round("stage", 4).alias("stage")), f"{_FGRID} SELECT station_id, slot, round(stage, 4) AS stage FROM o WHERE stage IS NOT NULL"),
    "D8_forecast_cadences": (d8, f"{_FGRID}, u AS (SELECT station_id, slot AS t, stage FROM o WHERE stage IS NOT NULL), m AS (SELECT station_id, t, stage FROM (SELECT *, {_DAYS} AS day FROM f) QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY stage DESC, t, seq) = 1) SELECT station_id, t, round(stage, 4) AS stage, 15 AS minutes FROM u UNION ALL SELECT station_id, t, round(stage, 4), 60 FROM u WHERE t % 3600000000 = 0 UNION ALL SELECT station_id, t, round(stage, 4), 1440 FROM m"),
    "D10_return_cadence": (lambda s, p: Q.synthetic_storm(table(s, p, "part"), "p_partkey", "p_size").where(F.abs(F.col("offset_hours") - F.round("offset_hours")) < 1e-8).select("p_partkey", "offset_hours", "stage"), "SELECT p_partkey, q::DOUBLE AS offset_hours, round(p_size - 6 * (1 - cos(3.141592653589793::DOUBLE * q / 12)) / 2, 6) AS stage FROM (SELECT p_partkey, p_size, unnest(generate_series(-12, 12)) AS q FROM part)"),
    "D12_run_frames": (d12, _D12),
    "D13_source_rows": (d13, f"{_J3}, {_crest_sql('j')} SELECT station_id, t, seq, is_live, is_crest, put AS stage FROM ck"),
    "E8_stored_phase": (lambda s, p: Q.phases(readings(s, p), TH.minor, TH.moderate, TH.major).select("seq", F.coalesce(F.when(F.col("seq") % 3 == 0, "slack"), F.col("phase")).alias("phase")), f"{_E7} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'slack' ELSE phase END AS phase FROM z"),
    "E9_milestones": (e9, _E9),
    "E11_rebased": (lambda s, p: readings(s, p).select("seq", F.round(O.rebased(F.col("stage"), F.col("t"), 0.013, 1767225600000000), 6).alias("stage")), f"WITH {_R} SELECT seq, round(stage + 0.013::DOUBLE * (1767225600000000 - t) / (365.2425::DOUBLE * 86400000000), 6) AS stage FROM r"),
    "E14_same_clock": (lambda s, p: O.same_clock(days_of(s, p), ["station_id", "day"], T.clock_minutes(F.col("t")), F.lit(720)), f"WITH {_R} SELECT station_id, {_DAYS} AS day, seq FROM r QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY abs(hour({_LOCAL}) * 60 + minute({_LOCAL}) - 720), t, seq) = 1"),
    "F2_observed_maxima": (f2, _F2),
    "F3_storm_day_maxima": (lambda s, p: readings(s, p).groupBy("station_id", T.storm_day((F.col("user_id") - 75).cast("double")).alias("day")).agg(F.min(F.struct((-F.col("stage")).alias("neg"), "seq")).alias("m")).select("station_id", "day", (-F.col("m.neg")).alias("stage"), F.col("m.seq").alias("seq")), f"WITH {_R} SELECT station_id, greatest(0, CAST(floor((user_id - 75 + 42) / 24.0) AS BIGINT)) AS day, stage, seq FROM r QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY stage DESC, seq) = 1"),
    "F7_best_records": (lambda s, p: O.best_records(_hours(s, p), ["station_id", "day"], "record").select("station_id", "day", "record", "score"), f"{_HK} SELECT station_id, day, record, score FROM w QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY score DESC, record DESC) = 1"),
    "F8_merged_hours": (lambda s, p: O.merged_records(_hours(s, p), ["station_id", "day"], "record").select("station_id", "day", "hour", "seq", "stage"), f"{_HK} SELECT station_id, day, hour, seq, s AS stage FROM k JOIN w USING (station_id, day, record) QUALIFY row_number() OVER (PARTITION BY station_id, day, hour ORDER BY s IS NULL, score, record, t, seq) = 1"),
    "F12_availability_bounds": (f12, f"WITH {_R}, {_F} SELECT min(t) AS first, (SELECT max(t) FROM f) AS last FROM r"),
    "F14_latest_day": (f14, f"WITH {_R}, d AS (SELECT station_id, {_DAYS} AS day, max(CASE WHEN user_id % 2 = 0 THEN stage END) AS peak, count(*) FILTER (user_id % 3 = 0) AS n FROM r GROUP BY 1, 2) SELECT station_id, coalesce(max(day) FILTER (peak IS NOT NULL OR n > 0), max(day)) AS latest FROM d GROUP BY 1"),
    "F15_latest_archive_day": (lambda s, p: days_of(s, p).groupBy("station_id").agg(F.greatest(F.max("day"), F.lit("2024-01-20")).alias("latest")), f"WITH {_R} SELECT station_id, greatest(max({_DAYS}), '2024-01-20') AS latest FROM r GROUP BY 1"),
    "H2_historic_candidates": (h2, _H2),
    "H7_alert_order": (h7, f"WITH {_AL} SELECT row_number() OVER (ORDER BY {_PRIO} DESC, cached, seq) AS place, seq, event FROM kp"),
    "I10_cycle_match": (lambda s, p: table(s, p, "orders").select("o_orderkey", T.cycle_id(F.date_format("o_orderdate", "yyyy-MM-dd'T'06:00:00'Z'")).alias("cycle")).join(table(s, p, "lineitem").select(F.date_format("l_shipdate", "yyyyMMdd'T'0600'Z'").alias("cycle")).distinct(), "cycle").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)"),
    "I13_frame_match": (lambda s, p: readings(s, p).join(readings(s, p).where("user_id % 4 <> 0").select("station_id", "t", (F.col("stage") + F.when(F.col("user_id") % 5 == 0, 0.001).otherwise(0.00005)).alias("other")), ["station_id", "t"]).where(F.abs(F.col("stage") - F.col("other")) <= 1e-4).select("seq"), f"WITH {_R} SELECT seq FROM r WHERE user_id % 4 <> 0 AND user_id % 5 <> 0"),
    "J3_live_over_archive": (j3, f"{_J3} SELECT * FROM j"),
    "J4_index_merge": (lambda s, p: j4(s, p), f"WITH {_J4} SELECT * FROM mx"),
    "J7_positional_index": (j7, f"WITH {_IX} SELECT * FROM dx"),
    "J10_live_upsert": (j10, _J10),
    "J11_current_alerts": (lambda s, p: j11(s, p).select("id", "zone", "event", "seq"), f"WITH {_AL} SELECT id, zone, event, seq FROM kp"),
    "J13_manifest_overlay": (lambda s, p: table(s, p, "part").select("p_partkey", F.concat(F.lit("v1-"), "p_partkey").alias("file")).join(table(s, p, "part").where("p_partkey % 6 = 0").select("p_partkey", F.concat(F.lit("v2-"), "p_partkey").alias("new")), "p_partkey", "left").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.coalesce("new", "file")).otherwise(F.col("file")).alias("file")), "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'v2-' ELSE 'v1-' END || p_partkey AS file FROM part"),
    "J14_archive_assembly": (j14, _J14),
    "K1_crest_reading": (k1, f"WITH {_R}, {_crest_sql('r')} SELECT seq, is_crest, put AS stage FROM ck"),
    "K3_crest_by_source": (k3, _K3),
    "O1_backfill_plan": (o1, f"WITH {_R} SELECT seq, coalesce(last_value(CASE WHEN user_id % 4 <> 0 THEN t - 86400000000 END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1704067200000000) AS start, t + CASE WHEN user_id % 4 <> 0 THEN 900000000 ELSE 60000000 END AS next_try FROM r"),
    "O4_forecast_accepted": (o4, _O4),
    "O5_zone_fallback": (lambda s, p: j11(s, p).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.bool_or("from_cache").alias("kept")), f"WITH {_AL} SELECT zone, count(*) AS n, bool_or(cached = 1) AS kept FROM kp GROUP BY 1"),
    "O6_newest_generation": (lambda s, p: Q.precedence(readings(s, p), ["station_id", "user_id"], [F.desc("t"), F.desc("seq")]).select("station_id", "user_id", "seq"), f"WITH {_R} SELECT station_id, user_id, seq FROM r QUALIFY row_number() OVER (PARTITION BY station_id, user_id ORDER BY t DESC, seq DESC) = 1"),
    "O7_cycle_age": (lambda s, p: readings(s, p).select("seq", F.round((1705900000000000 - F.col("t")) / HOUR, 2).alias("age")).select("seq", "age", F.col("age").between(0, 24).alias("fresh")), f"WITH {_R}, a AS (SELECT seq, round((1705900000000000 - t) / 3600000000.0::DOUBLE, 2) AS age FROM r) SELECT seq, age, age BETWEEN 0 AND 24 AS fresh FROM a"),
    "O8_publishable_cycles": (lambda s, p: readings(s, p).groupBy(F.floor(F.col("t") / (6 * HOUR)).alias("cycle")).agg(F.count_distinct(F.when(F.col("station_id").isin("click", "view"), F.col("station_id"))).alias("n")).select("cycle", (F.col("n") == 2).alias("ready")), f"WITH {_R} SELECT t // 21600000000 AS cycle, count(DISTINCT station_id) FILTER (station_id IN ('click', 'view')) = 2 AS ready FROM r GROUP BY 1"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
