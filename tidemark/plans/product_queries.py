"""Issued products, guidance and contracts (sections R, P and B of the survey), with their DuckDB SQL.

Stand-ins: a zone is an event type, a product its readings by user; files are parts, whose type is their content.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import products as P
from ..operators import series as Q
from ..sources.tables import HOUR, daily_peaks, readings, table

_R = "r AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) AS t, value AS stage, user_id FROM events)"
NOW = 1706400000000000
CYCLE = 1706140800000000
_LEADS = S.LEADS


def issued(spark, sf):
    k = F.col("seq")
    names = F.array(*(F.lit(x) for x in ("mean", "lowEnd", "highEnd", "other")))
    return readings(spark, sf).select(F.col("station_id").alias("zone"), F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("scenario"), k.alias("i"), "t", F.when(k % 3 == 0, F.col("t") + HOUR).alias("source_t"), F.when(k % 97 == 0, 9999.0).otherwise(F.col("stage") / 10 + 0.0003).alias("value"), F.when(k % 5 == 0, 2.0).otherwise(1.0).alias("scale"), F.when(k % 4 == 0, "NAVD88").when(k % 4 == 3, "other").otherwise("mllw").alias("datum"))


_IS = "s AS (SELECT station_id AS zone, ['mean', 'lowEnd', 'highEnd', 'other'][user_id % 4 + 1] AS scenario, seq AS i, t, CASE WHEN seq % 3 = 0 THEN t + 3600000000 END AS source_t, CASE WHEN seq % 97 = 0 THEN 9999.0 ELSE stage / 10 + 0.0003::DOUBLE END AS value, CASE WHEN seq % 5 = 0 THEN 2.0 ELSE 1.0 END AS scale, CASE WHEN seq % 4 = 0 THEN 'NAVD88' WHEN seq % 4 = 3 THEN 'other' ELSE 'mllw' END AS datum FROM r)"
_LV = "v AS (SELECT *, abs(value * scale) < 9999 AND datum <> 'other' AS good, CASE WHEN datum = 'mllw' THEN value * scale - 2.13::DOUBLE ELSE value * scale END AS navd, CASE WHEN datum = 'mllw' THEN value * scale ELSE value * scale + 2.13::DOUBLE END AS mllw FROM s WHERE scenario <> 'other')"


def r1(spark, sf):
    out = P.selected_products(issued(spark, sf), -2.13, 0.0, 20.0, 0.5)
    return out.select("zone", "scenario", "product", "i", "t", F.round(F.col("navd") + 1e-6, 1).alias("navd"), F.round(F.col("mllw") + 1e-6, 1).alias("mllw"), "clamped")


_R1 = f"WITH {_R}, {_IS}, {_LV} SELECT zone, scenario, CASE scenario WHEN 'mean' THEN 'TWL' WHEN 'lowEnd' THEN 'TWL90p' ELSE 'TWL10p' END AS product, i, coalesce(source_t, t) AS t, CASE WHEN good THEN round(round(navd, 2) + 1e-6, 1) + 0.0::DOUBLE END AS navd, CASE WHEN good THEN round(round(mllw, 2) + 1e-6, 1) + 0.0::DOUBLE END AS mllw, CASE WHEN good THEN round(navd, 2) < 0 OR round(navd, 2) > 20 END AS clamped FROM v"


def _curve(lead, i):
    out = "NULL"
    for lo, hi in reversed(list(zip(_LEADS, _LEADS[1:]))):
        out = f"CASE WHEN {lead} BETWEEN {lo[0]} AND {hi[0]} THEN {lo[i]}::DOUBLE + ({lead} - {lo[0]}) / {hi[0] - lo[0]} * ({hi[i]}::DOUBLE - {lo[i]}::DOUBLE) ELSE {out} END"
    return out


def _lead():
    return (F.col("t") - CYCLE) / HOUR


_LEAD = f"((t - {CYCLE}) / 3600000000.0::DOUBLE)"


def products_of(spark, sf):
    """Mean and low rows of a zone by hour, with the tide; two zones have a local adjustment and raw levels at source instants."""
    r = readings(spark, sf).withColumn("h", F.floor(F.col("t") / HOUR) * HOUR)
    m = r.groupBy(F.col("station_id").alias("zone"), F.col("h").alias("t")).agg((F.max("stage") / 20).alias("level"), (F.min("stage") / 20).alias("lo"))
    base = m.select("zone", F.lit(CYCLE).alias("cycle"), "t", (F.col("t") - 2 * HOUR).alias("source_t"), "level", (F.col("level") - 0.5).alias("raw"), (F.col("lo") * 0.5).alias("tide"), "lo")
    low = base.where(F.col("t") / HOUR % 3 != 0).select("zone", "cycle", "t", "source_t", F.col("lo").alias("level"), (F.col("lo") - 0.5).alias("raw"))
    return base.drop("lo"), low


def _adjusted():
    return F.length("zone") % 2 == 0


def r3(spark, sf):
    mean, low = products_of(spark, sf)
    return P.guidance_rows(mean, low, _adjusted(), F.lit(0.25))


_G = f"""WITH {_R}, m AS (SELECT station_id AS zone, t // 3600000000 * 3600000000 AS t, max(stage) / 20 AS level, min(stage) / 20 AS lo FROM r GROUP BY 1, 2), b AS (SELECT *, t - 7200000000 AS source_t, level - 0.5::DOUBLE AS raw, lo * 0.5::DOUBLE AS tide, length(zone) % 2 = 0 AS adj FROM m),
u AS (SELECT zone, t, adj, CASE WHEN adj THEN source_t ELSE t END AS ata, CASE WHEN adj THEN raw ELSE level END AS used, tide FROM b), l AS (SELECT zone, CASE WHEN adj THEN source_t ELSE t END AS ata, CASE WHEN adj THEN lo - 0.5::DOUBLE ELSE lo END AS low FROM b WHERE (t // 3600000000) % 3 <> 0),
j AS (SELECT u.*, l.low, (u.ata - {CYCLE}) / 3600000000.0::DOUBLE AS lead FROM u LEFT JOIN l USING (zone, ata)), c AS (SELECT *, tide + ({_curve('lead', 1)}) * (used - tide) + ({_curve('lead', 2)}) AS central, {_curve('lead', 3)} AS q FROM j),
z AS (SELECT zone, t, adj, used, low, q, CASE WHEN NOT adj OR low IS NOT NULL THEN central END AS central FROM c), w AS (SELECT zone, t, central IS NOT NULL AS available, CASE WHEN adj THEN 0.25 ELSE 0.0 END::DOUBLE AS d, central, used, q, CASE WHEN central IS NOT NULL AND low <= used + 0.05::DOUBLE THEN low END AS tail FROM z)"""


def p2(spark, sf):
    """A gauge's published files against its profile, at a fixed time."""
    one = readings(spark, sf).groupBy(F.col("station_id").alias("key")).agg(F.max("t").alias("latest"), (F.max("t") + 40 * HOUR).alias("end"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("t"))).alias("issued"))
    rules = {"latest": P.age_ok(F.col("latest"), NOW, 100), "issued": P.age_ok(F.col("issued"), NOW, 18), "coverage": F.col("end") >= NOW + 48 * HOUR, "statistic": F.col("key") != "error"}
    return P.checks(one, rules)


_AGE = "(({0}) BETWEEN -1800000000 AND {1} * 3600000000)"
_P2 = f"WITH {_R}, k AS (SELECT station_id AS key, max(t) AS latest, max(t) + 144000000000 AS e, max(CASE WHEN user_id % 2 = 0 THEN t END) AS issued FROM r GROUP BY 1) SELECT key, c AS \"check\", CASE c WHEN 'latest' THEN {_AGE.format(f'{NOW} - latest', 100)} WHEN 'issued' THEN {_AGE.format(f'{NOW} - issued', 18)} WHEN 'coverage' THEN e >= {NOW} + 172800000000 ELSE key <> 'error' END AS passed FROM k, (VALUES ('latest'), ('issued'), ('coverage'), ('statistic')) v(c)"


def p7(spark, sf):
    p = table(spark, sf, "part")
    files = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")).cast("binary").alias("content"))
    return P.digests_agree(files, p.select(F.col("p_partkey").cast("string").alias("name"), F.sha2("p_type", 256).alias("sha256"), F.octet_length("p_type").alias("bytes")))


def p8(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    stages = c.where(k % 9 != 0).select(k.alias("parcel"), F.sequence(F.lit(1), F.when(k % 10 == 0, 4).otherwise(5)).alias("stages"))
    ends = c.where(k % 8 != 0).select(k.alias("parcel"), F.sequence(F.lit(1), F.when(k % 12 == 0, 3).otherwise(2)).alias("stages"))
    return P.share_faults(stages, ends, 5)


_P8 = "WITH k AS (SELECT c_custkey AS k FROM customer) SELECT k AS parcel, 'width' AS fault FROM k WHERE k % 9 <> 0 AND k % 10 = 0 UNION ALL SELECT k, 'ends' FROM k WHERE k % 8 <> 0 AND k % 12 = 0 UNION ALL SELECT k, 'without ends' FROM k WHERE k % 9 <> 0 AND k % 8 = 0 UNION ALL SELECT k, 'unknown' FROM k WHERE k % 9 = 0 AND k % 8 <> 0"


def p9(spark, sf):
    """Terrain tiles (parts) against their manifest: digest, reference system, spacing, size."""
    k = F.col("p_partkey")
    one = table(spark, sf, "part").select(k.alias("key"), (k % 11 != 0).alias("digest"), F.when(k % 7 == 0, "EPSG:4326").otherwise("EPSG:6527").alias("crs"), F.when(k % 5 == 0, 10.0).otherwise(5.0).alias("spacing"), (F.col("p_size") - 1).alias("width"))
    return P.checks(one, {"digest": F.col("digest"), "crs": F.col("crs") == "EPSG:6527", "spacing": F.abs(F.col("spacing") - 5) < 1e-9, "size": F.col("width") > 0}).where("NOT passed").select("key", "check")


def f21(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("parcels"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("matched"), F.max("c_custkey").alias("last"))


def r2(spark, sf):
    """Payloads of one forecast or of several zones (an order of each customer by status), as rows by zone."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("z")).agg(F.max("o_totalprice").alias("v"))
    files = o.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("z", "v"))).alias("zones"), F.max("v").alias("forecast"))
    return P.zones(files.withColumn("zones", F.when(F.col("file") % 2 == 0, F.col("zones"))))


_ENTRIES = {
    "B4_issued_levels": (lambda s, p: issued(s, p).select("i", S.issued_level(F.col("value"), F.col("scale"), F.col("datum"), -2.13, 0.0, 20.0, 0.5).alias("l")).select("i", F.round(F.col("l.navd") + 1e-6, 1).alias("navd"), F.col("l.clamped").alias("clamped")), f"WITH {_R}, {_IS}, {_LV.replace(' WHERE scenario <> ' + chr(39) + 'other' + chr(39), '')} SELECT i, CASE WHEN good THEN round(round(navd, 2) + 1e-6, 1) + 0.0::DOUBLE END AS navd, CASE WHEN good THEN round(navd, 2) < 0 OR round(navd, 2) > 20 END AS clamped FROM v"),
    "B14_water_surface": (lambda s, p: readings(s, p).select("seq", F.round(S.water_surface(F.col("stage"), F.lit("slack"), S.Thresholds()), 4).alias("out")), f"WITH {_R} SELECT seq, round(stage - CASE WHEN stage < 50 OR stage >= 224 THEN 0.0 ELSE greatest(0.0::DOUBLE, (stage - 113) * (stage - 224) * (0.75::DOUBLE / ((50 - 113) * (50 - 224))) + (stage - 50) * (stage - 224) * (0.25::DOUBLE / ((113 - 50) * (113 - 224)))) END, 4) AS out FROM r"),
    "B23_lead_coefficients": (lambda s, p: readings(s, p).select("seq", S.lead_coefficients(_lead()).alias("c")).select("seq", *(F.round(f"c.{n}", 6).alias(n) for n in ("gain", "offset", "q25"))), f"WITH {_R} SELECT seq, round({_curve(_LEAD, 1)}, 6) AS gain, round({_curve(_LEAD, 2)}, 6) AS \"offset\", round({_curve(_LEAD, 3)}, 6) AS q25 FROM r"),
    "B24_guidance": (lambda s, p: readings(s, p).select("seq", S.guidance(_lead(), F.col("stage") / 10, F.col("user_id") / 20, F.when(F.col("user_id") % 3 != 0, F.col("stage") / 11)).alias("g")).select("seq", *(F.round(F.col(f"g.{c}") + 1e-6, 2).alias(c) for c in ("central", "shifted", "quartile"))), f"WITH {_R}, c AS (SELECT *, user_id / 20.0::DOUBLE + ({_curve(_LEAD, 1)}) * (stage / 10 - user_id / 20.0::DOUBLE) + ({_curve(_LEAD, 2)}) AS c, {_curve(_LEAD, 3)} AS q, CASE WHEN user_id % 3 <> 0 AND stage / 11 <= stage / 10 + 0.05::DOUBLE THEN stage / 11 END AS low FROM r) SELECT seq, round(round(c, 3) + 1e-6, 2) AS central, round(round(c + (low - stage / 10), 3) + 1e-6, 2) AS shifted, round(round(c + q + 0.1::DOUBLE * (low - stage / 10), 3) + 1e-6, 2) AS quartile FROM c"),
    "F21_build_report": (f21, "SELECT c_nationkey, count(*) AS parcels, count(*) FILTER (c_acctbal > 0) AS matched, max(c_custkey) AS last FROM customer GROUP BY 1"),
    "P2_profile": (p2, _P2),
    "P5_band_faults": (lambda s, p: P.band_faults(table(s, p, "customer").select("c_custkey", (F.col("c_custkey") % 20 - 1.0).alias("estimate"), (F.col("c_custkey") % 7).cast("double").alias("lower"), (F.col("c_custkey") % 11).cast("double").alias("upper")), 15.0).select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 20 - 1 BETWEEN 0 AND 15) OR c_custkey % 7 > c_custkey % 11"),
    "P5_axis_faults": (lambda s, p: P.axis_faults(table(s, p, "orders").select((F.col("o_custkey") % 50).alias("axis"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("value")), "axis"), "SELECT o_custkey % 50 AS axis, o_orderkey AS i FROM orders QUALIFY o_totalprice <= lag(o_totalprice) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)"),
    "P6_product_faults": (lambda s, p: P.product_faults(issued(s, p).where(~((F.col("zone") == "view") & (F.col("scenario") == "highEnd")))), f"WITH {_R}, {_IS}, y AS (SELECT * FROM s WHERE NOT (zone = 'view' AND scenario = 'highEnd')) SELECT z.zone, c AS scenario, 'missing' AS fault FROM (SELECT DISTINCT zone FROM y) z, (VALUES ('mean'), ('lowEnd'), ('highEnd')) v(c) WHERE (z.zone, c) NOT IN (SELECT (zone, scenario) FROM y) UNION ALL SELECT DISTINCT zone, scenario, 'invalid' FROM y WHERE abs(value * scale) >= 9999"),
    "P7_digest_faults": (p7, "SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 11 = 0 THEN 'missing' ELSE 'digest' END AS fault FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0"),
    "P8_share_faults": (p8, _P8),
    "P9_terrain_guard": (p9, "SELECT p_partkey AS key, c AS \"check\" FROM part, (VALUES ('digest'), ('crs'), ('spacing'), ('size')) v(c) WHERE CASE c WHEN 'digest' THEN p_partkey % 11 = 0 WHEN 'crs' THEN p_partkey % 7 = 0 WHEN 'spacing' THEN p_partkey % 5 = 0 ELSE p_size <= 1 END"),
    "P10_expectations": (lambda s, p: P.checks(daily_peaks(s, p).groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("hi")), {"rows": F.col("n") > 100, "height": F.col("hi") < 400000}), "WITH k AS (SELECT o_custkey % 3 AS key, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT key, c AS \"check\", CASE c WHEN 'rows' THEN n > 100 ELSE hi < 400000 END AS passed FROM k, (VALUES ('rows'), ('height')) v(c)"),
    "R1_selected_products": (r1, _R1),
    "R2_zones": (r2, "SELECT o_custkey AS file, o_orderstatus AS zone, max(o_totalprice) AS forecast FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT o_custkey, 'default', max(o_totalprice) FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1"),
    "R3_guidance_rows": (lambda s, p: r3(s, p).select("zone", "t", "available", *(F.round(F.col(c) + 1e-6, 2).alias(c) for c in ("central", "shifted", "quartile"))), f"{_G} SELECT zone, t, available, round(round(round(central, 3) + d, 3) + 1e-6, 2) AS central, round(round(round(central + (tail - used), 3) + d, 3) + 1e-6, 2) AS shifted, round(round(round(central + q + 0.1::DOUBLE * (tail - used), 3) + d, 3) + 1e-6, 2) AS quartile FROM w"),
    "R3_zone_status": (lambda s, p: P.zone_status(r3(s, p), F.col("zone") != "view"), f"{_G} SELECT zone, CASE WHEN bool_or(available) THEN CASE WHEN zone <> 'view' THEN 'experimental' ELSE 'stale' END ELSE 'unavailable' END AS status FROM w GROUP BY zone"),
    "R4_without_low_end": (lambda s, p: P.guidance_rows(products_of(s, p)[0], products_of(s, p)[1].limit(0), F.lit(False), F.lit(0.0)).groupBy("zone").agg(F.count(F.when(F.col("available"), 1)).alias("central"), F.count("quartile").alias("quartiles")), f"{_G.replace('length(zone) % 2 = 0 AS adj', 'false AS adj')} SELECT zone, count(*) FILTER (available) AS central, 0 AS quartiles FROM w GROUP BY 1"),
    "R5_zone_list": (lambda s, p: r2(s, p).groupBy("zone").agg(F.count(F.lit(1)).alias("files")), "WITH z AS (SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'default' END AS zone FROM orders) SELECT zone, count(*) AS files FROM z GROUP BY 1"),
    "R7_return_level": (lambda s, p: table(s, p, "part").select("p_partkey", F.posexplode(F.array(*(F.lit(y) for y in (1, 2, 5, 10, 20, 50, 100)))).alias("i", "years"), "p_retailprice").where(F.col("years") == F.element_at(F.array(F.lit(5), F.lit(100), F.lit(7)), (F.col("p_partkey") % 3 + 1).cast("int"))).select("p_partkey", "years"), "SELECT p_partkey, [5, 100][p_partkey % 3 + 1] AS years FROM part WHERE p_partkey % 3 < 2"),
    "R9_structure_exceedance": (lambda s, p: Q.exceeded(readings(s, p), "stage", table(s, p, "customer"), "c_custkey", F.col("c_acctbal") / 100 + 0.1), f"WITH {_R}, t AS (SELECT c_custkey, c_acctbal / 100 + 0.1::DOUBLE AS a FROM customer) SELECT c_custkey, (SELECT count(*) FROM r WHERE stage > t.a) AS n FROM t"),
    "R8_published_levels": (lambda s, p: table(s, p, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(y).alias("years"), (F.col("p_retailprice") / 1000 + i * 0.1).alias("metres")) for i, y in enumerate((1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000))))).alias("l")).select("p_partkey", "l.years", F.round(F.col("l.metres") * 3.280839895, 4).alias("feet")), "SELECT p_partkey, y AS years, round((p_retailprice / 1000 + i * 0.1::DOUBLE) * 3.280839895::DOUBLE, 4) AS feet FROM part, (VALUES (0, 1), (1, 2), (2, 5), (3, 10), (4, 20), (5, 50), (6, 100), (7, 200), (8, 500), (9, 1000), (10, 2000), (11, 5000), (12, 10000)) v(i, y)"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
