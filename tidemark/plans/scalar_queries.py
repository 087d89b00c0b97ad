"""Scalar operators over the driver's tables (sections B, C, Q of the survey), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import readings, table

TH = S.Thresholds()
_R = "r AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) AS t, value AS stage, user_id FROM events)"
_LOCAL = "timezone('America/New_York', timezone('UTC', make_timestamp(t)))"
_SEV = "CASE WHEN stage IS NULL OR stage < 50 THEN 'none' WHEN stage < 113 THEN 'minor' WHEN stage < 224 THEN 'moderate' ELSE 'major' END"
_PEN = "CASE WHEN stage < 50 THEN 0.0 WHEN stage >= 224 THEN 0.0 ELSE greatest(0.0::DOUBLE, (stage - 113.0::DOUBLE) * (stage - 224.0::DOUBLE) * (0.75::DOUBLE / ((50 - 113) * (50 - 224))) + (stage - 50.0::DOUBLE) * (stage - 224.0::DOUBLE) * (0.25::DOUBLE / ((113 - 50) * (113 - 224)))) END"
_PHASE = "CASE user_id % 5 WHEN 0 THEN 'filling' WHEN 1 THEN 'slack' WHEN 2 THEN 'draining-release-15' WHEN 3 THEN 'draining-release-30' ELSE 'draining' END"
_LEFT = f"CASE WHEN ({_PEN}) <= 0 THEN 0.0 WHEN phase IN ('filling', 'slack') THEN 1.0 WHEN phase = 'draining-release-15' THEN CASE WHEN stage < 113 THEN 2.0::DOUBLE / 3 ELSE 0.5 END WHEN phase = 'draining-release-30' THEN CASE WHEN stage < 113 THEN 1.0::DOUBLE / 3 ELSE 0.0 END ELSE 0.0 END"


def _phase():
    names = F.array(*(F.lit(x) for x in ("filling", "slack", "draining-release-15", "draining-release-30", "draining")))
    return F.element_at(names, (F.col("user_id") % 5 + 1).cast("int"))


def _r(expr, name="out"):
    """seq and one expression over readings."""
    return lambda spark, sf: readings(spark, sf).withColumn("phase", _phase()).select("seq", expr().alias(name))


def _sql(expr, name="out"):
    return f"WITH {_R}, p AS (SELECT *, {_PHASE} AS phase FROM r) SELECT seq, {expr} AS {name} FROM p"


_r4 = lambda c: F.round(c, 4)


def _addr():
    return F.concat(F.col("c_custkey") % 97, F.lit(" North "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " Street & Avenue").otherwise(" Road Borough, Apt 3"))


_addr_sql = "((c_custkey % 97) || ' North ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' Street & Avenue' ELSE ' Road Borough, Apt 3' END)"


def _address_sql(x: str, places: str = "") -> str:
    out = f"regexp_replace(lower({x}), '&', ' and ', 'g')"
    for pattern, short in S.STREET_WORDS:
        out = f"regexp_replace({out}, '{pattern}', '{short}', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\\s]', ' ', 'g')"
    if places:
        out = f"regexp_replace({out}, '\\b({places})\\b', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _c(expr, name="out"):
    return lambda spark, sf: table(spark, sf, "customer").select("c_custkey", expr().alias(name))


def _csql(expr, name="out"):
    return f"SELECT c_custkey, {expr} AS {name} FROM customer"


def _a():
    return S.address_text(_addr(), ("borough", "township"))


def _other():
    return S.address_text(F.concat(F.col("c_custkey") % 89, F.lit(" n customer st")))


_A = _address_sql(_addr_sql, "borough|township")
_OTHER = _address_sql("((c_custkey % 89) || ' n customer st')")
_BREAKS = [0.0, 10.0, 20.0, 40.0, 60.0, 90.0, 120.0, 160.0, 200.0, 300.0]

_ENTRIES = {
    "B1_stage_number": (lambda spark, sf: table(spark, sf, "events").select("event_id", S.stage_number(F.get_json_object("props", "$.k")).alias("out")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS out FROM events"),
    "B3_datum": (_r(lambda: _r4(F.col("stage") + TH.datum_offset)), _sql("round(stage + 2.13::DOUBLE, 4)")),
    "B5_severity": (_r(lambda: S.severity(F.col("stage"), TH)), _sql(_SEV)),
    "B6_severity_display_datum": (_r(lambda: S.severity(F.col("stage") + TH.datum_offset, TH)), _sql(_SEV.replace("stage", "(stage + 2.13::DOUBLE)"))),
    "B8_catalog_floor": (_r(lambda: S.catalog_floor(F.col("stage"))), _sql("round(floor((stage + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)")),
    "B9_catalog_stage": (_r(lambda: S.catalog_stage(F.col("stage"))), _sql("round(floor((greatest(0.0, least(20.0, stage)) + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)")),
    "B10_stage_code": (_r(lambda: S.stage_code(S.catalog_stage(F.col("stage")))), _sql("'p' || lpad(CAST(CAST(round(round(floor((greatest(0.0, least(20.0, stage)) + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2) * 10) AS INT) AS VARCHAR), 3, '0')")),
    "B11_attenuation": (_r(lambda: _r4(S.attenuation(F.col("stage"), TH))), _sql(f"round({_PEN}, 4)")),
    "B12_attenuation_left": (_r(lambda: _r4(S.attenuation_left(F.col("stage"), F.col("phase"), TH))), _sql(f"round({_LEFT}, 4)")),
    "B13_connected_depth": (
        lambda spark, sf: readings(spark, sf).withColumn("phase", _phase()).select("seq", S.connected_depth(F.col("stage"), F.col("user_id") / 2, F.col("user_id") % 2 == 0, F.col("phase"), TH).alias("d")).select("seq", _r4("d.raw_depth").alias("raw_depth"), _r4("d.adjusted_stage").alias("adjusted_stage"), _r4("d.depth").alias("depth")),
        f"WITH {_R}, p AS (SELECT *, {_PHASE} AS phase FROM r), q AS (SELECT *, stage - CASE WHEN user_id % 2 = 0 THEN {_PEN} ELSE 0.0 END * ({_LEFT}) AS adjusted FROM p) SELECT seq, round(greatest(0.0::DOUBLE, stage - user_id / 2.0::DOUBLE), 4) AS raw_depth, round(adjusted, 4) AS adjusted_stage, round(greatest(0.0::DOUBLE, CASE WHEN phase LIKE 'draining%' THEN stage ELSE adjusted END - user_id / 2.0::DOUBLE), 4) AS depth FROM q",
    ),
    "B15_depth_band": (_r(lambda: S.band(F.col("stage"), _BREAKS)), _sql(" + ".join(f"CASE WHEN stage >= {b} THEN 1 ELSE 0 END" for b in _BREAKS))),
    "B16_stage_band": (_r(lambda: S.band(F.col("stage"), [TH.minor, TH.moderate, TH.major])), _sql("CASE WHEN stage >= 224 THEN 3 WHEN stage >= 113 THEN 2 WHEN stage >= 50 THEN 1 ELSE 0 END")),
    "B17_step_fraction": (_r(lambda: _r4(S.step_fraction(F.col("stage"), S.catalog_floor(F.col("stage"))))), _sql("round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (stage - round(floor((stage + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)) / 0.1::DOUBLE)), 4)")),
    "B18_transition_blend": (_r(lambda: _r4(S.transition_blend(F.col("user_id") / 150))), "WITH " + _R + ", p AS (SELECT seq, least(1.0::DOUBLE, greatest(0.0::DOUBLE, user_id / 150.0::DOUBLE) * 2) AS x FROM r) SELECT seq, round(x * x * (3 - 2 * x), 4) AS out FROM p"),
    "B20_nice_maximum": (_r(lambda: S.nice_maximum(F.col("stage"))), "WITH " + _R + ", p AS (SELECT seq, greatest(1.0, stage) AS n FROM r), q AS (SELECT *, pow(10.0::DOUBLE, floor(log10(n))) AS m FROM p) SELECT seq, m * CASE WHEN n / m <= 1 THEN 1 WHEN n / m <= 2 THEN 2 WHEN n / m <= 5 THEN 5 ELSE 10 END AS out FROM q"),
    "C1_civil_parts": (
        lambda spark, sf: readings(spark, sf).withColumn("l", S.civil(F.col("t"))).select("seq", F.year("l").alias("y"), F.month("l").alias("m"), F.dayofmonth("l").alias("d"), F.hour("l").alias("h"), F.minute("l").alias("mi")),
        f"WITH {_R}, l AS (SELECT seq, {_LOCAL} AS l FROM r) SELECT seq, year(l) AS y, month(l) AS m, day(l) AS d, hour(l) AS h, minute(l) AS mi FROM l",
    ),
    "C2_civil_iso": (_r(lambda: F.date_format(S.civil(F.col("t")), "yyyy-MM-dd'T'HH:mm")), _sql(f"strftime({_LOCAL}, '%Y-%m-%dT%H:%M')")),
    "C3_civil_to_instants": (
        lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", S.instants(F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 0"), (F.col("o_orderkey") % 4).cast("string"), F.lit(":30:00")))).alias("c")).select("o_orderkey", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("first")),
        "WITH o AS (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 0' || (o_orderkey % 4) || ':30:00' AS TIMESTAMP) AS l FROM orders), c AS (SELECT o_orderkey, l, unnest([4, 5]) AS h FROM o), k AS (SELECT *, timezone('America/New_York', timezone('UTC', l + to_hours(h))) = l AS good FROM c) SELECT o_orderkey, CAST(count(*) FILTER (good) AS INT) AS n, min(epoch_us(l + to_hours(h))) FILTER (good) AS first FROM k GROUP BY 1",
    ),
    "C11_civil_day": (_r(lambda: F.date_format(S.civil_day(F.col("t")), "yyyy-MM-dd")), _sql(f"strftime({_LOCAL}, '%Y-%m-%d')")),
    "Q1_address_text": (_c(lambda: _a()), _csql(_A)),
    "Q5_levenshtein": (_c(lambda: F.levenshtein(_a(), _other())), _csql(f"levenshtein({_A}, {_OTHER})")),
    "Q6_similarity": (_c(lambda: _r4(S.similar(_a(), _other()))), _csql(f"round(1 - levenshtein({_A}, {_OTHER}) / greatest(length({_A}), length({_OTHER}), 1)::DOUBLE, 4)")),
    "Q12_road_name": (_c(lambda: S.road_name(F.concat(F.lit("North "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " Street").otherwise(" Parkway")))), _csql("'N ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' St' ELSE ' Pkwy' END")),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items()}
