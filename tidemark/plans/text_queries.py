"""Texts, labels and named fields over the driver's tables (sections B and Q of the survey), with their DuckDB SQL.

Stand-ins: a customer is an address (key as house number, name as road) or a structure; an event is a reading with fields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import series as O
from ..sources.tables import readings, table
from .scalar_queries import _A, _OTHER, _a, _addr, _addr_sql, _address_sql, _other

_R = "r AS (SELECT event_id AS seq, event_type AS station_id, epoch_us(ts) AS t, value AS stage, user_id FROM events)"
BREAKS = [0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0]


def _r(expr, name="out"):
    return lambda spark, sf: readings(spark, sf).select("seq", expr().alias(name))


def _sql(expr, name="out"):
    return f"WITH {_R} SELECT seq, {expr} AS {name} FROM r"


def _c(expr, name="out"):
    return lambda spark, sf: table(spark, sf, "customer").select("c_custkey", expr().alias(name))


def _csql(expr, name="out"):
    return f"SELECT c_custkey, {expr} AS {name} FROM customer"


def _null_if(cond, c):
    return F.when(~cond, c)


def b2(spark, sf):
    """Readings whose stage stands under one of several names, blank, or under a name that is none of the known ones."""
    k, v = F.col("seq") % 6, F.col("stage").cast("string")
    fields = F.when(k == 0, F.create_map(F.lit("value"), v)).when(k == 1, F.create_map(F.lit("stageFt"), F.lit(" "), F.lit("waterLevel"), v)).when(k == 2, F.create_map(F.lit("hourIndex"), F.lit("7"), F.lit("riverStage"), v))
    fields = fields.when(k == 3, F.create_map(F.lit("stageMllw"), v)).when(k == 4, F.create_map(F.lit("navd88StageFt"), F.lit("NaN"), F.lit("value"), v)).otherwise(F.create_map(F.lit("peakStage"), v, F.lit("note"), F.lit("3")))
    return readings(spark, sf).select("seq", S.named_stage(fields).alias("out"))


def _floor(certified=False):
    k = F.col("c_custkey")
    own = (_null_if(k % 4 == 0, F.col("c_nationkey").cast("double")), _null_if(k % 7 == 0, F.col("c_acctbal") / 1000), F.col("c_nationkey") * 1.5)
    return F.round(S.first_floor(*own, F.when(k % 10 == 3, k % 17 + 0.25) if certified else None), 6)


_FLOOR = "CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 THEN c_nationkey + greatest(0.0::DOUBLE, c_acctbal / 1000) ELSE c_nationkey * 1.5::DOUBLE END"


def _impact():
    return S.structure_impact(_null_if(F.col("user_id") % 9 == 0, F.col("user_id").cast("double")), F.col("stage"))


_BAND_SQL = "CASE " + " ".join(f"WHEN deepest = {i} THEN {('[0.0, ' + ', '.join(map(str, BREAKS)) + ']')}[{i + 1}]" for i in range(10)) + " END"


def _band():
    k = F.col("c_custkey")
    return S.band_label(k % 5, (k % 11 - 1).cast("int"), k % 6 == 0, BREAKS)


_EDGE = "[" + ", ".join(f"'{b:g}'" for b in BREAKS) + "]"
_BAND = f"""CASE WHEN k % 5 = 0 THEN 'Dry' WHEN d < 0 THEN 'Depth unavailable'
WHEN k % 6 = 0 THEN CASE WHEN d > 0 THEN '>=' || {_EDGE}[d] || ' ft' ELSE 'Depth varies' END
WHEN d = 9 THEN '>=' || {_EDGE}[9] || ' ft' ELSE CASE WHEN d = 0 THEN '0' ELSE {_EDGE}[d] END || '-' || {_EDGE}[d + 1] || ' ft' END"""


def _note():
    k = F.col("user_id")
    return S.quality_note(F.element_at(F.array(*(F.lit(x) for x in "MIUC")), (k % 4 + 1).cast("int")), k % 10 == 9, k % 3 == 0, k % 2 == 0, k % 7 == 0)


_Q = "['M', 'I', 'U', 'C'][user_id % 4 + 1]"
_NOTE = f"concat_ws(' . ', CASE WHEN {_Q} = 'I' OR user_id % 10 = 9 THEN 'Interpolated' WHEN {_Q} = 'U' THEN 'Sampling quality not recorded' WHEN {_Q} = 'C' THEN CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN 'USGS storm-tide crest' ELSE 'Calibrated storm replay' END END, CASE WHEN user_id % 7 = 0 THEN 'Replay timing estimated from source tide' END, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'Daily peak only' ELSE 'Daily peak only; peak time unknown' END END)"


def _n():
    return F.when(F.col("c_custkey") % 9 != 0, (F.col("c_custkey") * 7919 % 20011) / F.element_at(F.array(*(F.lit(float(x)) for x in (1, 16, 1024, 65536))), (F.col("c_custkey") % 4 + 1).cast("int")))


_N = "(CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 7919 % 20011) / [1.0, 16.0, 1024.0, 65536.0][c_custkey % 4 + 1]::DOUBLE END)"


def _label_parts():
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    return [F.when(k % 11 == 0, F.concat(F.lit("Label "), k)), F.when(k % 3 != 0, k.cast("string")), F.when(k % 5 != 0, F.col("c_name")), [none, F.when(k % 2 == 0, "Highlands")], F.when(k % 4 != 0, "NJ"), F.when(k % 7 == 0, "07732"), F.lit("address")]


_LABEL = "coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'Label ' || c_custkey END, nullif(concat_ws(', ', nullif(concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END, CASE WHEN c_custkey % 5 <> 0 THEN c_name END), ''), CASE WHEN c_custkey % 2 = 0 THEN 'Highlands' END, CASE WHEN c_custkey % 4 <> 0 THEN 'NJ' END, CASE WHEN c_custkey % 7 = 0 THEN '07732' END), ''), 'address')"


def _score(base):
    return F.round(S.candidate_score(base, _other(), _a()), 4)


_SIM = f"greatest(0.0::DOUBLE, 1 - levenshtein({_OTHER}, {_A}) / greatest(length({_OTHER}), length({_A}), 1)::DOUBLE)"
_SCORE = f"round(c_nationkey / 100.0::DOUBLE + CASE WHEN contains({_A}, {_OTHER}) THEN 0.4 ELSE 0.0 END::DOUBLE + 0.45::DOUBLE * {_SIM} + CASE WHEN starts_with({_A}, (c_custkey % 89)::VARCHAR) THEN 0.15 ELSE 0.0 END::DOUBLE, 4)"


def q8(spark, sf):
    """Candidates of two providers: kept where the type of address is one, the house number agrees and the place is in town."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("c_custkey"), S.house_number(_addr()).alias("house"), F.concat(k % 89, F.lit(" x")).alias("asked"), (k % 3 == 0).alias("arcgis"), F.element_at(F.array(*(F.lit(x) for x in ("PointAddress", "StreetName", "StreetAddress", "POI"))), (k % 4 + 1).cast("int")).alias("kind"), (k % 5 != 0).alias("in_town"), F.when(k % 7 != 0, "road").alias("road"))
    wanted = S.house_number(F.col("asked"))
    kinds = F.when(wanted != "", F.col("kind").isin("PointAddress", "Subaddress", "StreetAddress")).otherwise(F.col("kind").isin("StreetName", "StreetInt"))
    good = F.when(F.col("arcgis"), kinds & (F.col("house") == wanted)).otherwise(F.col("road").isNotNull() & (F.col("house") == wanted))
    return c.where(F.col("in_town") & good).select("c_custkey", "arcgis")


def h8(spark, sf):
    """The best candidate of each query (a nation): of candidates at one place (six decimals) the first only."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.round(40 + (k % 50) / 1000, 6).alias("lat"), F.round(-74 + (k % 40) / 1000, 6).alias("lon"), _score(k % 100 / 100.0).alias("score"))
    first = O.precedence(c, ["c_nationkey", "lat", "lon"], [F.col("c_custkey")])
    return O.precedence(first, ["c_nationkey"], [F.desc("score"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "score")


_H8 = f"WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 50 AS a, c_custkey % 40 AS b, {_SCORE.replace('c_nationkey / 100.0::DOUBLE', 'c_custkey % 100 / 100.0::DOUBLE')} AS score FROM customer), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey, a, b ORDER BY c_custkey) = 1) SELECT c_nationkey, c_custkey, score FROM f QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) = 1"


def _layer():
    k = F.col("p_partkey")
    names = F.array(*(F.lit(x) for x in ("motorway-shield", "primary-name", "residential-name", "cycleway-name", "trunk-shield", "tertiary-line")))
    return S.road_role(F.when(k % 7 != 0, "symbol").otherwise("line"), F.when(k % 5 != 0, "road/label").otherwise("water/label"), F.element_at(names, (k % 6 + 1).cast("int")), k % 11 != 0, k % 3 != 0)


_RANK = "CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 THEN CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 3 <> 0 THEN 150 END WHEN 1 THEN 30 WHEN 2 THEN 0 WHEN 4 THEN CASE WHEN p_partkey % 3 <> 0 THEN 140 END END END"
_PLACES = ("Highlands", "New Jersey", "NJ", "07732")


def _query():
    return F.concat(F.col("c_name"), F.lit("  Street"), F.element_at(F.array(*(F.lit(x) for x in (", Highlands, NJ", " highlands nj 07732", "", ", Elsewhere", ",NJ"))), (F.col("c_custkey") % 5 + 1).cast("int")))


_ENTRIES = {
    "B2_stage_columns": (b2, f"WITH {_R} SELECT seq, CASE WHEN seq % 6 IN (0, 1, 2, 4) THEN stage END AS out FROM r"),
    "B7_clamp": (_r(lambda: S.clamped(F.col("stage"), 0.0, 20.0)), _sql("greatest(0.0, least(20.0, stage))")),
    "B19_depth_text": (_c(lambda: S.depth_text(F.when(F.col("c_custkey") % 9 != 0, (F.col("c_custkey") % 64 - 20) / 7))), _csql("CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN abs(c_custkey % 64 - 20) < 7 THEN regexp_replace(printf('%.1f', (c_custkey % 64 - 20) / 7.0::DOUBLE * 12), '\\.0$', '') || ' in' ELSE printf('%.2f', (c_custkey % 64 - 20) / 7.0::DOUBLE) || ' ft' END")),
    "B21_count_text": (_c(lambda: F.concat_ws("|", S.count_text(_n()), S.interval_text(_n()))), _csql(f"CASE WHEN {_N} IS NULL THEN '-|-' ELSE CASE WHEN {_N} > 0 AND {_N} < 1 THEN '<1' WHEN {_N} >= 100 THEN format('{{{{:,.0f}}}}', {_N}) WHEN {_N} < 10 THEN format('{{{{:,.1f}}}}', {_N}) ELSE format('{{{{:,.0f}}}}', {_N}) END || '|' || CASE WHEN {_N} <= 0 THEN '0' WHEN {_N} < 0.1 THEN '<0.1' WHEN {_N} < 10 THEN format('{{{{:,.1f}}}}', {_N}) ELSE format('{{{{:,.0f}}}}', floor({_N} + 0.5)) END END".replace("{{", "{").replace("}}", "}"))),
    "B22_stage_note": (_r(lambda: S.stage_note(F.col("stage") - 3, S.catalog_stage(F.col("stage") - 3))), _sql("concat_ws('; ', CASE WHEN abs(stage - 3 - round(floor((greatest(0.0, least(20.0, stage - 3)) + 1e-9) / 0.1::DOUBLE) * 0.1::DOUBLE, 2)) > 0.0001::DOUBLE THEN 'rounded down' END, CASE WHEN stage - 3 > 20 THEN 'above range' WHEN stage - 3 < 0 THEN 'below range' END)")),
    "B25_structure_severity": (_r(_impact), _sql("CASE WHEN user_id % 9 = 0 THEN 'unknown' WHEN stage - user_id > 0.1::DOUBLE THEN 'above' WHEN stage - user_id >= -0.5 THEN 'near' ELSE 'below' END")),
    "B26_first_floor": (_c(_floor, "floor"), _csql(f"round({_FLOOR}, 6)", "floor")),
    "B27_certified_floor": (_c(lambda: _floor(True), "floor"), _csql(f"round(CASE WHEN c_custkey % 10 = 3 THEN c_custkey % 17 + 0.25::DOUBLE ELSE {_FLOOR} END, 6)", "floor")),
    "B28_finite_number": (lambda s, p: table(s, p, "part").select("p_partkey", S.stage_number(F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).when(F.col("p_partkey") % 4 == 1, "Infinity").when(F.col("p_partkey") % 4 == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_type"))).alias("out")), "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_size::DOUBLE END AS out FROM part"),
    "B29_frame_hours": (_r(lambda: O.frame_hours(F.when(F.col("user_id") % 4 == 0, F.col("user_id")), F.when(F.col("user_id") % 4 == 1, "15min").when(F.col("user_id") % 4 == 2, "daily"))), _sql("CASE WHEN user_id % 4 = 0 AND user_id > 0 THEN user_id / 60.0::DOUBLE WHEN user_id % 4 = 1 THEN 0.25 WHEN user_id % 4 = 2 THEN 24.0 ELSE 1.0 END")),
    "B30_band_label": (_c(_band), f"SELECT k AS c_custkey, {_BAND} AS out FROM (SELECT c_custkey AS k, c_custkey % 11 - 1 AS d FROM customer)"),
    "B31_quality_note": (_r(_note), _sql(_NOTE)),
    "Q2_without_places": (_c(lambda: S.without_places(_query(), _PLACES)), _csql("c_name || ' Street' || CASE WHEN c_custkey % 5 = 3 THEN ', Elsewhere' ELSE '' END")),
    "Q3_house_number": (_c(lambda: S.house_number(_addr())), _csql(f"lower(regexp_extract(trim({_addr_sql}), '^(\\d+[a-zA-Z]?(?:-\\d+[a-zA-Z]?)?)(?:\\s|,|$)', 1))")),
    "Q4_street_part": (_c(lambda: S.street_part(_addr())), _csql(_address_sql(rf"regexp_replace(split_part({_addr_sql}, ',', 1), '\s+(?:apt|unit|suite|ste)\.?\s+.*$|\s*#.*$', '', 'i')"))),
    "Q7_candidate_score": (_c(lambda: _score(F.col("c_nationkey") / 100)), _csql(_SCORE)),
    "Q8_candidate_filter": (q8, f"WITH c AS (SELECT c_custkey, c_custkey % 3 = 0 AS arcgis, ['PointAddress', 'StreetName', 'StreetAddress', 'POI'][c_custkey % 4 + 1] AS kind FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 97 = c_custkey % 89) SELECT c_custkey, arcgis FROM c WHERE CASE WHEN arcgis THEN kind IN ('PointAddress', 'StreetAddress') ELSE c_custkey % 7 <> 0 END"),
    "Q9_place_text": (_c(lambda: S.names_place([F.when(F.col("c_custkey") % 3 == 0, "Highlands Borough"), F.col("c_name")], F.when(F.col("c_custkey") % 4 == 0, " 07732 "), ("Highlands",), "07732")), _csql("c_custkey % 3 = 0 OR c_custkey % 4 = 0")),
    "Q10_address_label": (_c(lambda: S.address_label(*_label_parts())), _csql(_LABEL)),
    "Q11_road_role": (lambda s, p: table(s, p, "part").select("p_partkey", _layer().alias("r")).select("p_partkey", F.col("r.rank").alias("rank"), F.col("r.major").alias("major"), F.col("r.shield").alias("shield")), f"WITH x AS (SELECT p_partkey, {_RANK} AS rank FROM part) SELECT p_partkey, rank, CASE WHEN rank IS NOT NULL THEN rank > 10 END AS major, CASE WHEN rank IS NOT NULL THEN rank >= 100 END AS shield FROM x"),
    "Q13_event_filter": (lambda s, p: table(s, p, "part").where(F.col("p_type").rlike("(?i)(eco|pro)")).select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(eco|pro)', 'i')"),
    "Q14_html_escape": (_c(lambda: S.html_escaped(F.concat(F.lit("<b a=\"1\" c='&amp;'>"), "c_name", F.lit("</b>")))), _csql("'&lt;b a=&quot;1&quot; c=&#39;&amp;amp;&#39;&gt;' || c_name || '&lt;/b&gt;'")),
    "Q14_html_text": (_c(lambda: S.html_text(F.concat(F.lit("&lt;&amp;lt;&quot;&#39;"), "c_name"))), _csql("'<&lt;\"''' || c_name")),
    "Q15_dynamic_keys": (
        lambda s, p: table(s, p, "events").select("event_id", F.explode(F.map_filter(F.from_json(F.concat(F.lit('{"Stage_'), F.col("user_id") % 3, F.lit('": 1.5, "peakStage": 2, "note": "x", "mllw level": 3, "k": '), F.get_json_object("props", "$.k"), F.lit("}")), "map<string,string>"), lambda k, v: F.lower(k).rlike(S.STAGE_LIKE) & ~F.lower(k).rlike(S.STAGE_UNLIKE) & ~F.lower(k).rlike(S.OTHER_DATUMS))).alias("key", "value")),
        "SELECT event_id, 'Stage_' || (user_id % 3) AS key, '1.5' AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    ),
    "Q16_json_paths": (
        lambda s, p: table(s, p, "events").select("event_id", F.from_json(F.concat(F.lit('{"value": {"timeSeries": [{"name": "'), "event_type", F.lit('", "values": [{"value": [{"value": "'), F.col("value").cast("string"), F.lit('"}, {"value": "-"}]}]}]}}')), "value struct<timeSeries: array<struct<name: string, values: array<struct<value: array<struct<value: string>>>>>>>").alias("j")).select("event_id", F.explode("j.value.timeSeries").alias("s")).select("event_id", F.col("s.name").alias("station"), F.explode(F.flatten(F.transform("s.values", lambda v: v["value"]))).alias("v")).select("event_id", "station", S.stage_number(F.col("v.value")).alias("stage")).where("stage IS NOT NULL"),
        "SELECT event_id, event_type AS station, value AS stage FROM events",
    ),
    "H8_best_candidate": (h8, _H8),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
