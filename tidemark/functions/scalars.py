"""Column expressions: stages, datums, attenuation, phases, civil time and address text. No Python runs per row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


@dataclass(frozen=True)
class Thresholds:
    """Flood thresholds and the attenuation at each of them."""

    minor: float = 50.0
    moderate: float = 113.0
    major: float = 224.0
    at_minor: float = 0.75
    at_moderate: float = 0.25
    at_major: float = 0.0
    datum_offset: float = 2.13


def stage_number(text: Column) -> Column:
    """A finite number or null; blank, NaN and infinite texts are null."""
    x = F.trim(text).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def severity_rank(stage: Column, th: Thresholds) -> Column:
    return F.when(stage.isNull() | F.isnan(stage) | (stage < th.minor), 0).when(stage < th.moderate, 1).when(stage < th.major, 2).otherwise(3)


def severity(stage: Column, th: Thresholds) -> Column:
    names = F.array(*(F.lit(x) for x in ("none", "minor", "moderate", "major")))
    return F.element_at(names, severity_rank(stage, th) + 1)


def catalog_floor(stage: Column) -> Column:
    return F.round(F.floor((stage + 1e-9) / F.lit(0.1)) * F.lit(0.1), 2)


def catalog_stage(stage: Column, low: float = 0.0, high: float = 20.0) -> Column:
    return F.when(stage.isNotNull(), catalog_floor(F.greatest(F.lit(low), F.least(F.lit(high), stage))))


def stage_code(stage: Column) -> Column:
    tenths = F.round(F.abs(stage) * 10).cast("int").cast("string")
    return F.concat(F.when(stage < 0, "m").otherwise("p"), F.when(F.length(tenths) < 3, F.lpad(tenths, 3, "0")).otherwise(tenths))


def attenuation(stage: Column, th: Thresholds) -> Column:
    """The parabola through the three anchors, 0 below the first, never negative."""
    x = (th.minor, th.moderate, th.major)
    y = (th.at_minor, th.at_moderate, th.at_major)
    total = F.lit(0.0)
    for i in range(3):
        j, k = (m for m in range(3) if m != i)
        total = total + (stage - x[j]) * (stage - x[k]) * (y[i] / ((x[i] - x[j]) * (x[i] - x[k])))
    return F.when(stage < th.minor, 0.0).when(stage >= th.major, th.at_major).otherwise(F.greatest(F.lit(0.0), total))


def attenuation_left(stage: Column, phase: Column, th: Thresholds) -> Column:
    """Share of the attenuation that still holds in a phase."""
    low = stage < th.moderate
    return (
        F.when(attenuation(stage, th) <= 0, 0.0)
        .when(phase.isin("filling", "slack"), 1.0)
        .when(phase == "draining-release-15", F.when(low, 2 / 3).otherwise(0.5))
        .when(phase == "draining-release-30", F.when(low, 1 / 3).otherwise(0.0))
        .otherwise(0.0)
    )


def connected_depth(stage: Column, ground: Column, developed: Column, phase: Column, th: Thresholds) -> Column:
    """struct(raw_depth, adjusted_stage, surface, depth)."""
    adjusted = stage - F.when(developed, attenuation(stage, th)).otherwise(0.0) * attenuation_left(stage, phase, th)
    surface = F.when(phase.startswith("draining"), stage).otherwise(adjusted)
    return F.struct(F.greatest(F.lit(0.0), stage - ground).alias("raw_depth"), adjusted.alias("adjusted_stage"), surface.alias("surface"), F.greatest(F.lit(0.0), surface - ground).alias("depth"))


def band(x: Column, breaks: list[float]) -> Column:
    """Half-open bands [lo, hi): how many breaks are at or below x."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in breaks), F.lit(0))


# Names under which a reading's stage may stand, in order; the rule for any other name.
STAGE_NAMES = ["navd88StageFt", "stageFt", "value", "waterLevel", "waterLevelFt", "waterLevelNAVD88", "waterLevelNavd88", "navd88", "NAVD88", "navd88_ft", "navd88Ft", "stage_navd88_ft", "stageNAVD88", "stageNavd88", "water_level", "water_level_ft", "water_level_navd88", "wl_navd88_ft"]
STAGE_LIKE, STAGE_UNLIKE, OTHER_DATUMS = "navd|stage|water|level|height", "peak|max|min|hour|index|rank|date|time|class|source", "mllw|mhhw|mhw|mlw|msl|ngvd"


def named_stage(fields: Column) -> Column:
    """The stage of a reading given as a map of texts: the first known name that holds a finite number, else the first other
    name that sounds like a stage of this datum."""
    known = [stage_number(F.try_element_at(fields, F.lit(n))) for n in STAGE_NAMES]
    name = lambda k: F.lower(k)
    rest = F.filter(F.map_entries(fields), lambda e: name(e["key"]).rlike(STAGE_LIKE) & ~name(e["key"]).rlike(STAGE_UNLIKE) & ~name(e["key"]).rlike(OTHER_DATUMS) & stage_number(e["value"]).isNotNull())
    return F.coalesce(*known, stage_number(F.get(rest, F.lit(0))["value"]))


def clamped(stage: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), stage))


def stage_note(raw: Column, matched: Column, low: float = 0.0, high: float = 20.0) -> Column:
    """What to say of a stage that is shown by another one: not exact, above or below the published range; '' if neither."""
    differs = F.when(F.abs(raw - matched) > 0.0001, "rounded down")
    clamp = F.when(raw > high, "above range").when(raw < low, "below range")
    return F.when(raw.isNull() | matched.isNull(), "").otherwise(F.concat_ws("; ", differs, clamp))


def short_number(x: Column, digits: int) -> Column:
    """At most ``digits`` decimals, without zeros at the end."""
    text = F.regexp_replace(F.format_number(x, digits), ",", "")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def depth_text(feet: Column, digits: int = 2) -> Column:
    """Inches to one decimal below a foot, else feet; N/A for none."""
    finite = F.abs(feet) < float("inf")
    return F.when(~F.coalesce(finite, F.lit(False)), "N/A").when(F.abs(feet) < 1, F.concat(short_number(feet * 12, 1), F.lit(" in"))).otherwise(F.concat(F.regexp_replace(F.format_number(feet, digits), ",", ""), F.lit(" ft")))


def count_text(n: Column) -> Column:
    """An expected count: <1, one decimal below ten, none below a hundred, then grouped by thousands."""
    return F.when(n.isNull() | F.isnan(n), "-").when((n > 0) & (n < 1), "<1").when(n >= 100, F.format_number(n, 0)).when(n < 10, F.format_number(n, 1)).otherwise(F.format_number(n, 0))


def interval_text(n: Column) -> Column:
    return F.when(n.isNull() | F.isnan(n), "-").when(n <= 0, "0").when(n < 0.1, "<0.1").when(n < 10, F.format_number(n, 1)).otherwise(F.format_number(F.floor(n + 0.5), 0))


def structure_impact(floor: Column, stage: Column) -> Column:
    """How water stands to a first floor: above it, near it, below it, or unknown."""
    over = stage - floor
    return F.when(over.isNull(), "unknown").when(over > 0.1, "above").when(over >= -0.5, "near").otherwise("below")


def first_floor(ground: Column, foundation: Column, modelled: Column, certified: Column | None = None) -> Column:
    """A certified floor, else ground and foundation (never below it), else the modelled floor."""
    own = F.coalesce(F.when(foundation.isNotNull(), ground + F.greatest(F.lit(0.0), foundation)), modelled)
    return own if certified is None else F.coalesce(certified, own)


def band_label(wet: Column, deepest: Column, unresolved: Column, breaks: list[float]) -> Column:
    """What to say of a parcel's deepest band (-1: none of the palette's)."""
    edge = F.array(*(F.lit(float(b)) for b in breaks))
    low, high = F.when(deepest > 0, F.get(edge, deepest - 1)).otherwise(0.0), F.get(edge, deepest)
    text = lambda c: short_number(c, 2)
    least = F.concat(F.lit(">="), text(low), F.lit(" ft"))
    return F.when(wet == 0, "Dry").when(deepest < 0, "Depth unavailable").when(unresolved, F.when(low > 0, least).otherwise("Depth varies")).when(high.isNull(), least).otherwise(F.concat(text(low), F.lit("-"), text(high), F.lit(" ft")))


def quality_note(quality: Column, interpolated: Column, peak_only: Column, time_known: Column, estimated: Column) -> Column:
    """The remarks on a reading, in order, by a dot."""
    told = F.when((quality == "I") | interpolated, "Interpolated").when(quality.isin("U", "unknown"), "Sampling quality not recorded").when(quality == "C", F.when(peak_only & time_known, "USGS storm-tide crest").otherwise("Calibrated storm replay"))
    peak = F.when(peak_only, F.when(time_known, "Daily peak only").otherwise("Daily peak only; peak time unknown"))
    return F.concat_ws(" . ", told, F.when(estimated, "Replay timing estimated from source tide"), peak)


def water_surface(stage: Column, phase: Column, th: Thresholds) -> Column:
    """The stage less the attenuation that is left in the phase."""
    return stage - attenuation(stage, th) * attenuation_left(stage, phase, th)


def issued_level(value: Column, scale: Column, datum: Column, offset: float, low: float, high: float, step: float) -> Column:
    """struct(navd, mllw, matched, clamped) of an issued level of either datum; null for another datum or a level that is none."""
    level = value * scale
    good = (F.abs(level) < 9999) & F.upper(datum).isin("MLLW", "NAVD88")
    navd, mllw = F.when(F.upper(datum) == "MLLW", level + offset).otherwise(level), F.when(F.upper(datum) == "MLLW", level).otherwise(level - offset)
    shown = F.round(navd, 2)
    matched = F.greatest(F.lit(low), F.least(F.lit(high), F.round(shown / step) * step))
    return F.when(good, F.struct(shown.alias("navd"), F.round(mllw, 2).alias("mllw"), F.format_number(matched, 1).alias("matched"), ((shown < low) | (shown > high)).alias("clamped")))


# Lead hours with the gain, the offset in feet and the offset of the lower quartile.
LEADS = [(12.0, 0.69, 0.17639, -0.201845), (24.0, 0.60, 0.23020, -0.217000), (48.0, 0.57, 0.24387, -0.220760), (72.0, 0.56, 0.24668, -0.230950)]


def lead_coefficients(lead: Column) -> Column:
    """struct(gain, offset, q25) by straight lines between the leads; null outside of them."""
    out = F.lit(None)
    for lo, hi in reversed(list(zip(LEADS, LEADS[1:]))):
        part = (lead - lo[0]) / (hi[0] - lo[0])
        line = F.struct(*((F.lit(lo[i]) + part * (hi[i] - lo[i])).alias(n) for i, n in ((1, "gain"), (2, "offset"), (3, "q25"))))
        out = F.when((lead >= lo[0]) & (lead <= hi[0]), line).otherwise(out)
    return out


def guidance(lead: Column, mean: Column, tide: Column, low: Column) -> Column:
    """struct(central, low, shifted, quartile): the mean moved by what past leads have shown; the low end only where it does
    not stand above the mean. Null without a supported lead, a mean and a tide."""
    c = lead_coefficients(lead)
    central = tide + c["gain"] * (mean - tide) + c["offset"]
    tail = low <= mean + 0.05
    return F.when(
        central.isNotNull(),
        F.struct(F.round(central, 3).alias("central"), F.when(tail, F.round(low, 3)).alias("low"), F.when(tail, F.round(central + (low - mean), 3)).alias("shifted"), F.when(tail, F.round(central + c["q25"] + 0.1 * (low - mean), 3)).alias("quartile")),
    )


def step_fraction(raw: Column, lower: Column, step: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - lower) / step))


def transition_blend(fraction: Column) -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction) * 2)
    return x * x * (3 - 2 * x)


def nice_maximum(x: Column) -> Column:
    n = F.greatest(F.lit(1.0), F.coalesce(x, F.lit(1.0)))
    scale = F.pow(F.lit(10.0), F.floor(F.log10(n)))
    share = n / scale
    return scale * F.when(share <= 1, 1).when(share <= 2, 2).when(share <= 5, 5).otherwise(10)


def civil(t: Column, zone: str = ZONE) -> Column:
    """Civil timestamp of an instant in microseconds."""
    return F.from_utc_timestamp(F.timestamp_micros(t), zone)


def civil_day(t: Column, zone: str = ZONE) -> Column:
    return F.to_date(civil(t, zone))


def instants(local: Column, zone: str = ZONE, offsets_h: tuple[int, ...] = (4, 5)) -> Column:
    """The 0, 1 or 2 instants (microseconds) that show a civil timestamp: candidates that come back to it."""
    micros = F.unix_micros(local)
    tries = F.array(*(micros + h * 3_600_000_000 for h in offsets_h))
    return F.filter(tries, lambda m: F.unix_micros(civil(m, zone)) == micros)


# Month names.
MONTHS = "january february march april may june july august september october november december".split()


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """A date of the calendar, or null; nothing rolls over."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))


def _groups(text: Column, pattern: str, *order: int) -> list[Column]:
    return [F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i)) for i in order]


def _month_number(name: Column) -> Column:
    """1 to 12 of a month's whole name or its first three letters (and sept), else null."""
    name = F.regexp_replace(F.lower(name), "^sept$", "sep")
    full = F.array(*(F.lit(m) for m in MONTHS))
    place = F.array_position(F.transform(full, lambda m: (m == name) | (F.substring(m, 1, 3) == name)), F.lit(True))
    return F.when(place > 0, place.cast("string"))


def typed_date(text: Column, year: int = 2024) -> Column:
    """A real calendar date of what a person types, or null: year first, month first with two, four or no digits of a year
    (``year`` then), a named month first or after the day."""
    text = F.trim(text)
    y, m, d = _groups(text, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 1, 2, 3)
    m2, d2, y2 = _groups(text, r"^(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?$", 1, 2, 3)
    n2 = F.when(y2 == "", F.lit(year)).otherwise(y2.try_cast("int"))
    m3, d3, y3 = _groups(text, r"^(?i)([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$", 1, 2, 3)
    d4, m4, y4 = _groups(text, r"^(?i)(\d{1,2})\s+([a-z]+)\.?,?\s+(\d{4})$", 1, 2, 3)
    return F.coalesce(_real_date(y, m, d), _real_date(F.when(n2 < 100, n2 + 2000).otherwise(n2).cast("string"), m2, d2), _real_date(y3, _month_number(m3), d3), _real_date(y4, _month_number(m4), d4))


def export_date(text: Column) -> Column:
    """A real date of 1900 to 2200 of an export field, or null: year first, month first, or eight digits MMDDYYYY; a text that
    still has letters of the field's pattern is none."""
    text = F.trim(text)
    y, m, d = _groups(text, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", 1, 2, 3)
    m2, d2, y2 = _groups(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})$", 1, 2, 3)
    n2 = y2.try_cast("int")
    digits = F.regexp_replace(text, r"\D", "")
    m3, d3, y3 = _groups(digits, r"^(\d{2})(\d{2})(\d{4})$", 1, 2, 3)
    out = F.when(y.isNotNull(), _real_date(y, m, d)).when(y2.isNotNull(), _real_date(F.when(n2 < 100, n2 + 2000).otherwise(n2).cast("string"), m2, d2)).otherwise(_real_date(y3, m3, d3))
    return F.when(~text.rlike("(?i)[mdy]") & F.year(out).between(1900, 2200), out)


# Spellings of street words and their short forms, in the order in which they are replaced.
STREET_WORDS = [
    (r"\b(avenue|ave\.?|av)\b", "ave"), (r"\b(street|st\.?)\b", "st"), (r"\b(road|rd\.?)\b", "rd"), (r"\b(drive|dr\.?)\b", "dr"),
    (r"\b(place|pl\.?)\b", "pl"), (r"\b(court|ct\.?)\b", "ct"), (r"\b(lane|ln\.?)\b", "ln"), (r"\b(boulevard|blvd\.?)\b", "blvd"),
    (r"\b(north|n)\b", "n"), (r"\b(south|s)\b", "s"), (r"\b(east|e)\b", "e"), (r"\b(west|w)\b", "w"),
]
ROAD_ENDINGS = [("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Boulevard", "Blvd"), ("Parkway", "Pkwy"), ("Drive", "Dr"), ("Lane", "Ln"), ("Court", "Ct"), ("Circle", "Cir"), ("Terrace", "Ter"), ("Place", "Pl"), ("Highway", "Hwy")]


def address_text(text: Column, places: tuple[str, ...] = ()) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&", " and ")
    for pattern, short in STREET_WORDS:
        out = F.regexp_replace(out, pattern, short)
    out = F.regexp_replace(out, r"[^a-z0-9\s]", " ")
    if places:
        out = F.regexp_replace(out, rf"\b({'|'.join(places)})\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# What a house number and a unit look like.
HOUSE_NUMBER = r"^(?i)(\d+[a-z]?(?:-\d+[a-z]?)?)(?:\s|,|$)"
UNIT = r"(?i)\s+(?:apt|unit|suite|ste)\.?\s+.*$|\s*#.*$"


def house_number(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), HOUSE_NUMBER, 1))


def street_part(text: Column, places: tuple[str, ...] = ()) -> Column:
    """The address before its first comma, without a unit."""
    return address_text(F.regexp_replace(F.split_part(F.coalesce(text, F.lit("")), F.lit(","), F.lit(1)), UNIT, ""), places)


def similar(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def without_places(text: Column, places: tuple[str, ...]) -> Column:
    """A query without the place names at its end; spaces squeezed."""
    names = "|".join(re.escape(p) for p in places)
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(squeezed, rf"(?i),?\s*({names})(\s*,?\s*({names}))*\s*$", "")) if names else squeezed


def names_place(parts: list[Column], postcode: Column, places: tuple[str, ...], code: str) -> Column:
    """Whether an address names the town, or has its postcode."""
    text = F.lower(F.concat_ws(" ", *parts))
    named = F.lit(False)
    for place in places:
        named = named | F.contains(text, F.lit(place.lower()))
    return named | F.coalesce(F.trim(postcode) == code, F.lit(False))


def address_label(label: Column, house: Column, road: Column, cities: list[Column], state: Column, postcode: Column, fallback: Column) -> Column:
    """The given label, else house and road, city, state and postcode by commas, else ``fallback``."""
    known = lambda c: F.when(c != "", c)
    street = known(F.trim(F.concat_ws(" ", known(house), known(road))))
    joined = F.concat_ws(", ", street, F.coalesce(*(known(c) for c in cities)), known(state), known(postcode))
    return F.coalesce(known(label), known(joined), fallback)


def candidate_score(base: Column, query: Column, label: Column) -> Column:
    """How well a label answers a query (both normalised): 0.4 where it contains it, 0.45 by similarity, 0.15 where it begins
    with the query's house number."""
    number = F.regexp_extract(query, r"^\d+\b", 0)
    told = (query != "") & (label != "")
    contained = F.when(told & F.contains(label, query), 0.4).otherwise(0.0)
    alike = F.when(told, 0.45 * F.greatest(F.lit(0.0), similar(query, label))).otherwise(0.0)
    return base + contained + alike + F.when((number != "") & label.startswith(number), 0.15).otherwise(0.0)


# Road kinds of label layers by rank, and kinds that get no label.
ROAD_KINDS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential"]
ROAD_RANKS = {"residential": 0, "tertiary": 10, "secondary": 20, "primary": 30, "trunk": 40, "motorway": 50}
NOT_ROADS = "under construction|pedestrian|raceway|bridleway|cycleway|steps|living street"


def road_role(kind: Column, source: Column, layer: Column, has_text: Column, has_icon: Column) -> Column:
    """struct(shield, major, rank) of a label layer of roads, null for any other."""
    name = F.lower(F.coalesce(layer, F.lit("")))
    shield = name.rlike(r"\bshield$") & has_icon
    road = F.coalesce(*(F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in ROAD_KINDS))
    rank = sum((F.when(road == k, r).otherwise(0) for k, r in ROAD_RANKS.items()), F.lit(0))
    is_road = (kind == "symbol") & source.rlike(r"(?i)^road(?:\s|/)") & source.rlike(r"(?i)/label$") & ~name.rlike(NOT_ROADS) & has_text & road.isNotNull() & (shield | name.rlike(r"\bname$"))
    return F.when(is_road, F.struct(shield.alias("shield"), road.isin(ROAD_KINDS[:4]).alias("major"), (rank + F.when(shield, 100).otherwise(0)).alias("rank")))


# Characters that stand for themselves nowhere in HTML.
HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, name in HTML:
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def html_text(text: Column) -> Column:
    """The reverse of ``html_escaped``; an ampersand's name comes last, so that nothing is decoded twice."""
    out = F.coalesce(text, F.lit(""))
    for mark, name in reversed(HTML):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def road_name(name: Column) -> Column:
    """First direction and last type word in their short forms."""
    out = name
    for word in ("North", "South", "East", "West"):
        out = F.regexp_replace(out, f"^(?i){word} ", f"{word[0]} ")
    for long, short in ROAD_ENDINGS:
        out = F.regexp_replace(out, f"(?i)(?<=.) {long}$", f" {short}")
    return out


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an array of struct(x, y)."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, F.pmod(i - 1 + n, n)).alias("q")))
    crossed = F.filter(edges, lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return F.size(crossed) % 2 == 1


def ring_area(ring: Column) -> Column:
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, F.pmod(i + 1, n))["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow((lat2 - lat1) * 111320.0, F.lit(2)) + F.pow((lon2 - lon1) * 111320.0 * F.cos(F.radians(lat1)), F.lit(2)))
