"""Column expressions over instants (microseconds UTC), civil times and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ZONE, civil, civil_day, instants

ISO_LOCAL = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})"


def utc_micros(text: Column) -> Column:
    """The instant of a text with a zone, or null."""
    return F.unix_micros(F.when(text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp")))


def local_instant(text: Column, zone: str = ZONE) -> Column:
    """The earliest instant that shows a civil text (yyyy-MM-ddTHH:mm...), or null: none in a spring gap."""
    stamp = F.concat_ws(" ", F.regexp_extract(text, ISO_LOCAL, 1), F.concat_ws(":", F.regexp_extract(text, ISO_LOCAL, 2), F.regexp_extract(text, ISO_LOCAL, 3)))
    local = F.when(text.rlike(ISO_LOCAL), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")))
    return F.get(instants(local, zone), F.lit(0))


def entry_instant(utc: list[Column], local: list[Column], observed_date: Column, date_only: Column) -> Column:
    """A row's instant: of a day whose peak has no known time its midnight, else the first field that is set, UTC ones first."""
    of = F.lit(None).cast("long")
    for c in reversed(local):
        of = F.when(c != "", local_instant(c)).otherwise(of)
    for c in reversed(utc):
        of = F.when(c != "", utc_micros(c)).otherwise(of)
    return F.when(date_only, local_instant(F.concat(observed_date, F.lit("T00:00")))).otherwise(of)


def day_shift(key: Column, days: int) -> Column:
    """A date key (yyyy-MM-dd) some days on."""
    return F.date_format(F.date_add(F.to_date(key), days), "yyyy-MM-dd")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def key_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by date where both are dates, else as texts."""
    key = r"^\d{4}-\d{2}-\d{2}$"
    x, y = (F.when(c.rlike(key), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))) for c in (a, b))
    sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), sign(x, y)).otherwise(sign(a, b))


def cycle_id(text: Column) -> Column:
    """YYYYMMDDTHH00Z of a whole hour, '' for a text without zone, with minutes, or of no real date."""
    shape = r"^(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.0+)?)?(Z|[+-]([01]\d|2[0-3]):([0-5]\d))$"
    part = lambda i: F.regexp_extract(text, shape, i)
    local = F.unix_micros(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3)), F.lit("yyyy-MM-dd HH:mm")))
    away = F.coalesce(part(6).try_cast("int"), F.lit(0)) * 3_600_000_000 + F.coalesce(part(7).try_cast("int"), F.lit(0)) * 60_000_000
    at = F.when(text.rlike(shape) & (F.coalesce(part(4).try_cast("int"), F.lit(0)) == 0), local - F.when(F.startswith(part(5), F.lit("-")), -away).otherwise(away))
    return F.when(at % 3_600_000_000 == 0, F.date_format(F.timestamp_micros(at), "yyyyMMdd'T'HHmm'Z'")).otherwise("")


def run_cycle(run_dir: Column, cycle: Column) -> Column:
    """The instant of a model run from its folder (....YYYYMMDD) and cycle name (tHHz), or null."""
    day, hour = F.regexp_extract(run_dir, r"\.(\d{8})", 1), F.regexp_extract(cycle, r"^t(\d{2})z$", 1)
    return F.unix_micros(F.when((day != "") & (hour != ""), F.try_to_timestamp(F.concat(day, hour), F.lit("yyyyMMddHH"))))


def clock_minutes(t: Column, zone: str = ZONE) -> Column:
    return F.hour(civil(t, zone)) * 60 + F.minute(civil(t, zone))


def hour_index(text: Column, t: Column, direct: Column) -> Column:
    """The hour of day of a row: of its civil text, else of its instant, else as given; null outside 0 to 23."""
    said = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:"), F.regexp_extract(text, r"T(\d{2}):", 1).try_cast("int"))
    good = lambda h: F.when(h.between(0, 23), h)
    return F.coalesce(good(said), F.hour(civil(t)), good(direct))


def same_civil_day(a: Column, b: Column) -> Column:
    return F.coalesce(civil_day(a) == civil_day(b), F.lit(False))


def civil_label(t: Column, with_year: bool = False) -> Column:
    """September 5, 3:07 PM EDT."""
    local = civil(t)
    zone = F.when(F.unix_micros(local) - t == -4 * 3_600_000_000, "EDT").otherwise("EST")
    return F.concat_ws(" ", F.date_format(local, "MMMM d, yyyy," if with_year else "MMMM d,"), F.date_format(local, "h:mm a"), zone)


def standard_instant(day: Column, clock: Column) -> Column:
    """The instant of a crest told in standard time, five hours behind UTC all year."""
    return F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm"))) + 5 * 3_600_000_000


def storm_day(offset_hours: Column, window_hours: float = 84.0) -> Column:
    """The day of a storm's window that an offset from its peak falls in, from 0."""
    return F.greatest(F.lit(0), F.floor((offset_hours + window_hours / 2) / 24))


def storm_offset_text(offset_hours: Column) -> Column:
    away = F.abs(offset_hours)
    value = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", away), r"0+$", ""), r"\.$", "")
    return F.when(offset_hours.isNull(), "Synthetic storm").when(away < 1e-8, "Storm peak").otherwise(F.concat(value, F.lit(" hr "), F.when(offset_hours < 0, "before").otherwise("after"), F.lit(" peak")))
