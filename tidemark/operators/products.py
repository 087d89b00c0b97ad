"""Issued forecast products and contracts: what a published file must hold, and the rows that are read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guidance, issued_level
from ..sources.tables import HOUR

# The scenarios that are read off issued products, and their columns there.
PRODUCTS = {"mean": "TWL", "lowEnd": "TWL90p", "highEnd": "TWL10p"}


def zones(payloads: DataFrame) -> DataFrame:
    """(file, zone, forecast) of payloads with several zones, or of the payload itself as ``default``."""
    several = F.map_entries(F.col("zones"))
    return payloads.select("file", F.explode(F.coalesce(several, F.array(F.struct(F.lit("default").alias("key"), F.col("forecast").alias("value"))))).alias("z")).select("file", F.col("z.key").alias("zone"), F.col("z.value").alias("forecast"))


def selected_products(rows: DataFrame, offset: float, low: float, high: float, step: float) -> DataFrame:
    """(zone, scenario, i, t, navd, mllw, matched, clamped) of issued rows (zone, scenario, i, t, source_t, value, scale, datum):
    a row's own instant is that of its source where it has one."""
    level = issued_level(F.col("value"), F.col("scale"), F.col("datum"), offset, low, high, step)
    good = rows.where(F.col("scenario").isin(*PRODUCTS)).withColumn("level", level)
    return good.select("zone", "scenario", "i", F.coalesce("source_t", "t").alias("t"), F.element_at(F.create_map(*(F.lit(x) for kv in PRODUCTS.items() for x in kv)), F.col("scenario")).alias("product"), "level.*")


def product_faults(rows: DataFrame) -> DataFrame:
    """(zone, scenario, fault): products that a zone lacks, and levels that are none."""
    wanted = rows.select("zone").distinct().select("zone", F.explode(F.array(*(F.lit(k) for k in PRODUCTS))).alias("scenario"))
    lacking = wanted.join(rows.select("zone", "scenario").distinct(), ["zone", "scenario"], "left_anti").withColumn("fault", F.lit("missing"))
    level = F.col("value") * F.col("scale")
    bad = rows.where(~F.coalesce(F.abs(level) < 9999, F.lit(False))).select("zone", "scenario").distinct().withColumn("fault", F.lit("invalid"))
    return lacking.unionByName(bad)


def guidance_rows(mean: DataFrame, low: DataFrame, adjusted: Column, adjustment: Column) -> DataFrame:
    """Guidance of each mean row (zone, cycle, t, source_t, level, raw, tide) with the low end at the same source instant. Zones
    with a local adjustment use raw levels at source instants and are moved back by it; without both raw levels there is none."""
    at = lambda df: df.withColumn("at", F.when(adjusted, F.col("source_t")).otherwise(F.col("t"))).withColumn("used", F.when(adjusted, F.col("raw")).otherwise(F.col("level")))
    last = at(low).groupBy("zone", "at").agg(F.max(F.struct("t", "used")).alias("l")).select("zone", "at", F.col("l.used").alias("low"))
    both = at(mean).where("at IS NOT NULL").join(last, ["zone", "at"], "left")
    g = guidance((F.col("at") - F.col("cycle")) / HOUR, F.col("used"), F.col("tide"), F.col("low"))
    told = F.when(~adjusted | (F.col("used").isNotNull() & F.col("low").isNotNull()), g)
    shift = F.when(adjusted, adjustment).otherwise(0.0)
    out = both.withColumn("g", told)
    return out.select("zone", "t", F.col("g").isNotNull().alias("available"), *(F.round(F.col(f"g.{n}") + shift, 3).alias(n) for n in ("central", "low", "shifted", "quartile")))


def zone_status(rows: DataFrame, fresh: Column) -> DataFrame:
    """(zone, status): experimental or stale where any row has guidance, else unavailable."""
    some = rows.groupBy("zone").agg(F.bool_or("available").alias("some"))
    return some.select("zone", F.when(F.col("some"), F.when(fresh, "experimental").otherwise("stale")).otherwise("unavailable").alias("status"))


def age_ok(t: Column, now: int, hours: float) -> Column:
    """At most ``hours`` old; half an hour ahead is let pass, nothing else of the future."""
    return F.coalesce((now - t).between(-HOUR // 2, int(hours * HOUR)), F.lit(False))


def checks(one: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(key columns, check, passed): one row for each rule and row of ``one``; nulls don't pass."""
    told = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in rules.items()))
    return one.select("key", F.explode(told).alias("c")).select("key", "c.*")


def digests_agree(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, fault) of files whose content has not the digest or size of the manifest, or that are not there."""
    both = manifest.join(files.select("name", F.sha2("content", 256).alias("own"), F.octet_length("content").alias("size")), "name", "left")
    fault = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("sha256"), "digest").when(F.col("size") != F.col("bytes"), "size")
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select("name", "fault")


def axis_faults(axis: DataFrame, by: str) -> DataFrame:
    """(by, i) of places of an axis (i, value) that do not rise."""
    w = Window.partitionBy(by).orderBy("i")
    return axis.withColumn("before", F.lag("value").over(w)).where(F.col("value").isNull() | (F.col("value") <= F.col("before"))).select(by, "i")


def band_faults(cube: DataFrame, most: float) -> DataFrame:
    """Cells of a cube (estimate, lower, upper) that are no counts up to ``most``, or whose lower end is above the upper one."""
    good = [F.coalesce(F.col(c).between(0, most), F.lit(False)) for c in ("estimate", "lower", "upper")]
    return cube.where(~(good[0] & good[1] & good[2]) | (F.col("lower") > F.col("upper")))


def share_faults(stages: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """(parcel, fault) of a parcel table (parcel, stages) and its end stages (parcel, stages) of two: widths, and parcels that
    only one of them has."""
    wide = stages.where(F.size("stages") != width).select("parcel", F.lit("width").alias("fault"))
    two = ends.where(F.size("stages") != 2).select("parcel", F.lit("ends").alias("fault"))
    lone = stages.select("parcel").join(ends.select("parcel"), "parcel", "left_anti").select("parcel", F.lit("without ends").alias("fault"))
    extra = ends.select("parcel").join(stages.select("parcel"), "parcel", "left_anti").select("parcel", F.lit("unknown").alias("fault"))
    return wide.unionByName(two).unionByName(lone).unionByName(extra)
