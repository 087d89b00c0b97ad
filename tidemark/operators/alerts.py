"""Weather alerts: which of them count, and in which order they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import precedence

# Fixed value: events that concern floods at the coast.
EVENTS = "(?i)(coastal flood|storm surge|lakeshore flood|flood warning|flood watch|flood advisory)"


def current_alerts(fresh: DataFrame, cached: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """Alerts (id, zone, event, expires, seq) of the last answers; zones that ``failed`` keep their last good ones. A fresh copy of
    an id wins, expired alerts and other events are left out. ``from_cache`` tells where one comes from."""
    kept = cached.join(F.broadcast(failed.select("zone").distinct()), "zone", "left_semi") if failed.count() < 10_000 else cached.join(failed.select("zone").distinct(), "zone", "left_semi")
    every = fresh.withColumn("from_cache", F.lit(False)).unionByName(kept.withColumn("from_cache", F.lit(True)))
    named = precedence(every.where("id <> ''"), ["id"], [F.col("from_cache"), F.col("seq")]).unionByName(every.where("id IS NULL OR id = ''"))
    return named.where((F.col("expires").isNull() | (F.col("expires") > now)) & F.col("event").rlike(EVENTS))


def urgency(event: Column) -> Column:
    return F.when(event.rlike("(?i)warning"), 3).when(event.rlike("(?i)watch"), 2).otherwise(1)


def ordered(alerts: DataFrame) -> DataFrame:
    """Alerts with their place, warnings first, else as they came. What is in force at a time is few, so one task orders it."""
    return alerts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(urgency(F.col("event"))), "from_cache", "seq")))
