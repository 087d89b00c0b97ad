"""Ordered series of gauges: resampling, outages, phases, segments, nearest joins, crest fits.

A gauge's series may be of any length, so nothing is grouped by gauge alone: rows go to (gauge, block of time), and each
block also gets the rows of a margin around it, marked as not its own. Windows and grouped pandas code see one block.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import DAY, HOUR, MINUTE, saved

BLOCK = 10 * DAY
QUARTER = 15 * MINUTE


def blocked(rows: DataFrame, margin: int, block: int = BLOCK, t: str = "t") -> DataFrame:
    """``rows`` with their block and ``own``; a row within ``margin`` of another block is there as well, not as its own."""
    at = F.floor(F.col(t) / block)
    span = F.sequence(F.floor((F.col(t) - margin) / block), F.floor((F.col(t) + margin) / block))
    return rows.withColumn("block", F.explode(span)).withColumn("own", F.col("block") == at)


def quarter_hours(rows: DataFrame, max_gap: int = 75 * MINUTE, slot: int = QUARTER, ends: DataFrame | None = None, exact_only: bool = False) -> DataFrame:
    """(station_id, slot, stage, kind, before_t, after_t) on the quarter-hour grid of each gauge, from its first to its last
    reading, or from slot number ``lo`` to ``hi`` of ``ends`` (station_id, lo, hi).

    exact: the reading nearest to the slot, within half a slot, first on ties (``exact_only``: at the slot itself);
    interpolated: between the readings around it if they are no more than ``max_gap`` apart; missing: null. Never beyond the
    first and last reading.
    """
    ends = rows.groupBy("station_id").agg((F.ceil(F.min("t") / slot)).alias("lo"), (F.floor(F.max("t") / slot)).alias("hi")) if ends is None else ends
    grid = ends.where("lo <= hi").select("station_id", F.explode(F.sequence("lo", "hi")).alias("n")).select("station_id", (F.col("n") * slot).alias("t"))
    near = F.floor(F.col("t") / slot + 0.5).cast("long")
    off = F.abs(F.col("t") - F.col("n") * slot)
    exact = rows.withColumn("n", near).where(off == 0 if exact_only else F.lit(True))
    exact = exact.groupBy("station_id", "n").agg(F.min(F.struct(off.alias("off"), "t", "seq", "stage")).alias("e")).select("station_id", (F.col("n") * slot).alias("t"), F.col("e.stage").alias("exact"))
    mixed = grid.join(exact, ["station_id", "t"], "left").select("station_id", "t", F.lit(1).alias("is_slot"), "exact", F.lit(None).cast("double").alias("stage"), F.lit(None).cast("long").alias("seq"))
    mixed = mixed.unionByName(rows.select("station_id", "t", F.lit(0).alias("is_slot"), F.lit(None).cast("double").alias("exact"), "stage", "seq"))
    placed = blocked(mixed, max_gap)
    w = Window.partitionBy("station_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    reading = F.when(F.col("is_slot") == 0, F.struct("t", "stage"))
    # the reading ahead is the last one of the opposite order, so both frames only grow
    back = F.last(reading, True).over(w.orderBy("t", "is_slot", "seq"))
    ahead = F.last(reading, True).over(w.orderBy(F.desc("t"), F.desc("is_slot"), F.desc("seq")))
    lerp = F.col("b.stage") + (F.col("a.stage") - F.col("b.stage")) * ((F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t")))
    out = placed.withColumns({"b": back, "a": ahead}).where("own AND is_slot = 1")
    told, inside = F.col("exact").isNotNull(), F.coalesce((F.col("a.t") - F.col("b.t")) <= max_gap, F.lit(False))
    between = ~told & inside
    return out.select(
        "station_id",
        F.col("t").alias("slot"),
        F.when(told, F.col("exact")).when(inside, F.round(lerp, 4)).alias("stage"),
        F.when(told, "exact").when(inside, "interpolated").otherwise("missing").alias("kind"),
        F.when(between, F.col("b.t")).alias("before_t"),
        F.when(between, F.col("a.t")).alias("after_t"),
    )


def daily_maximum(rows: DataFrame, day: Column, by: str = "station_id") -> DataFrame:
    """The peak reading of each day with its own instant; the earliest of equal peaks."""
    peak = F.min(F.struct((-F.col("stage")).alias("neg"), "t", "seq")).alias("p")
    kept = rows.where(F.col("stage").isNotNull() & ~F.isnan("stage")).withColumn("day", day).where("day IS NOT NULL")
    return kept.groupBy(by, "day").agg(peak, F.count(F.lit(1)).alias("n")).select(by, "day", (-F.col("p.neg")).alias("stage"), F.col("p.t").alias("t"), F.col("p.seq").alias("seq"), "n")


def missing_runs(rows: DataFrame, missing: Column, hours: Column, by: str = "station_id", t: str = "slot", block: int = BLOCK) -> DataFrame:
    """(by, first, last, hours) of the unbroken runs of missing rows, ``hours`` summed over their rows.

    Runs are found inside blocks of time and then joined where the row before a block's first is missing as well."""
    w = Window.partitionBy(by, "block").orderBy("t")
    flagged = rows.select(by, F.col(t).alias("t"), missing.alias("missing"), hours.alias("hours"), F.floor(F.col(t) / block).alias("block"))
    inside = flagged.withColumn("island", F.sum(F.when(F.col("missing"), 0).otherwise(1)).over(w))
    edges = flagged.groupBy(by, "block").agg(F.min("t").alias("block_first"), F.max("t").alias("block_last"))
    runs = inside.where("missing").groupBy(by, "block", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("hours").alias("hours")).join(edges, [by, "block"])
    # blocks that follow each other with rows: a run that ends one goes on in a run that begins the next
    order = edges.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("block"))).select(by, "block", "number")
    runs, up = runs.join(order, [by, "block"]), Window.partitionBy(by).orderBy("first")
    goes_on = (F.col("first") == F.col("block_first")) & (F.lag("last").over(up) == F.lag("block_last").over(up)) & (F.lag("number").over(up) == F.col("number") - 1)
    chain = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(up)
    return runs.withColumn("run", chain).groupBy(by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.round(F.sum("hours"), 2).alias("hours")).drop("run")


def frame_hours(minutes: Column, interval: Column, default: float = 1.0) -> Column:
    """Hours that a row stands for: its own minutes, else its interval's, else ``default``."""
    return F.when(minutes > 0, minutes / 60.0).when(interval == "15min", 0.25).when(interval == "daily", 24.0).otherwise(F.lit(default))


def outages(rows: DataFrame, missing: Column | None = None, hours: Column | None = None, by: str = "station_id", t: str = "slot", trailing: bool = True) -> DataFrame:
    """(by, hours) of each series' longest run of missing rows, 0 where none is; ``trailing``: whether one that ends it counts."""
    missing = F.col("stage").isNull() | F.isnan("stage") if missing is None else missing
    runs = missing_runs(rows, missing, F.lit(0.25) if hours is None else hours, by, t)
    ends = rows.groupBy(by).agg(F.max(t).alias("end"))
    if not trailing:
        runs = runs.join(ends, by).where(F.col("last") < F.col("end"))
    return ends.select(by).join(runs.groupBy(by).agg(F.max("hours").alias("hours")), by, "left").select(by, F.coalesce("hours", F.lit(0.0)).alias("hours"))


def segments(rows: DataFrame, gap: int = 5400 * 1_000_000, by: str = "station_id") -> DataFrame:
    """``rows`` with segment: the start of the contiguous stretch (no gap above ``gap``) that they stand in. Gaps are found
    inside blocks and at their edges; the starts, which are few, are then looked up by time."""
    w = Window.partitionBy(by, "block").orderBy("t", "seq")
    placed = rows.withColumn("block", F.floor(F.col("t") / BLOCK)).withColumn("before", F.lag("t").over(w))
    ends = placed.groupBy(by, "block").agg(F.max("t").alias("end"))
    ends = ends.select(by, "block", F.lag("end").over(Window.partitionBy(by).orderBy("block")).alias("end"))
    known = placed.join(ends, [by, "block"]).withColumn("before", F.coalesce("before", "end"))
    start = F.when(F.col("before").isNull() | (F.col("t") - F.col("before") > gap), F.col("t"))
    inside = F.last(start, True).over(w)
    opened = known.withColumn("start", inside)
    last = opened.groupBy(by, "block").agg(F.max("start").alias("last"))
    carried = last.select(by, "block", F.last("last", True).over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return opened.join(carried, [by, "block"]).withColumn("segment", F.coalesce("start", "carried")).select(*rows.columns, "segment")


SAMPLES = 1024  # samples of a stretch that stand in one block


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with i, their place in the order of t and seq within ``by``: counted inside blocks of time, carried over them."""
    placed = rows.withColumn("block", F.floor(F.col("t") / BLOCK))
    before = placed.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(*by, "block", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, "block").orderBy("t", "seq")) - 1
    return placed.withColumn("inside", inside).join(before, [*by, "block"]).select(*rows.columns, (F.col("before") + F.col("inside")).alias("i"))


def tops(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, level) of the plateaus of samples (by, i, stage, block) with lower samples on both sides; p is their middle. Starts
    of plateaus know their neighbours inside a block, at its ends from the next blocks that have any."""
    inside, blocks = Window.partitionBy(*by, "block").orderBy("i"), Window.partitionBy(*by).orderBy("block")
    last = samples.groupBy(*by, "block").agg(F.max_by("stage", "i").alias("last"))
    before = last.select(*by, "block", F.lag("last").over(blocks).alias("before"))
    starts = samples.join(before, [*by, "block"]).withColumn("left", F.coalesce(F.lag("stage").over(inside), F.col("before")))
    starts = starts.where(F.col("left").isNull() | (F.col("left") != F.col("stage"))).select(*by, "block", "i", "stage", "left")
    one = F.struct("i", "stage")
    first = starts.groupBy(*by, "block").agg(F.min_by(one, "i").alias("first"))
    ahead = first.select(*by, "block", F.lead("first").over(blocks).alias("ahead"))
    known = starts.join(ahead, [*by, "block"]).withColumn("next", F.coalesce(F.lead(one).over(inside), F.col("ahead")))
    high = known.where((F.col("left") < F.col("stage")) & (F.col("next.stage") < F.col("stage")))
    return high.select(*by, F.floor((F.col("i") + F.col("next.i") - 1) / 2).alias("p"), F.col("stage").alias("level"))


def apart(peaks: DataFrame, by: list[str], distance: int) -> DataFrame:
    """The peaks (by, p, level) that are left when higher ones (later ones of equal height) rule out those less than ``distance``
    from them. A round keeps what nothing higher is near to and drops what that rules out; neighbours meet by spans."""
    order = F.struct((-F.col("level")).alias("a"), (-F.col("p")).alias("b"))
    around = F.explode(F.array(*(F.floor(F.col("p") / distance) + d for d in (-1, 0, 1)))).alias("span")
    left, kept = saved(peaks, "peaks"), None
    while True:
        near = left.select(*by, around, F.col("p").alias("other"), order.alias("its"))
        mine = left.select(*by, "p", "level", F.floor(F.col("p") / distance).alias("span"), order.alias("own"))
        beaten = mine.join(near, [*by, "span"]).where((F.abs(F.col("p") - F.col("other")) < distance) & (F.col("its") < F.col("own"))).select(*by, "p").distinct()
        best = saved(left.join(beaten, [*by, "p"], "left_anti"), "peaks-kept")
        kept = best if kept is None else kept.unionByName(best)
        ruled = mine.join(best.select(*by, around, F.col("p").alias("other")), [*by, "span"]).where(F.abs(F.col("p") - F.col("other")) < distance).select(*by, "p").distinct()
        left = saved(left.join(ruled, [*by, "p"], "left_anti"), "peaks")
        if left.isEmpty():
            return kept


def prominent(peaks: DataFrame, samples: DataFrame, by: list[str], prominence: float) -> DataFrame:
    """The peaks (by, p, level) on whose both sides the samples (by, i, stage, block) fall by ``prominence`` before one is higher. A
    side is followed block by block, in rounds, until a sample settles it; where the stretch ends before, it does not fall."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in peaks.select(*by).schema) + ", p long, level double, side int, block long, falls int"

    def look(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asks.empty:
            return pd.DataFrame({c: [] for c in [*by, "p", "level", "side", "block", "falls"]})
        held = held.sort_values("i")
        i, s = held["i"].to_numpy(), held["stage"].to_numpy(float)
        falls = []
        for p, level, side in asks[["p", "level", "side"]].itertuples(index=False):
            row = s[: np.searchsorted(i, p)][::-1] if side < 0 else s[np.searchsorted(i, p, "right") :]
            out = (row > level) | (level - row >= prominence)
            k = int(out.argmax()) if len(row) and out.any() else -1
            falls.append(-1 if k < 0 else int(not row[k] > level))
        return asks.assign(falls=falls)

    ends = samples.groupBy(*by).agg(F.max("block").alias("end"))
    asks = peaks.select(*by, "p", "level", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumns({"block": F.floor(F.col("p") / SAMPLES), "falls": F.lit(-1)})
    good = None
    while True:
        near = samples.join(asks.select(*by, "block").distinct(), [*by, "block"], "left_semi")
        told = saved(asks.groupBy(*by, "block").cogroup(near.groupBy(*by, "block")).applyInPandas(look, schema), "peak-sides")
        good = told.where("falls = 1") if good is None else good.unionByName(told.where("falls = 1"))
        asks = told.where("falls = -1").withColumn("block", F.col("block") + F.col("side")).join(ends, by).where(F.col("block").between(0, F.col("end"))).drop("end")
        if asks.isEmpty():
            both = good.groupBy(*by, "p").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(*by, "p")
            return peaks.join(both, [*by, "p"], "left_semi")


def segment_peaks(rows: DataFrame, gap: int = 5400 * 1_000_000, distance: int = 6, prominence: float = 0.2) -> DataFrame:
    """(station_id, segment, seq, t, stage) of the maxima of each contiguous stretch (a plateau's middle one), of which any two
    are ``distance`` samples apart (higher ones first) and each stands ``prominence`` above the higher of the two lowest points
    between it and a higher one or the end. Stretches of any length: a task holds blocks of ``SAMPLES`` samples."""
    by = ["station_id", "segment"]
    kept = rows.where(F.col("stage").isNotNull() & ~F.isnan("stage")).select("station_id", "seq", "t", F.col("stage").cast("double").alias("stage"))
    samples = saved(numbered(segments(kept, gap), by).withColumn("block", F.floor(F.col("i") / SAMPLES)), "samples")
    cut = samples.select(*by, "i", "stage", "block")
    found = prominent(apart(tops(cut, by), by, distance), cut, by, prominence)
    return found.select(*by, F.col("p").alias("i")).join(samples, [*by, "i"]).select(*by, "seq", "t", "stage")


def deltas_phase(before: Column, after: Column, eps: float = 0.025) -> Column:
    """The phase that two neighbouring changes tell by themselves; null where the crest has to be looked up."""
    both = before.isNotNull() & after.isNotNull()
    move = F.when(after.isNotNull() & (before.isNull() | (F.abs(after) >= F.abs(before))), after).otherwise(before)
    return (
        F.when(both & (before > eps) & (after <= eps), "slack")
        .when(both & (before >= 0) & (after < -eps), "slack")
        .when(both & (before < -eps) & (after >= -eps), "draining")
        .when(both & (before <= eps) & (after > eps), F.when(before < 0, "draining").otherwise("slack"))
        .when((before < -eps) | ((after < -eps) & (before < 0)), F.lit(None).cast("string"))
        .when(move > eps, "filling")
        .when(move < -eps, "draining")
        .otherwise("slack")
    )


def crests_before(t: np.ndarray, s: np.ndarray, reach: int = 8 * HOUR, drop: float = 0.4) -> np.ndarray:
    """For each row the crest that it falls from: all rows step back together, one row at a time, until ``reach`` or a drop of
    ``drop`` below their running crest."""
    best, top = np.arange(len(t)), s.copy()
    walking = np.arange(len(t))
    step = 0
    while len(walking):
        step += 1
        walking = walking[walking >= step]
        walking = walking[t[walking] - t[walking - step] <= reach]
        level = s[walking - step]
        higher = ~np.isnan(level) & (np.isnan(top[walking]) | (level > top[walking] + 1e-9))
        risen = walking[higher]
        best[risen], top[risen] = risen - step, level[higher]
        walking = walking[higher | ~(level < top[walking] - drop)]
    return best


def neighbours(rows: DataFrame, value: Column, by: str = "station_id", block: int = BLOCK) -> DataFrame:
    """``rows`` with before and after: ``value`` of the row before and after in the series, however far away these are."""
    w = Window.partitionBy(by, "near_").orderBy("t", "seq")
    own = F.struct(value.alias("v"))
    placed = rows.withColumn("near_", F.floor(F.col("t") / block)).withColumns({"back_": F.lag(own).over(w), "next_": F.lead(own).over(w)})
    at = F.struct("t", "seq", value.alias("v"))
    ends = placed.groupBy(by, "near_").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    order = Window.partitionBy(by).orderBy("near_")
    ends = ends.select(by, "near_", F.struct(F.lag("last.v").over(order).alias("v")).alias("early_"), F.struct(F.lead("first.v").over(order).alias("v")).alias("late_"))
    both = placed.join(ends, [by, "near_"])
    return both.withColumns({"before": F.coalesce("back_", "early_")["v"], "after": F.coalesce("next_", "late_")["v"]}).drop("near_", "back_", "next_", "early_", "late_")


def phases(rows: DataFrame, minor: float, moderate: float, major: float) -> DataFrame:
    """(station_id, seq, t, stage, phase, crest_t, crest_stage, elapsed_min) of every reading."""
    stage = F.when(~F.isnan("stage"), F.col("stage"))
    told = neighbours(rows.select("station_id", "seq", "t", "stage"), stage)
    told = told.withColumn("phase", F.when(stage.isNull(), "slack").otherwise(deltas_phase(stage - F.col("before"), F.col("after") - stage)))
    told = blocked(told, 8 * HOUR, 2 * DAY)

    def crests(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"], kind="stable").reset_index(drop=True)
        t, s = pdf["t"].to_numpy(), pdf["stage"].to_numpy(float)
        at = crests_before(t, s)
        minutes = np.maximum(0, (t - t[at]) / MINUTE)
        crest = s[at]
        release = np.where((crest < minor) | (crest >= major), "draining", np.where(crest >= moderate, np.where(minutes <= 15, "draining-release-15", "draining"), np.where(minutes <= 15, "draining-release-15", np.where(minutes <= 30, "draining-release-30", "draining"))))
        pdf["phase"] = np.where(pdf["phase"].isna(), release, pdf["phase"])
        pdf["crest_t"], pdf["crest_stage"], pdf["elapsed_min"] = t[at], crest, minutes
        return pdf.loc[pdf["own"], ["station_id", "seq", "t", "stage", "phase", "crest_t", "crest_stage", "elapsed_min"]]

    return told.select("station_id", "block", "own", "seq", "t", "stage", "phase").groupBy("station_id", "block").applyInPandas(crests, "station_id string, seq long, t long, stage double, phase string, crest_t long, crest_stage double, elapsed_min double")


def nearest(left: DataFrame, right: DataFrame, by: str, reach: int, later_wins: bool = False) -> DataFrame:
    """For each (by, seq, t) of ``left`` the nearest row of ``right`` within ``reach``: the last one before and the first one
    after it, from two windows over both sides; of rows at one instant the least seq."""
    some = F.struct("t", "seq", "stage")
    both = left.select(by, "seq", "t", F.lit(None).cast("double").alias("stage"), F.lit(1).alias("asks")).unionByName(right.select(by, "seq", "t", "stage", F.lit(0).alias("asks")))
    placed = blocked(both, reach, 2 * DAY).where("own OR asks = 0")
    w = Window.partitionBy(by, "block").rowsBetween(Window.unboundedPreceding, -1)
    back = F.last(F.when(F.col("asks") == 0, some), True).over(w.orderBy("t", "asks", F.desc("seq")))
    ahead = F.last(F.when(F.col("asks") == 0, some), True).over(w.orderBy(F.desc("t"), F.desc("asks"), F.desc("seq")))
    told = placed.withColumns({"b": back, "a": ahead}).where("asks = 1")
    before, after = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    first = (before < after) if later_wins else (before <= after)
    use = F.when(F.col("a").isNull() | first, F.col("b")).otherwise(F.col("a"))
    use = F.when(F.col("b").isNull(), F.col("a")).otherwise(use)
    off = F.abs(F.col("m.t") - F.col("t"))
    return told.withColumn("m", use).where(off <= reach).select("seq", F.col("m.seq").alias("match"), F.col("m.stage").alias("match_stage"), off.alias("off"))


SLOTS = 240  # hour slots of a block


def hourly_slots(rows: DataFrame, tolerance: int = 31 * MINUTE, bounds: tuple[int, int] | None = None) -> DataFrame:
    """UTC hour slots of each gauge from its first to its last reading (or of ``bounds``): the nearest unused reading within
    ``tolerance``, slots in order, first on ties.

    A reading can serve a slot and the next one only, so all that a slot has to know is whether the one before took its first
    choice: then it takes its second one. Whether a slot takes its second choice is thus the parity of such changes since
    the last slot whose first choice nobody else may have taken, a running sum that blocks of slots carry on."""
    ends = rows.groupBy("station_id").agg(F.ceil(F.min("t") / HOUR).alias("lo"), F.floor(F.max("t") / HOUR).alias("hi"))
    if bounds:
        ends = ends.select("station_id", F.lit(-(-bounds[0] // HOUR)).alias("lo"), F.lit(bounds[1] // HOUR).alias("hi"))
    hour = F.floor(F.col("t") / HOUR)
    tries = rows.select("station_id", "seq", "t", F.explode(F.array(hour, hour + 1)).alias("n")).withColumn("off", F.abs(F.col("t") - F.col("n") * HOUR)).where(F.col("off") <= tolerance)
    tries = tries.join(ends, "station_id").where(F.col("n").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    rank = F.row_number().over(Window.partitionBy("station_id", "n").orderBy("off", "t", "seq"))
    choice = lambda k: F.max(F.when(F.col("rank") == k, F.struct("seq", "t"))).alias(f"c{k}")
    slots = tries.withColumn("rank", rank).where("rank <= 2").groupBy("station_id", "n").agg(choice(1), choice(2)).withColumn("block", F.floor(F.col("n") / SLOTS))

    inside, blocks = Window.partitionBy("station_id", "block").orderBy("n"), Window.partitionBy("station_id").orderBy("block")
    me = F.struct("n", "c1", "c2")
    last = slots.groupBy("station_id", "block").agg(F.max_by(me, "n").alias("end"))
    before = last.select("station_id", "block", F.lag("end").over(blocks).alias("end"))
    placed = slots.join(before, ["station_id", "block"]).withColumn("prev", F.coalesce(F.lag(me).over(inside), F.col("end")))
    took = lambda c: F.coalesce((F.col("prev.n") == F.col("n") - 1) & (F.col(f"prev.{c}.seq") == F.col("c1.seq")), F.lit(False))
    # the slot before has this one's first choice as its own first (turns), as its second (holds) or not at all (free)
    told = placed.select("station_id", "block", "n", "c1", "c2", took("c1").cast("long").alias("turns"), (~took("c1") & ~took("c2")).alias("free"))
    running = told.withColumn("sum", F.sum("turns").over(inside)).withColumn("since", F.last(F.when(F.col("free"), F.col("sum")), True).over(inside))
    ended = running.groupBy("station_id", "block").agg(F.max_by(F.struct("sum", "since"), "n").alias("e"))
    ended = ended.select("station_id", "block", (F.col("e.sum") - F.coalesce("e.since", F.lit(0))).alias("own"), F.col("e.since").isNotNull().alias("fixed"))
    summed = ended.withColumn("sum", F.sum("own").over(blocks)).withColumn("since", F.last(F.when(F.col("fixed"), F.col("sum") - F.col("own")), True).over(blocks))
    carried = summed.select("station_id", "block", F.lag(F.col("sum") - F.coalesce("since", F.lit(0)), 1, 0).over(blocks).alias("carry"))
    turned = F.pmod(F.col("sum") - F.coalesce("since", F.lit(0)) + F.when(F.col("since").isNull(), F.col("carry")).otherwise(0), F.lit(2)) == 1
    taken = running.join(carried, ["station_id", "block"]).select("station_id", (F.col("n") * HOUR).alias("slot"), F.when(turned, F.col("c2")).otherwise(F.col("c1")).alias("c"))
    return taken.where("c IS NOT NULL").select("station_id", "slot", "c.seq", "c.t")


def declustered(events: DataFrame, k: int, window: int) -> DataFrame:
    """Greedy top k by peak: an event within ``window`` of a chosen one is passed over. A round keeps each event that is
    the highest within ``window`` of itself, and drops what those rule out, so no task holds the whole series. Only the highest
    of a span of ``window`` can be kept, so spans are cut to one candidate before they meet their neighbours' events."""
    order = F.struct((-F.col("peak")).alias("neg"), "t", "seq")
    span = F.floor(F.col("t") / window)
    left, kept = events.select("seq", "t", "peak", span.alias("span"), order.alias("me")), None
    while True:
        top = left.groupBy("span").agg(F.min("me").alias("top"))
        around = top.select(F.explode(F.array(F.col("span") - 1, F.col("span") + 1)).alias("span"), "top")
        beaten = left.join(around, "span").where((F.abs(F.col("top.t") - F.col("t")) < window) & (F.col("me") < F.col("top"))).select(F.col("top.seq").alias("seq")).distinct()
        best = top.select(F.col("top.seq").alias("seq"), F.col("top.t").alias("t"), (-F.col("top.neg")).alias("peak"), "span").join(beaten, "seq", "left_anti")
        kept = (best.drop("span") if kept is None else kept.unionByName(best.drop("span"))).checkpoint()
        marks = best.select(F.explode(F.array(*(F.col("span") + d for d in (-1, 0, 1)))).alias("span"), F.col("t").alias("t0"))
        ruled = left.join(marks, "span").where(F.abs(F.col("t0") - F.col("t")) < window).select("seq").distinct()
        left = left.join(ruled, "seq", "left_anti").checkpoint()
        if left.isEmpty():
            return kept.orderBy(F.desc("peak"), "t", "seq").limit(k)


def raised_cosine(rows: DataFrame, crests: DataFrame, half: int = 6 * HOUR) -> DataFrame:
    """Each reading moved towards its gauge's official crest around the gauge's peak, by half a cosine within ``half``."""
    peak = rows.groupBy("station_id").agg(F.min(F.struct((-F.col("stage")).alias("neg"), "t", "seq")).alias("p")).select("station_id", (-F.col("p.neg")).alias("peak"), F.col("p.t").alias("peak_t"), F.col("p.seq").alias("peak_seq"))
    far = F.abs(F.col("t") - F.col("peak_t"))
    weight = 0.5 * (1 + F.cos(F.lit(np.pi) * far / half))
    moved = F.when(F.col("seq") == F.col("peak_seq"), F.col("crest")).when(far <= half, F.round(F.col("stage") + (F.col("crest") - F.col("peak")) * weight, 4)).otherwise(F.col("stage"))
    return rows.join(peak.join(crests, "station_id"), "station_id").select("seq", "station_id", "t", moved.alias("stage"))


def upper_median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The element at n / 2 (rounded down, from 0) of each group's sorted values: by rank, so no group is held as an array."""
    ranked = rows.where(F.col(value).isNotNull()).withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    sizes = ranked.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / 2 + 1).alias("middle_"))
    return ranked.join(sizes, by).where("rank_ = middle_").select(*by, F.col(value).alias(name))


def whole_upper_median(rows: DataFrame, value: str) -> float | None:
    """The upper median of all rows: they are dealt by range, and only the part that holds the middle is ranked."""
    dealt = saved(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    middle, before = sum(n for _, n in sizes) // 2, 0
    for part, n in sizes:
        if before + n > middle:
            rank = F.row_number().over(Window.partitionBy("part").orderBy("v"))
            return dealt.where(F.col("part") == part).withColumn("rank", rank).where(F.col("rank") == middle - before + 1).first()["v"]
        before += n
    return None


def exceeded(values: DataFrame, value: str, thresholds: DataFrame, key: str, threshold: Column, width: float = 1.0) -> DataFrame:
    """(key, n): how many values are above each threshold: whole bins above its own by their sums, and within its bin a running count
    of the values in order, so no threshold meets the values one by one. None are above a threshold of null."""
    held = values.where(F.col(value).isNotNull()).groupBy((F.col(value) + 0.0).alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("asks", F.lit(0))
    asked = thresholds.select(key, (threshold + 0.0).alias("at"))  # + 0.0: one zero only
    asks = asked.where("at IS NOT NULL").select("at", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asks")).distinct()
    every = held.unionByName(asks).withColumn("bin", F.floor(F.col("at") / width))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = every.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", before(Window.orderBy(F.desc("bin"))).alias("above"))
    inside = every.withColumn("inside", before(Window.partitionBy("bin").orderBy(F.desc("at"), F.desc("asks")))).where("asks = 1")
    told = inside.join(above, "bin").select("at", (F.col("above") + F.col("inside")).alias("n"))
    return asked.join(told, "at", "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def resolution(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, minutes): the upper median of the positive gaps between readings."""
    gap = (F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t"))) / MINUTE
    return upper_median(rows.withColumn("gap", gap).where("gap > 0"), by, "gap", "minutes")


def synthetic_storm(targets: DataFrame, key: str, target: str, rise: float = 6.0, hours: float = 12.0, step_minutes: int = 15) -> DataFrame:
    """(key, q, offset_hours, stage) of an illustrative storm: half a cosine of ``rise`` feet around each target."""
    n = int(hours * 60 // step_minutes)
    offset = F.col("q") * (step_minutes / 60)
    return targets.select(key, target, F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("q")).select(key, "q", offset.alias("offset_hours"), F.round(F.col(target) - rise * (1 - F.cos(F.lit(np.pi) * offset / hours)) / 2, 6).alias("stage"))


def precedence(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


