"""Sequential operators against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import series as Q
from tidemark.sources.tables import DAY, HOUR, MINUTE

SF = "/root/testdata/sf0.001"


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"seq": range(n), "station_id": rng.choice(["a", "b"], n), "t": np.sort(rng.integers(0, 30 * DAY, n)), "stage": np.round(rng.normal(50, 30, n), 1), "user_id": 0})
    return pdf, spark.createDataFrame(pdf)


def test_hour_slots_go_through_the_whole_range(spark):
    pdf, df = frame(spark, 900)
    edge = pd.DataFrame({"seq": [1000, 1001, 1002], "station_id": "c", "t": [DAY - 30 * MINUTE, 3 * DAY - 15 * MINUTE, 3 * DAY + 40 * MINUTE], "stage": 1.0, "user_id": 0})
    pdf = pd.concat([pdf, edge], ignore_index=True)
    want = set()
    for name, g in pdf.groupby("station_id"):
        g, used = g.sort_values(["t", "seq"]), set()
        for slot in range(-(-g.t.min() // HOUR) * HOUR, g.t.max() + 1, HOUR):
            free = [(abs(r.t - slot), r.t, r.seq) for r in g.itertuples() if abs(r.t - slot) <= 31 * MINUTE and r.seq not in used]
            if free:
                used.add(min(free)[2])
                want.add((name, slot, min(free)[2]))
    got = {(r.station_id, r.slot, r.seq) for r in Q.hourly_slots(spark.createDataFrame(pdf)).collect()}
    assert got == want and ("c", 3 * DAY, 1001) in got


def test_declustered_is_greedy(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    pdf, df = frame(spark)
    chosen = []
    for r in pdf.sort_values(["stage", "t", "seq"], ascending=[False, True, True]).itertuples():
        if all(abs(r.t - c.t) >= 12 * HOUR for c in chosen):
            chosen.append(r)
    got = Q.declustered(df.withColumnRenamed("stage", "peak"), 10, 12 * HOUR).toPandas()
    assert got.seq.tolist() == [c.seq for c in chosen[:10]]


def plain_crest(t, s, i):
    best = i
    for j in range(i - 1, -1, -1):
        if t[i] - t[j] > 8 * HOUR:
            return best
        if np.isnan(s[j]):
            continue
        if np.isnan(s[best]) or s[j] > s[best] + 1e-9:
            best = j
        elif s[j] < s[best] - 0.4:
            return best
    return best


def test_crests_step_back_row_by_row():
    rng = np.random.default_rng(8)
    t = np.sort(rng.integers(0, 10 * DAY, 600))
    s = np.round(np.cumsum(rng.normal(0, 0.3, 600)), 2)
    s[rng.random(600) < 0.1] = np.nan
    assert Q.crests_before(t, s).tolist() == [plain_crest(t, s, i) for i in range(600)]
    assert Q.crests_before(t[:0], s[:0]).tolist() == []


def test_runs_and_segments_do_not_end_with_blocks(spark):
    rows = [("a", k * HOUR, None if 200 <= k < 560 or k in (3, 4) else 1.0) for k in range(600)] + [("b", 5 * HOUR, 1.0)]
    grid = spark.createDataFrame(rows, "station_id string, slot long, stage double")
    runs = {(r["first"] // HOUR, r["last"] // HOUR, r.hours) for r in Q.missing_runs(grid, Q.F.col("stage").isNull(), Q.F.lit(1.0)).collect()}
    assert runs == {(200, 559, 360.0), (3, 4, 2.0)}
    assert {(r.station_id, r.hours) for r in Q.outages(grid, hours=Q.F.lit(1.0)).collect()} == {("a", 360.0), ("b", 0.0)}
    tail = grid.where("slot < 400 * 3600000000L OR station_id = 'b'")
    assert {(r.station_id, r.hours) for r in Q.outages(tail, hours=Q.F.lit(1.0), trailing=False).collect()} == {("a", 2.0), ("b", 0.0)}
    readings_ = spark.createDataFrame([(k, "a", k * HOUR, 1.0) for k in range(900) if k not in (300, 301)], "seq long, station_id string, t long, stage double")
    starts = Q.segments(readings_).groupBy("segment").count().collect()
    assert {(r.segment // HOUR, r["count"]) for r in starts} == {(0, 300), (302, 598)}


def plain_maxima(s, distance, prominence):
    tops = []
    i = 1
    while i < len(s) - 1:
        j = i
        while j + 1 < len(s) and s[j + 1] == s[i]:
            j += 1
        if s[i - 1] < s[i] and j + 1 < len(s) and s[j + 1] < s[i]:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (s[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lo, left = p, s[p]
        while lo >= 0 and s[lo] <= s[p]:
            left, lo = min(left, s[lo]), lo - 1
        hi, right = p, s[p]
        while hi < len(s) and s[hi] <= s[p]:
            right, hi = min(right, s[hi]), hi + 1
        if s[p] - max(left, right) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("size", [7, 1024])
def test_peaks_of_stretches(spark, monkeypatch, size):
    """Noise, plateaus across blocks, long flat stretches, short ones and two gauges; blocks of few samples and of many."""
    monkeypatch.setattr(Q, "SAMPLES", size)
    rng = np.random.default_rng(1)
    rows, want, at = [], [], 0
    flat = np.concatenate([[1.0, 3.0], np.full(40, 2.9), [2.5, 2.9, 2.95, 2.9], np.full(30, 2.9), [1.0, 1.0]])
    hills = np.concatenate([[0.0], np.full(25, 2.0), [0.0], np.full(9, 1.0), [0.5]])
    for n, s in enumerate([np.round(np.cumsum(rng.normal(0, 0.2, k)), 1) for k in (1, 2, 5, 300)] + [flat, hills, np.zeros(20)]):
        for gauge in ("a", "b"):
            own = s if gauge == "a" else s[::-1]
            start = (1000 * n + 3) * DAY // 100
            rows += [(gauge, at + k, start + k * 15 * MINUTE, float(v)) for k, v in enumerate(own)]
            want += [(gauge, start, at + p) for p in plain_maxima(own.tolist(), 6, 0.2)]
            at += len(own)
    got = Q.segment_peaks(spark.createDataFrame(rows, "station_id string, seq long, t long, stage double").repartition(3)).collect()
    assert sorted((r.station_id, r.segment, r.seq) for r in got) == sorted(want) and len(want) > 20


def test_last_readings_win_whenever_they_arrive(spark, tmp_path):
    from tidemark.streaming.upserts import LastReadings

    for n, rows in enumerate([[("a", 1, 10, 1.0), ("a", 30, 5, 2.0)], [("a", 1, 12, 3.0), ("b", 1, 1, 4.0)], [("a", 1, 11, 9.0), ("a", 30, 6, 5.0)]]):
        spark.createDataFrame(rows, "station_id string, hour long, t long, stage double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("station_id string, hour long, t long, stage double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = LastReadings(spark, str(tmp_path), ["station_id", "hour"], ["t"], Q.F.floor(Q.F.col("hour") / 24)).take(stream).collect()
    assert {(r.station_id, r.hour, r.stage) for r in got} == {("a", 1, 3.0), ("a", 30, 5.0), ("b", 1, 4.0)}


def test_grid_never_bridges_a_long_gap(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1.0, 0), (2, "a", 60 * MINUTE, 5.0, 0), (3, "a", 240 * MINUTE, 9.0, 0)], "seq long, station_id string, t long, stage double, user_id long")
    got = {r.slot // MINUTE: (r.stage, r.kind) for r in Q.quarter_hours(rows).collect()}
    assert got[15] == (2.0, "interpolated") and got[60] == (5.0, "exact") and got[120] == (None, "missing") and max(got) == 240


def plain_slots(rows, tolerance, hour):
    out = []
    for g in sorted({r[0] for r in rows}):
        own, used = [r for r in rows if r[0] == g], set()
        for n in range(-(-min(r[2] for r in own) // hour), max(r[2] for r in own) // hour + 1):
            free = sorted((abs(t - n * hour), t, seq) for _, seq, t in own if abs(t - n * hour) <= tolerance and seq not in used)
            if free:
                used.add(free[0][2])
                out.append((g, n * hour, free[0][2], free[0][1]))
    return out


@pytest.mark.parametrize("block", [3, 240])
def test_hourly_slots_in_order(spark, monkeypatch, block):
    """Readings half way between slots, which only the order of slots can deal out, with gaps and near ones here and there."""
    monkeypatch.setattr(Q, "SLOTS", block)
    rng = np.random.default_rng(12)
    rows, seq = [], 0
    for g in ("a", "b", "c", "d"):
        for n in range(60):
            for _ in range(int(rng.integers(0, 3)) if g != "a" else 1):
                off = rng.integers(29, 32) if g == "a" or rng.random() < 0.85 else rng.integers(0, 60)
                rows.append((g, seq, int((n * 60 + off) * MINUTE + rng.integers(0, 2) * 500_000)))
                seq += 1
    got = Q.hourly_slots(spark.createDataFrame(rows, "station_id string, seq long, t long").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_slots(rows, 31 * MINUTE, HOUR))


def test_storm_offsets_of_many_hours_have_no_group_marks(spark):
    rows = spark.createDataFrame([(-1234.5,), (1000.0,), (250000.25,), (-0.75,), (0.0,), (None,)], "h double").select(times.storm_offset_text(F.col("h")))
    assert [r[0] for r in rows.collect()] == ["1234.5 hr before peak", "1000 hr after peak", "250000.25 hr after peak", "0.75 hr before peak", "Storm peak", "Synthetic storm"]


def test_exceeded_counts_in_one_crowded_bin(spark):
    values, asks = [0.5 + k % 400 / 1000 for k in range(4000)] + [-0.0, 0.0, 7.0, None], [*(k / 500 for k in range(500)), 0.5, 6.0, 7.0, 8.0, -0.0, -5.0, None]
    got = Q.exceeded(spark.createDataFrame([(v,) for v in values], "v double"), "v", spark.createDataFrame(list(enumerate(asks)), "k long, at double"), "k", F.col("at"))
    assert {r.k: r.n for r in got.collect()} == {k: 0 if a is None else sum(v is not None and v > a for v in values) for k, a in enumerate(asks)}
