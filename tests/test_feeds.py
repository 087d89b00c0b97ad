"""Paged services, images, stores, labels and playback against plain versions."""

import base64
import gzip
import json
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import labels
from tidemark.plans import feed_queries, terrain_queries
from tidemark.sources import blobs, images, pages, readers
from tidemark.streaming import playback

SF = "/root/testdata/sf0.001"


@pytest.fixture
def service(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1000 * i, i / 2, "a" if i % 2 else None) for i in range(100)], "object_id long, t long, value double, kind string")
    path, fallback = str(tmp_path / "service"), str(tmp_path / "fallback")
    pages.write_pages(rows, path, 10, "page IN (2, 5)")
    pages.write_pages(rows, fallback, 10, "page = 5")
    return path, fallback


def test_pages_are_read_only_where_asked(spark, service):
    path, fallback = service
    (plan := pages.pages(spark, path, fallback).where("object_id >= 31 AND object_id < 40 AND t <= 35000")).count()
    assert plan.rdd.getNumPartitions() == 1 and [r.object_id for r in plan.orderBy("object_id").collect()] == [31, 32, 33, 34, 35]
    reader = pages.PageReader({"path": path})
    assert len(reader.partitions()) == 10
    assert pages.pages(spark, path).where("object_id > 500").count() == 0


def test_many_pages_share_partitions(service, monkeypatch):
    monkeypatch.setattr(pages, "MOST_PARTITIONS", 4)
    reader = pages.PageReader({"path": service[0], "fallback": service[1]})
    parts = reader.partitions()
    assert len(parts) == 4 and sorted(r[0] for p in parts for r in reader.read(p) if r[0] is not None) == [i for i in range(100) if i // 10 != 5]


def test_pages_fall_back_and_tell_faults(spark, service):
    path, fallback = service
    got = {(r.page, r.origin, r.fault): r["count"] for r in pages.pages(spark, path, fallback).groupBy("page", "origin", "fault").count().collect()}
    assert got == {**{(str(p), "service", None): 10 for p in (0, 1, 3, 4, 6, 7, 8, 9)}, ("2", "fallback", None): 10, ("5", None, "JSONDecodeError"): 1}
    assert {r.fault for r in pages.pages(spark, path).where("page = '2'").collect()} == {"JSONDecodeError"}


def test_live_windows_go_on_from_their_offset(spark, service, tmp_path):
    path, fallback = service
    out = str(tmp_path / "out")
    stop_after = lambda n: [r.object_id for r in spark.read.schema(pages.SCHEMA).parquet(f"{out}/rows").orderBy("object_id").collect()][:n]
    for _ in range(2):
        query = pages.live(spark, path, 25_500, 20_000, fallback).where("fault IS NULL").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert stop_after(1000) == [i for i in range(26, 100) if i // 10 != 5]
    offsets = [json.loads(x.read_text().splitlines()[-1])["t"] for x in sorted((tmp_path / "out/checkpoint/offsets").glob("[0-9]*"))]
    assert len(offsets) >= 4 and all(b - a <= 20_000 for a, b in zip(offsets, offsets[1:]))


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_images_are_read_as_they_were_packed(spark, channels):
    rng = np.random.default_rng(channels)
    held = {f"{k}.png": rng.integers(0, 256, (int(rng.integers(1, 30)), int(rng.integers(1, 20)), channels)) // (1 + k % 3) for k in range(20)}
    files = [(n, images.packed(v, rng.integers(0, 5, len(v)))) for n, v in held.items()]
    got = images.strips(spark.createDataFrame(files, "name string, content binary").repartition(3)).collect()
    for name, v in held.items():
        rows = sorted((r.y, r.pixels) for r in got if r.name == name)
        assert np.array_equal(np.array([p for _, p in rows]), v.reshape(len(v), -1)) and [y for y, _ in rows] == list(range(len(v)))


def test_faulty_images_are_told(spark):
    good = images.packed(np.full((3, 4, 3), 7), [0, 1, 2])
    spoilt = bytearray(good)
    spoilt[-20] ^= 1
    at = good.index(b"IDAT") - 4
    filtered = zlib.compress(b"\x05" + bytes(12) + bytes(26))
    piece = len(filtered).to_bytes(4, "big") + b"IDAT" + filtered + zlib.crc32(b"IDAT" + filtered).to_bytes(4, "big")
    short = zlib.compress(bytes(10))
    less = len(short).to_bytes(4, "big") + b"IDAT" + short + zlib.crc32(b"IDAT" + short).to_bytes(4, "big")
    end = good[-12:]
    cases = {"good": good, "spoilt": bytes(spoilt), "cut": good[:-5], "text": b"no image", "none": None, "filter": good[:at] + piece + end, "short": good[:at] + less + end, "empty": good[:at] + end}
    got = {}
    for r in images.strips(spark.createDataFrame(list(cases.items()), "name string, content binary")).collect():
        got.setdefault(r.name, set()).add(r.fault)
    assert got == {"good": {None}, "spoilt": {"checksum"}, "cut": {"cut off"}, "text": {"no image"}, "none": {"no image"}, "filter": {"filter"}, "short": {"length"}, "empty": {"length"}}


def test_store_keeps_a_content_once(spark, tmp_path):
    store = str(tmp_path / "store")
    files = spark.createDataFrame([(f"f{k}", bytes([k % 3])) for k in range(9)], "name string, content binary")
    assert blobs.manifest(spark, store) is None
    assert blobs.keep(files, store, 0)[0] == 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/contents").rglob("*.blob")}
    assert blobs.keep(files, store, 1)[0] == 0
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store/contents").rglob("*.blob")} == before
    more = files.union(spark.createDataFrame([("g", b"new"), ("h", b"")], "name string, content binary"))
    assert blobs.keep(more, store, 2)[0] == 2
    held = {r.name: r.hash for r in blobs.manifest(spark, store).collect()}
    assert len(held) == 11 and all((tmp_path / f"store/contents/{h[:2]}/{h}.blob").exists() for h in held.values())
    assert blobs.keep(files.limit(0), store, 3)[0] == 0


def test_files_of_folders_are_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "READ_ROWS", 3)
    held = {f"{k}.bin": bytes([k]) * k for k in range(40)}
    assert blobs.read_files(spark, str(tmp_path / "none")).count() == 0
    assert blobs.write_files(spark.createDataFrame([(f"{len(v) % 7}/{k}", v) for k, v in held.items()], "name string, content binary"), str(tmp_path / "files")) == 40
    got = blobs.read_files(spark, str(tmp_path / "files"))
    assert {r.name: bytes(r.content) for r in got.collect()} == held and got.rdd.getNumPartitions() > 1
    (tmp_path / "store/contents/6e").mkdir(parents=True)
    known = "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d"  # of one zero byte
    (tmp_path / f"store/contents/6e/{known}.blob").write_bytes(b"\0")
    assert [r[0] for r in blobs._lacking(spark.createDataFrame([(known,), ("ab" * 32,)], "hash string"), str(tmp_path / "store")).collect()] == ["ab" * 32]


def plain_labels(rows):
    """Line by line, in order, in each view."""
    out = []
    for view in sorted({r.view for r in rows}):
        placed, count = [], {}
        for line in sorted({r.line for r in rows if r.view == view}):
            mine = sorted((r.far, r.at, r.px, r.py, r.elevation) for r in rows if r.view == view and r.line == line)
            elevation = mine[0][4]
            if len(placed) >= labels.PER_VIEW or count.get(elevation, 0) >= labels.PER_ELEVATION:
                continue
            free = [m for m in mine if not any(abs(m[2] - x) < labels.BOX_X and abs(m[3] - y) < labels.BOX_Y for x, y in placed)]
            if free:
                placed.append(free[0][2:4])
                count[elevation] = count.get(elevation, 0) + 1
                out.append((view, line, elevation, *free[0][1:4]))
    return out


def test_labels_are_those_of_the_greedy_order(spark):
    places = feed_queries.label_places(spark, SF).where("line < 60")
    crowded = places.withColumns({"view": F.lit(9).cast("long"), "elevation": F.col("line") % 30, "px": F.col("px") / 2, "py": F.col("py") / 2})
    both = places.unionByName(crowded).checkpoint()
    got = sorted(tuple(r) for r in labels.placed_labels(both).collect())
    want = plain_labels(both.collect())
    assert got == want and max(sum(r[0] == v for r in want) for v in {r[0] for r in want}) > 12
    assert labels.placed_labels(both.limit(0)).count() == 0


def test_labels_take_no_rounds(spark):
    places = feed_queries.label_places(spark, SF).where("line < 60").withColumn("view", F.floor(F.col("line") / 40))
    spark.sparkContext.setJobGroup("labels", "labels")
    got = sorted(tuple(r) for r in labels.placed_labels(places).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("labels"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_labels(places.collect()) and jobs <= 4


def test_labels_keep_their_view_over_batches(spark):
    rows = [(v, line, line % 40, 0, float(line * 90), 0.0, 1.0) for v in (1, 2) for line in range(50)] + [(None, 0, 0, 0, 0.0, 0.0, 0.0), (3, 0, 0, 0, None, 0.0, 0.0)]
    places = spark.createDataFrame(rows, "view long, line long, elevation long, at long, px double, py double, far double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = [(r.view, r.line) for r in labels.placed_labels(places).orderBy("view", "line").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(v, line) for v in (1, 2) for line in range(labels.PER_VIEW)]


def test_playback_is_the_plain_cursor(spark):
    days = feed_queries.playback_days(spark, SF)
    order, at, want = {d: k for k, (d, _) in enumerate(days)}, {}, []
    rows = sorted((r.seq, r.cursor, r.command) for r in feed_queries.playback_commands(spark, SF).collect())
    for seq, cursor, command in rows:
        now = playback.stepped(at.get(cursor, [days[0][0], 0, False, False, 0]), command, days, order, playback.MOST_DAYS)
        at[cursor] = now
        want.append((cursor, seq, now[0], now[1], "paused" if now[3] else "playing" if now[2] else "stopped"))
    assert sorted(map(tuple, feed_queries.o9(spark, SF).collect())) == sorted(want)


def test_a_cursor_pauses_and_wraps():
    days, order = [(5, 2), (6, 1), (7, 3)], {5: 0, 6: 1, 7: 2}
    told = {
        "back": (5, 1, False, False), "step": (6, 0, False, False), "back ": (5, 1, False, False), "play": (5, 1, True, False), "step ": (6, 0, False, True), "step  ": (6, 0, False, True), "play ": (6, 0, False, True),
        "confirm": (6, 0, True, False), "step   ": (7, 0, False, True), "confirm ": (7, 0, True, False), "step    ": (7, 1, True, False), "step     ": (7, 2, True, False), "step      ": (7, 0, True, False), "stop": (7, 0, False, False), "back  ": (6, 0, False, False),
    }
    at = [5, 0, False, False, 0]
    for command, want in told.items():
        at = playback.stepped(at, command.strip(), days, order, 1)
        assert tuple(at[:4]) == want, command


def test_an_idle_cursor_is_forgotten(spark, tmp_path):
    schema = "cursor string, seq long, command string, ts timestamp"
    at = lambda cursor, seq, hour: (cursor, seq, "step", datetime(2024, 1, 1) + timedelta(hours=hour))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in ([at("a", 1, 0), at("b", 2, 0), at("a", 3, 1)], [at("b", 4, 40)], [at("a", 5, 41), at("b", 6, 42)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
            playback.cursors(stream, [(5, 9)], 24 * 3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.seq: r.place for r in got if r.seq} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 3}
    assert [(r.cursor, r.place) for r in got if r.state == "forgotten"] == [("a", 2)]


def test_features_of_any_document(spark):
    area = '{"type": "Polygon", "coordinates": [[[1, 2], [3, 4.5], [1, 2]]]}'
    rows = [(1, area), (2, f'{{"type":"Feature","geometry":{area}}}'), (3, '{"type":"FeatureCollection","features":[{"geometry":null},5,' + f'{{"geometry":{area},"properties":{{"p":[1]}}}}]}}'), (4, None), (5, "{"), (6, "[]"), (7, '{"type":"FeatureCollection"}'), (8, '{"type": 5}'), (9, '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}'), (10, '{"type":"Polygon","coordinates":"x"}')]
    f = features.chosen_feature(F.col("text"))
    got = {r.k: (r.kind, r.rings) for r in spark.createDataFrame(rows, "k long, text string").select("k", f.alias("f")).select("k", "f.kind", features.rings_of(F.col("f.geometry")).alias("rings")).collect()}
    ring = [[[1.0, 2.0], [3.0, 4.5], [1.0, 2.0]]]
    assert got == {1: ("geometry", ring), 2: ("Feature", ring), 3: ("FeatureCollection", ring), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: ("Feature", None), 10: ("geometry", None)}


def test_contour_queries_match_a_plain_tracer(spark):
    from test_terrain import filtered, plain_lines

    rows = terrain_queries.raster(spark, SF).collect()
    z = np.full((max(r.y for r in rows) + 1, terrain_queries.WIDE), np.nan)
    for r in rows:
        z[r.y, r.x] = np.nan if r.z is None else r.z
    want = {k: len(filtered(v, 0.1, 1.0)) for k, v in plain_lines(z, terrain_queries.INTERVAL).items()}
    got = {}
    for r in terrain_queries.a24(spark, SF).collect():
        got[r.level] = r.lines
        assert r["index"] == (r.level % 25 == 0)
    assert got == {k: n for k, n in want.items() if n}


def test_packed_rows_are_handed_over_bit_by_bit(monkeypatch):
    monkeypatch.setattr(readers, "ROWS", 10)
    found = [(1, [np.arange(25), np.arange(25) * 2]), (2, [np.arange(0), np.arange(0)]), (3, [np.arange(4), np.arange(4)]), (4, [np.arange(9), np.arange(9)])]
    out = list(readers._handed(["k", "i", "v"], iter(found)))
    assert max(b.num_rows for b in out) < 20 and [b.num_rows for b in out][:2] == [10, 10]
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(k, int(i), int(v)) for k, (a, b) in found for i, v in zip(a, b)]


def test_strips_and_indexes_that_are_spoilt_give_no_rows(spark):
    strip = lambda n: base64.b64encode(gzip.compress(np.arange(n, dtype="<u2").tobytes())).decode()
    strips = spark.createDataFrame([(1, 2, 3, strip(6)), (2, 2, 3, strip(5)), (3, 0, 0, strip(0)), (4, 1, 1, strip(1))], "tile long, width int, rows int, data string")
    assert [tuple(r) for r in readers.strip_values(strips).orderBy("tile", "i").collect()] == [(1, i, i) for i in range(6)] + [(4, 0, 0)]
    indexes = spark.createDataFrame([(1, 2, bytes([5, 0x81, 1])), (2, 3, bytes([5, 1])), (3, 1, bytes([0x81])), (4, 2, bytes([5, 0])), (5, 0, b"")], "stage long, n int, data binary")
    assert sorted(tuple(r) for r in readers.delta_cells(indexes).collect()) == [(1, 5), (1, 134)]
    assert readers.strip_values(strips.limit(0)).count() == 0 and readers.delta_cells(indexes.limit(0)).count() == 0
