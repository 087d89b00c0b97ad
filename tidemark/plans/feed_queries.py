"""Paged services, live windows, schema-free features, label places, playback and the content store, with DuckDB SQL.

Stand-ins: orders are the features of a paged service, customers parcels, documents of unknown kind, contour lines and files,
events live readings and playback commands. Label places and playback have no SQL; tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as G
from ..operators.labels import placed_labels
from ..sources import blobs, pages
from ..sources.tables import DAY, readings, scratch, table
from ..streaming.playback import cursors

PAGE, BAD, WORSE = 500, 4, 9  # rows of a page; one page in BAD can't be read, and one in WORSE not from the fallback either


def service(spark, sf, rows):
    """A paged service with spoilt pages, and its fallback."""
    path, fallback = scratch(spark, "service"), scratch(spark, "fallback")
    pages.write_pages(rows, path, PAGE, f"page % {BAD} = 1 OR page % {WORSE} = 5")
    pages.write_pages(rows, fallback, PAGE, f"page % {WORSE} = 5")
    return path, fallback


def _orders(spark, sf):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), micros.alias("t"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("kind"))


def a21(spark, sf):
    """Structures by a range of ids: pages outside of it aren't opened, pages that fail come from the fallback."""
    rows = pages.pages(spark, *service(spark, sf, _orders(spark, sf)))
    return rows.where("object_id >= 300 AND object_id < 1200").select("object_id", F.round("value", 2).alias("value"), "kind", "origin")


_A21 = f"SELECT o_orderkey AS object_id, round(o_totalprice, 2) AS value, o_orderstatus AS kind, CASE WHEN o_orderkey // {PAGE} % {BAD} = 1 THEN 'fallback' ELSE 'service' END AS origin FROM orders WHERE o_orderkey >= 300 AND o_orderkey < 1200 AND o_orderkey // {PAGE} % {WORSE} <> 5"


def a22(spark, sf):
    """All pages of parcels, and the pages that neither place could give."""
    rows = pages.pages(spark, *service(spark, sf, _orders(spark, sf)))
    return rows.groupBy("page", "origin", "fault").agg(F.count("object_id").alias("features"), F.coalesce(F.min("object_id"), F.lit(-1)).alias("first"), F.coalesce(F.max("object_id"), F.lit(-1)).alias("last"))


_A22 = f"""WITH p AS (SELECT o_orderkey // {PAGE} AS page, o_orderkey FROM orders)
SELECT page::VARCHAR AS page, CASE WHEN page % {WORSE} = 5 THEN NULL WHEN page % {BAD} = 1 THEN 'fallback' ELSE 'service' END AS origin, CASE WHEN page % {WORSE} = 5 THEN 'JSONDecodeError' END AS fault,
  CASE WHEN page % {WORSE} = 5 THEN 0 ELSE count(*) END AS features, CASE WHEN page % {WORSE} <> 5 THEN min(o_orderkey) ELSE -1 END AS first, CASE WHEN page % {WORSE} <> 5 THEN max(o_orderkey) ELSE -1 END AS last FROM p GROUP BY page"""


def a11(spark, sf):
    """Readings from the third day on, window by window, as a stream reads them."""
    own = readings(spark, sf).select(F.col("seq").alias("object_id"), "t", F.col("stage").alias("value"), F.col("station_id").alias("kind"))
    path, out = scratch(spark, "live"), scratch(spark, "windows")
    pages.write_pages(own, path, PAGE)
    start, last = own.agg(F.min("t"), F.max("t")).first()
    window = max(5 * DAY, (last - start) // 6)
    query = pages.live(spark, path, start + 2 * DAY, window).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(pages.SCHEMA).parquet(f"{out}/rows").select("object_id", "t", "value", "kind")


_A11 = f"SELECT event_id AS object_id, epoch_us(ts) AS t, value, event_type AS kind FROM events WHERE epoch_us(ts) >= (SELECT min(epoch_us(ts)) FROM events) + {2 * DAY}"


def _texts():
    """A document of each kind; ``%1$d`` stands for the customer."""
    ring = "[[[%1$d.5, 40], [%1$d.5, 41], [7, 41], [%1$d.5, 40]], [[1, 2], [3, 4], [5, 6], [1, 2]]]"
    area, many, point = f'{{"type": "Polygon", "coordinates": {ring}}}', f'{{"coordinates": [{ring}, {ring}], "type": "MultiPolygon"}}', '{"type": "Point", "coordinates": [%1$d, 2]}'
    feature = lambda g: f'{{"type": "Feature", "properties": {{"name": "n%1$d", "extra": [null, {{"a": 1}}]}}, "geometry": {g}}}'
    return [feature(area), f'{{"type": "FeatureCollection", "features": [{feature(point)}, {feature(many)}, {feature(area)}]}}', area, many, '{"type": "Polygon", "coordinates": [[', f'{{"type": "FeatureCollection", "features": [{feature(point)}]}}', feature(point), '["Feature", %1$d]', point]


def _documents(spark, sf):
    k, text = F.col("c_custkey"), lambda s: F.format_string(s, F.col("c_custkey"))
    kinds = _texts()
    chosen = F.when(F.lit(False), F.lit(""))
    for n, s in enumerate(kinds):
        chosen = chosen.when(k % len(kinds) == n, text(s))
    return table(spark, sf, "customer").select(k.alias("k"), chosen.alias("text"))


def m8(spark, sf):
    """The boundary of documents of unknown kind."""
    found = _documents(spark, sf).select("k", G.chosen_feature(F.col("text")).alias("f"))
    rings = G.rings_of(F.col("f.geometry"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    return found.select("k", F.col("f.kind").alias("kind"), get(F.col("f.geometry"), "$.type", "string").alias("geometry"), get(F.col("f.properties"), "$.name", "string").alias("name"), F.size(rings).alias("n"), F.get(F.get(F.get(rings, F.lit(0)), F.lit(0)), F.lit(0)).alias("lon")).withColumn("rings", F.when(F.col("geometry").isin(*G.AREAS), F.col("n").cast("long")).otherwise(0)).drop("n")


def _m8_sql():
    texts = _texts()
    case = " ".join(f"WHEN {n} THEN replace('{s}', '%1$d', c_custkey::VARCHAR)" for n, s in enumerate(texts))
    area = "IN ('Polygon', 'MultiPolygon')"
    return f"""WITH d AS (SELECT c_custkey AS k, CASE c_custkey % {len(texts)} {case} END AS text FROM customer),
j AS (SELECT k, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM d),
t AS (SELECT k, j, j ->> '$.type' AS type, list_filter(from_json(coalesce(j -> '$.features', '[]'::JSON), '["JSON"]'), lambda f: coalesce(f ->> '$.geometry.type', '') {area})[1] AS first FROM j),
f AS (SELECT k, CASE WHEN type = 'Feature' THEN 'Feature' WHEN type = 'FeatureCollection' AND first IS NOT NULL THEN 'FeatureCollection' WHEN type {area} THEN 'geometry' END AS kind,
  CASE WHEN type = 'Feature' THEN j -> '$.geometry' WHEN type = 'FeatureCollection' THEN first -> '$.geometry' WHEN type {area} THEN j END AS g, CASE WHEN type = 'Feature' THEN j -> '$.properties' WHEN type = 'FeatureCollection' THEN first -> '$.properties' END AS p FROM t)
SELECT k, kind, g ->> '$.type' AS geometry, p ->> '$.name' AS name, CASE g ->> '$.type' WHEN 'Polygon' THEN (g ->> '$.coordinates[0][0][0]')::DOUBLE WHEN 'MultiPolygon' THEN (g ->> '$.coordinates[0][0][0][0]')::DOUBLE END AS lon,
  CASE g ->> '$.type' WHEN 'Polygon' THEN json_array_length(g, '$.coordinates')::BIGINT WHEN 'MultiPolygon' THEN (json_array_length(g, '$.coordinates[0]') + json_array_length(g, '$.coordinates[1]'))::BIGINT ELSE 0 END AS rings FROM f"""


LINES, PLACES, MAP = 150, 6, (1000.0, 600.0)  # lines of a view, places of a line, size of a view


def label_places(spark, sf):
    k, i = F.col("c_custkey"), F.col("i")
    each = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("i"))
    px, py = ((k * 97 + i * 53) % int(MAP[0])).cast("double"), ((k * 61 + i * 37) % int(MAP[1])).cast("double")
    far = F.sqrt(F.pow(px - MAP[0] / 2, F.lit(2)) + F.pow(py - MAP[1] / 2, F.lit(2)))
    return each.select(F.floor(k / LINES).alias("view"), (k % LINES).alias("line"), ((k * 7 % 11) * 25).alias("elevation"), i.alias("at"), px.alias("px"), py.alias("py"), far.alias("far"))


def a26(spark, sf):
    """The manifest of a store after the same files were kept twice, with what each run wrote."""
    store, text = scratch(spark, "store"), F.concat("c_mktsegment", F.lit(" "), F.floor(F.col("c_custkey") / 3).cast("string"))
    files = table(spark, sf, "customer").select(F.concat(F.col("c_custkey") % 256, F.lit("/"), "c_custkey", F.lit(".bin")).alias("name"), F.encode(text, "UTF-8").alias("content"))
    folder = scratch(spark, "files")
    blobs.write_files(files, folder)
    found = blobs.read_files(spark, folder)
    first, _ = blobs.keep(found, store, 0)
    again, held = blobs.keep(found, store, 1)
    return held.select("name", "hash", "size", F.lit(first).cast("long").alias("written"), F.lit(again).cast("long").alias("written_again"))


_A26 = "WITH f AS (SELECT c_custkey::VARCHAR || '.bin' AS name, c_mktsegment || ' ' || (c_custkey // 3)::VARCHAR AS content FROM customer) SELECT name, sha256(content) AS hash, strlen(content)::BIGINT AS size, (SELECT count(DISTINCT content) FROM f) AS written, 0::BIGINT AS written_again FROM f"

COMMANDS = {"click": "step", "view": "step", "error": "back", "purchase": "play", "signup": "confirm"}
IDLE = 400 * DAY // 1000  # milliseconds of event time


def playback_days(spark, sf):
    """(day, readings) in order; a list of days, as a calendar has."""
    day = F.floor(F.col("t") / DAY)
    return [(r.day, r.n) for r in readings(spark, sf).groupBy(day.alias("day")).agg(F.least(F.count(F.lit(1)), F.lit(4)).alias("n")).orderBy("day").collect()]


def playback_commands(spark, sf):
    command = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv)), F.col("station_id")), F.lit("step"))
    r = readings(spark, sf)
    return r.select((F.col("user_id") % 7).cast("string").alias("cursor"), "seq", F.when(F.col("seq") % 41 == 40, "stop").when(F.col("seq") % 5 == 0, "play").otherwise(command).alias("command"), F.timestamp_micros("t").alias("ts"))


def o9(spark, sf, thirds=(0, 1, 2)):
    """Where each command leaves its cursor. Commands arrive in three parts; the stream ends after each and goes on from its
    checkpoint with the next."""
    path, out = scratch(spark, "commands"), scratch(spark, "playback")
    own, days = playback_commands(spark, sf), playback_days(spark, sf)
    end = own.agg(F.max("seq")).first()[0] or 0
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in thirds:
            own.where(F.floor(F.col("seq") * len(thirds) / (end + 1)) == k).write.mode("append").parquet(path)
            stream = spark.readStream.schema(own.schema).parquet(path).withWatermark("ts", "1 hour")
            cursors(stream, days, IDLE).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema("cursor string, seq long, day long, place long, state string").parquet(f"{out}/rows").where("seq IS NOT NULL")


_ENTRIES = {
    "A21_structure_pages": (a21, _A21),
    "A22_parcel_pages": (a22, _A22),
    "A11_live_window": (a11, _A11),
    "M8_chosen_feature": (m8, _m8_sql()),
    "H9_label_places": (lambda spark, sf: placed_labels(label_places(spark, sf)), None),
    "O9_playback": (o9, None),
    "A26_content_store": (a26, _A26),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1]}
