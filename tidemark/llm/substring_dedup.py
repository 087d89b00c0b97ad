"""Operator 5, substring deduplication with a log-structured fingerprint index.

A window is ``WIDTH`` consecutive words of one document. A window's key is the least hash of its ``GRAM``-word grams, so
equal windows share a key and neighbours mostly do too: consecutive windows of one key are a stretch, and a stretch is one
row (key, digest of its words, document, first word, windows).

The index is a list of immutable runs: Parquet rows of the distinct stretches of earlier batches, sorted by key. A new
batch is cut into stretches, dealt by key and merged with the runs in key order:

* a stretch whose digest (128 bits of BLAKE2b over the words themselves) stands earlier is a repeat, all its windows;
* a stretch that is the first of its digest is looked at closer where its key has other digests, or where it holds one
  window twice: the digests of its single windows are taken from the text and compared in the same way.

So keys only propose, and words decide through their digests; a clash of keys costs work, never a result. The batch's first
stretches become the next run; where there would be more than ``MOST_RUNS`` runs, the merge writes all of them as one.

Hot groups: a slice of text reports a stretch or window once and marks the others of it as repeats where it stands, so a
passage that many rows hold is summed before it moves; keys with many different stretches (found on ``SAMPLE_DOCS`` rows;
this sets the layout only) are dealt over ``PARTS`` parts, and all their stretches are looked at closer.

Defined results: a null or empty text has no words; windows are judged on the input; a null doc_id comes before all
others; equal (doc_id, start) is not earlier, so a repeated row doesn't remove itself; a row in gives a row out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import NO_ID, bounded, documents, keyed, store

WIDTH, GRAM = 20, 6
SLICE_BYTES = 2 << 20  # text bytes that a task holds in arrays at a time
MOST_RUNS = 1
BATCHES = 3
PARTS, SPREAD = 1024, 1 << 20  # shares of a hot key; of rows that are known to repeat
SAMPLE_DOCS, HOT_SHARE, HOT_LEAST, MOST_HOT = 10_000, 0.005, 50, 1 << 16
STRETCH = "key long, deal long, w1 long, w2 long, id long, tag long, start int, size int, again boolean, known boolean"
RUN = ["key", "deal", "w1", "w2", "id", "tag", "start", "size", "again", "batch"]
PLACE = ("batch", "id", "start")  # the order in which windows stand


def expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start .. start + size - 1 of each entry in turn, and the entry."""
    entry = np.repeat(np.arange(len(size)), size)
    return np.repeat(start, size) + np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size), entry


def digests(w: X.Words, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each span of ``count`` words from ``first``: BLAKE2b of the words, joined by one space."""
    length = w.end - w.start
    begin = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    out[expand(begin, length)[0]] = w.data[expand(w.start, length)[0]]
    view, last = memoryview(out.tobytes()), first + count - 1
    hashes = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin[first].tolist(), (begin + length)[last].tolist(), strict=True)]
    return np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)


def later(digest: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an equal digest at an earlier (id, start) among these rows."""
    order = np.lexsort((start, ids, digest[:, 1], digest[:, 0]))
    d = digest[order]
    same = np.zeros(len(order), bool)
    same[1:] = (d[1:] == d[:-1]).all(1)
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), bool)
    out[order] = same & ((ids[order] != ids[order[lead]]) | (start[order] != start[order[lead]]))
    return out


def stretch_keys(w: X.Words, at: np.ndarray) -> np.ndarray:
    """The key of the window at each word of ``at``: the least gram hash."""
    every = np.arange(len(w.start) - GRAM + 1)
    low = X.spans_hash(w.hash, every, every + GRAM)
    span, reach = 1, WIDTH - GRAM + 1
    while span < reach:  # the least of each run of ``reach`` grams, by doubling
        step = min(span, reach - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return X.mix(low[at] ^ X.U(0xA5A5A5A5))


def stretches(w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word and windows of each stretch, and whether it may hold one window twice."""
    n = len(w.start)
    at = np.flatnonzero(w.doc[: n - WIDTH + 1] == w.doc[WIDTH - 1 :]) if n >= WIDTH else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, np.zeros(0, bool)
    key = stretch_keys(w, at)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
    head, entry = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(head, len(at)))
    again = size > WIDTH - GRAM + 1
    prints = X.spans_hash(w.hash, at, at + WIDTH)
    for lag in range(1, WIDTH - GRAM + 1):
        hit = np.flatnonzero(prints[lag:] == prints[:-lag])
        again[entry[hit][entry[hit] == entry[hit + lag]]] = True
    return key[head], at[head], size, again


def stretch_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """STRETCH of (id, tag, text) rows. ``known``: an equal stretch stands earlier in the same slice of text."""
    hot = np.sort(hot.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, size=SLICE_BYTES):
            w = X.split(part.column("text"))
            key, first, size, again = stretches(w)
            if not len(key):
                continue
            doc, key = w.doc[first], key.astype(np.int64)
            ids, start, digest = part.column("id").to_numpy()[doc], first - w.first[doc], digests(w, first, size + WIDTH - 1)
            known = later(digest, ids, start)
            spread = X.mix(digest[:, 0].astype(np.uint64) ^ X.mix(ids.astype(np.uint64) + start.astype(np.uint64)))
            deal = np.where(known, -1 - (spread % X.U(SPREAD)).astype(np.int64), np.where(np.isin(key, hot), 1 + (digest[:, 0].astype(np.uint64) % X.U(PARTS)).astype(np.int64), 0))
            digest, key = np.where(known[:, None], 0, digest), np.where(known, 0, key)  # known rows are judged, so they travel light
            cols = [key, deal, digest[:, 0], digest[:, 1], ids, part.column("tag").to_numpy()[doc], start.astype(np.int32), size.astype(np.int32), again, known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in STRETCH.split(", ")])

    return docs.select("id", "tag", "text").mapInArrow(run, STRETCH)


def hot_keys(rows: DataFrame) -> np.ndarray:
    """Keys of many different stretches, by a sample; at most ``MOST_HOT``. They set how rows are dealt, not what is found."""
    some = bounded(rows, SAMPLE_DOCS, F.struct("id", "tag"))
    least = max(HOT_LEAST, HOT_SHARE * some.count())
    count = stretch_rows(some, np.zeros(0, np.int64)).where("NOT known").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.array([r["key"] for r in count.orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()], np.int64)


@dataclass
class FingerprintIndex:
    """Immutable sorted runs of the distinct stretches of all batches so far."""

    spark: SparkSession
    hot: np.ndarray
    runs: list[DataFrame] = field(default_factory=list)
    batches: int = 0

    def history(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.runs) if self.runs else None

    def merge(self, docs: DataFrame, add: bool = True) -> DataFrame:
        """(batch, id, tag, start, size, is_repeat): stretches of the batch of (id, tag, text) rows that repeat, and those
        of any batch that ``closer`` has to look at. ``add``: the batch's first stretches become a run, or one run with all
        earlier ones."""
        rows = stretch_rows(docs, self.hot).withColumn("batch", F.lit(self.batches))
        if (old := self.history()) is not None:
            rows = rows.unionByName(old.withColumn("known", F.lit(False)))
        # one shuffle by key, sorted once: stretches of one digest, and all of one key, stand together
        digest, key = Window.partitionBy("key", "deal", "w1", "w2"), Window.partitionBy("key", "deal")
        rows = rows.repartition("key", "deal").withColumn("first", F.min(F.struct(*PLACE)).over(digest))
        several = (F.min("w1").over(key) != F.max("w1").over(key)) | (F.min("w2").over(key) != F.max("w2").over(key))
        rows = rows.withColumns({"several": several, "newest": F.max("batch").over(key)})
        repeat = F.col("known") | (F.col("first") < F.struct(*PLACE))
        closer = ~repeat & (F.col("newest") == self.batches) & (F.col("again") | F.col("several") | (F.col("deal") > 0))
        own, compacts = F.col("batch") == self.batches, add and len(self.runs) >= MOST_RUNS
        flagged = rows.select(*RUN, repeat.alias("is_repeat"), closer.alias("closer"))
        if not compacts:
            flagged = flagged.where(own | F.col("closer") if add else "is_repeat OR closer")
        merged = store(flagged, "substring-merge")
        if compacts:  # all runs and the batch have met here in key order, so what is written is the one run already
            self.runs = [merged.where("NOT is_repeat").select(*RUN)]
        elif add:
            self.runs.append(merged.where(own & ~F.col("is_repeat")).select(*RUN))
        self.batches += 1
        return merged.where("is_repeat OR closer").select("batch", "id", "tag", "start", "size", "is_repeat")

    def _sorted(self) -> DataFrame:
        return self.history().repartitionByRange("key").sortWithinPartitions("key", "deal", "w1", "w2")

    def save(self, path: str) -> None:
        """The whole index as one run in a folder, to be opened by a later job."""
        self._sorted().withColumn("batches", F.lit(self.batches)).write.parquet(path)

    @staticmethod
    def open(spark: SparkSession, path: str, hot: np.ndarray) -> FingerprintIndex:
        held = spark.read.parquet(path)
        return FingerprintIndex(spark, hot, [held.select(*RUN)], held.agg(F.max("batches")).first()[0] or 0)


def closer(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(batch, id, tag, start, size) of the single windows in ``found`` stretches whose words stand earlier; ``docs`` has the
    texts of all batches."""
    spots = found.where("NOT is_repeat").select("batch", "id", "tag", "start", "size").distinct()
    spots = spots.groupBy("id", "tag").agg(F.min("batch").alias("batch"), F.collect_list(F.struct("start", "size")).alias("spots"))
    schema = "w1 long, w2 long, deal long, batch int, id long, tag long, start int, known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, size=SLICE_BYTES):
            w = X.split(part.column("text"))
            spots = part.column("spots")
            flat, doc = spots.flatten(), np.repeat(np.arange(part.num_rows), spots.value_lengths().to_numpy())
            at, entry = expand(w.first[doc] + flat.field("start").to_numpy(), flat.field("size").to_numpy().astype(np.int64))
            at = np.unique(at)
            if not len(at):
                continue
            doc = w.doc[at]
            ids, start, digest = part.column("id").to_numpy()[doc], at - w.first[doc], digests(w, at, np.full(len(at), WIDTH))
            known = later(digest, ids, start)
            deal = np.where(known, 1 + (X.mix(ids.astype(np.uint64) + start.astype(np.uint64)) % X.U(SPREAD)).astype(np.int64), 0)
            digest = np.where(known[:, None], 0, digest)
            cols = [digest[:, 0], digest[:, 1], deal, part.column("batch").to_numpy()[doc], ids, part.column("tag").to_numpy()[doc], start.astype(np.int32), known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in schema.split(", ")])

    windows = docs.join(spots, ["id", "tag"]).select("id", "tag", "text", "batch", "spots").mapInArrow(run, schema)
    first = F.min(F.struct(*PLACE)).over(Window.partitionBy("w1", "w2", "deal"))
    return windows.withColumn("first", first).where(F.col("known") | (F.col("first") < F.struct(*PLACE))).select("batch", "id", "tag", "start", F.lit(1).alias("size"))


def repeated_windows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(id, tag, start, size) of the repeated windows: the documents in batches of rising doc_id, each merged with the runs
    of those before it."""
    rows = keyed(docs)
    index = FingerprintIndex(docs.sparkSession, hot_keys(rows))
    cuts = [k / batches for k in range(1, batches)]
    limits = rows.where(F.col("id") != NO_ID).agg(F.percentile_approx("id", cuts)).first()[0] if cuts else None
    edges = [None, *sorted({int(x) for x in limits or []}), None]
    found = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = rows if lo is None else rows.where(F.col("id") > lo)
        part = part if hi is None else part.where(F.col("id") <= hi)
        found.append(index.merge(part, add=hi is not None))
    every = reduce(DataFrame.unionByName, found)
    return every.where("is_repeat").select("id", "tag", "start", "size").unionByName(closer(rows, every).drop("batch"))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): the words that no repeated window covers, by one space."""
    spans = found.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, size=SLICE_BYTES):
            ids, texts, spans = (batch.column(c) for c in ("id", "text", "spans"))
            cols: list[list] = [[] for _ in range(5)]
            for doc, text, own in zip(ids.to_pylist(), texts, spans, strict=True):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                if own.is_valid:
                    start, size = own.values.field("start").to_numpy(), own.values.field("size").to_numpy()
                    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size + WIDTH - 1, minlength=n + 1)
                    words = [x for x, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
                kept = b" ".join(words)
                for c, v in zip(cols, (None if doc == NO_ID else doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return keyed(docs).join(spans, ["id", "tag"], "left").select("id", "text", "spans").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Each row of ``docs`` with what is left of its text."""
    return remove(docs, repeated_windows(docs, batches))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
