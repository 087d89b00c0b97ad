"""Operator 8, benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names and units turn into typed placeholders, a run of name words (or of number words)
into one; other words are lower-cased and stripped of punctuation. A capitalised word that opens a sentence is a name too
unless it is one of ``OPENERS``. Windows of ``WINDOW`` tokens are hash-joined between the benchmark and all documents: by
template where they hold ``LITERALS`` ordinary words, by their very words where they hold fewer.

A document holds an item if at least ``COVERAGE`` of the item's windows are found near one alignment (places may drift by
half a ``REACH``, so inserted and dropped words do no harm) and agree on the slots: for each filler of the item the document's
most frequent filler there is taken, and a window counts if all its slots have these. So a question that was asked again
with other numbers or names is caught, and a text that has only its shape in common is not.

Windows that many items share don't pair documents with all of these: of an item's n windows, of which c must be found, one
of the n - c + 1 that fewest items have is among them, so only those propose a pair. The benchmark is read in blocks of whole
items with about ``BLOCK`` windows, so what each task holds is bounded.

Defined results: null texts count as empty; an item shorter than a window is one window of its own length; an item without
words can't be found; repeated rows count once; an empty table or benchmark gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import docstats as S
from . import textops as X
from .common import NO_ID, documents, fresh, keyed, named, store, table, tag_of

WINDOW, LITERALS, COVERAGE, REACH = 8, 4, 0.5, 16
BLOCK = 250_000
# Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz ton tons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ml l liter liters litre litres c f k kelvin celsius fahrenheit degree degrees percent % $ € £ dollar dollars euro euros cent cents usd eur v w kw kwh hz mhz ghz n pa kpa j kj cal kcal mol kmh mph".split()
# Numbers in words, and words that open sentences without being names.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
OPENERS = "a an the this that these those it he she they we you i his her their our its if in on at to of for from by with and or but not so as then there here each every all some any no when while where what which who whose why how is are was were do does did can could will would should after before".split()
NUMBER, NAME, UNIT, PLAIN = (X.U(k) for k in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
WINDOWS = "id long, tag long, place int, width int, window long, fillers array<long>"


def _plain(w: X.Words) -> np.ndarray:
    """Hash of each word in lower case, without punctuation around it."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        if len(end):
            end -= S._PUNCT[w.data[end - 1]] & (end > start + 1)
            start += S._PUNCT[w.data[np.minimum(start, len(w.data) - 1)]] & (start < end - 1)
    return X.spans_hash(X.BYTE[_LOWER[w.data]], start, end)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(_plain(X.split(pa.array(words))))


_UNITS, _NUMBERS, _OPENERS = _hashes(UNITS), _hashes(NUMBERS), _hashes(OPENERS)


@dataclass
class Tokens:
    """Template tokens of a slice: kind and own hash, whether they are slots, their document, offsets of the documents."""

    token: np.ndarray
    filler: np.ndarray
    slot: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def template(w: X.Words) -> Tokens:
    plain = _plain(w)
    if not len(plain):
        return Tokens(plain, plain, np.zeros(0, bool), w.doc, w.first)
    same = np.zeros(len(plain), bool)
    same[1:] = w.doc[1:] == w.doc[:-1]
    digits = np.concatenate([[0], np.cumsum(S._DIGIT[w.data])])
    number = (digits[w.end] > digits[w.start]) | S.member(plain, _NUMBERS)
    begins = ~same
    begins[1:] |= _STOP[w.data[w.end[:-1] - 1]]
    after = np.zeros(len(plain), bool)
    after[1:] = number[:-1] & same[1:]
    unit = after & ~number & S.member(plain, _UNITS)
    head = w.data[np.minimum(w.start + (S._PUNCT[w.data[w.start]] & (w.end > w.start + 1)), len(w.data) - 1)]
    second = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    upper = S._UPPER[head] | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = upper & ~number & ~unit & ~(begins & S.member(plain, _OPENERS))
    goes_on = np.zeros(len(plain), bool)
    goes_on[1:] = same[1:] & ~S._PUNCT[w.data[w.end[:-1] - 1]] & ~begins[1:] & ((name[1:] & name[:-1]) | (number[1:] & number[:-1]))
    at = np.flatnonzero(~goes_on)
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, plain)))[at]
    filler = X.spans_hash(plain, at, np.append(at[1:], len(plain)))
    return Tokens(token, filler, (number | unit | name)[at], w.doc[at], np.searchsorted(at, w.first))


class Bits:
    """Membership in sorted keys, with a bit table first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, np.zeros(1 << 23, bool)
        self.bits[(keys & X.U((1 << 23) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[(h & X.U((1 << 23) - 1)).astype(np.int64)])
        return at[S.member(h[at], self.keys)] if len(self.keys) and len(at) else at[:0]


def windows(rows: DataFrame, widths: tuple[int, ...] | None = None, keys: np.ndarray | None = None) -> DataFrame:
    """WINDOWS of (id, tag, text) rows: of the given widths and keys, or, for a benchmark, all of each item's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if keys is None else Bits(keys)
        for part in X.slices(batches):
            t = template(X.split(part.column("text")))
            slots = np.concatenate([[0], np.cumsum(t.slot)])
            filler, size, exact = t.filler[t.slot].astype(np.int64), np.diff(t.first), np.where(t.slot, t.filler, t.token)
            ids, tags = part.column("id").to_numpy(), part.column("tag").to_numpy()
            for width in widths or sorted({min(WINDOW, int(n)) for n in size if n}):
                count = len(t.token) - width + 1
                if count <= 0:
                    continue
                at = np.flatnonzero(t.doc[:count] == t.doc[width - 1 :])
                if widths is None:
                    at = at[np.minimum(size[t.doc[at]], WINDOW) == width]
                few = width - (slots[at + width] - slots[at]) < min(LITERALS, width)
                h = np.where(few, X.mix(X.spans_hash(exact, at, at + width) ^ PLAIN), X.spans_hash(t.token, at, at + width)) ^ X.mix(np.full(1, width, np.uint64))
                if known is not None:
                    hit = known(h)
                    at, h = at[hit], h[hit]
                if not len(at):
                    continue
                doc, lo, hi = t.doc[at], slots[at], slots[at + width]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)), pa.array(np.concatenate([filler[a:b] for a, b in zip(lo, hi, strict=True)]), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(tags[doc]), pa.array((at - t.first[doc]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(h.astype(np.int64)), values], names=[f.split()[0] for f in WINDOWS.split(", ")])

    return rows.select("id", "tag", "text").mapInArrow(run, WINDOWS)


ITEM = ["item_id", "item_tag"]


def items(benchmark: DataFrame, coverage: float) -> DataFrame:
    """The benchmark's windows: ITEM, item_place, width, window, item_fillers, n_windows, and whether they propose a pair."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("id"), tag_of(text).alias("tag"), text.alias("text")).distinct()
    own = windows(rows).select(F.col("id").alias("item_id"), F.col("tag").alias("item_tag"), F.col("place").alias("item_place"), "width", "window", F.col("fillers").alias("item_fillers"))
    common = own.groupBy("window", "width").agg(F.count(F.lit(1)).alias("common"))
    rank = F.row_number().over(Window.partitionBy(*ITEM).orderBy("common", "window", "item_place"))
    ranked = own.join(common, ["window", "width"]).withColumns({"rank": rank, "n_windows": F.count(F.lit(1)).over(Window.partitionBy(*ITEM))})
    rare = F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * coverage) + 1
    return store(ranked.select(*ITEM, "item_place", "width", "window", "item_fillers", "n_windows", rare.alias("proposes")), "benchmark-windows")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(id, tag, item_id, n_matched, coverage, reparameterised) of each document and an item that it holds."""
    own = items(benchmark, coverage)
    shape = own.agg(F.count(F.lit(1)), F.collect_set("width")).first()
    blocks, widths = max(1, -(-shape[0] // BLOCK)), tuple(sorted(shape[1])) or (WINDOW,)
    rows, found = keyed(docs), []
    for block in range(blocks):
        mine = own.where(F.pmod(F.xxhash64(*ITEM), F.lit(blocks)) == block)  # about BLOCK rows, so they may go to all tasks
        keys = np.unique(np.array([r[0] for r in mine.select("window").distinct().collect()], np.int64).astype(np.uint64))
        seen = store(windows(rows, widths, keys), "document-windows")
        pairs = seen.join(F.broadcast(mine.where("proposes").select(*ITEM, "window", "width")), ["window", "width"]).select("id", "tag", *ITEM).distinct()
        found.append(pairs.join(seen, ["id", "tag"]).join(F.broadcast(mine), [*ITEM, "window", "width"]))
    return judged(reduce(DataFrame.unionByName, found), coverage)


def judged(hits: DataFrame, coverage: float) -> DataFrame:
    """The pairs of a document and an item whose hits (windows in common) cover the item near one alignment, with slots that
    agree. Hits near one alignment share one of two overlapping ranges of shifts."""
    shift = F.col("place") - F.col("item_place")
    ranges = F.array(F.struct(F.lit(0).alias("k"), F.floor(shift / REACH).alias("at")), F.struct(F.lit(1).alias("k"), F.floor((shift + REACH / 2) / REACH).alias("at")))
    group = ["id", "tag", *ITEM, "n_windows", "near"]
    hits = store(hits.select("id", "tag", *ITEM, "n_windows", F.explode(ranges).alias("near"), "item_place", F.arrays_zip("item_fillers", "fillers").alias("slots")), "benchmark-hits")
    told = hits.select(*group, F.explode("slots").alias("s")).groupBy(*group, F.col("s.item_fillers").alias("item_filler"), F.col("s.fillers").alias("filler")).agg(F.count(F.lit(1)).alias("n"))
    most = told.groupBy(*group, "item_filler").agg(F.max(F.struct("n", "filler")).alias("m")).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("item_filler", "m.filler"))).alias("taken"))
    agrees = F.forall("slots", lambda s: F.element_at("taken", s["item_fillers"]) == s["fillers"])
    changed = F.exists("slots", lambda s: s["item_fillers"] != s["fillers"])
    kept = hits.join(most, group, "left").where((F.size("slots") == 0) | agrees)
    share = F.col("n_matched") / F.col("n_windows")
    held = kept.groupBy(*group).agg(F.countDistinct("item_place").alias("n_matched"), F.max(changed).alias("changed")).where(share >= coverage)
    return held.groupBy("id", "tag", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max(share).alias("coverage"), F.min("changed").alias("reparameterised"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that it holds."""
    found = matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
    return found.select(back("id")("doc_id"), back("item_id")("item_id"), "n_matched", "coverage", "reparameterised")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all others stay with their own columns."""
    leak = fresh(docs, "leak")
    bad = matches(docs, table(spark, sf_dir, "benchmark")).select(F.struct("id", "tag").alias(leak)).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), tag_of(text).alias("tag"))
    return docs.withColumn(leak, key).join(bad, leak, "left_anti").select(*named(docs.columns))
