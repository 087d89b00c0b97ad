"""Operator 6, near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is ``SHINGLE`` consecutive words; its weight in a document is its count times 1 + ln(rows / rows that hold it); a caller
may set a floor to the share of rows, op6 and the pipeline set none. Every shingle is counted over all rows: a slice of texts sends its distinct shingles, packed and in order, to their counters (a
counter has a range of hashes), and each counter sends back the counts in the same order, of which nearly all are small and
pack to almost nothing. The texts meet the counts of their slice and keep them as ``held``, one for each distinct shingle.

What a text shares with no other row can't make it similar to anything. So texts whose shingles of one row alone outweigh
what similarity leaves are told to be alone there and then; this loses no pair. The others go on.

Equal word sequences are one node. A node's weighted set is dealt into ``BINS`` bins by shingle hash, and each bin gives
the improved consistent weighted sample of its shingles (an empty bin takes the next one's, marked by the distance).
``ROWS`` samples make a band. Nodes that share a band are linked to the first node there and to the one before them, in
order of doc_id, never pair by pair; links are verified by the exact weighted Jaccard similarity of whole texts, and
parts of the connected components follow. Then all texts of a band that stand in different parts are compared: the weights of
the bins bound the similarity from above, block by block, and the texts of pairs that may reach it are compared exactly, in
tasks that return a forest of the links and not the pairs. So every similar pair of a band ends in one class.

Defined results: texts without words are equal to each other; a text shorter than a shingle is one shingle; a row in
gives a row out, also for repeated rows and null ids (an id of null is never a class id unless its class has no other);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import NO_ID, documents, fresh, keyed, named, split_join, store, tag_of

SHINGLE, SIMILARITY = 5, 0.8
SHARE, WHOLE = 0.01, 0.0  # lower shares count as this one, unless a caller says otherwise; op6 and the pipeline take shares as they are
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
PACK_BYTES = X.SLICE_BYTES  # text bytes whose distinct shingles are counted together first
COUNTER_SHINGLES = 1 << 21  # shingles that a counter takes, about
SIGNED_TEXTS = 1024  # texts whose samples are drawn together
PART_ROWS = 4096  # rows of a band that are chained in one task, about
BLOCK_TEXTS, TILE_TEXTS, TILE_SHINGLES = 2048, 512, 200_000  # texts of a band whose bins meet in one task; texts that meet whole
COARSE, PAIRS = 4, 1 << 16  # bins that are added up for a first bound; pairs whose bins are compared together
LOCAL_EDGES = 200_000  # edges that a task makes stars of, about
KEPT_BITS = 44  # of a shingle's hash; the rest of a word holds the document's place in its slice
PAIR = ["a_id", "a_tag", "b_id", "b_tag"]
_SALTS = X.mix(np.arange(1, 7, dtype=np.uint64) * X.U(0x9E3779B97F4A7C15))


def shingles(w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, and the count of each."""
    n = len(w.start)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    at = np.flatnonzero(w.doc[: n - SHINGLE + 1] == w.doc[SHINGLE - 1 :]) if n >= SHINGLE else np.zeros(0, int)
    start = np.concatenate([at, w.first[short]])
    end = np.concatenate([at + SHINGLE, w.first[short + 1]])
    h = X.spans_hash(w.hash, start, end) >> X.U(64 - KEPT_BITS)
    both = np.sort((w.doc[start].astype(np.uint64) << X.U(KEPT_BITS)) | h) if len(start) else np.zeros(0, np.uint64)
    head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    one = both[head]
    return (one >> X.U(KEPT_BITS)).astype(np.int64), one & X.U((1 << KEPT_BITS) - 1), np.diff(np.append(head, len(both)))


class Idf:
    """Weights of shingles by the share of rows that hold them: of those in a table, and of all others, which ``least`` of the
    rows hold. Shares below ``floor`` count as it."""

    def __init__(self, keys: np.ndarray, share: np.ndarray, least: float = SHARE, floor: float = WHOLE) -> None:
        order = np.argsort(keys)
        self.keys, self.least, self.floor = keys[order], least, floor
        self.value, self.most = self.of(share[order] / least), float(self.of(np.ones(1))[0])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), self.most)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.value[at], self.most)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The weight of a shingle that so many times ``least`` of the rows hold."""
        return 1 - np.log(np.maximum(rows * self.least, self.floor))


def weights(column: pa.Array, idf: Idf, held: pa.Array | None = None) -> tuple[X.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, (document, shingle) in order, counts, and weights of a shingle's one use: by the counts that the texts have with them
    (``held``), otherwise by the table of ``idf``."""
    w = X.split(column)
    doc, h, count = shingles(w)
    if held is None or held.null_count:
        return w, doc, h, count, idf(h)
    return w, doc, h, count, idf.of(np.frombuffer(b"".join(zstandard.decompress(x) for x in held.to_pylist()), "<u4").astype(float))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, all first bytes before all second ones, which packs better."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising shingles and their counts."""
    return zstandard.compress(planes(np.diff(keys, prepend=X.U(0)), 6) + planes(n, 4), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = zstandard.decompress(data)
    cut = len(both) // 10 * 6
    return np.cumsum(from_planes(both[:cut], 6), dtype=np.uint64), from_planes(both[cut:], 4)


def sealed(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(part)
    return sink.getvalue().to_pybytes()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in slices of at most ``PACK_BYTES`` of text, of several batches where these are small; a longer text alone."""
    parts, size = [], 0
    for part in X.slices(batches, size=PACK_BYTES):
        more = len(X.utf8(part.column("text"))[0])
        if parts and size + more > PACK_BYTES:
            yield pa.Table.from_batches(parts).combine_chunks()
            parts, size = [], 0
        parts.append(part)
        size += more
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def counted(rows: DataFrame, counters: int) -> DataFrame:
    """(slice, range, data) of (id, tag, text) rows. Of each slice: its rows, sealed (range -1), and of each range of hashes the
    numbers of all rows that hold the slice's distinct shingles, in order. ``counters``: a power of two."""
    shift = X.U(KEPT_BITS - counters.bit_length() + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, part in enumerate(gathered(batches)):
            keys, n = np.unique(shingles(X.split(part.column("text")))[1], return_counts=True)
            head = np.flatnonzero(np.diff(keys >> shift, prepend=X.U(2**63)))
            ends = [*head[1:].tolist(), len(keys)]
            number = [*(keys[head] >> shift).astype(np.int32).tolist(), k % counters]
            data = [*(packed(keys[a:b], n[a:b]) for a, b in zip(head.tolist(), ends, strict=True)), sealed(part)] if len(keys) else [sealed(part)]
            whole = np.arange(len(data)) == len(data) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), task + k)), pa.array(number[-len(data) :], pa.int32()), pa.array(whole), pa.array(data, pa.binary())], names=["slice", "range", "whole", "data"])

    def count(table: pa.Table) -> pa.Table:
        whole = table.column("whole").to_numpy()
        data = table.column("data").to_pylist()
        parts = [unpacked(x) for x, rest in zip(data, whole, strict=True) if not rest]
        if parts:
            _, place = np.unique(np.concatenate([keys for keys, _ in parts]), return_inverse=True)
            total = np.bincount(place, np.concatenate([n for _, n in parts]).astype(float)).astype(np.uint64)[place]
            ends = np.cumsum([len(keys) for keys, _ in parts])[:-1]
            for at, n in zip(np.flatnonzero(~whole).tolist(), np.split(total, ends), strict=True):
                data[at] = zstandard.compress(planes(n, 4), 1)
        number = np.where(whole, -1, table.column("range").to_numpy())
        return pa.table([table.column("slice"), pa.array(number, pa.int32()), pa.array(data, pa.binary())], names=["slice", "range", "data"])

    tasks = max(counters, rows.sparkSession.sparkContext.defaultParallelism)  # as many as the input asks for
    sent = rows.select("id", "tag", "text").mapInArrow(pack, "slice long, range int, whole boolean, data binary")
    return sent.repartition(tasks, "range").groupBy("range").applyInArrow(count, "slice long, range int, data binary").repartition(tasks, "slice")


def told(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a slice of ``counted``, its distinct shingles, and how many rows of all hold each."""
    number, data = table.column("range").to_numpy(), table.column("data").to_pylist()
    order = np.argsort(number).tolist()
    part = pa.ipc.open_stream(data[order[0]]).read_all().combine_chunks()
    counts = [from_planes(zstandard.decompress(data[k]), 4) for k in order[1:]]
    keys = np.unique(shingles(X.split(part.column("text")))[1])
    return part, keys, np.concatenate(counts) if counts else np.zeros(0, np.uint64)


def counters_of(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and how many counters they need."""
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return total, 1 << int(np.clip(np.ceil(np.log2((size or 0) / 6 / COUNTER_SHINGLES + 1e-9)), 0, 20))


def frequent(rows: DataFrame, floor: float = SHARE) -> Idf:
    """The counts of ``counted`` as one table in the driver, for small corpora that are compared pair by pair: the shares of the
    shingles that several rows hold."""
    total, counters = counters_of(rows)
    ids = rows.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), "text")

    def several(table: pa.Table) -> pa.Table:
        _, keys, n = told(table)
        return pa.table([pa.array(keys[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    got = counted(ids, counters).groupBy("slice").applyInArrow(several, "h long, n long").distinct().collect()
    return Idf(np.array([r["h"] for r in got], np.int64).astype(np.uint64), np.array([r["n"] for r in got], float) / max(total, 1), 1 / max(total, 1), floor)


def uniform(h: np.ndarray, k: int) -> np.ndarray:
    return ((X.mix(h ^ _SALTS[k]) >> X.U(11)).astype(float) + 0.5) / (1 << 53)


def bin_of(h: np.ndarray) -> np.ndarray:
    return (h >> X.U(KEPT_BITS - 7)).astype(np.int64)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x BINS sample ids; rows without shingles are 0."""
    out, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    if len(h):
        r = -np.log(uniform(h, 0) * uniform(h, 1))
        c = -np.log(uniform(h, 2) * uniform(h, 3))
        t = np.floor(np.log(weight) / r + uniform(h, 4))
        rank = np.log(c) - r * (t - uniform(h, 4)) - r
        cell = doc * BINS + bin_of(h)
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        least = np.minimum.reduceat(rank, head)
        hit = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(head, len(cell)))))[::-1]
        ids = X.mix(h[hit] ^ X.mix(t[hit].astype(np.int64).astype(np.uint64) + X.U(3)))
        out.reshape(-1)[cell[hit]] = ids
        filled.reshape(-1)[cell[hit]] = True
    # an empty bin takes the next filled one, around the end
    twice = np.concatenate([filled, filled], 1)
    place = np.where(twice, np.arange(2 * BINS), 4 * BINS)
    nearest = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :BINS]
    some = filled.any(1)
    nearest = np.where(some[:, None], nearest, 0)
    away = (nearest - np.arange(BINS)).astype(np.int64).astype(np.uint64)
    got = np.take_along_axis(out, nearest % BINS, 1)
    got = np.where(filled, got, X.mix(got ^ X.mix(away + X.U(0x77))))
    got[~some] = 0
    return got


def bands(sample: np.ndarray) -> np.ndarray:
    h = np.full(sample.shape[0], 1, np.uint64)[:, None] * np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    for k in range(ROWS):
        h = X.mix(h * X.BASE + sample[:, k::ROWS])
    return h


def signatures(rows: DataFrame, idf: Idf, counters: int, least: float) -> DataFrame:
    """(id, tag, text, held, node, bands) of (id, tag, text) rows; node: 128 bits of the word sequence; held: how many rows hold
    each distinct shingle. All but (id, tag) are null where what a text shares with any other row is below ``least`` of it."""
    schema = "id long, tag long, text string, held binary, node binary, bands array<long>"

    def sign(table: pa.Table) -> pa.Table:
        part, keys, n = told(table)
        out = []
        for at in range(0, part.num_rows, SIGNED_TEXTS):
            some = part.slice(at, SIGNED_TEXTS).combine_chunks()
            w = X.split(some.column("text"))
            doc, h, count = shingles(w)
            rows = n[np.searchsorted(keys, h)]
            each = count * idf.of(rows.astype(float))
            whole = np.bincount(doc, each, w.n)
            alone = np.bincount(doc, each * (rows < 2), w.n) > (1 - least) * whole * (1 + 1e-9) + 1e-9
            cut = np.searchsorted(doc, np.arange(w.n + 1)).tolist()
            held = [None if x else zstandard.compress(rows[a:b].astype("<u4").tobytes(), 1) for x, a, b in zip(alone.tolist(), cut, cut[1:], strict=False)]
            mine = ~alone[doc]
            key = bands(samples(doc[mine], h[mine], each[mine], w.n)).astype(np.int64)
            other = X.mix(w.hash ^ X.U(0x0F0F0F0F0F0F0F0F))
            node = np.stack([X.spans_hash(x, w.first[:-1], w.first[1:]) for x in (w.hash, other)], 1)
            stay = pa.array(np.arange(w.n), mask=alone)
            lists = pa.array([None if x else k for x, k in zip(alone.tolist(), key, strict=True)], pa.list_(pa.int64()))
            cols = [some.column("id"), some.column("tag"), some.column("text").take(stay), pa.array(held, pa.binary()), pa.array([x.tobytes() for x in node], pa.binary()).take(stay), lists]
            out.append(pa.table(cols, names=["id", "tag", "text", "held", "node", "bands"]))
        return pa.concat_tables(out)

    return counted(rows, counters).groupBy("slice").applyInArrow(sign, schema)


def weighed(texts: DataFrame, idf: Idf) -> DataFrame:
    """(id, tag, bins, shingles) of (id, tag, text, held) rows. bins: the weight of a text in each bin, as single floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w, doc, h, count, each = weights(part.column("text"), idf, part.column("held"))
            held = np.bincount(doc * BINS + bin_of(h), count * each, w.n * BINS).astype(np.float32).reshape(w.n, BINS)
            total = np.bincount(doc, count, w.n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array([r.tobytes() for r in held], pa.binary()), pa.array(total)], names=["id", "tag", "bins", "shingles"])

    return texts.select("id", "tag", "text", "held").mapInArrow(run, "id long, tag long, bins binary, shingles long")


def similarity(a: pa.Array, b: pa.Array, idf: Idf, held_a: pa.Array | None = None, held_b: pa.Array | None = None) -> np.ndarray:
    """Weighted Jaccard similarity, row by row."""
    parts = []
    for column, held in ((a, held_a), (b, held_b)):
        w, doc, h, count, each = weights(column, idf, held)
        parts.append(((doc.astype(np.uint64) << X.U(KEPT_BITS)) | h, count * each, doc, w.n))
    (ka, wa, da, n), (kb, wb, db, _) = parts
    total = np.bincount(da, wa, n) + np.bincount(db, wb, n)
    if not len(ka) or not len(kb):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    least = np.bincount(da[same], np.minimum(wa[same], wb[at[same]]), n)
    return least / np.maximum(total - least, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """The pairs (a_id, a_tag, b_id, b_tag) whose texts are as similar as ``least``; ``texts`` has each (id, tag) once."""
    side = lambda c: texts.select(F.col("id").alias(f"{c}_id"), F.col("tag").alias(f"{c}_tag"), F.col("text").alias(f"text_{c}"), F.col("held").alias(f"held_{c}"))
    full = pairs.join(side("b"), ["b_id", "b_tag"]).join(side("a"), ["a_id", "a_tag"]).select(*PAIR, "text_a", "text_b", "held_a", "held_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in X.slices(iter([batch]), "text_a", X.SLICE_BYTES // 2):
                for part in X.slices(iter([half]), "text_b", X.SLICE_BYTES // 2):
                    keep = pa.array(similarity(*(part.column(c) for c in ("text_a", "text_b")), idf, *(part.column(c) for c in ("held_a", "held_b"))) >= least)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in PAIR], names=PAIR)

    return full.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def chained(rows: DataFrame) -> DataFrame:
    """Pairs, a before b, of each row (key, id, tag) with the first of its key and with the one before it of its key. The
    rows of a key are chained in parts of about ``PART_ROWS``, so none is sorted whole in one task."""
    first = rows.groupBy("key").agg(F.min(F.struct("id", "tag")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    near = split_join(rows, first, "key", "size").withColumn("part", F.pmod(F.xxhash64("id", "tag"), F.ceil(F.col("size") / PART_ROWS)))
    before = F.lag(F.struct("id", "tag")).over(Window.partitionBy("key", "part").orderBy("id", "tag"))
    pairs = near.withColumn("before", before).select("id", "tag", F.explode(F.array("first", "before")).alias("a")).where(F.col("a").isNotNull() & (F.col("a") < F.struct("id", "tag")))
    return pairs.select(F.col("a.id").alias("a_id"), F.col("a.tag").alias("a_tag"), F.col("id").alias("b_id"), F.col("tag").alias("b_tag")).distinct()


def tiles(size: np.ndarray, most: int, shingles: int) -> list[slice]:
    """Runs of at most ``most`` texts and about so many shingles."""
    edges, held = [0], 0
    for k, n in enumerate(size.tolist()):
        if k > edges[-1] and (k - edges[-1] >= most or held + n > shingles):
            edges.append(k)
            held = 0
        held += n
    return [slice(a, b) for a, b in zip(edges, [*edges[1:], len(size)], strict=True)]


def reachable(a: np.ndarray, b: np.ndarray, apart: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of ``apart`` may be as similar as ``least``: in no bin do two texts share more than the smaller weight. Bins
    are taken ``COARSE`` at a time first, then one by one for the pairs that are left."""
    wide = [x.reshape(len(x), -1, COARSE).sum(2) for x in (a, b)]
    total = a.sum(1)[:, None] + b.sum(1)[None, :]
    shared = np.zeros((len(a), len(b)), np.float32)
    for k in range(BINS // COARSE):
        shared += np.minimum(wide[0][:, k, None], wide[1][None, :, k])
    may = lambda shared, total: shared * (1 + 1e-4) >= least * (total - shared)
    out = apart & may(shared, total)
    i, j = np.nonzero(out)
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        out[x, y] = may(np.minimum(a[x], b[y]).sum(1), total[x, y])
    return out


def candidates(live: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """(key, lo, hi, tile, id, tag) of the texts that may be similar to a text of another component of their key. ``live``:
    (key, n, root, size) rows of keys of several components. The texts of a key are dealt into blocks, each block meets each
    other one with the weights of the bins alone; pairs of one component count for nothing, and what may be similar is told
    tile by tile."""
    blocks = F.ceil(F.col("size") / BLOCK_TEXTS)
    rows = store(live.select("key", "n.id", "n.tag", F.xxhash64("root").alias("root"), "size"), "near-live")
    told = weighed(texts.join(rows.select("id", "tag").distinct(), ["id", "tag"], "left_semi"), idf)
    placed = rows.join(told, ["id", "tag"]).withColumns({"mine": F.pmod(F.xxhash64("id", "tag"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    placed = placed.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "tag", "root", "bins", "shingles")
    names, limits = ["key", "lo", "hi", "tile", "id", "tag"], (TILE_TEXTS, TILE_SHINGLES)

    def cut(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        mine, root, size = (table.column(c).to_numpy() for c in ("mine", "root", "shingles"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.float32).reshape(-1, BINS)
        sides, parts, number = [], [], 0
        for block in (lo, hi):
            at = np.flatnonzero(mine == block)
            at = at[np.argsort(root[at], kind="stable")]
            sides.append([at[t] for t in tiles(size[at], *limits)] if len(at) else [])
        for i, a in enumerate(sides[0]):
            for j, b in enumerate(sides[1]):
                apart = root[a][:, None] != root[b][None, :]
                if (lo != hi or j >= i) and apart.any():
                    may = reachable(bins[a], bins[b], apart, least)
                    some = np.union1d(a[may.any(1)], b[may.any(0)])
                    parts.append(np.stack([some, np.full(len(some), number)], 1))
                    number += 1
        at = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, 2), np.int64)
        return pa.table([table.column(c).take(at[:, 0]) if c != "tile" else pa.array(at[:, 1]) for c in names], names=names)

    return placed.groupBy("key", "lo", "hi").applyInArrow(cut, ", ".join(f"{c} long" for c in names))


def in_tiles(rows: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """Links (PAIR) that join all similar texts of each tile of ``candidates``: a forest, never the pairs."""

    def links(table: pa.Table) -> pa.Table:
        ids, tags = (table.column(c).to_numpy() for c in ("id", "tag"))
        a, b = forest(similar(table.column("text"), idf, least, table.column("held")))
        return pa.table([pa.array(x) for x in (ids[a], tags[a], ids[b], tags[b])], names=PAIR)

    return rows.join(texts.select("id", "tag", "text", "held"), ["id", "tag"]).groupBy("key", "lo", "hi", "tile").applyInArrow(links, ", ".join(f"{c} long" for c in PAIR))


def similar(column: pa.Array, idf: Idf, least: float, held: pa.Array | None = None) -> np.ndarray:
    """Which texts of a block are as similar as ``least``: products of their shingle tables, a few columns at a time."""
    w, doc, h, count, each = weights(column, idf, held)
    total = np.bincount(doc, count * each, w.n)
    row = np.repeat(np.arange(len(h)), count)  # the k-th use of a shingle is an element of its own, so its least count is a product
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    _, column_of, texts = np.unique(X.mix(h[row] ^ X.mix(nth.astype(np.uint64) + X.U(1))), return_inverse=True, return_counts=True)
    place = np.cumsum(texts > 1) - 1
    keep = texts[column_of] > 1
    at, of, weight = place[column_of[keep]], doc[row[keep]], each[row[keep]]
    by = np.argsort(at, kind="stable")
    at, of, weight = at[by], of[by], np.sqrt(weight[by])
    both = np.zeros((w.n, w.n))
    columns = int(place[-1]) + 1 if len(place) else 0
    for lo in range(0, columns, 2048):
        a, b = np.searchsorted(at, [lo, lo + 2048])
        part = np.zeros((w.n, min(2048, columns - lo)))
        part[of[a:b], at[a:b] - lo] = weight[a:b]
        both += part @ part.T
    return both >= least * (total[:, None] + total[None, :] - both) * (1 - 1e-12)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a tree for each component of a table of links."""
    left, edges = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        todo = [i] if left[i] else []
        left[i] = False
        while todo:
            a = todo.pop()
            near = np.flatnonzero(linked[a] & left)
            left[near] = False
            edges.append(np.stack([np.full(len(near), a), near], 1))
            todo.extend(near.tolist())
    both = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b), of which each task takes its own and gives the stars of their components instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[np.stack([b.column(c).field(f).to_numpy(zero_copy_only=False) for f in ("id", "tag")], 1) for c in ("a", "b")] for b in batches]
        if not ends:
            return
        both = np.concatenate([e[0] for e in ends] + [e[1] for e in ends])
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.ones(len(both), bool)
        new[1:] = (both[order][1:] != both[order][:-1]).any(1)
        place = np.empty(len(both), np.int64)
        place[order] = np.cumsum(new) - 1
        node, (a, b) = both[order][new], place.reshape(2, -1)
        root = least_labels(len(node), a, b)
        leaf = np.flatnonzero(root != np.arange(len(node)))
        column = lambda at: pa.StructArray.from_arrays([pa.array(node[at, k]) for k in range(2)], names=["id", "tag"])
        yield pa.RecordBatch.from_arrays([column(root[leaf]), column(leaf)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a struct<id:long,tag:long>, b struct<id:long,tag:long>")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b, was[a], was[b]):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == was).all():
            return label


def components(edges: DataFrame, whole: bool = True) -> DataFrame:
    """Stars (a, b), a the least node of its component, of the components of the edges (a, b). Tasks first make stars of the edges
    that they have, up to about ``LOCAL_EDGES`` each; then each round joins every node to the least of its neighbours, first for
    the larger ones and then for the smaller ones, until the edges are stars. Without ``whole`` it ends before the rounds: what
    is one star then is connected, but a component may be several."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = both if large else both.where(F.col("v") < F.col("u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        out = split_join(both, least, "u", "size")
        moved = out.where(F.col("v") > F.col("u")).select("m", "v") if large else out.select("m", "v").unionByName(least.select("m", F.col("u").alias("v")))
        return store(moved.where(F.col("m") < F.col("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "components")

    def are_stars(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("u"), F.lit(0).alias("in_")).unionByName(e.select(F.col("b").alias("u"), F.lit(1).alias("in_")))
        return ends.groupBy("u").agg(F.min("in_").alias("out"), F.sum("in_").alias("ins")).where("ins > 1 OR (ins = 1 AND out = 0)").isEmpty()

    parts = edges.count() // LOCAL_EDGES + 1
    now = store(contracted(edges.repartition(parts, "a") if parts > 1 else edges.repartition(1)), "components")
    while whole and not are_stars(now):
        now = stars(stars(now, True), False)
    return now


def linked(shared: DataFrame, rows: DataFrame, idf: Idf, least: float) -> DataFrame:
    """(n, root) of the components of the texts of ``shared`` (key, id, tag) that share a key and are similar. Rows without
    ``held`` are weighed by the table of ``idf``."""
    rows = rows if "held" in rows.columns else rows.withColumn("held", F.lit(None).cast("binary"))
    texts = store(rows.select("id", "tag", "text", "held").join(shared.select("id", "tag").distinct(), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]), "near-texts")
    ends = lambda p: p.select(F.struct(F.col("a_id").alias("id"), F.col("a_tag").alias("tag")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_tag").alias("tag")).alias("b"))
    stars = components(ends(store(verified(chained(shared), texts, idf, least), "near-links")), whole=False)
    # only keys that still span several stars are in play
    placed = store(shared.select("key", F.struct("id", "tag").alias("n")).join(labels(stars), "n", "left").select("key", "n", F.coalesce("root", "n").alias("root")), "near-placed")
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    maybe = store(candidates(split_join(placed, several, "key", "size"), texts, idf, least), "near-candidates")
    found = store(in_tiles(maybe, texts, idf, least), "near-found")
    return labels(components(ends(found).unionByName(stars)))


def labels(stars: DataFrame) -> DataFrame:
    """(n, root) of every node of stars, the roots too; a node of several stars has the least root."""
    leaves = stars.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("root"))
    return leaves.unionByName(stars.select(F.col("a").alias("n"), F.col("a").alias("root")).distinct().join(leaves.select("n"), "n", "left_anti"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, floor: float = SHARE) -> DataFrame:
    """(id, tag, root, class_id, similar) of each row: ``root`` names its class, class_id is the least id in it and may be
    null or that of another class too; ``similar``: its text has a verified link. Shingles that less than ``floor`` of the rows
    hold weigh as if so many did; with ``WHOLE`` each has the weight of its own count."""
    rows = keyed(docs)
    total, counters = counters_of(rows)
    idf = Idf(np.zeros(0, np.uint64), np.zeros(0), 1 / max(total, 1), floor)
    every = store(signatures(rows, idf, counters, least), "near-signatures")
    signed, alone = every.where("node IS NOT NULL"), every.where("node IS NULL").select("id", "tag", F.struct("id", "tag").alias("root"), _known("id").alias("class_id"), F.lit(False).alias("similar"))
    own = signed.groupBy("node").agg(F.min(F.struct("id", "tag", "bands")).alias("o"))
    keys = store(own.select("o.id", "o.tag", F.posexplode("o.bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "id", "tag"), "near-keys")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = store(split_join(keys, held, "key", "size").drop("size"), "near-shared")  # the bands that join several texts
    found = linked(shared, signed, idf, least)
    nodes = signed.groupBy("node").agg(F.min(F.struct("id", "tag")).alias("n")).join(found, "n", "left")
    rooted = nodes.select("node", "n", F.coalesce("root", "n").alias("root"), F.col("root").isNotNull().alias("similar"))
    ids = rooted.groupBy("root").agg(F.min(_known("n.id")).alias("class_id"))
    return signed.select("id", "tag", "node").join(rooted.join(ids, "root").select("node", "root", "class_id", "similar"), "node").drop("node").unionByName(alone)


def _known(c: str) -> Column:
    return F.when(F.col(c) != NO_ID, F.col(c))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class: exact copies and documents linked by verified similarity have one class id."""
    return near_duplicates(documents(spark, sf_dir), floor=WHOLE).select(_known("id").alias("doc_id"), "class_id", "similar")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first row of each class stays (least id, then text), with its own columns."""
    found, kept = near_duplicates(docs, floor=WHOLE), fresh(docs, "kept")
    first = found.groupBy("root").agg(F.min(F.struct("id", "tag")).alias(kept)).select(kept)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), tag_of(text).alias("tag"))
    return docs.withColumn(kept, key).join(first, kept, "left_semi").dropDuplicates([kept]).select(*named(docs.columns))
