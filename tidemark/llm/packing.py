"""Operator 9, hierarchical multi-length packing.

Documents become token ids plus an end id. Each batch of a task routes its documents to tiers of context size
(256 .. 4096), packs each tier best-fit-decreasing, fills the gaps of longer windows from documents of shorter tiers,
and cuts a document only to close a window that no whole document closes. Windows of all tiers are full, so none is
padded; what is left at the end of a batch is carried into the next one, and at the end of the task it is cut at powers
of two. No shuffle: a window holds documents of one task. Windows are numbered by task, and step groups take windows of
one tier in order, so that every group but the last of a tier holds the same number of tokens.

Defined results: a null text counts as empty and has the end id alone; a row in gives its pieces, also for repeated
rows; an empty table gives none. Ids are those of the tokenizer on the whole text; words that were met before are
looked up (words don't influence each other in this tokenizer, which cuts at white space).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import documents, store

LONGEST = 4096
TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 32 * LONGEST
HELD_WORDS = 1_500_000
ROW_WORDS = 512  # new words in one call of the tokenizer
_MARK, _LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER[65:91] += 32
SCHEMA = "doc_id long, start long, length long, input_ids binary, doc_tokens long, sequence_id long, offset long, tier int, task long, in_tier long"
MOST_TASKS = 100_000  # rows of (task, tier) counts that may go to all tasks


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts, word by word, with the words met so far kept by their hash."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        reserved = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = sorted({t[:2] for t in reserved})  # how reserved strings begin
        self.keys, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Size and ids of each word; words are encoded in rows of text, and offsets tell whose an id is."""
        size, ids = [], []
        for at in range(0, len(words), ROW_WORDS):
            part = words[at : at + ROW_WORDS]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            length = np.fromiter(map(len, part), np.int64, len(part))
            begin = np.cumsum(length + 1) - length - 1
            whose = np.searchsorted(begin, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.offsets)), "right") - 1
            size.append(np.bincount(whose, minlength=len(part)))
            ids.append(np.array(got.ids, np.uint32))
        return np.concatenate(size), np.concatenate(ids)

    def _folded(self, w: X.Words) -> np.ndarray:
        """The bytes in lower case, but those of words in which a reserved string may begin."""
        out = _LOWER[w.data]
        for head in self.heads:
            found = np.flatnonzero((w.data[:-1] == head[0]) & (w.data[1:] == head[-1])) if len(head) > 1 else np.flatnonzero(w.data == head[0])
            for k in np.unique(np.searchsorted(w.start, found, "right") - 1).tolist():
                if k >= 0:
                    out[w.start[k] : w.end[k]] = w.data[w.start[k] : w.end[k]]
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 bounds of documents in them; each document ends with END_ID.

        A mark at the end of a word, behind an ASCII letter, is a word of its own, and case doesn't count: the tokenizer
        cuts there and lowers case itself, and so more words are known already. Words that may hold a reserved string are
        looked up as they are, since the tokenizer tells the case of these.
        """
        w = X.split(column)
        folded = self._folded(w)
        tail = (w.end - w.start > 1) & _MARK[w.data[w.end - 1]] & _LETTER[w.data[np.maximum(w.end - 2, 0)]] if len(w.end) else np.zeros(0, bool)
        place = np.concatenate([[0], np.cumsum(1 + tail)])
        start, end = np.empty(place[-1], np.int64), np.empty(place[-1], np.int64)
        start[place[:-1]], end[place[:-1]] = w.start, w.end - tail
        start[place[1:][tail] - 1], end[place[1:][tail] - 1] = w.end[tail] - 1, w.end[tail]
        h, one, which = np.unique(X.spans_hash(X.BYTE[folded], start, end), return_index=True, return_inverse=True)
        if len(self.keys) > HELD_WORDS:
            self.keys, self.first, self.size, self.ids = self.keys[:0], self.first[:0], self.size[:0], self.ids[:0]
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == h
        new = np.flatnonzero(~known)
        if len(new):
            data = w.data.tobytes()
            size, ids = self._learn([data[a:b].decode() for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            first = len(self.ids) + np.cumsum(size) - size
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, h)
        size, first = self.size[at][which], self.first[at][which]
        out_end = np.cumsum(size)
        total = int(out_end[-1]) if len(size) else 0
        ids = self.ids[np.repeat(first - (out_end - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        bounds = np.concatenate([[0], out_end])[place[w.first]]
        return np.insert(ids, bounds[1:], np.uint32(END_ID)), bounds + np.arange(len(bounds))


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, so that the words of one task are known in the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Tiers:
    """Pieces that wait for a window, by tier; each is (length, document, start)."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}

    def route(self, length: int, doc: int, start: int) -> None:
        tier = next(t for t in TIERS if length <= t)
        bisect.insort(self.waiting[tier], (length, doc, start))

    def total(self, most: int) -> int:
        return sum(x[0] for t in TIERS if t <= most for x in self.waiting[t])

    def largest(self, room: int) -> tuple[int, int, int] | None:
        """The longest piece that fits, from the highest tier that has one."""
        for t in reversed(TIERS):
            held = self.waiting[t]
            if (i := bisect.bisect_right(held, (room, float("inf"), 0))) > 0:
                return held.pop(i - 1)
        return None

    def shortest(self) -> tuple[int, int, int] | None:
        for t in TIERS:
            if self.waiting[t]:
                return self.waiting[t].pop(0)
        return None

    def window(self, tier: int) -> list[tuple[int, int, int]]:
        """A full window: whole pieces while they fit, the last one cut."""
        out, room = [], tier
        while room:
            piece = self.largest(room)
            if piece is None:
                length, doc, start = self.shortest()
                self.route(length - room, doc, start + room)
                piece = (room, doc, start)
            out.append(piece)
            room -= piece[0]
        return out


def pack(tiers: Tiers, final: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) of full windows, longest tier first; at the end, what is left in powers of two."""
    for tier in reversed(TIERS):
        while len(tiers.waiting[tier]) and tiers.total(LONGEST) >= tier:
            yield tier, tiers.window(tier)
    if final:
        while left := tiers.total(LONGEST):
            size = min(LONGEST, 1 << (left.bit_length() - 1))
            yield size, tiers.window(size)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents: SCHEMA with step_group for task and in_tier; input_ids are little-endian unsigned 32-bit ids."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tiers = encoder_of(path), Tiers()
        task = TaskContext.get().partitionId()
        number, in_tier = 0, dict.fromkeys(range(LONGEST + 1), 0)
        texts: dict[int, tuple] = {}  # documents of which a piece waits
        serial = 0

        def emit(final: bool) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(10)]
            for tier, pieces in pack(tiers, final):
                offset = 0
                for length, doc, start in pieces:
                    doc_id, ids = texts[doc]
                    for c, v in zip(cols, (doc_id, start, length, ids[start : start + length].tobytes(), len(ids), (task << 36) + number, offset, tier, task, in_tier[tier]), strict=True):
                        c.append(v)
                    offset += length
                number += 1
                in_tier[tier] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for part in X.slices(batches):
            ids, bounds = encoder(part.column("text"))
            waiting = {x[1] for held in tiers.waiting.values() for x in held}
            texts = {k: v for k, v in texts.items() if k in waiting}
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                texts[serial] = (doc_id, ids[a:b].astype("<u4"))
                for start in range(0, b - a, LONGEST):
                    tiers.route(min(LONGEST, b - a - start), serial, start)
                serial += 1
            yield emit(False)
        yield emit(True)

    return balanced(store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "packed"))


def balanced(packed: DataFrame) -> DataFrame:
    """``packed`` with its step groups: the windows of a tier are numbered through all tasks, and so many make a group as hold
    ``STEP_TOKENS`` tokens. The counts by task and tier are few; beyond ``MOST_TASKS`` they are joined by a shuffle."""
    counts = store(packed.groupBy("tier", "task").agg((F.max("in_tier") + 1).alias("n")), "packed-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("tier", "task", before.alias("before"))
    before = F.broadcast(before) if counts.count() <= MOST_TASKS else before
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("before") + F.col("in_tier")) * F.col("tier") / STEP_TOKENS)
    return packed.join(before, ["tier", "task"]).select("doc_id", "start", "length", "input_ids", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces with their ids."""
    return pack_documents(docs)
