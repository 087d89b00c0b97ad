"""Operator 11, alignment of two tokenizers by a dangling-suffix transducer.

Both tokenizers cut the same bytes. The transducer knows which side leads and the bytes of its last token that the other
side has not reached; a token of the other side either stays inside these bytes, ends with them, or runs over them and
leads from then on. Each such step is remembered by (side, bytes left, next token). An empty rest closes a group.

Texts are cut before a space or line end that follows something else: no token of either vocabulary goes across such a
place (checked when the vocabularies are loaded), so pieces are encoded and aligned one by one, and those met before are
looked up, up to ``HELD_PIECES`` in a worker. Links of a document are kept as distinct id pairs with how often each stands
there. The corpus counts of id pairs are vocabulary statistics: up to ``SENT_PAIRS`` of them go to all tasks, otherwise
links and counts are joined by a shuffle with hot pairs split off; both ways give the same rows.

Defined results: a text that is null, empty, or that one of the tokenizers does not give back byte for byte (U+2581 in the
text) has no tokens: zeros and an empty digest; it adds to no count. A row in gives a row out, also for repeated rows (each
is a document of its own) and null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textops as X
from .common import documents, split_join, store

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HELD_PIECES = 500_000
SENT_PAIRS = 4_000_000
SUMMED_PAIRS = 2_000_000  # distinct pairs that a task holds before it hands them on
SCHEMA = "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
NUMBERS = ["row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
CUT = re.compile(r"(?<=\S)(?=[ \n])")
_LEADS_A, _LEADS_B = 0, 1


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        for held in (self.a_bytes, self.b_bytes):
            if any(CUT.search(t.decode(errors="replace")) for t in held):
                raise ValueError("a token goes across the end of a word")
        if any("\n" in p for p in names):
            raise ValueError("a piece holds a line end")
        self.lone = self.b.piece_to_id("▁")
        self.digits = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))

    def encode(self, pieces: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides. Side B puts a space before what it gets: that space is the piece's own, or goes again where the piece
        begins with a line end."""
        a = self.a.encode_batch_fast(pieces, add_special_tokens=False)
        b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [(x.ids, y if p[0] == " " and len(p) > 1 else [self.lone] if p[0] == " " else y[1:]) for p, x, y in zip(pieces, a, b, strict=True)]


@cache
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


class Transducer:
    """Aligns two rows of ids that give the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.tokens = (a_bytes, b_bytes)
        self.steps: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}

    def step(self, leads: int, left: bytes, token: int) -> tuple[int, bytes]:
        """Who leads and what is left after the next token of the side that doesn't lead."""
        key = (leads, left, token)
        after = self.steps.get(key)
        if after is None:
            t = self.tokens[1 - leads][token]
            if left.startswith(t):
                after = (leads, left[len(t) :])
            elif t.startswith(left):
                after = (1 - leads, t[len(left) :])
            else:
                raise ValueError("the sides differ")
            if len(self.steps) >= 1_000_000:
                self.steps.clear()
            self.steps[key] = after
        return after

    def align(self, a: list[int], b: list[int], width: int) -> tuple[list[tuple[int, int]], list[int]]:
        """The ends (in tokens of a and b) of the groups, and the links as id of a x ``width`` + id of b, in order."""
        steps, first = self.steps, self.tokens[0]
        i, j, n = 0, 0, len(a)
        ends, links = [], []
        while i < n:
            leads, left = _LEADS_A, first[a[i]]
            i += 1
            while left:
                if leads == _LEADS_A:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                links.append(a[i - 1] * width + b[j - 1])
                after = steps.get((leads, left, token))
                leads, left = after if after is not None else self.step(leads, left, token)
            ends.append((i, j))
        return ends, links


class Pieces:
    """Pieces that were met, with their counts, links and groups; sums of documents are taken from these."""

    def __init__(self, both: Sides) -> None:
        self.both, self.transducer = both, Transducer(both.a_bytes, both.b_bytes)
        self.width = len(both.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, is the piece given back
        self.bounds, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Takes in pieces that aren't known, each once."""
        numbers, lengths, pairs = [], [], []
        a_bytes, b_bytes, digits, align, width = self.both.a_bytes, self.both.b_bytes, self.both.digits, self.transducer.align, self.width
        for piece, (a, b) in zip(new, self.both.encode(new), strict=True):
            raw = piece.encode()
            same = b"".join([a_bytes[x] for x in a]) == raw and b"".join([b_bytes[x] for x in b]) == raw
            ends, links = align(a, b, width) if same else ([], [])
            i = j = 0
            text = []
            for k, m in ends:
                text.append((digits[a[i]] if k == i + 1 else ",".join([digits[x] for x in a[i:k]])) + "|" + (digits[b[j]] if m == j + 1 else ",".join([digits[x] for x in b[j:m]])))
                i, j = k, m
            self.at[piece] = len(self.groups)
            self.groups.append(";".join(text))
            numbers.append((len(a), len(b), len(ends), len(links), same))
            lengths.append(len(links))
            pairs += links
        self.numbers = np.concatenate([self.numbers, np.array(numbers, np.int64)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
        self.pairs = np.concatenate([self.pairs, np.array(pairs, np.int64)])

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text."""
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        if len(self.at) > HELD_PIECES:
            self.clear()
        return [self._sums(at) for at in self.places(cut)]

    def places(self, cut: list[list[str]]) -> list[list[int]]:
        """Where the pieces of each text stand among those that are known, which all are then."""
        if new := [p for p in dict.fromkeys(p for c in cut for p in c) if p not in self.at]:
            self.learn(new)
        at = self.at
        return [[at[p] for p in c] for c in cut]

    def _sums(self, at: list[int]) -> tuple:
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        where = np.array(at, np.int64)
        n = self.numbers[where]
        if not at or not n[:, 4].all():
            return nothing
        digest = hashlib.sha256(";".join([self.groups[k] for k in at]).encode()).hexdigest()
        lengths = n[:, 3]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pairs, times = np.unique(self.pairs[np.repeat(self.bounds[where], lengths) + inside], return_counts=True)
        return (*n[:, :4].sum(0).tolist(), digest, pairs, times)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """SCHEMA of each document: its numbers, and its distinct id pairs (A id x size of B + B id) with how often each is linked."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pieces(sides(a_path, b_path))
        for part in X.slices(batches):
            found = held.documents(part.column("text").to_pylist())
            column = lambda k, kind: pa.array([x[k] for x in found], kind)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x[5]) for x in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([x[k] for x in found]).astype(np.int64))) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([part.column("row_no"), part.column("doc_id"), *(column(k, pa.int64()) for k in range(4)), column(4, pa.string()), *lists], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs): how many of the rows hold a pair; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, new, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, at = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            return one, np.bincount(at, np.concatenate([n, np.ones(waiting, np.int64)]), len(one)).astype(np.int64)

        hand = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "docs"])
        for batch in batches:
            new.append(batch.column("pairs").flatten().to_numpy())
            waiting += len(new[-1])
            if waiting >= SUMMED_PAIRS:
                keys, n = merged(keys, n)
                new, waiting = [], 0
                if len(keys) >= SUMMED_PAIRS:
                    yield hand()
                    keys, n = keys[:0], n[:0]
        keys, n = merged(keys, n)
        yield hand()

    return rows.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def scored_by_table(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of each row; the counts, which are few, go to all tasks."""
    spark = rows.sparkSession
    table = counts.toArrow()
    pair, docs, best = (table.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order], docs[order], (docs == best)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(keys, pairs.flatten().to_numpy())
            bounds = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            sums = [pa.array(X.cut_sum(times * x[at], bounds)) for x in (best, docs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NUMBERS), *sums], names=[*NUMBERS, "n_best", "count_sum"])

    return rows.mapInArrow(run, ", ".join([s for s in SCHEMA.split(", ") if s.split()[0] in NUMBERS] + ["n_best long", "count_sum long"]))


def scored_by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``scored_by_table``, for any number of counts."""
    links = rows.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_no", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    both = split_join(links, counts, "pair", "docs")
    sums = both.groupBy("row_no").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return rows.select(NUMBERS).join(sums, "row_no", "left").na.fill(0, ["n_best", "count_sum"])


def token_alignment(docs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """(row_no, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document."""
    width = len(sides(a_path, b_path).b_bytes)
    rows = store(linked(docs, a_path, b_path), "alignment-links")
    summed = store(pair_counts(rows), "alignment-counts")
    best = summed.groupBy((F.col("pair") / width).cast("long").alias("a")).agg(F.max("docs").alias("best"))  # at most one row an A id
    counts = summed.withColumn("a", (F.col("pair") / width).cast("long")).join(F.broadcast(best), "a").select("pair", "docs", "best")
    return scored_by_table(rows, counts) if summed.count() <= sent_pairs else scored_by_join(rows, counts)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b) of each group of each document, in order within it (``at``): the ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pieces(sides(a_path, b_path))
        for part in X.slices(batches):
            ids, at, a, b = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                pieces = CUT.split(" " + text) if text else []
                where = held.places([pieces])[0]
                if held.numbers[where, 4].all():
                    each = [g.split("|") for k in where for g in held.groups[k].split(";")]
                    ids += [doc_id] * len(each)
                    at += range(len(each))
                    a += [list(map(int, x[0].split(","))) for x in each]
                    b += [list(map(int, x[1].split(","))) for x in each]
            if len(held.at) > HELD_PIECES:
                held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))], names=["doc_id", "at", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, at long, a array<long>, b array<long>")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's groups and links between the two public vocabularies."""
    import public_tokenizers

    return token_alignment(documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)).drop("row_no")
