"""Operator 10, language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public vocabulary. Each language has its own piece probabilities, estimated by
expectation-maximisation; a text's likelihood sums over all segmentations. As pieces don't cross white space, that sum
is a product over words, so the forward algorithm runs once for each distinct word of a batch, for all languages at once.
Words up to ``SHORT`` bytes run side by side by length; a longer one (text without spaces, addresses) runs by itself with
a sum that is rescaled on its way, so it may be of any length and is never cut.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no training rows every text is
``und``; ties go to the language that comes first by name; a row in gives a row out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .common import documents, fold

FOLDS, HELD = 3, 1
TRAIN_ROWS = 12_000  # documents that the probabilities are estimated on, at most about
ROUNDS = 2
SHORT = 40  # bytes
LANG_ROWS = 50  # documents of each language that are chosen, however rare it is, about
BLOCK_LANGS, KEPT_BLOCKS = 64, 4  # languages that a table of pieces holds; tables that a task keeps between slices
RESCALE = 16  # positions; no piece is less likely than LEAST, so sums stay above LEAST ** RESCALE between two rescalings
LEAST = 1e-7
_LETTER = regex.compile(r"\p{L}")
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_FIRST = X.U(0x5851F42D4C957F2D)  # marks a piece that begins a word


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """Hashes of the vocabulary's pieces, sorted; a single byte is always a piece, so that every word has a segmentation."""

    keys: np.ndarray
    longest: int

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        begin = [t[1:].encode() for t in texts if t[0] == "▁" and len(t) > 1 and "▁" not in t[1:]]
        inner = [t.encode() for t in texts if "▁" not in t]
        one = [bytes([b]) for b in range(256)]
        begin, inner = sorted({*begin, *one}), sorted({*inner, *one})

        def keys(words: list[bytes]) -> np.ndarray:
            data = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            return X.spans_hash(X.BYTE[data], ends - np.array([len(w) for w in words]), ends)

        return Pieces(np.unique(np.concatenate([keys(begin) ^ _FIRST, keys(inner)])), max(map(len, begin + inner)))

    def __len__(self) -> int:
        return len(self.keys)


def lattice(data: np.ndarray, start: np.ndarray, size: int, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, piece) for the words of one length that have a piece there."""
    out = []
    values = X.BYTE[data[start[:, None] + np.arange(size)]]
    sums = np.zeros((len(start), size + 1), np.uint64)
    np.cumsum(values * X.powers(X.BASE, size)[:size], axis=1, out=sums[:, 1:])
    inverse = X.powers(X.INVERSE, size)
    for to in range(1, size + 1):
        for frm in range(max(0, to - pieces.longest), to):
            h = X.mix((sums[:, to] - sums[:, frm]) * inverse[frm] + X.U((to - frm) * 0xD6E8FEB86659FD93 % 2**64))
            h = h ^ _FIRST if frm == 0 else h
            i = np.minimum(np.searchsorted(pieces.keys, h), len(pieces) - 1)
            rows = np.flatnonzero(pieces.keys[i] == h)
            if len(rows):
                out.append((frm, to, rows, i[rows]))
    return out


def forward(arcs: list, n: int, size: int, p: np.ndarray) -> np.ndarray:
    """Rows x positions x languages: the sum over segmentations of what stands before."""
    alpha = np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = 1
    for frm, to, rows, piece in arcs:
        alpha[to, rows] += alpha[frm, rows] * p[piece]
    return alpha


def by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each size up to SHORT."""
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], SHORT, "right")]
    cut = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            for at in range(0, len(rows), 20_000):
                yield int(sizes[rows[0]]), rows[at : at + 20_000]


def long_arcs(data: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For each end of a word's prefix and each length, the piece that ends there, or -1."""
    n, values = len(data), X.BYTE[data]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * X.powers(X.BASE, n)[:n], out=sums[1:])
    out = np.full((n + 1, pieces.longest), -1, np.int32)
    for size in range(1, min(pieces.longest, n) + 1):
        h = X.mix((sums[size:] - sums[:-size]) * X.powers(X.INVERSE, n)[: n - size + 1] + X.U(size * 0xD6E8FEB86659FD93 % 2**64))
        h[0] ^= _FIRST
        i = np.minimum(np.searchsorted(pieces.keys, h), len(pieces) - 1)
        out[size:, size - 1] = np.where(pieces.keys[i] == h, i, -1)
    return out


def rolling(arcs: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations before each position, by language, as numbers and the logs of their scales."""
    n, reach, none = len(arcs) - 1, arcs.shape[1], np.concatenate([p, np.zeros((1, p.shape[1]))])
    total, scale, log = np.zeros((n + 1 + reach, p.shape[1])), np.zeros((n + 1 + reach, p.shape[1])), np.zeros(p.shape[1])
    total[reach] = 1
    for to in range(1, n + 1):
        at = to + reach
        total[at] = (none[arcs[to]] * total[at - reach : at][::-1]).sum(0)
        scale[at] = log
        if to % RESCALE == 0:
            most = total[at - reach + 1 : at + 1].max(0)
            total[at - reach + 1 : at + 1] /= most
            scale[at - reach + 1 : at + 1] += np.log(most)
            log = log + np.log(most)
    return total[reach:], scale[reach:]


def long_word(data: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log likelihood of one word by language."""
    total, scale = rolling(long_arcs(data, pieces), p)
    return np.log(total[-1]) + scale[-1]


def long_counts(data: np.ndarray, pieces: Pieces, p: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected uses of pieces over all segmentations of a word that stands ``times`` in each language."""
    arcs = long_arcs(data, pieces)
    n = len(arcs) - 1
    back = np.full_like(arcs, -1)
    for size in range(1, min(arcs.shape[1], n) + 1):
        back[size:, size - 1] = arcs[size:, size - 1][::-1]
    (before, before_log), (after, after_log) = rolling(arcs, p), rolling(back, p)
    whole = np.log(before[-1]) + before_log[-1]
    for size in range(1, min(arcs.shape[1], n) + 1):
        to = np.flatnonzero(arcs[:, size - 1] >= 0)
        piece, frm = arcs[to, size - 1], to - size
        share = before[frm] * after[n - to] * p[piece] * np.exp(before_log[frm] + after_log[n - to] - whole)
        np.add.at(out, piece, times * share)


@dataclass
class Scorer:
    """Log likelihoods of words under one model; words already met are kept, up to ``held`` of them."""

    pieces: Pieces
    p: np.ndarray
    held: int = 400_000
    keys: np.ndarray | None = None
    logs: np.ndarray | None = None

    def words(self, w: X.Words, h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log likelihoods of distinct words; h is sorted."""
        logs, known = np.zeros((len(h), self.p.shape[1])), np.zeros(len(h), bool)
        if self.keys is not None and len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[i] == h
            logs[known] = self.logs[i[known]]
        new = np.flatnonzero(~known)
        for n, rows in by_size(size[new]):
            at = new[rows]
            logs[at] = np.log(forward(lattice(w.data, start[at], n, self.pieces), len(at), n, self.p)[n])
        for i in new[size[new] > SHORT].tolist():
            logs[i] = long_word(w.data[start[i] : start[i] + size[i]], self.pieces, self.p)
        if self.keys is None or len(self.keys) + len(new) > self.held:
            self.keys, self.logs = h, logs
        else:
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.logs = keys[order], np.concatenate([self.logs, logs[new]])[order]
        return logs

    def documents(self, w: X.Words) -> np.ndarray:
        """Documents x languages: log likelihood of the whole text."""
        if not len(w.start):
            return np.zeros((w.n, self.p.shape[1]))
        h, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
        logs = self.words(w, h, w.start[one], (w.end - w.start)[one])
        return np.stack([np.diff(np.concatenate([[0.0], np.cumsum(logs[which, k])])[w.first]) for k in range(self.p.shape[1])], 1)


def expected_counts(w: X.Words, lang: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Pieces x languages: expected uses over all segmentations of documents of known language."""
    out = np.zeros((len(pieces), p.shape[1]))
    if not len(w.start):
        return out
    _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    times = np.zeros((len(one), p.shape[1]))
    np.add.at(times, (which, lang[w.doc]), 1.0)
    s, sizes = w.start[one], (w.end - w.start)[one]
    for size, rows in by_size(sizes):
        arcs = lattice(w.data, s[rows], size, pieces)
        alpha = forward(arcs, len(rows), size, p)
        beta = np.zeros_like(alpha)
        beta[size] = times[rows] / alpha[size]
        for frm, to, at, piece in sorted(arcs, key=lambda a: -a[1]):
            use = p[piece] * beta[to, at]
            beta[frm, at] += use
            np.add.at(out, piece, alpha[frm, at] * use)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        long_counts(w.data[s[i] : s[i] + sizes[i]], pieces, p, times[i], out)
    return out


@dataclass
class Model:
    """Languages by name, their shares, and the uses of pieces by language where there are any (sorted by language): as many as
    the training documents have, whatever the number of languages. Tables are made for a block of languages at a time."""

    langs: list[str]
    prior: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    uses: np.ndarray
    size: int
    path: str
    known: bool = True  # without uses all pieces are alike
    width: int = BLOCK_LANGS

    def pieces(self) -> Pieces:
        return Pieces.load(self.path)

    def blocks(self) -> list[tuple[int, int]]:
        return [(k, min(k + self.width, len(self.langs))) for k in range(0, len(self.langs), self.width)]

    def table(self, block: tuple[int, int]) -> np.ndarray:
        """Pieces x languages of the block: probabilities."""
        lo, hi = block
        if not self.known:
            return np.full((self.size, hi - lo), 1.0 / self.size)
        a, b = np.searchsorted(self.lang, [lo, hi])
        c = np.zeros((self.size, hi - lo))
        c[self.piece[a:b], self.lang[a:b] - lo] = self.uses[a:b]
        p = np.maximum((c + 0.01) / (c + 0.01).sum(0), LEAST)
        return p / p.sum(0)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None, block_langs: int = BLOCK_LANGS) -> Model:
    """Uses of pieces in training folds: each round is one Spark pass, summed by language and piece. About ``rows`` documents are
    chosen, and at least about ``LANG_ROWS`` of each language; all languages are learnt."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs, total = sorted(counts), sum(counts.values())
    n = len(Pieces.load(path))
    prior = np.array([counts[x] for x in langs], float) / max(total, 1)
    none = np.zeros(0, np.int64)
    model = Model(langs, prior, none, none, none.astype(float), n, path, False, block_langs)
    if not langs:
        return model
    share = [(x, k, int(min(1.0, max(rows / total, LANG_ROWS / counts[x])) * (1 << 20))) for k, x in enumerate(langs)]
    places = spark.createDataFrame(share, "lang string, place int, below int")
    chosen = known.join(F.broadcast(places), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.col("below")).select("text", "place")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            pieces, total = Pieces.load(path), {}
            for part in X.slices(batches):
                lang = part.column("place").to_numpy()
                for k in np.unique(lang // block_langs).tolist():
                    block, mine = model.blocks()[k], lang // block_langs == k
                    own = expected_counts(X.split(part.column("text").filter(pa.array(mine))), lang[mine] - block[0], pieces, model.table(block))
                    total[k] = total.get(k, 0) + own
                    if len(total) > KEPT_BLOCKS:
                        yield handed(total)
            yield handed(total)

        def handed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
            each = [(*np.nonzero(t), k * block_langs, t) for k, t in total.items()]
            piece, lang, uses = [np.concatenate([x, *y]) for x, y in zip((none, none, none.astype(float)), ([e[0] for e in each], [e[1] + e[2] for e in each], [e[3][e[0], e[1]] for e in each]), strict=True)]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(np.round(uses, 6))], names=["piece", "lang", "n"])

        got = chosen.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "piece"])
        model = Model(langs, prior, got["piece"].to_numpy(int), got["lang"].to_numpy(int), got["n"].to_numpy(float), n, path, True, block_langs)
    return model


def has_letter(column: pa.Array, w: X.Words) -> np.ndarray:
    out = w.bytes_per_doc(_ALPHA[w.data]) > 0
    for i in np.flatnonzero(~out & (np.diff(w.bounds) > 0)):
        out[i] = bool(_LETTER.search(column[int(i)].as_py()))
    return out


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (posterior probability of lang_pred)."""
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score can't be kept columns")
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, blocks, held = model.pieces(), model.blocks(), {}
        log_prior = np.log(np.maximum(model.prior, 1e-9))
        for part in X.slices(batches):
            w = X.split(part.column("text"))
            best, top, rest = np.full(w.n, len(model.langs)), np.full(w.n, -np.inf), np.zeros(w.n)  # rest: sum of exp(log - top)
            for block in blocks:
                scorer = held.get(block) or Scorer(pieces, model.table(block))
                if len(held) < KEPT_BLOCKS:
                    held[block] = scorer
                logs = scorer.documents(w) + log_prior[block[0] : block[1]]
                most = np.maximum(top, logs.max(1))
                best = np.where(most > top, logs.argmax(1) + block[0], best)  # ties stay with the earlier name
                rest = rest * np.exp(top - most) + np.exp(logs - most[:, None]).sum(1)
                top = most
            some = has_letter(part.column("text"), w) & (len(model.langs) > 0)
            best, prob = np.where(some, best, len(model.langs)), np.where(some, 1 / np.maximum(rest, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(names[best].tolist(), pa.string()), pa.array(prob)], names=[*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
