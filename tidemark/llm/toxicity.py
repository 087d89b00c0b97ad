"""Operator 4, toxicity by weak supervision.

Voters are fixed lexicons by language, lexicons mined from labelled rows (whole words and word beginnings), several finds in
one text, and patterns that stand apart from these: an insult in a frame of the second person, an insult in masked spelling,
repeated marks, shouting; denied insults and texts without any find speak against. In training rows the label itself
votes too, and its accuracy is estimated like that of any other. A generative model estimates accuracies
and correlations from the vote patterns of all documents. A linear classifier over hashed words is trained on the posterior
labels of a bounded sample: labelled rows of each class and rows of any kind, at most about ``CLASS_ROWS`` of each, all of
them outside fold 0. Its probability is the score.

Defined results: a null text counts as empty and is scored (no features: the intercept); a row in gives a row out;
labels that are null or not 0/1 are ignored; without usable labels the fixed lexicon alone sets the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats as S
from . import textops as X
from .common import bounded, documents, fold, named, store, table
from .label_model import LabelModel, fit, patterns
from .quality_classifier import labelled

CLASS_ROWS = 4_000  # labelled rows of each class, and rows of any kind, that the classifier is fitted on, at most about
FOLDS = 5
FEATURES_KEPT = 4_000
MOST_LEXICON = 5_000  # mined words and word beginnings
LEAST_ROWS = 3  # that a feature is found in
PREFIXES = (4, 5, 6)
# Insults by language, words that speak to somebody, words that deny, and letters that others stand for.
LEXICONS = {
    "v_english": "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown imbecile dumb".split(),
    "v_romance": "idiota estúpido imbécil basura idiote stupide débile ordure connard".split(),
    "v_german": "dumm idiotin abschaum trottel".split(),
}
SECOND_PERSON = "you your you're yourself u tu eres usted vous es êtes du bist ihr seid".split()
DENIALS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais nunca ni".split()
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
REACH = 4  # words before an insult that tell whom it is meant for, or deny it
VOTERS = [*LEXICONS, "v_words", "v_prefix", "v_several", "v_frame", "v_masked", "v_marks", "v_shouting", "v_clean"]
VOTING_PREFIX = 5
LABEL = "v_label"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOUD, _SIGN, _READ = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LOUD[list(b"!?")] = True
for _sign, _letter in STANDS_FOR.items():
    _SIGN[ord(_sign)], _READ[ord(_sign)] = True, ord(_letter)


def hashed(w: X.Words) -> list[np.ndarray]:
    """32-bit hashes for each word: the whole word, and its first bytes (0 where it is shorter), in lower case."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        if len(end):
            end -= S._PUNCT[w.data[end - 1]] & (end > start + 1)
            start += S._PUNCT[w.data[np.minimum(start, len(w.data) - 1)]] & (start < end - 1)
    values = X.BYTE[_LOWER[w.data]]
    cut = lambda h: (h & X.U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    out = [cut(X.spans_hash(values, start, end) ^ X.U(0xABCDEF))]
    for k in PREFIXES:
        h = cut(X.spans_hash(values, start, np.minimum(start + k, end)))
        h[end - start < k] = 0
        out.append(h)
    return out


def doc_features(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), by document."""
    h = np.concatenate(hashed(w))
    key = np.unique((np.tile(w.doc, 1 + len(PREFIXES)).astype(np.uint64) << X.U(32)) | h)
    key = key[(key & X.U(0xFFFFFFFF)) > 0]
    return (key >> X.U(32)).astype(np.int64), (key & X.U(0xFFFFFFFF)).astype(np.uint32)


class Finder:
    """Membership and values of 32-bit keys: a bit table first, a search only for what passes it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are keys, and their values."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.values[:0]
        bits = np.zeros(1 << 22, bool)
        bits[self.keys & np.uint32((1 << 22) - 1)] = True
        at = np.flatnonzero(bits[h & np.uint32((1 << 22) - 1)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        return at[hit], self.values[i[hit]]


def _words(texts: list[str]) -> np.ndarray:
    return hashed(X.split(pa.array(texts)))[0] if texts else np.zeros(0, np.uint32)


@dataclass
class Voters:
    """Lexicons by kind: 0 to 2 the fixed ones, 3 mined words and word beginnings, a bit each."""

    finder: Finder
    second: Finder
    denial: Finder

    def votes(self, w: X.Words) -> np.ndarray:
        """Documents x VOTERS. An insult that is denied just before counts against toxicity where a text has no other."""
        out = np.zeros((w.n, len(VOTERS)), np.int8)
        n, every = len(w.doc), hashed(w)
        insult, mined, begun = np.zeros((n, 3), bool), np.zeros(n, bool), np.zeros(n, bool)
        at, kind = self.finder(every[0])
        for k in range(3):
            insult[at, k] = (kind & (1 << k)) > 0
        mined[at] = (kind & 8) > 0
        at, _ = self.finder(every[1 + PREFIXES.index(VOTING_PREFIX)])
        begun[at] = True
        any_ = insult.any(1)
        near = lambda finder: self._before(w, finder, every[0])
        denied = any_ & near(self.denial)
        plain = insult & ~denied[:, None]
        for k in range(3):
            out[:, k] = w.per_doc(plain[:, k]) > 0
        out[:, 3], out[:, 4] = w.per_doc(mined) > 0, w.per_doc(begun) > 0
        out[:, 5] = w.per_doc(plain.any(1) | mined | begun) >= 2
        out[:, 6] = w.per_doc(plain.any(1) & near(self.second)) > 0
        out[:, 7] = w.per_doc(self._masked(w, any_)) > 0
        doubled = np.zeros(len(w.data), bool)
        doubled[1:] = _LOUD[w.data[1:]] & _LOUD[w.data[:-1]]
        out[:, 8] = w.bytes_per_doc(doubled) >= 3
        upper = np.concatenate([[0], np.cumsum(S._UPPER[w.data])])
        loud = w.per_doc((upper[w.end] - upper[w.start]) * 2 > w.end - w.start)
        out[:, 9] = loud * 2 > np.maximum(np.diff(w.first), 1)
        out[:, 10] = -((out[:, [0, 1, 2, 3, 4, 7]] == 0).all(1).astype(np.int8))
        return out

    @staticmethod
    def _before(w: X.Words, finder: Finder, h: np.ndarray) -> np.ndarray:
        """Words that have one of the finder's words at most ``REACH`` before them in their text."""
        found, out = np.zeros(len(h), bool), np.zeros(len(h), bool)
        found[finder(h)[0]] = True
        for k in range(1, REACH + 1):
            out[k:] |= found[:-k] & (w.doc[k:] == w.doc[:-k])
        return out

    def _masked(self, w: X.Words, known: np.ndarray) -> np.ndarray:
        """Words that are insults once signs that stand for letters are read as these, and weren't before."""
        odd = w.per_doc(np.ones(len(w.doc), bool))[:0]
        signs = np.concatenate([[0], np.cumsum(_SIGN[w.data])])
        some = np.flatnonzero((signs[w.end] > signs[w.start]) & ~known)
        out = np.zeros(len(w.doc), bool)
        if len(some):
            read = X.Words(_READ[w.data], w.bounds, w.start[some], w.end[some], w.doc[some], odd)
            at, kind = self.finder(hashed(read)[0])
            out[some[at[(kind & 7) > 0]]] = True
        return out


@dataclass
class Linear:
    bias: float
    finder: Finder

    def score(self, w: X.Words) -> np.ndarray:
        doc, value = [], []
        for k, h in enumerate(hashed(w)):
            at, got = self.finder(h)
            pair = np.stack([w.doc[at].astype(np.uint64), h[at].astype(np.uint64)], 1)
            _, once = np.unique((pair[:, 0] << X.U(32)) | pair[:, 1], return_index=True)
            doc.append(w.doc[at][once]), value.append(got[once])
        total = self.bias + np.bincount(np.concatenate(doc), np.concatenate(value), w.n)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def signature(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The two least mixed hashes of each document as one number: near copies of a text mostly share it."""
    mixed = X.mix(h.astype(np.uint64))
    order = np.lexsort((mixed, doc))
    first = np.searchsorted(doc[order], np.arange(n))
    padded = np.append(mixed[order], np.zeros(2, np.uint64))
    return X.mix(padded[first] + X.mix(padded[np.minimum(first + 1, len(padded) - 1)])).astype(np.int64)


def labelled_rows(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(_label, h) of at most about ``rows`` labelled documents of each class, near copies of one text once. An id may stand for
    many rows, so these are bounded again."""
    chosen = bounded(known.where("_label = 1"), rows, F.col("doc_id")).unionByName(bounded(known.where("_label = 0"), rows, F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            doc, h = doc_features(X.split(part.column("text")))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(signature(doc, h, part.num_rows)), lists], names=["_label", "sig", "h"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "_label int, sig long, h array<int>")
    return bounded(store(found.dropDuplicates(["_label", "sig"]), "toxic-rows"), 2 * rows, F.col("sig"))


def telling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that speak for the toxic class, and those that tell the classes apart best, by their log odds."""
    many, others = rows.agg(F.sum("_label"), F.sum(1 - F.col("_label"))).first()
    counts = rows.select("_label", F.explode("h").alias("h")).groupBy("h").agg(F.sum("_label").alias("pos"), F.sum(1 - F.col("_label")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / ((many or 0) + 1.0)) - F.log((F.col("neg") + 0.5) / ((others or 0) + 1.0))
    counts = store(counts.where(F.col("pos") + F.col("neg") >= LEAST_ROWS).withColumn("odds", odds), "toxic-hashes")
    lexicon = counts.where((F.col("odds") > 3) & (F.col("pos") >= max(5, 0.004 * (many or 0)))).orderBy(F.desc("pos"), "h").limit(MOST_LEXICON)
    features = counts.orderBy(F.desc(F.sqrt(F.col("pos") + F.col("neg")) * F.abs("odds")), "h").limit(FEATURES_KEPT)
    back = lambda df: np.sort(np.array([r["h"] for r in df.select("h").collect()], np.int32).view(np.uint32))
    return back(lexicon), back(features)


def fixed_hashes() -> np.ndarray:
    return _words([x for words in LEXICONS.values() for x in words])


def build_voters(lexicon: np.ndarray) -> Voters:
    kinds = {int(h): 8 for h in lexicon.tolist()}
    for k, words in enumerate(LEXICONS.values()):
        for h in _words(words).tolist():
            kinds[h] = kinds.get(h, 0) | 1 << k
    keys = np.array(sorted(kinds), np.uint32)
    of = lambda texts: (h := np.unique(_words(texts)), np.ones(len(h), int))
    return Voters(Finder(keys, np.array([kinds[int(h)] for h in keys], int)), Finder(*of(SECOND_PERSON)), Finder(*of(DENIALS)))


def vote(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and VOTERS of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            v = voters.votes(X.split(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v[:, k].astype(np.int32)) for k in range(len(VOTERS)))], names=["doc_id", *VOTERS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{v} int" for v in VOTERS))


def with_label(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the label's vote: 1, -1, or 0 where there is none."""
    return rows.join(known, "doc_id", "left").withColumn(LABEL, F.coalesce(F.col("_label") * 2 - 1, F.lit(0))).drop("_label")


def label_model(docs: DataFrame, known: DataFrame, voters: Voters) -> LabelModel:
    """Fitted on the vote patterns of all documents; a document's own pattern is counted before labels are looked up."""
    counted = vote(docs, voters).groupBy("doc_id", *VOTERS).agg(F.count(F.lit(1)).alias("n"))
    votes, counts = patterns(with_label(counted, known), [*VOTERS, LABEL], "n")
    if not len(votes):
        return fit(votes, counts, [*VOTERS, LABEL])
    hits, label = (votes[:, :8] > 0).sum(1), votes[:, -1]
    start = np.where(label != 0, np.where(label > 0, 0.98, 0.02), 1 / (1 + np.exp(2.0 - 1.5 * hits)))
    return fit(votes, counts, [*VOTERS, LABEL], start=start, with_correlations=True)


def posterior_rows(docs: DataFrame, known: DataFrame, voters: Voters, features: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of the training sample with the label's, and the places of its features: row bounds and columns."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold(F.col("doc_id"), FOLDS) != 0)
    chosen = bounded(known.where("_label = 1"), rows, F.col("doc_id")).unionByName(bounded(known.where("_label = 0"), rows, F.col("doc_id")))
    sample = of.join(F.broadcast(chosen.select("doc_id")), "doc_id").unionByName(bounded(of, rows, F.xxhash64("doc_id", "text")))
    schema = "doc_id long, sig long, at binary, " + ", ".join(f"{v} int" for v in VOTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            w = X.split(part.column("text"))
            doc, h = doc_features(w)
            sig, v = signature(doc, h, w.n), voters.votes(w)
            at = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
            keep = features[at] == h if len(features) else np.zeros(len(h), bool)
            cut, at = np.searchsorted(doc[keep], np.arange(w.n + 1)), at[keep].astype(np.int32)
            blobs = pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sig), blobs, *(pa.array(v[:, k].astype(np.int32)) for k in range(len(VOTERS)))], names=[f.split()[0] for f in schema.split(", ")])

    found = with_label(store(sample.mapInArrow(run, schema).dropDuplicates(["doc_id", "sig"]), "toxic-sample"), known)
    one = found.groupBy("sig", LABEL).agg(F.min(F.struct("at", *VOTERS)).alias("r")).select("r.*", LABEL, "sig")
    got = sorted(bounded(store(one, "toxic-training"), 3 * rows, F.col("sig")).drop("sig").collect())
    columns = [np.frombuffer(bytes(r["at"]), np.int32) for r in got]
    votes = np.array([[r[v] for v in (*VOTERS, LABEL)] for r in got], int).reshape(len(got), len(VOTERS) + 1)
    return votes, np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(int), np.concatenate([np.zeros(0, np.int32), *columns])


def fit_linear(y: np.ndarray, bounds: np.ndarray, col: np.ndarray, features: np.ndarray, rounds: int = 200, ridge: float = 0.01) -> Linear:
    """Logistic regression on soft labels by scaled gradient steps over presence of the features."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    prior = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-4, 1 - 1e-4)
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(len(features))
    scale, bias_scale = np.full(len(features), 1e-3), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(y)), -50, 50)))
        r = p - y
        g = np.bincount(col, r[row], len(features)) + ridge * w
        scale += g * g
        bias_scale += r.sum() ** 2
        w -= 0.5 * g / np.sqrt(scale)
        bias -= 0.5 * r.sum() / np.sqrt(bias_scale)
    return Linear(float(bias), Finder(features, w))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = CLASS_ROWS) -> tuple[Linear, LabelModel]:
    known = labelled(labels, column).select(F.col("doc_id").cast("long").alias("doc_id"), "_label").where(fold(F.col("doc_id"), FOLDS) != 0)
    some = labelled_rows(docs, known, rows)
    if some.isEmpty():
        fixed = fixed_hashes()
        order = np.argsort(fixed)
        return Linear(-2.0, Finder(fixed[order], np.full(len(fixed), 3.0))), label_model(docs, known, build_voters(fixed[:0]))
    lexicon, features = telling(some)
    voters = build_voters(lexicon)
    model = label_model(docs, known, voters)
    votes, bounds, col = posterior_rows(docs, known, voters, features, rows)
    return fit_linear(model.posterior_array(votes), bounds, col, features), model


def score(docs: DataFrame, model: Linear, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    if name in keep:
        raise ValueError(f"{name} is among the kept columns")
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(model.score(X.split(part.column("text"))))], names=[*keep, name])

    return docs.select(*named(list(dict.fromkeys([*keep, "text"])))).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, _ = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
