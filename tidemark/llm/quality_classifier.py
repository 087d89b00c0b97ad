"""Operator 7, quality classifier: histogram gradient-boosted trees over document statistics.

Features come from whole texts in Spark tasks. The trees are fitted with numpy on a bounded sample of labelled rows
(``TRAIN_ROWS``), then flattened into arrays; tasks score batches by walking all rows down a level at a time.

Defined results: a null text counts as empty and is scored; a row in gives a row out; labels that are null or not 0/1
are ignored, an id labelled twice counts with its least label; with no usable labels every score is the prior 0.5.
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
from .common import bounded, documents, fold, fresh, named, store, table

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.15, 20, 5.0

_RATIOS = ["n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_exclaim", "n_nonascii", "n_stop", "n_unique", "n_ends", "n_alpha_words", "n_upper_words", "n_symbol_words", "n_lines"]
COLUMNS = ["log_words", "log_chars", "mean_word", "max_word", *(f"{r}_share" for r in _RATIOS)]


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x COLUMNS, of FEATURES."""
    words = np.maximum(stats["n_words"], 1)
    cols = [np.log1p(stats["n_words"]), np.log1p(stats["n_chars"]), stats["word_chars"] / words, stats["max_word"], *(stats[r] / words for r in _RATIOS)]
    return np.stack([np.asarray(c, float) for c in cols], 1)


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Newton boosting of the log loss, splits chosen on per-bin sums of gradients and curvatures."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feat, limit, cut = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, bins + 1)
        node = np.zeros(len(y), int)
        for level in range(depth):
            lo, width = 2**level - 1, 2**level
            at = node - lo
            best = np.full(width, 1e-3)
            for k in range(x.shape[1]):
                key = at * bins + binned[:, k]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins) for w in (g, h, None)]
                left = [s.cumsum(1)[:, :-1] for s in sums]
                right = [s.sum(1, keepdims=True) - q for s, q in zip(sums, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - (sums[0].sum(1) ** 2 / (sums[1].sum(1) + RIDGE))[:, None]
                gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), top] > best):
                    if top[i] < len(edges[k]):
                        best[i], feat[lo + i], cut[lo + i], limit[lo + i] = gain[i, top[i]], k, top[i], edges[k][top[i]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feat[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[leaf]
        out_f.append(feat), out_t.append(limit), out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one 0/1 label for an id."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("_label"))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees of at most about ``rows`` labelled rows outside fold 0; the chosen labels are few, so they are broadcast."""
    chosen = bounded(labelled(labels, column).where(fold(F.col("doc_id"), FOLDS) != 0), rows, F.col("doc_id"))
    rows_of = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows_of = store(S.with_stats(rows_of, ["doc_id", "_label"]).drop("doc_id").distinct(), "quality-rows")  # an id may stand for many rows
    got = bounded(rows_of, 2 * rows, F.struct(*rows_of.columns)).toPandas()
    got = got.sort_values(list(got.columns))  # the order of arrival has no say
    x = features({f: got[f].to_numpy(float) for f in S.FEATURES})
    return fit_trees(x, got["_label"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns of docs and the score of its whole text."""
    clash = name in keep
    if clash:
        raise ValueError(f"{name} is among the kept columns")
    own = [f"c{i}" for i in range(len(keep))]  # whatever the kept columns are called
    text = own[keep.index("text")] if "text" in keep else "text"  # a text goes to the task once
    schema = T.StructType([T.StructField(c, docs.schema[k].dataType) for c, k in zip(own, keep, strict=True)] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, text):
            got = trees.score(features(S.stats(X.split(part.column(text)))))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(got)], names=[*own, "score"])

    rows = docs.select(*(c.alias(n) for c, n in zip(named(list(keep)), own, strict=True)), *([] if "text" in keep else ["text"]))
    return rows.mapInArrow(run, schema).toDF(*keep, name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches the threshold stay, with their own columns only."""
    trees, name = train(docs, table(spark, sf_dir, "labels")), fresh(docs, "quality_score")
    return score(docs, trees, tuple(docs.columns), name).where(F.col(name) >= THRESHOLD).select(*named(docs.columns))
