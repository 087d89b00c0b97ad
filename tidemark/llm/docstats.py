"""Statistics of whole documents, for the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops as X

# Frequent function words.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from at or an".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur est il elle avec".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine".split(),
    "es": "el la los las de del y en un una que por para con es se su al lo como".split(),
}
SYMBOLS = b"#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_text_lines", "n_upper", "n_digits", "n_punct", "n_exclaim", "n_nonascii", "n_stop", "n_unique", "n_ends", "n_alpha_words", "n_upper_words", "n_symbol_words", "max_word"]


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_UPPER, _DIGIT = _table(range(65, 91)), _table(range(48, 58))
_ALPHA = _table([*range(65, 91), *range(97, 123), *range(128, 256)])
_PUNCT = _table([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_SYMBOL, _END, _BANG = _table(SYMBOLS), _table(b".!?,;:"), _table(b"!")


def stop_hashes() -> np.ndarray:
    words = sorted({w for ws in STOP_WORDS.values() for w in ws} | {w.capitalize() for ws in STOP_WORDS.values() for w in ws})
    return np.sort(X.split(pa.array(words)).hash)


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def line_repeats(w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: lines, lines with a word, lines with a word that equal an earlier line."""
    cut = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.bounds[:-1], cut + 1]))
    # the start after a newline that ends a document belongs to that document: order by document first
    doc = np.concatenate([np.arange(w.n), np.searchsorted(w.bounds[1:], cut, "right")])
    start = np.concatenate([w.bounds[:-1], cut + 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    del starts
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[last] = w.bounds[1:][doc[last]]
    has_word = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    h = X.spans_hash(X.BYTE[w.data], start, end)
    _, later = X.repeated(h[has_word] ^ X.mix(doc[has_word].astype(np.uint64) + X.U(77)))
    count = lambda d: np.bincount(d, minlength=w.n)
    return count(doc), count(doc[has_word]), count(doc[has_word][later])


def stats(w: X.Words) -> dict[str, np.ndarray]:
    """FEATURES of each document of a slice."""
    n, cp = w.n, (w.data & 0xC0) != 0x80
    by, per = w.bytes_per_doc, w.per_doc
    at3 = X.window_hash(w, 3)
    many, _ = X.repeated(at3[0] ^ X.mix(w.doc[at3[1]].astype(np.uint64) + X.U(5)))
    rep = X.covered(at3[1][many], 3, len(w.start))
    _, later = X.repeated(w.hash ^ X.mix(w.doc.astype(np.uint64) + X.U(9)))
    lines, text_lines, dups = line_repeats(w)
    size = (w.end - w.start).astype(np.int64)
    sums = lambda t: np.concatenate([[0], np.cumsum(t[w.data])])
    in_word = lambda t: (s := sums(t))[w.end] - s[w.start]
    alpha, upper, symbol = in_word(_ALPHA), in_word(_UPPER), in_word(_SYMBOL)
    out = {
        "n_words": np.diff(w.first),
        "word_chars": by(cp & ~X.SPACE[w.data]),
        "n_symbols": by(_SYMBOL[w.data]),
        "n_dup_lines": dups,
        "n_repeat_words": per(rep),
        "n_chars": by(cp),
        "n_lines": lines,
        "n_text_lines": text_lines,
        "n_upper": by(_UPPER[w.data]),
        "n_digits": by(_DIGIT[w.data]),
        "n_punct": by(_PUNCT[w.data]),
        "n_exclaim": by(_BANG[w.data]),
        "n_nonascii": by(w.data >= 192),
        "n_stop": per(member(w.hash, _STOP)),
        "n_unique": np.diff(w.first) - per(later),
        "n_ends": per(_END[w.data[w.end - 1]]) if len(w.end) else np.zeros(n),
        "n_alpha_words": per(alpha == size),
        "n_upper_words": per((upper > 1) & (upper * 2 >= size)),
        "n_symbol_words": per(symbol > 0),
    }
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, size)
    out["max_word"] = longest
    return out


_STOP = stop_hashes()


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and FEATURES (long) of its text; a row in, a row out; a null text counts as empty."""
    fields = [docs.select("*").schema[k] for k in keep]
    schema = T.StructType(fields + [T.StructField(f, T.LongType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            got = stats(X.split(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(got[f].astype(np.int64)) for f in FEATURES], names=[*keep, *FEATURES])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
