"""Rows that are hard to tell apart, reserved strings, very many matches, very many languages."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import decontamination, language, packing, secrets, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(head: str, others: str) -> list[str]:
    """Two different texts with one CRC-32, told apart by their heads."""
    seen = {}
    for k in range(400_000):
        end = hashlib.md5(b"%d" % k).hexdigest()[:12]
        for t in (f"{head} {end}", f"{others} {end}"):
            c = zlib.crc32(t.encode())
            if c in seen and (seen[c].startswith(head)) != t.startswith(head):
                return sorted([seen[c], t], key=lambda x: not x.startswith(head))
            seen[c] = t
    raise AssertionError


def long_words(seed, n):
    return " ".join("".join(np.random.default_rng([seed, k]).choice(list("abcdefghij"), 6)) for k in range(n))


def test_clashing_texts_without_id_keep_their_own_spans(spark):
    shared, other = long_words(1, 40), "few words only"
    a, b = clashing(shared, other)
    rows = [(None, a), (None, b), (5, shared), (5, a), (5, b)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(-1, 41, 0), (-1, 4, 0), (5, 40, 40), (5, 41, 41), (5, 4, 0)])


def test_clashing_clean_text_stays(spark, monkeypatch):
    item = long_words(2, 40)
    leaked, clean = clashing(item, "nothing of it")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "table", lambda *_: bench)
    docs = spark.createDataFrame([(None, leaked), (None, clean), (3, leaked), (3, clean)], "doc_id long, text string")
    assert sorted(r.text for r in decontamination.stage_decontamination(spark, docs, "").collect()) == [clean, clean]


@pytest.mark.parametrize("turn", [1, -1])
def test_reserved_strings_keep_their_case(turn):
    from pyarrow import array

    path = packing.tokenizer_path()
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "A<|endoftext|>B, c<|EndOfText|>D.", "<|startoftext|>. <|STARTOFTEXT|>.", "Word WORD word. <|", "|> < | é<|endoftext|>É"][::turn]
    encoder, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    for part in (texts, texts[::-1]):
        ids, bounds = encoder(array(part))
        for t, lo, hi in zip(part, bounds[:-1], bounds[1:]):
            assert ids[lo:hi].tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_very_many_secrets_in_one_text(spark):
    n = 100_000
    text = "".join(f"é password = hunter{k:06d}x, " for k in range(n))
    began = time.time()
    row = secrets.scan(spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "token: abcdef", "s")], "doc_id long, text string, source string")).selectExpr("doc_id", "size(secret_spans) AS n", "get(secret_spans, 0) AS first", "get(secret_spans, size(secret_spans) - 1) AS last").collect()
    assert time.time() - began < 60
    got = {r.doc_id: r for r in row}
    last = list(re.finditer(r"password = hunter\d+x", text))[-1]
    assert got[1].n == n and (got[1].first.start, got[1].last.start, got[1].last.end) == (2, last.start(), last.end())
    assert got[2].n == 0 and got[3].n == 1
    began = time.time()
    out = secrets.redact(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first().text
    assert out == "".join("é <secret>, " for _ in range(n)) and time.time() - began < 120


def test_overlapping_secrets_are_one_and_live_if_any_is(spark):
    text = "a token = 0123456789abcdef0123456789 b"  # assign and hex overlap
    rows = [(k, text, f"owner{k}") for k in range(5)] + [(9, "x token=" + "0123456789abcdef0123456789" + "z live", "own")]
    got = sorted(r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == ["a <example-secret> b"] * 5 + ["x <secret> live"]


def test_all_languages_are_learnt(spark):
    rng = np.random.default_rng(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": rng.choice(list(letters), 3, replace=False) for k in range(40)}
    text = lambda x: " ".join("".join(rng.choice(own[x], 5)) for _ in range(60))
    rows = [(i, text(x), x) for i, x in enumerate(list(own) * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs, rows=50, block_langs=7)
    assert model.langs == sorted(own) and len(model.blocks()) == 6
    got = language.identify(docs, model, ("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)
    whole = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs, language.train(docs, rows=50)).collect()}
    assert whole == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got}
