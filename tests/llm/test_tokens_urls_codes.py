"""Token alignment, URL filters and vector codes against plain versions."""

import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from public_tokenizers import path

from tidemark.llm import token_alignment, url_filter, vector_codes

SF = "/root/testdata/sf0.001"
FILES = path(token_alignment.A_FILE), path(token_alignment.B_FILE)


def plain_alignment(rows):
    """All links from byte ranges of whole texts, without pieces and without the transducer."""
    both = token_alignment.sides(*FILES)
    out, each, held = [], [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = both.a.encode(raw.decode(), add_special_tokens=False).ids, both.b.encode(text or "")
        a_end, b_end = [list(accumulate(len(t[i]) for i in ids)) for t, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        if not text or b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
            out.append((doc_id, 0, 0, 0, 0, ""))
            each.append([])
            continue
        side_of = lambda ids, ends: [(i, e - s, e) for i, s, e in zip(ids, np.diff([0, *ends]), ends)]
        links = [(i, j) for i, s, e in side_of(a, a_end) for j, s2, e2 in side_of(b, b_end) if s < e2 and s2 < e]
        cuts = [0, *sorted(set(a_end) & set(b_end))]
        text = ";".join(",".join(str(i) for i, e in zip(a, a_end) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, b_end) if lo < e <= hi) for lo, hi in zip(cuts, cuts[1:]))
        out.append((doc_id, len(a), len(b), len(cuts) - 1, len(links), hashlib.sha256(text.encode()).hexdigest()))
        each.append(links)
        held.update(set(links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return sorted((str((*o, sum(held[x] == best[x[0]] for x in ls), sum(held[x] for x in ls))) for o, ls in zip(out, each)))


ODD_TEXTS = [
    (1, "a▁b"), (2, " lead"), (3, "\n\nx\n y  \n"), (4, "a  b\t\tc d  "), (5, "<|endoftext|> </s> <s> <0x0A>"), (None, "é́ ﬁ 你好 😀"), (6, None), (6, ""), (7, " "), (8, "\n"),
    (9, "  \n \n"), (10, "x" * 900), (11, "a\x00b \x1c y\u00a0 z\x85 w"), (12, "don't I'll  we'RE\n's"), (13, "\r\n a\r b"), (14, "x \u3000y \n\n\n  z"), (14, "x \u3000y \n\n\n  z"), (None, None),
]


@pytest.mark.parametrize("sent", [token_alignment.SENT_PAIRS, 0])
def test_alignment_matches_byte_ranges(spark, sent):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").selectExpr("*", "1 AS row_no", "2 AS pairs", "3 AS n_a")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 700").select("doc_id", "text"), allowMissingColumns=True)
    got = token_alignment.token_alignment(docs, *FILES, sent_pairs=sent).collect()
    assert sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)) for r in got) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert token_alignment.token_alignment(docs.limit(0), *FILES, sent_pairs=sent).count() == 0


def test_alignment_groups_give_the_bytes_back(spark):
    docs = spark.createDataFrame(ODD_TEXTS[1:4], "doc_id long, text string")
    both = token_alignment.sides(*FILES)
    got = token_alignment.groups(docs, *FILES).orderBy("doc_id", "at").collect()
    for doc_id, text in ODD_TEXTS[1:4]:
        mine = [g for g in got if g.doc_id == doc_id]
        assert all(b"".join(both.a_bytes[i] for i in g.a) == b"".join(both.b_bytes[i] for i in g.b) for g in mine)
        assert b"".join(both.a_bytes[i] for g in mine for i in g.a) == (" " + text).encode()


def test_pieces_are_forgotten_without_a_trace(monkeypatch):
    both = token_alignment.sides(*FILES)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 30").fetchall()]
    key = lambda rows: [(*x[:5], x[5].tolist(), x[6].tolist()) for x in rows]
    want = key(token_alignment.Pieces(both).documents(texts))
    monkeypatch.setattr(token_alignment, "HELD_PIECES", 3)
    held = token_alignment.Pieces(both)
    assert key([held.documents([t])[0] for t in texts]) == want


def test_sums_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "SUMMED_PAIRS", 2)
    rows = spark.createDataFrame([([k % 5, 7 + k % 3],) for k in range(30)], "pairs array<long>").repartition(2)
    got = {r.pair: r.docs for r in token_alignment.pair_counts(rows).collect()}
    assert got == {**dict.fromkeys(range(5), 6), **dict.fromkeys(range(7, 10), 10)}


def plain_verdict(url):
    host = path_ = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path_ = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c in url_filter.UPPER else c for c in host)
    low = "".join(c.lower() if c in url_filter.UPPER else c for c in url or "")
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path_.startswith(r.path)]
    rule = max(fits, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    found = {t for t in url_filter.VOCABULARY if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)}
    strict = sum(url_filter.VOCABULARY[t] >= url_filter.STRICT for t in found)
    verdict = rule.verdict if rule else "block" if strict or len(found) - strict >= url_filter.SOFT_HITS else "allow"
    return host, path_, rule and rule.host + rule.path, verdict, strict, len(found) - strict


ODD_URLS = [
    "http://a.org/x", "http://A.ORG", "http://org/", "http://example.org/es/1", "https://x.example.org/en/12?q", "http://a.com/fr/#f", "http://com/de/", "http://notcom.xcom/de/", "ftp://u@a.com:80/fr/", "no scheme porn", "",
    None, "://", "x://y://z.org/", "http://bet.win.example.net/", "http://bet-bet.net/bet", "http://casinos.net/", "http://my-casino.net", "http://a.net/?XXX", "http://a.net/éporn", "http://" + "a." * 5000 + "org/", "http://a..org/p", "http://.org/", "http://a.net\n/porn\n", "http://a.net/cheap-pills", "http://free-download.net/adult\x00",
]


def test_verdicts_on_odd_addresses(spark):
    pages = spark.createDataFrame([(None if k == 3 else k // 2, u) for k, u in enumerate(ODD_URLS)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS url_", "3 AS n_soft", "'x' AS html")
    got = url_filter.url_verdicts(pages).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((None if k == 3 else k // 2, *plain_verdict(u))) for k, u in enumerate(ODD_URLS))
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, [], {}).collect()} == {"allow"}


def test_junk_hosts_are_blocked_by_terms():
    assert [plain_verdict(u)[3] for u in ("http://spam-farm.example.net/x", "http://ads.track.net/", "http://track.net/", "http://news.net/win-a-prize")] == ["block", "block", "allow", "block"]


@pytest.mark.parametrize("name", ["op12_url_filter", "op13_vector_codes"])
def test_sql(spark, name):
    from tidemark.llm import queries

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def plain_codes(rows):
    """Every distance of every round."""
    kept = [(i, [max(-vector_codes.LARGEST, min(vector_codes.LARGEST, math.floor(x * 256))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 16 == 0]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:64]
    width = len(first[0][1]) // 16
    kept = [x for x in kept if len(x[1]) == 16 * width]
    books = [[v[p * width : (p + 1) * width] for _, v in first if len(v) == 16 * width] for p in range(16)]
    for k in range(3):
        codes, errors = [], []
        for _, v, _ in kept:
            near = [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e)), k) for k, e in enumerate(books[p])) for p in range(16)]
            codes.append([x[1] for x in near])
            errors.append(sum(x[0] for x in near))
        if k < 2:
            for p in range(16):
                for e in range(len(books[p])):
                    mine = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(kept, codes) if c[p] == e]
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)] if mine else books[p][e]
    labels = Counter()
    for (_, _, y), e in zip(kept, errors):
        labels[y] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join(f"{c:02x}" for c in code), e, labels[y], digest)) for (i, _, y), code, e in zip(kept, codes, errors))


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(k, rng.choice([-0.3, -0.1, 0.0, 0.004, 0.2], 32).tolist(), None if k % 7 == 0 else k % 3) for k in range(150)]  # few values: many ties
    rows += [(200, [0.0] * 32, 1)] * 3 + [(None, [0.5] * 32, 1), (-5, None, 1), (201, [], 1), (202, [float("nan")] * 32, 1), (203, [None] * 32, 1), (204, [float("inf")] + [0.0] * 31, 1), (205, [1.0] * 16, 2), (206, [1.0] * 20, 2), (207, [1e30, -1e30] * 16, 2)]
    return rows


def test_codes_match_all_distances(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "table", lambda *_: spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS v", "2 AS key", "3 AS code").repartition(3))
    assert sorted(str(tuple(r)) for r in vector_codes.op13_vector_codes(spark, "").collect()) == plain_codes(odd_vectors())


def test_codes_of_few_or_no_rows(spark, monkeypatch):
    few = [(3, [0.25] * 16, None), (1, [-0.001] * 16, None)]
    monkeypatch.setattr(vector_codes, "table", lambda *_: spark.createDataFrame(few, "vec_id long, embedding array<float>, label int"))
    assert sorted(str(tuple(r)) for r in vector_codes.op13_vector_codes(spark, "").collect()) == plain_codes(few)
    for rows in ([], [(None, [1.0] * 16, 1)], [(1, None, 1)]):
        monkeypatch.setattr(vector_codes, "table", lambda *_, r=rows: spark.createDataFrame(r, "vec_id long, embedding array<float>, label int"))
        assert vector_codes.op13_vector_codes(spark, "").count() == 0


def test_bounds_skip_groups_and_keep_results():
    rng = np.random.default_rng(1)
    book = np.sort(rng.integers(-300, 300, (64, 4)), 0)
    x, of = rng.integers(-300, 300, (2000, 4)), vector_codes.grouped(book)
    first = vector_codes.Assign(book, of, None)
    code, error, bound = first(x, None, None)
    moved = book + rng.integers(-2, 3, book.shape)
    again = vector_codes.Assign(moved, of, book)
    got, error, _ = again(x, code.astype(np.uint8), vector_codes.down(bound))
    d = vector_codes.squares(x, moved)
    assert (got == d.argmin(1)).all() and (error == d.min(1)).all()
    assert again.scanned < first.scanned / 2
