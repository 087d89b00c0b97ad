"""The methods of the operators against brute-force versions."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, label_model, language, packing, quality_classifier, quality_rules, secrets, toxicity
from tidemark.llm import textops as X
from tidemark.llm.common import tag_of

SF = "/root/testdata/sf0.001"


def pieces_of(words, begin):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = X.spans_hash(X.BYTE[data], ends - np.array([len(w) for w in words]), ends)
    return h ^ language._FIRST if begin else h


@pytest.fixture(scope="module")
def vocabulary():
    """Pieces, their probabilities in two languages, and the place of each (piece, begins)."""
    inner = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"\xc3\xa9", b"a\xc3", "語".encode(), b"cab"]
    begin = [bytes([b]) for b in range(256)] + [b"ab", b"ca", "日本".encode()]
    keys = np.unique(np.concatenate([pieces_of(begin, True), pieces_of(inner, False)]))
    p = np.random.default_rng(1).random((len(keys), 2)) / 50
    place = {(w, True): int(np.searchsorted(keys, k)) for w, k in zip(begin, pieces_of(begin, True))} | {(w, False): int(np.searchsorted(keys, k)) for w, k in zip(inner, pieces_of(inner, False))}
    return language.Pieces(keys, 6), p, place


def plain_sums(word, place, p):
    """Sum over segmentations at each position, in logs."""
    out = [np.zeros(2)] + [np.full(2, -np.inf)] * len(word)
    for to in range(1, len(word) + 1):
        for frm in range(max(0, to - 6), to):
            at = place.get((word[frm:to], frm == 0))
            if at is not None:
                out[to] = np.logaddexp(out[to], out[frm] + np.log(p[at]))
    return out[-1]


def test_words_sum_all_segmentations(vocabulary):
    pieces, p, place = vocabulary
    rng = np.random.default_rng(2)
    words = [b"abcab", "caé日本語".encode(), "日本語" .encode() * 30, "日".encode() * 167] + [bytes(rng.choice(list(b"abc"), n).tolist()) for n in (1, 40, 41, 80, 499, 500)]
    column = pa.array([w.decode() for w in words])
    got = language.Scorer(pieces, p).documents(X.split(column))
    for w, g in zip(words, got):
        np.testing.assert_allclose(g, plain_sums(w, place, p), rtol=1e-9)
    every = 0.0
    for cuts in itertools.product([0, 1], repeat=4):  # b"abcab" piece by piece
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [5]
        parts = [b"abcab"[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        at = [place.get((x, i == 0)) for i, x in enumerate(parts)]
        every = every + (np.prod([p[k] for k in at], 0) if None not in at else 0)
    np.testing.assert_allclose(got[0], np.log(every))


def test_expected_counts_of_long_words(vocabulary, monkeypatch):
    pieces, p, _ = vocabulary
    w, lang = X.split(pa.array(["abcabcab cab " + "abcacb" * 5, "caab"])), np.array([0, 1])
    short = language.expected_counts(w, lang, pieces, p)
    monkeypatch.setattr(language, "SHORT", 2)
    np.testing.assert_allclose(language.expected_counts(w, lang, pieces, p), short, rtol=1e-8, atol=1e-12)


def test_label_model_is_expectation_maximisation():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    right = np.array([0.9, 0.8, 0.7])
    votes = np.where(rng.random((4000, 3)) < 0.2, 0, np.where((rng.random((4000, 3)) < right) == truth[:, None], 1, -1))
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = label_model.fit(rows, counts.astype(float), ["a", "b", "c"], rounds=60)
    q = (1 + (votes > 0).sum(1)) / (2 + (votes != 0).sum(1))  # row by row, without patterns
    for _ in range(60):
        table = np.full((3, 3, 2), 2.0)
        table[:, 1, :] = 2.0
        table[:, 0, 0] = table[:, 2, 1] = 20.0
        for k, v in enumerate((-1, 0, 1)):
            table[:, k, 0] += ((votes == v) * (1 - q)[:, None]).sum(0)
            table[:, k, 1] += ((votes == v) * q[:, None]).sum(0)
        table /= table.sum(1, keepdims=True)
        prior = (q.sum() + 1) / (4000 + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[m, votes[:, m] + 1, 1] / table[m, votes[:, m] + 1, 0]) for m in range(3))
        q = 1 / (1 + np.exp(-odds))
    np.testing.assert_allclose(model.posterior_array(votes), q, atol=1e-5)
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.06


def test_posterior_decides_quality(spark):
    out = quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    names = list(quality_rules.rules())
    rows, counts = np.unique(out[names].to_numpy(), axis=0, return_counts=True)
    model = label_model.fit(rows, counts.astype(float), names, start=1 / (1 + 0.25 * 6.0 ** (rows < 0).sum(1)))
    np.testing.assert_allclose(out.posterior, model.posterior_array(out[names].to_numpy()), atol=1e-9)
    assert (out.kept == (~out.base_failed & (out.posterior >= 0.5))).all() and 0 < out.kept.mean() < 1


def test_toxic_labels_are_posteriors(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    linear, model = toxicity.train(docs, labels)
    told = dict(zip(model.names, model.accuracies().values()))
    assert set(told) == {*toxicity.VOTERS, toxicity.LABEL} and 0.7 < told[toxicity.LABEL] <= 1
    row = lambda **v: [v.get(n, 0) for n in model.names]
    quiet, loud, known = model.posterior_array(np.array([row(v_clean=-1), row(v_english=1, v_words=1, v_prefix=1, v_several=1), row(v_clean=-1, v_label=1)]))
    assert quiet < 0.1 and loud > 0.5 and known > quiet
    got = toxicity.score(docs, linear).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.score[got.toxic == 1].mean() > 0.5 > got.score[got.toxic == 0].mean()


@pytest.mark.parametrize("text, want", [
    ("You are such an idiot.", {"v_english", "v_frame"}), ("du bist ein Trottel und dumm", {"v_german", "v_several", "v_frame"}), ("what an 1d1ot, st0pid, stup1d", {"v_masked"}), ("he is not an idiot", {"v_clean"}),
    ("he is not an idiot but a moron", {"v_english"}), ("so many!!! words??? here!!", {"v_marks", "v_clean"}), ("ALL LOUD WORDS", {"v_shouting", "v_clean"}), ("", {"v_clean"}), ("idiote!", {"v_romance"}), ("idiot a b c d you", {"v_english"}),
])
def test_voters_stand_apart(text, want):
    column = pa.array(["you are", text, "idiot"])
    got = toxicity.build_voters(np.zeros(0, np.uint32)).votes(X.split(column))[1]
    assert {n for n, v in zip(toxicity.VOTERS, got) if v} == want
    assert all(v == (-1 if n == "v_clean" else 1) for n, v in zip(toxicity.VOTERS, got) if v)


def test_trees_are_walked_as_nodes():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality_classifier.fit_trees(x, y, trees=12, depth=3)

    def walk(row, f, t, v):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        return v[node - len(f)]

    plain = [trees.base + sum(walk(r, *tree) for tree in zip(trees.feature, trees.limit, trees.value)) for r in x[:200]]
    np.testing.assert_allclose(trees.score(x[:200]), 1 / (1 + np.exp(-np.array(plain))))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


ITEMS = ["Alice buys 12 apples at the market for 3 dollars and gives some to a friend", "The train from Boston leaves at 9 and reaches its goal after three hours of travel through hills", "Mary gave 7 kg of flour to John before the long walk home that same evening", "What is the sum of 4 and 5"]
HELD = {
    1: ("Robert buys 99 apples at the market for 5 dollars and gives some to a friend", {0}),
    2: ("Well. The train from New York City leaves at 11 and reaches its goal after twelve hours of travel through hills. So", {1}),
    3: ("Mary Ann Smith gave 8 kg of flour to Peter Paul before the long walk home that same evening", {2}),
    4: ("Mary gave 7 kg of flour to John before the long walk home that very same evening", {2}),
    5: ("A boy buys some apples at a shop and then walks home", set()),
    6: ("Mary gave 7 kg of flour to John before the long walk home that same evening", {2}),
    7: ("", set()),
    8: (None, set()),
    9: ("You see, what is the sum of 14 and 15", set()),
    10: ("gave of flour to before the long walk", set()),
}


def test_reparameterised_items_are_found(spark):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs = spark.createDataFrame([(k, v[0]) for k, v in HELD.items()], "doc_id long, text string")
    got = defaultdict(dict)
    for r in decontamination.matches(docs, bench).collect():
        got[r.id][r.item_id] = r.reparameterised
    for k, (_, want) in HELD.items():
        assert set(got[k]) - {3} == want, k
    assert got[1][0] and got[2][1] and got[3][2] and not got[6][2]


def slow_matches(docs, items, coverage=0.5):
    """All windows of all pairs of a document and an item, without the order of windows by how many items share them."""
    def shape(text):
        t = decontamination.template(X.split(pa.array([text or ""])))
        return t.token.tolist(), t.filler.tolist(), t.slot.tolist()

    def cut(t, width):
        token, filler, slot = t
        out = []
        for a in range(len(token) - width + 1):
            span = slice(a, a + width)
            few = width - sum(slot[span]) < min(4, width)
            key = ("w", *(f if s else k for k, f, s in zip(token[span], filler[span], slot[span]))) if few else ("t", *token[span])
            out.append((a, key, [f for f, s in zip(filler[span], slot[span]) if s]))
        return out

    found = set()
    shapes = [(i, shape(t)) for i, t in docs]
    for item, text in items:
        t = shape(text)
        width = min(8, len(t[0]))
        own = cut(t, width) if width else []
        for doc, d in shapes:
            hits = [(a, b, f, g) for b, k, g in own for a, key, f in (cut(d, width) if width else []) if key == k]
            groups = defaultdict(list)
            for a, b, f, g in hits:
                groups[0, (a - b) // 16].append((b, f, g))
                groups[1, (a - b + 8) // 16].append((b, f, g))
            for near in groups.values():
                count = Counter((y, x) for _, f, g in near for x, y in zip(f, g))
                taken = {}
                for (y, x), n in count.items():
                    taken[y] = max(taken.get(y, (0, -(2**64))), (n, np.uint64(x).astype(np.int64).item()))
                good = {b for b, f, g in near if all(taken[y][1] == np.uint64(x).astype(np.int64).item() for x, y in zip(f, g))}
                if own and len(good) >= coverage * len(own):
                    found.add((doc, item))
    return found


def test_decontamination_matches_all_pairs(spark):
    bench, docs = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    docs = docs[docs.text.str.len() < 2000].head(25)
    rows, items = list(zip(docs.doc_id.tolist(), docs.text.tolist())), list(zip(bench.item_id.tolist(), bench.text.tolist()))
    rng = np.random.default_rng(6)
    for n, (_, text) in enumerate(items[:8]):
        words = text.split()
        words.insert(len(words) // 2, "indeed")
        rows.append((100_000 + n, rows[n][1] + " " + " ".join(words)))
        rows.append((200_000 + n, " ".join(w for w in text.split() if rng.random() > 0.1)))
    got = decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow_matches(rows, items)
    assert {(r.id, r.item_id) for r in got} == want and len(want) >= 8


def test_ownership_counts_owners_and_repositories(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.NEVER_HOT", 0)
    rows = [(i, "token: widelycopied99", f"o{i % 5}") for i in range(40)] + [(100 + i, "token: onlymine12345", "o1") for i in range(3)] + [(200 + i % 2, "token: onlymine12345", "o1") for i in range(6)] + [(300 + i, "token: manyrepos777", "o2") for i in range(25)] + [(400, None, None), (401, "none here", "o1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan_with_verdicts(docs, ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    held = defaultdict(lambda: (set(), set()))
    for i, t, o in rows:
        if t and ":" in t:
            held[t][0].add(o), held[t][1].add(i)
    for r in got:
        for s in r.secret_live or []:
            owners, repositories = held[r.text]
            assert (s.n_owners, s.n_repositories) == (len(owners), len({(i, o) for i, t, o in rows if t == r.text}))
            assert s.live == (len(owners) <= secrets.MOST_OWNERS and len(repositories) <= secrets.MOST_REPOSITORIES)
    assert Counter(r.text for r in secrets.redact(docs).collect()) == {"<example-secret>": 65, "<secret>": 9, "none here": 1, None: 1}


def test_step_groups_are_balanced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    out = packing.pack_documents(docs).toPandas()
    of = out.groupby(["tier", "step_group"]).length.sum()
    for _, g in of.groupby("tier"):
        assert (g.sort_index().iloc[:-1] == packing.STEP_TOKENS).all() and g.max() <= packing.STEP_TOKENS
    assert (out.groupby("sequence_id").tier.nunique() == 1).all()


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    names = ["secret_row", "secret_live", "secret_spans", "kept", "_kept", "leak", "_leak", "quality_score", "_quality_score", "copies", "root", "a.b", "KEPT", "score", "h", "size"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for n in names:
        if n.lower() not in {c.lower() for c in docs.columns}:
            docs = docs.withColumn(n, docs.doc_id * 2)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r["a.b"] == r.doc_id * 2 and r.secret_row == r.doc_id * 2, name


def test_pipeline_rows(spark, tmp_path):
    """Each stage's rows, from its operator's own answer on its own input."""
    import corpus_pipeline
    from tidemark.llm import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(None, "one of its own kind " * 3, None, None, None), (None, "another that stands alone here", None, None, None), (5, "with an id that is used twice", "en", "a", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema))
    key = lambda df: Counter((r.doc_id, r.tag) for r in df.select("doc_id", tag_of(F.coalesce("text", F.lit(""))).alias("tag")).collect())
    stages = dict(corpus_pipeline.STAGES)
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels), ("doc_id", "text"))
    assert key(stages["quality_classifier"](spark, docs, SF)) == key(scored.where("score >= 0.3"))
    found = near_dedup.near_duplicates(docs).toPandas()
    first = found.assign(root=found.root.map(tuple)).sort_values(["id", "tag"]).groupby("root").first()
    left = stages["near_dedup"](spark, docs, SF)
    assert sorted(r[0] if r[0] is not None else near_dedup.NO_ID for r in left.select("doc_id").collect()) == sorted(first.id)
    bad = {(r.id, r.tag) for r in decontamination.matches(docs, bench).collect()}
    kept = key(stages["decontamination"](spark, docs, SF))
    assert kept == Counter({k: n for k, n in key(docs).items() if (k[0] if k[0] is not None else near_dedup.NO_ID, k[1]) not in bad})
    masked = stages["secret_scans"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in masked) == Counter(r.doc_id for r in docs.collect())
