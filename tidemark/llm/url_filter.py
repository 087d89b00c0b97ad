"""Operator 12, URL filters: rules for hosts and paths first, then a weighted vocabulary counted by Aho-Corasick.

An address is cut into host and path. The longest rule that fits decides. Where none does, one pass of an Aho-Corasick
automaton over the address (A-Z lower-cased) finds every term of the vocabulary, overlapping ones too; a find counts where
the characters beside it aren't ASCII letters or digits. A term of weight ``STRICT`` blocks alone, lighter ones are soft:
``SOFT_HITS`` distinct ones block, however often each occurs.

Defined results: an address that is null or has no ``://`` has an empty host and path and no rule; its terms still count
(a null has none). A host keeps its port and user part, so that no rule fits it. Of rules of one length that fit, the one
that sorts last wins. A row in gives a row out, also for repeated rows and null ids; an empty table gives an empty result;
other columns are ignored. Each row stands alone: nothing is shuffled, and only the address is read of a page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

STRICT, SOFT_HITS = 1.0, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = frozenset(LOWER + "0123456789")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)
#: Term to weight; terms are lower case. Several words are joined as addresses join them.
VOCABULARY = {
    **dict.fromkeys(["porn", "porno", "xxx", "hentai", "camgirls", "escorts", "spam-farm", "link-farm", "spamfarm", "adult", "cheap-pills", "viagra", "cialis", "warez", "keygen", "torrentz", "phishing", "malware", "casino", "payday-loans"], STRICT),
    **dict.fromkeys(["sexy", "nude", "dating", "bet", "betting", "poker", "slots", "jackpot", "lottery", "cheap", "discount", "pills", "pharmacy", "replica", "crack", "serial", "torrent", "free-download", "loans", "bonus", "win", "prize", "clickbait", "ads", "track", "tracker", "banner", "popup", "affiliate"], 0.5),
}


def address(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = lambda k: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(at(1), UPPER, LOWER), at(2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null: the ends of the host, of as many names as the
    rules have, are looked up in a map from host to rules."""
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    one = lambda r: F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("start"))
    held = F.create_map(*(x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(one, rs)))))
    names = F.split(host, r"\.", -1)
    depth = max(h.count(".") + 1 for h in by_host)
    ends = [F.when(F.size(names) >= k, F.array_join(F.slice(names, -k, k), ".")) for k in range(1, depth + 1)]
    found = F.flatten(F.array(*(F.coalesce(F.try_element_at(held, e), F.slice(F.array(one(rules[0])), 1, 0)) for e in ends)))
    fits = F.filter(found, lambda r: F.startswith(path, r["start"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


class Terms:
    """The vocabulary as an automaton, built once in each task."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            self.automaton.add_word(term, (term, len(term), weight >= STRICT))
        self.automaton.make_automaton()
        self.some = len(vocabulary) > 0

    def hits(self, text: str) -> tuple[int, int]:
        """Distinct strict and soft terms of a text."""
        strict, soft = set(), set()
        for last, (term, n, is_strict) in self.automaton.iter(text) if self.some else ():
            before, after = last - n, last + 1
            if (before < 0 or text[before] not in _ALNUM) and (after == len(text) or text[after] not in _ALNUM):
                (strict if is_strict else soft).add(term)
        return len(strict), len(soft)


def with_hits(pages: DataFrame, column: str, vocabulary: dict[str, float]) -> DataFrame:
    """``pages`` with n_strict and n_soft of the lower-case addresses in ``column``."""
    names = pages.columns
    schema = pages.limit(0).withColumns({"n_strict": F.lit(0).cast("long"), "n_soft": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary)
        for batch in batches:
            found = [terms.hits(x or "") for x in batch.column(column).to_pylist()]
            counts = [pa.array([x[k] for x in found], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*names, "n_strict", "n_soft"])

    return pages.mapInArrow(run, schema)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, vocabulary: dict[str, float] = VOCABULARY, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, n_strict, n_soft) of each row of ``pages``."""
    low = fresh(pages.select(key), "url_")
    rows = with_hits(pages.select(key, "url", F.translate("url", UPPER, LOWER).alias(low)), low, vocabulary)
    host, path = address(F.col("url"))
    cut = rows.select(key, host.alias("host"), path.alias("path"), "n_strict", "n_soft")
    ruled = cut.withColumn("by", longest_rule(F.col("host"), F.col("path"), rules))
    rejected = (F.col("n_strict") > 0) | (F.col("n_soft") >= SOFT_HITS)
    verdict = F.coalesce(F.col("by.verdict"), F.when(rejected, "block").otherwise("allow"))
    return ruled.select(key, "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's address."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def _sql() -> str:
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT"
    total = lambda strict: " + ".join(has(t) for t, w in VOCABULARY.items() if (w >= STRICT) == strict)
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.host}{r.path}', '{r.verdict}')" for r in RULES)
    return f"""
WITH rules(rhost, rpath, rule, rverdict) AS (VALUES {rules}),
low AS (SELECT page_id, url, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low, row_number() OVER () AS row_no FROM pages),
cut AS (SELECT *, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, {total(True)} AS n_strict, {total(False)} AS n_soft FROM low),
best AS (SELECT row_no, arg_max(rule, (length(rule), rule)) AS rule, arg_max(rverdict, (length(rule), rule)) AS rverdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft FROM cut LEFT JOIN best USING (row_no)"""


OP12_SQL = _sql()
