"""Operator 2, secret scans with corpus-wide ownership frequency. DataFrame functions only.

Spans come from regular expressions over whole texts: the pieces between matches give each match its place in code
points. Candidate values are hashed and counted over the corpus by distinct owners and repositories; a value that many
owners or many repositories hold is a widely copied example, one that few hold is owner-specific and looks live.

Kinds: the base ones (assign, access, hex) and those that the method adds: ``vendor`` (values with a known issuer's
prefix) and ``key`` (private key headers). Counting goes by (hash, owner, repository), then (hash, owner), then hash, so
a value that a third of all rows holds is summed where it stands before it moves; joined back, it stays where it is.

Defined results: a null text counts as empty and has no spans; a row in gives a row out, also for repeated rows and null
ids; a null owner or repository is an owner of its own; redacting adds no column and
clashes with none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, named, split_join, store

# Patterns by kind, in order; the number is of the group that holds the value.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    "access": (r"AKIA[A-Z0-9]{16,}", 0),
    "hex": (r"[0-9a-f]{24,}", 0),
    "vendor": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0),
    "key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0),
}
BASE_KINDS = ("assign", "access", "hex")
LEAST_ASSIGN = 6
MOST_OWNERS = 3  # a value that more owners hold is an example
MOST_REPOSITORIES = 20  # ... and so is one in more repositories, even of one owner

SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def in_chunks(rows: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each of about sqrt(n) chunks of an array, so that what a chunk does step by step stays short."""
    step = lambda r: F.greatest(F.ceil(F.sqrt(F.size(r))).cast("int"), F.lit(1))
    return let(rows, lambda r: let(step(r), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0)), s), lambda k: body(F.slice(r, k + 1, s)))))


def _appended(rows: Column, at: Column, length: Callable[[Column], Column], item: Callable[[Column, Column], Column], kind: str) -> Column:
    """item(start, row) of each row, rows one behind the other from ``at``."""
    begin = F.struct(at.cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(rows, begin, lambda acc, r: F.struct((acc["at"] + length(r)).alias("at"), F.concat(acc["out"], F.array(item(acc["at"], r)).cast(kind)).alias("out")), lambda acc: acc["out"])


def _found(text: Column, kind: str, no: int) -> Column:
    """Spans of one kind: matches, and the text between them for their places. Places are sums of lengths, first of chunks of
    matches and then inside each, so that no long array is copied for every match."""
    pattern, group = KINDS[kind]
    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    rows = let(match, lambda m: F.arrays_zip(m.alias("m"), F.slice(between, 1, F.size(m)).alias("b"), (value if group else m).alias("v")))
    length = lambda r: F.length(r["b"]) + F.length(r["m"])
    sized = in_chunks(rows, lambda c: F.struct(c.alias("rows"), F.aggregate(c, F.lit(0).cast("bigint"), lambda n, r: n + length(r)).alias("size")))

    def span(at: Column, r: Column) -> Column:
        start = at + F.length(r["b"])
        return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (start + F.length(r["m"])).alias("end"), r["v"].alias("value"))

    placed = let(sized, lambda c: F.arrays_zip(c.alias("chunk"), _appended(c, F.lit(0), lambda x: x["size"], lambda at, _: at, "array<bigint>").alias("at")))
    walk = F.flatten(F.transform(placed, lambda p: _appended(p["chunk"]["rows"], p["at"], length, span, SPAN)))
    long = F.filter(walk, lambda s: F.length(s["value"]) >= (LEAST_ASSIGN if kind == "assign" else 1))
    return F.when(F.regexp_like(text, F.lit(pattern)), long).otherwise(F.array().cast(SPAN))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    found = [_found(text, kind, no) for no, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """secret_hash, n_owners, n_repositories and live, of (secret_hash, owner, repository) rows."""
    pairs = candidates.groupBy("secret_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("secret_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("secret_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_uses"))


def row_key(text: str, owner: str, repository: str) -> Column:
    """Names a row by its content, so that copies of a row have one key."""
    return F.sha2(F.to_json(F.struct(F.col(repository).alias("r"), F.col(owner).alias("o"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("t"))), 256)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``keep`` columns with secret_row (of the row's content), secret_spans, secret_owner and secret_repository."""
    return docs.select(*named(list(keep)), row_key(text, owner, repository).alias("secret_row"), spans(F.col(text)).alias("secret_spans"), F.col(owner).cast("string").alias("secret_owner"), F.col(repository).cast("string").alias("secret_repository"))


def verdicts(found: DataFrame) -> DataFrame:
    """secret_row, copies, secret_live (spans with whether each looks live) and secret_masks (start, end, live of what is to be
    masked: overlapping spans are one, live if any of them is), for rows that have spans.

    Copies of a row are one row from the start, and a value that a large share of all rows holds is judged where it stands."""
    few = found.where(F.size("secret_spans") > 0).groupBy("secret_row").agg(F.first("secret_spans").alias("spans"), F.first("secret_owner").alias("owner"), F.first("secret_repository").alias("repository"), F.count(F.lit(1)).alias("copies"))
    each = store(few.select("secret_row", "copies", "owner", "repository", F.explode("spans").alias("span")).withColumn("secret_hash", F.sha2(F.col("span.value"), 256)), "secret-values")
    counts = ownership(each)
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    judged = split_join(each, counts, "secret_hash", "n_uses").select("secret_row", "copies", F.struct("span.start", "span.kind_no", "span.kind", "span.end", live.alias("live"), "n_owners", "n_repositories").alias("s"))
    order = Window.partitionBy("secret_row").orderBy("s.start", "s.end", "s.kind_no")
    before = F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = judged.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("s.start")).cast("long")).withColumn("mask", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    masks = placed.groupBy("secret_row", "mask").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"), F.max("s.live").alias("live"), F.collect_set("s").alias("s"), F.max("copies").alias("copies"))
    out = masks.groupBy("secret_row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("secret_live"), F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("secret_masks"), F.max("copies").alias("copies"))
    return out


def scan_with_verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **columns: str) -> DataFrame:
    """scan(), stored once without the text, with secret_live (empty where there is no span)."""
    found = store(scan(docs, keep, **columns), "secrets")
    none = found.where(F.size("secret_spans") == 0)
    some = split_join(found.where(F.size("secret_spans") > 0), verdicts(found).drop("secret_masks"), "secret_row", "copies").drop("copies")
    return some.unionByName(none.withColumn("secret_live", F.lit(None).cast(some.schema["secret_live"].dataType)))


def redact(docs: DataFrame) -> DataFrame:
    """Texts with each span replaced by <secret> (looks live) or <example-secret> (widely copied), other columns as they
    are. Overlapping spans count as one, live if any of them is."""
    row = fresh(docs, "secret_row")
    live, copies = fresh(docs, "secret_live"), fresh(docs, "copies")
    judged = verdicts(store(scan(docs.select("doc_id", "text", "source")), "secrets")).select(F.col("secret_row").alias(row), F.col("secret_masks").alias(live), F.col("copies").alias(copies))
    matches = reduce(lambda a, b: a | b, (F.regexp_like("text", F.lit(pattern)) for pattern, _ in KINDS.values()))
    matches = F.coalesce(matches, F.lit(False))  # texts without a match stay where they are
    both = split_join(docs.where(matches).withColumn(row, row_key("text", "source", "doc_id")), judged, row, copies, how="left")
    masked = both.withColumn("text", _masked(F.col("text"), F.col(live))).select(*named(docs.columns))
    return masked.unionByName(docs.where(~matches))


def _masked(text: Column, masks: Column) -> Column:
    """The text with its masks, which are by start and don't overlap: a chunk of masks is cut out of the text once, and the
    pieces between its masks out of that."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(masks, lambda m: m["end"]))
    rows = F.arrays_zip(masks.alias("m"), F.slice(before, 1, F.size(masks)).alias("at"))
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def chunk(c: Column) -> Column:
        part = F.struct(cut(text, c[0]["at"], F.element_at(c, -1)["m"]["end"]).alias("text"), c[0]["at"].alias("at"))
        return let(part, lambda p: F.array_join(F.transform(c, lambda r: F.concat(cut(p["text"], r["at"] - p["at"], r["m"]["start"] - p["at"]), F.when(r["m"]["live"], "<secret>").otherwise("<example-secret>"))), ""))

    rest = F.substring(text, (F.element_at(masks, -1)["end"] + 1).cast("int"), F.lit(2147483647))
    return F.when(masks.isNull(), text).otherwise(F.concat(F.array_join(in_chunks(rows, chunk), ""), rest))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_with_verdicts(documents(spark, sf_dir))
    base = F.filter("secret_spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n_live = F.coalesce(F.size(F.filter("secret_live", lambda s: s["live"])), F.lit(0)).cast("long")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), F.greatest(n_live, F.lit(0).cast("long")).alias("n_live"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are masked."""
    return redact(docs)
