"""Operator 13, product codes of vectors: integer Lloyd rounds with Yinyang bounds.

A vector is cut into ``PARTS`` parts of integers; each part position has a codebook of ``ENTRIES`` entries, taken from
the rows of the smallest ids. The entries of a codebook are clustered into a few groups once. A row carries, for each
part, its entry and for each group a lower bound of the distance to the group's entries but its own. After a round a
bound shrinks by the largest move of its group; only groups whose bound does not exceed the exact distance to the own
entry are scanned. Distances are integers, bounds are kept rounded down, and a bound that is level with the distance fails,
so ties are always settled by integers: the lower index wins.

A round is two passes over stored rows: one assigns, one adds up the parts of each entry, at most PARTS x ENTRIES rows from
a task. Driver and tasks hold codebooks, never rows.

Defined results: rows with a null vector or a null or non-finite component are left out, as are empty vectors, vectors whose
length isn't a multiple of PARTS and vectors not as long as the first codebook row. Components are held to +-``LARGEST``
after the scaling, so that an error fits a long. A null id starts no codebook; of rows with one id the one with the smallest
vector comes first; fewer rows than entries give smaller codebooks. Without any row with an id nothing is kept. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_join, store, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUP_ENTRIES = 10  # about so many entries to a group
LARGEST = 2**27
BATCH = 4096  # rows whose distances are taken together
STATE = "vec_id long, label string, v binary, code binary, bound binary"


def integers(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that count: the label as text, the components as an array of scaled integers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c)) * SCALE))).cast("int"))
    size = F.size("embedding")
    counts = F.coalesce(finite & (size > 0) & (size % PARTS == 0), F.lit(False))
    return vectors.where(counts).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))


def first_books(rows: DataFrame) -> np.ndarray | None:
    """PARTS x entries x width, from the rows of the smallest ids; None without any."""
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(ENTRIES).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    v = np.array([r["v"] for r in first if len(r["v"]) == width], np.int64)
    return v.reshape(len(v), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry of a codebook, by a few rounds of k-means; which entries are together has no say in results."""
    k = max(1, -(-len(book) // GROUP_ENTRIES))
    centre, of = book[:: max(1, len(book) // k)][:k].astype(float), np.zeros(len(book), np.int64)
    for _ in range(8):
        of = ((book[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(k):
            if (of == g).any():
                centre[g] = book[of == g].mean(0)
    return of


def down(x: np.ndarray) -> np.ndarray:
    """Single floats that are not above ``x``."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(0)), y)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    d = x[:, None, :] - entries[None]
    return np.einsum("ijk,ijk->ij", d, d)


class Assign:
    """Assigns rows to the entries of one codebook, for a batch of rows of one part."""

    def __init__(self, book: np.ndarray, of: np.ndarray, was: np.ndarray | None) -> None:
        self.book, self.groups = book, [np.flatnonzero(of == g) for g in range(of.max() + 1)]
        self.of = of
        moved = np.zeros(len(book)) if was is None else np.sqrt(((book - was) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        self.drift = np.array([moved[g].max() if len(g) else 0.0 for g in self.groups])
        self.scanned = 0

    def __call__(self, x: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, squared distances, bounds); without earlier ones every group is scanned."""
        n = len(x)
        if code is None:
            best, error, bound = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), np.zeros((n, len(self.groups)))
            todo = np.ones((n, len(self.groups)), bool)
        else:
            best, d = code.astype(np.int64), x - self.book[code]
            error = np.einsum("ij,ij->i", d, d)
            bound = np.maximum(bound.astype(float) - self.drift[None], 0) * (1 - 1e-12)
            todo = bound <= (np.sqrt(error.astype(float)) * (1 + 1e-12))[:, None]
        first, first_error, found = best.copy(), error.copy(), {}
        for g, members in enumerate(self.groups):
            at = np.flatnonzero(todo[:, g])
            if not len(members) or not len(at):
                continue
            self.scanned += len(at) * len(members)
            d = squares(x[at], self.book[members])
            k = d.argmin(1)  # members ascend, so the first is the lowest index
            near, entry = d[np.arange(len(at)), k], members[k]
            better = (near < error[at]) | ((near == error[at]) & (entry < best[at]))
            best[at[better]], error[at[better]] = entry[better], near[better]
            found[g] = (at, d, members)
        for g, (at, d, members) in found.items():  # the bound leaves out the row's own entry
            others = np.where(members[None] == best[at][:, None], np.iinfo(np.int64).max, d)
            bound[at, g] = np.sqrt(others.min(1).astype(float)) * (1 - 1e-12)
        left = np.flatnonzero((first >= 0) & (first != best))  # an entry that was left is one of the others of its group
        if len(left):
            g = self.of[first[left]]
            bound[left, g] = np.minimum(bound[left, g], np.sqrt(first_error[left].astype(float)) * (1 - 1e-12))
        return best, error, bound


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width of a column of binaries of 32-bit integers."""
    column = column.cast(pa.large_binary())
    n, (_, _, data) = len(column), column.buffers()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(np.int32).reshape(n, width).astype(np.int64)


def plain(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def assigned(rows: DataFrame, books: np.ndarray, of: np.ndarray, was: np.ndarray | None, last: bool = False) -> DataFrame:
    """The rows of STATE with new codes and bounds, or at ``last`` (vec_id, label, code, error)."""
    parts, _, width = books.shape
    groups = int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Assign(books[p], of[p], None if was is None else was[p]) for p in range(parts)]
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            n = batch.num_rows
            x = matrix(batch.column("v"), parts * width).reshape(n, parts, width)
            code = None if was is None else plain(batch.column("code"), np.uint8, parts)
            bound = None if was is None else plain(batch.column("bound"), np.float32, parts * groups).reshape(n, parts, groups)
            new, total, kept = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.zeros((n, parts, groups), np.float32)
            for p in range(parts):
                best, error, lower = each[p](x[:, p], None if code is None else code[:, p], None if bound is None else bound[:, p, : len(each[p].groups)])
                new[:, p] = best
                total += error
                kept[:, p, : lower.shape[1]] = down(lower)
            codes = pa.array([c.tobytes() for c in new], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(total)], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), codes, pa.array([b.tobytes() for b in kept.reshape(n, -1)], pa.binary())], names=["vec_id", "label", "v", "code", "bound"])

    return rows.mapInArrow(run, "vec_id long, label string, code binary, error long" if last else STATE)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of the mean of its parts: sums are made in tasks, then across them."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("v"), parts * width).reshape(n * parts, width)
            at = (plain(batch.column("code"), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, at, x)
            held += np.bincount(at, minlength=parts * entries)
        some = np.flatnonzero(held)
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * width).astype(np.int32)), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some), lists, pa.array(held[some])], names=["entry", "total", "n"])

    each = state.select("v", "code").mapInArrow(run, "entry long, total array<long>, n long")
    sums = each.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)))
    new = books.reshape(-1, width).copy()
    for r in sums.collect():
        new[r["entry"]] = np.array([r[f"t{k}"] for k in range(width)], np.int64) // r["n"]
    return new.reshape(books.shape)


def vector_codes(vectors: DataFrame, label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of each row that counts, and the final codebooks (PARTS x entries x width)."""
    rows = integers(vectors, label)
    books = first_books(rows)
    if books is None:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = books.shape[0] * books.shape[2]
    of = np.stack([grouped(b) for b in books])
    state, was = rows.where(F.size("v") == width).select("vec_id", "label", _packed(F.col("v")).alias("v"), F.lit(b"").alias("code"), F.lit(b"").alias("bound")), None
    for _ in range(ROUNDS):
        state = store(assigned(state, books, of, was), "vector-state")
        books, was = moved(state, books), books
    done = assigned(state, books, of, was, last=True)
    return done.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), books


def _packed(v: Column) -> Column:
    """32-bit integers, little-endian."""
    digits = F.transform(v, lambda c: F.lpad(F.hex(c), 16, "0"))
    return F.unhex(F.array_join(F.transform(digits, lambda d: F.concat(*(d.substr(p, 2) for p in (15, 13, 11, 9)))), ""))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors, the error of all rows of a label, and a digest of the codebooks."""
    done, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = "" if books is None else hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = store(done.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))), "vector-codes")
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return split_join(rows, labels, "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    book = lambda k: f"""
near{k} AS MATERIALIZED (SELECT r, p.part, arg_min(e, (dist, e)) AS e, min(dist) AS dist, any_value(q) AS q
  FROM (SELECT r, p.part, e, q, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q, c)])::BIGINT AS dist FROM parts p JOIN book{k} b ON p.part = b.part) p GROUP BY r, p.part)"""  # noqa: E731
    move = lambda k: f"""
mean{k} AS (SELECT part, e, pos, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM (SELECT part, e, unnest(q) AS x, unnest(range(len(q))) AS pos FROM near{k}) GROUP BY part, e, pos),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT part, e, list(m ORDER BY pos) AS c FROM mean{k} GROUP BY part, e) n ON n.part = b.part AND n.e = b.e)"""  # noqa: E731
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) t(part)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS e, q AS c FROM parts WHERE r <= {ENTRIES}),{book(0)},{move(0)},{book(1)},{move(1)},{book(2)},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book2),
code AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (r), digest"""


OP13_SQL = _sql()
