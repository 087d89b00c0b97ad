"""Trend curves, exceedance and the projection cube over the driver's tables (section G), with their DuckDB SQL.

Stand-ins: a part is a projection point (brand, size as year, price); an order is a peak of its year (price / 100000).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projection as P
from ..sources.tables import table

GRID = [float(i) for i in range(0, 25, 3)]


def peaks(spark, sf):
    return table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 100000).alias("peak"))


def deltas(spark, sf):
    return P.quadratic_deltas(table(spark, sf, "part"), "p_brand", F.col("p_size"), F.col("p_retailprice"), F.sequence(F.lit(25), F.lit(60)), 25)


def g4(spark, sf):
    asked = table(spark, sf, "part").select((F.col("p_size") / 10).alias("threshold"))
    return P.exceedance(peaks(spark, sf), asked).select("threshold", *(F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")))


def g6(spark, sf):
    some = [r.e for r in table(spark, sf, "part").select((F.col("p_size") / 10).alias("e")).distinct().collect()]  # sizes are few, as a cube's grid is
    rise = deltas(spark, sf).select("p_brand", "year", F.round(F.col("delta") / 1000, 2).alias("delta"))
    return P.cube(peaks(spark, sf), some, rise, "p_brand")


def g3(spark, sf):
    """The smoothed cumulative share at each occupied bin of the grid."""
    own = peaks(spark, sf)
    bins = own.select((F.floor(F.col("peak") / P.STEP + 0.5)).alias("bin")).distinct()
    found = P.exceedance(own, bins.select((F.col("bin") * P.STEP).alias("threshold")), draws=1, chunks=1)
    return bins.withColumn("threshold", F.col("bin") * P.STEP).join(found, "threshold").select("bin", F.round(1 - F.col("estimate"), 6).alias("share"))


def g5(spark, sf):
    """The share above thresholds between the points of the grid."""
    asked = table(spark, sf, "part").select(((F.col("p_partkey") % 600) / 100 - 0.3 + 0.0007).alias("threshold")).distinct()
    return P.exceedance(peaks(spark, sf), asked, draws=1, chunks=1).select(F.round("threshold", 4).alias("threshold"), F.round("estimate", 6).alias("survival"))


_SMOOTH = f"""p AS (SELECT o_totalprice / 100000 AS peak FROM orders), w AS (SELECT count(*) AS n, greatest(0.02::DOUBLE, 1.06::DOUBLE * stddev_samp(peak) * count(*) ** -0.2::DOUBLE) AS bw FROM p),
h AS (SELECT floor(peak / {P.STEP}::DOUBLE + 0.5::DOUBLE)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1), r AS (SELECT ceil(6 * bw / {P.STEP}::DOUBLE)::BIGINT AS reach, bw FROM w),
k AS (SELECT o, exp(-0.5::DOUBLE * (o * {P.STEP}::DOUBLE / bw) ** 2) AS e FROM r, range(-100000, 100001) t(o) WHERE o BETWEEN -reach AND reach), c AS (SELECT o, sum(e) OVER (ORDER BY o) / sum(e) OVER () AS c FROM k)"""
_G3 = f"WITH {_SMOOTH} SELECT a.bin, round(sum(b.n * CASE WHEN a.bin - b.bin > reach THEN 1.0::DOUBLE WHEN a.bin - b.bin < -reach THEN 0.0::DOUBLE ELSE c.c END) / any_value(w.n), 6) AS share FROM h a CROSS JOIN h b CROSS JOIN w CROSS JOIN r LEFT JOIN c ON c.o = a.bin - b.bin GROUP BY a.bin"
_G5 = f"""WITH {_SMOOTH}, t AS (SELECT DISTINCT (p_partkey % 600) / 100.0::DOUBLE - 0.3::DOUBLE + 0.0007::DOUBLE AS threshold FROM part), g AS (SELECT threshold, floor(threshold / {P.STEP}::DOUBLE)::BIGINT + d AS bin, d, threshold / {P.STEP}::DOUBLE - floor(threshold / {P.STEP}::DOUBLE) AS part FROM t, range(2) u(d)),
s AS (SELECT threshold, d, any_value(part) AS part, sum(b.n * CASE WHEN g.bin - b.bin > reach THEN 1.0::DOUBLE WHEN g.bin - b.bin < -reach THEN 0.0::DOUBLE ELSE c.c END) / any_value(w.n) AS share FROM g CROSS JOIN h b CROSS JOIN w CROSS JOIN r LEFT JOIN c ON c.o = g.bin - b.bin GROUP BY threshold, d)
SELECT round(threshold, 4) AS threshold, round(1 - sum(CASE WHEN d = 0 THEN (1 - part) * share ELSE part * share END), 6) AS survival FROM s GROUP BY threshold"""


def g9(spark, sf):
    return g6(spark, sf).where("elevation = 1.5 AND year = 40")


def g8(spark, sf):
    stages = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 61) / 10).alias("stage"))
    grid = spark.range(51).select((F.col("id") / 10).alias("elevation"), F.col("id").alias("index"))
    return P.share_rows(stages, grid)


_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_SUMS = ", ".join([f"sum(CAST(p_size - 25 AS DOUBLE) ** {i}) AS s{i}" for i in range(5)] + [f"sum(p_retailprice * CAST(p_size - 25 AS DOUBLE) ** {i}) AS t{i}" for i in range(3)])
_WHOLE = _DET.format(*"s4 s3 s2 s3 s2 s1 s2 s1 s0".split())
_ENTRIES = {
    "G1_quadratic_deltas": (
        deltas,
        f"WITH s AS (SELECT p_brand, {_SUMS} FROM part GROUP BY 1), f AS (SELECT p_brand, {_DET.format(*'t2 s3 s2 t1 s2 s1 t0 s1 s0'.split())} / {_WHOLE} AS a, {_DET.format(*'s4 t2 s2 s3 t1 s1 s2 t0 s0'.split())} / {_WHOLE} AS b FROM s WHERE abs({_WHOLE}) > 0), y AS (SELECT *, CAST(unnest(generate_series(25, 60)) AS INT) AS year FROM f) SELECT p_brand, year, round(greatest(0.0::DOUBLE, a * (year - 25) * (year - 25) + b * (year - 25)), 4) AS delta FROM y",
    ),
    "G3_smoothed_share": (g3, _G3),
    "G5_survival": (g5, _G5),
    "G4_exceedance": (g4, None),
    "G6_projection_cube": (g6, None),
    "G9_cube_lookup": (g9, None),
    "G7_nearest_elevation": (
        lambda spark, sf: table(spark, sf, "customer").select("c_custkey", P.nearest_index(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 300), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 13 - 2), GRID).alias("index")),
        "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 300 END AS e, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 13 - 2 END AS p FROM customer) SELECT c_custkey, CAST(CASE WHEN p BETWEEN 0 AND 8 THEN p WHEN e IS NULL THEN 0 ELSE (SELECT arg_min(i, abs(i * 3 - e) * 1000 + i * 1e-9) FROM range(9) g(i)) END AS INT) AS index FROM c",
    ),
    "G8_share_rows": (g8, "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 61) / 10.0::DOUBLE END AS stage, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 61 BETWEEN 1 AND 51 THEN c_custkey % 61 - 1 END AS index FROM customer"),
}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLES = {k: v[1] for k, v in _ENTRIES.items() if v[1]}
