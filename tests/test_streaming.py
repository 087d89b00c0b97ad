from pyspark.sql import functions as F

from tidemark.streaming.upserts import LastReadings


def rows_of(held, like):
    return sorted((r.key, r.seq, r.stage) for r in held.state(held._schema(like)).collect())


def test_a_batch_that_runs_again_leaves_the_same_state(spark, tmp_path):
    schema = "key long, seq long, stage double"
    held = LastReadings(spark, str(tmp_path), ["key"], ["seq"], F.col("key") % 2)
    first = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)], schema)
    second = spark.createDataFrame([(1, 4, 9.0), (3, 0, 8.0)], schema)
    held.upsert(first, 0)
    held.upsert(second, 1)
    want = rows_of(held, first)
    assert want == [(1, 4, 9.0), (2, 2, 2.0), (3, 3, 3.0)]
    for _ in range(2):
        held.upsert(second, 1)
        assert rows_of(held, first) == want
    held.upsert(spark.createDataFrame([(2, 9, 5.0)], schema), 2)
    held.upsert(spark.createDataFrame([(2, 9, 5.0)], schema), 2)
    assert rows_of(held, first) == [(1, 4, 9.0), (2, 9, 5.0), (3, 3, 3.0)]


def test_old_versions_expire_and_a_replay_still_works(spark, tmp_path):
    schema = "key long, seq long, stage double"
    held = LastReadings(spark, str(tmp_path), ["key"], ["seq"], F.col("key") % 2)
    for n in range(4):
        held.upsert(spark.createDataFrame([(k, 10 * n + k, float(n)) for k in range(4) if k % 2 == n % 2 or n == 0], schema), n)
    like = spark.createDataFrame([], schema)
    want = rows_of(held, like)
    assert held.expire(2) == 2 and held.expire(2) == 0  # batch 3 may still run again
    assert rows_of(held, like) == want
    held.upsert(spark.createDataFrame([(k, 30 + k, 3.0) for k in (1, 3)], schema), 3)
    assert rows_of(held, like) == want
