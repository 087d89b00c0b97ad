"""Readers of the driver's tables in the shapes that the operators take.

Stand-ins: a gauge is an ``event_type`` of ``events``, its instant ``ts`` (UTC) and its stage ``value``; a forecast is the
same series two hours later at nine tenths; daily archives come from ``orders``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """As many tasks as a shuffle of the session has, and no fewer than it runs at once, for rows whose bytes say little about the
    work; a number that is told isn't brought down by Spark."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, dealt over the session's tasks: a small file is one split, however much is made of each of its rows."""
    return rows.repartition(tasks(rows.sparkSession), key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local session, where both are one
    machine, may leave it unset; a folder below its warehouse stands in then."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once in a new shared folder and read again: cuts the lineage, as a checkpoint does."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, station_id, t, stage, user_id): t in microseconds UTC."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("station_id"), micros.alias("t"), F.col("value").alias("stage"), "user_id")


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("seq", "station_id", (F.col("t") + 2 * HOUR).alias("t"), (F.col("stage") * 0.9).alias("stage"), "user_id")


def daily_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, day, peak, source) of the order archive: one row an order; source 0, 1 or 2 by customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("peak"), (F.col("o_custkey") % 3).alias("source"))


def gauge_files(spark: SparkSession, path: str) -> DataFrame:
    """Nested instantaneous-value payloads (JSON): one row for each finite value that isn't the series' no-data value."""
    schema = "value struct<timeSeries:array<struct<name:string,variable:struct<noDataValue:double>,values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"
    series = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("value.timeSeries").alias("s"))
    each = series.select(F.col("s.name").alias("station_id"), F.col("s.variable.noDataValue").alias("none"), F.explode("s.values").alias("v")).select("station_id", "none", F.explode("v.value").alias("x"))
    stage = F.expr("try_cast(trim(x.value) AS double)")
    out = each.select("station_id", F.expr("try_cast(x.dateTime AS timestamp)").alias("ts"), stage.alias("stage"), "none")
    return out.where(F.col("ts").isNotNull() & F.col("stage").between(-1e300, 1e300) & ~F.col("stage").eqNullSafe(F.col("none"))).drop("none")


def compact_days(days: DataFrame, step_s: int = 900) -> DataFrame:
    """Readings of compact days (d, u start second, v hundredths, q quality letters, p peak): one row a slot."""
    slot = days.select("d", "u", "q", F.posexplode("v").alias("i", "code"))
    return slot.select("d", (F.col("u") + F.col("i") * step_s).alias("t_s"), (F.col("code") / 100).alias("stage"), F.expr("substring(q, i + 1, 1)").alias("quality"), F.col("code").isNull().alias("is_missing"))
