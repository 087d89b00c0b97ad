"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


NO_ID = -(2**63)  # stands for a null doc_id in keys
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
NEVER_HOT = 500  # rows of one key that any task may take


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests); a folder of its own is then made and kept in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.tidemark.local.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python ``BATCH_ROWS`` at a time, unless the session has a size of its own: both sides of the pipe hold whole
    batches, and texts are long."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in fold 0 and so is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def bounded(df: DataFrame, bound: int, key: Column) -> DataFrame:
    """At most about ``bound`` rows of ``df``, chosen by a hash of ``key``; all rows when there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < int(bound / n * (1 << 20)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tag, text): the tag tells rows apart that share an id, or have none, but not their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), tag_of(text).alias("tag"), text.alias("text"))


def tag_of(text: Column) -> Column:
    """64 bits: of a hundred million different texts without an id, two have one tag in a corpus of some thousands."""
    return F.xxhash64(text)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def split_join(rows: DataFrame, ones: DataFrame, on: str, n: str, parts: int = 1024, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``ones``, which has one row for each key and how many of ``rows`` it has (``n``).

    Keys with more than 1 / ``parts`` of all rows are fewer than ``parts``: these go to all tasks, and their rows stay where
    they are, so no task takes a hot key's rows. The others are joined by a shuffle. ``ones`` is stored once. Where no key has
    more than ``NEVER_HOT`` rows, nothing needs to be told apart.
    """
    ones = store(ones, "keys")
    total, most = ones.agg(F.sum(n), F.max(n)).first()
    if (most or 0) <= NEVER_HOT:
        return rows.join(ones, on, how)
    limit = total // parts
    hot, cold = ones.where(F.col(n) > limit), ones.where(F.col(n) <= limit)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))
