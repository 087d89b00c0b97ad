"""Streams whose later rows replace earlier ones: the last row of a key wins, whenever it arrives.

State is a Parquet dataset in folders by part (for readings, a gauge's days): a micro-batch rewrites the parts that it touches,
each as a new version, and leaves the others. A part's last version is the one that counts. Versions are named by batch, and a
batch starts from the last version below its own number, so one that is run again after a failure writes the same rows again.
``expire`` removes what no batch can start from any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import precedence


@dataclass
class LastReadings:
    """``key`` names a row, the greatest ``order`` of a key wins, ``part`` deals keys over folders."""

    spark: SparkSession
    path: str
    key: list[str]
    order: list[str]
    part: Column

    def state(self, schema, below: int | None = None) -> DataFrame | None:
        """The rows that count so far, with part_, or those that did before batch ``below``; None before the first batch."""
        try:
            held = self.spark.read.schema(schema).parquet(f"{self.path}/state")
        except Exception as e:  # noqa: BLE001  nothing has been written yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        held = held if below is None else held.where(F.col("version_") < below)
        newest = F.max("version_").over(Window.partitionBy("part_"))
        return held.withColumn("newest_", newest).where("version_ = newest_").drop("newest_")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("part_", self.part.cast("long"))
        order = [F.desc(c) for c in self.order]
        old = self.state(self._schema(batch), batch_id)
        if old is not None:
            touched = kept.select("part_").distinct()
            kept = kept.unionByName(old.drop("version_").join(touched, "part_", "left_semi"))
        out = precedence(kept, self.key, order).withColumn("version_", F.lit(batch_id).cast("long"))
        out.write.partitionBy("part_", "version_").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/state")

    def expire(self, done: int) -> int:
        """Removes the versions that were replaced before batch ``done``, the last one known to be complete; returns how many."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held: dict[str, list[tuple[int, object]]] = {}
        for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "part_=*/version_=*")) or []:
            held.setdefault(x.getPath().getParent().getName(), []).append((int(x.getPath().getName().split("=")[1]), x.getPath()))
        old = [p for versions in held.values() for v, p in versions if v < max((w for w, _ in versions if w <= done), default=-1)]
        return sum(bool(fs.delete(p, True)) for p in old)

    @staticmethod
    def _schema(rows: DataFrame) -> str:
        return f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, part_ long, version_ long"

    def take(self, stream: DataFrame) -> DataFrame:
        """Run through all that has arrived; returns the rows that count."""
        stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.state(self._schema(stream)).drop("part_", "version_")
