"""Incremental ingestion: a file stream of records, deduplicated by key within a watermark, or merged
into a table of records that grows with each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators import resolve


def new_records(spark: SparkSession, path: str, schema: str, key: str, at: str, late: str = "1 day") -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def start(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``apply`` on each batch of what there is now; the checkpoint makes batches repeatable."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Merged:
    """The merged records of all batches so far and the list that first brought each key, as tables in
    ``path``, a folder that driver and executors share. A batch goes into the version after its number,
    written over if the batch is repeated, so a batch that fails halfway counts once.

    Records merge one after the other, and merging into a merged record is the same as merging all at
    once (see ``resolve.merge_records``): any split of the input gives what one batch would."""

    def __init__(self, path: str, key: str, order: list[str], listed: str = "list_idx", now: int = 2026) -> None:
        self.path, self.key, self.order, self.listed, self.now = path, key, order, listed, now

    def _version(self, batch: int) -> str:
        return f"{self.path}/{batch:012d}"

    def add(self, records: DataFrame, batch: int) -> None:
        """Merges a batch of records, which have the key, the order and any canonical fields."""
        late = F.struct(F.lit(1).alias("new"), *self.order)
        rows = records.withColumn("_turn", late).drop(*[c for c in self.order if c != self.listed])
        first = records.groupBy(self.key).agg(F.min(self.listed).alias("first_list"))
        if batch > 0:
            before = records.sparkSession.read.parquet(self._version(batch - 1))
            nothing = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(records.schema[c].dataType).alias(c) for c in self.order])
            rows = before.drop("first_list").withColumn("_turn", nothing).unionByName(rows.drop(self.listed))
            first = before.select(self.key, "first_list").unionByName(first).groupBy(self.key).agg(F.min("first_list").alias("first_list"))
        else:
            rows = rows.drop(self.listed)
        merged = resolve.merge_records(rows, self.key, ["_turn"], self.now)
        merged.join(first, self.key).write.mode("overwrite").parquet(self._version(batch))

    def records(self, spark: SparkSession, batch: int) -> DataFrame:
        """key, the merged fields and first_list after a batch."""
        return spark.read.parquet(self._version(batch))

    def marginal_yield(self, spark: SparkSession, batch: int) -> DataFrame:
        """list and new_keys: how many keys each list was the first to bring."""
        return self.records(spark, batch).groupBy(F.col("first_list").alias("list")).agg(F.count("*").alias("new_keys"))
