"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random draw u in (0, 1); the record goes to the
shard with the smallest -ln(u) / weight. A shard's draw doesn't depend on the other
shards, so one more shard takes rows into itself and moves none between the others.
Native: DataFrame functions alone.

Cases: a null key is the key ''; equal keys share a shard; fully equal rows are
collapsed to a count before the shuffle and get different slots; a null text counts
no bytes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task gets on average. The number of tasks grows with the table.
ROWS_PER_BUCKET = 20_000
#: Copies of one row that one array holds while they are unfolded.
FAN = 4096
_HEX = 13  # 52 bits, exact in a double


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _draw(key: Column, shard: int) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_HEX))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key. Weights must be positive; ties go to
    the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = [F.struct((-F.log(_draw(_key(key), i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*costs)).getField("shard")


def shard_records(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and slot of each row.

    slot numbers the rows of a shard from 0 without gaps in the order of md5(key), key,
    crc, size. Tasks number ranges of that order; a small table of range counts gives
    their offsets, so no task sees a whole shard."""
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    n_buckets = max(1, -(-source.count() // (rows_per_bucket * len(weights))))
    digest = F.md5(_key(F.col("_key")))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(16**8)) * F.lit(n_buckets)).cast("int")

    offsets = (
        source.groupBy("_key").count()
        .select(shard_of(F.col("_key"), weights).alias("shard"), bucket.alias("bucket"), "count")
        .groupBy("shard", "bucket").agg(F.sum("count").alias("n"))
        .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    filled = F.coalesce(F.col("_text"), F.lit(""))
    rows = (
        source.select("_key", (F.octet_length(filled) + F.lit(1)).cast("long").alias("size"), F.crc32(filled.cast("binary")).alias("text_crc32"))
        .groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumns({"shard": shard_of(F.col("_key"), weights), "grown_shard": shard_of(F.col("_key"), grown), "bucket": bucket, "digest": digest})
    )
    order = Window.partitionBy("shard", "bucket").orderBy("digest", "_key", "text_crc32", "size")
    return (
        rows.withColumn("before", F.sum("n").over(order) - F.col("n"))
        .join(offsets, ["shard", "bucket"])
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {FAN})")))
        .withColumn("copy", F.explode(F.expr(f"sequence(block * {FAN}, least(n - 1, block * {FAN} + {FAN - 1}))")))
        .select(F.col("_key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
    )
