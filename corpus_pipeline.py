"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the
shared folder as Parquet and rereads as the next stage's documents; what a stage wrote on its
way goes once its output is there. A null text passes the filters and has no tokens. Rows are
judged one by one, also those whose key repeats or is null; null keys come last. An empty
table goes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import scratch
from recordloom.llm import bpe, common, decontamination, line_dedup, near_dedup, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and blank texts stay."""
    common.ship(spark)
    model = queries.toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    at = common.fresh(docs, "_score")
    scored = toxicity.score(docs, "text", model, into=at)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return scored.filter(blank | (F.col(at) < queries.TOXIC_AT)).select(*_names(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; so do documents of which nothing is left. The
    count of code points follows the text."""
    common.ship(spark)
    at = common.fresh(docs, "removed_lines")
    out = line_dedup.deduplicated(docs, "doc_id", "text", equal_from=1, into=at).filter((F.col(at) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(at) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*_names(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id (then number)."""
    common.ship(spark)
    at = common.fresh(docs, "_row")
    rows = common.cut(docs.withColumn(at, F.monotonically_increasing_id()), "near-rows")
    found = near_dedup.near_duplicates(rows.select(at, "text"), at, "text").select(F.col(at).alias("row"), "component_id")
    placed = found.join(rows.select(F.col(at).alias("row"), "doc_id"), "row")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(at)), at, "left_semi").select(*_names(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.ship(spark)
    return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"), "text", "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and decodes_back (whether the ids give the text's bytes again),
    in place of the text."""
    common.ship(spark)
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    coded = bpe.round_trip(rows, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.col("digest")
    return coded.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("decodes_back"))


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", encode),
]

#: SQL can't express the stages; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = scratch.mark()
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        scratch.release_since(spark, before, docs)
    return docs
