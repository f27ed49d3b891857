"""Rank tables from the three CSV dialects, with tolerant header resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import normalize as N


def find_column(columns: list[str], *wanted: str) -> str | None:
    """Exact match first, then containment, in the order of the candidates."""
    clean = {c.replace("﻿", "").strip().lower(): c for c in columns}
    for w in wanted:
        if w.lower() in clean:
            return clean[w.lower()]
    for w in wanted:
        for name, c in clean.items():
            if w.lower() in name:
                return c
    return None


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def _cell(df: DataFrame, *wanted: str) -> Column:
    found = find_column(df.columns, *wanted)
    return F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")


def partition(c: Column) -> Column:
    """The tier of a cell like ``3 [168/495]``."""
    return F.regexp_extract(c, r"^\s*([1-4])", 1).try_cast("int")


def read_cas(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, ",")
    minors = [F.struct(_cell(df, f"小类{i}").alias("category"), partition(_cell(df, f"小类{i}分区")).alias("tier")) for i in range(1, 7) if find_column(df.columns, f"小类{i}")]
    minor = F.filter(F.array(*minors), lambda m: F.coalesce(m["category"] != "", F.lit(False))) if minors else F.array().cast("array<struct<category:string,tier:int>>")
    return df.select(F.explode(N.issns(_cell(df, "ISSN/EISSN", "ISSN"))).alias("issn"), _cell(df, "Journal").alias("title"), partition(_cell(df, "大类分区")).alias("tier"), (_cell(df, "Top") == "是").alias("top"), minor.alias("minor"))


def read_jcr(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, ",")
    both = F.array_distinct(F.array_compact(F.array(N.issn(_cell(df, "ISSN")), N.issn(_cell(df, "eISSN")))))
    return df.select(F.explode(both).alias("issn"), _cell(df, "Journal").alias("title"), quartile(_cell(df, "IF Quartile")).alias("quartile"), F.replace(_cell(df, "IF("), F.lit(","), F.lit("")).try_cast("double").alias("impact_factor"), _cell(df, "Category").alias("category"))


def quartile(c: Column) -> Column:
    return N.blank_to_null(F.regexp_extract(F.upper(c), r"^\s*(Q[1-4])\s*$", 1))


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def read_sjr(spark: SparkSession, path: str) -> DataFrame:
    """Categories like ``Education (Q2); Linguistics (Q4)``; the best quartile falls back to theirs."""
    df = _read(spark, path, ";")
    cats = F.filter(F.transform(F.split(_cell(df, "Categories"), ";"), lambda c: F.struct(F.trim(F.regexp_extract(c, r"^(.*?)\s*(?:\((Q[1-4])\))?\s*$", 1)).alias("category"), N.blank_to_null(F.regexp_extract(c, r"\((Q[1-4])\)", 1)).alias("quartile"))), lambda x: x["category"] != "")
    best = F.coalesce(quartile(_cell(df, "SJR Best Quartile")), F.array_min(F.filter(F.transform(cats, lambda x: x["quartile"]), lambda q: q.isNotNull())))
    return df.select(F.explode(N.issns(_cell(df, "Issn"))).alias("issn"), _cell(df, "Title").alias("title"), best.alias("best_quartile"), decimal_comma(_cell(df, "SJR")).alias("sjr"), cats.alias("categories"))
