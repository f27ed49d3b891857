"""Report artefacts: method log, Markdown summary, stop decision, cached results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sources that come first in a method log.
FIRST_SOURCES = ("openalex", "semantic_scholar")


def databases_used(records: DataFrame) -> list[str]:
    """Distinct sources: the two general ones first, the others by name."""
    names = {r["s"] for r in records.select(F.explode("sources").alias("s")).distinct().collect()}  # a dozen at most
    return [s for s in FIRST_SOURCES if s in names] + sorted(names - set(FIRST_SOURCES))


def method_log(records: DataFrame) -> DataFrame:
    """One row: records, citation expansion used, distinct seeds ("ref of X" and the like; a
    two-word path is no seed), classified and relevant counts."""
    words = F.split("discovery_path", " ")
    chased = F.col("discovery_path").rlike("^(ref of|cited by|cites) ")
    return records.agg(
        F.count("*").alias("records"), F.coalesce(F.bool_or(chased), F.lit(False)).alias("citation_expansion"), F.countDistinct(F.when(chased & (F.size(words) >= 3), F.element_at(words, -1))).alias("seeds"),
        F.count("rcs").alias("classified"), F.count_if(F.col("rcs") >= 7).alias("highly_relevant"),
    )


def stop_decision(coverage: Column, spent: Column) -> Column:
    """Coverage against the share of the budget that is spent."""
    return F.when(coverage > 0.85, "stop").when(spent >= 0.8, "stop_on_budget").when(coverage >= 0.6, "one_more_round").otherwise("expand")


def saturation(yields: DataFrame, list_col: str = "list", new: str = "new_keys") -> DataFrame:
    """One row: whether the last list brought at most 15 % of ten or more keys, over two lists."""
    out = yields.agg(F.max_by(new, list_col).alias("last_new"), F.sum(new).alias("total"), F.count("*").alias("lists"))
    return out.withColumn("saturated", (F.col("total") >= 10) & (F.col("lists") >= 2) & (F.col("last_new") <= 0.15 * F.col("total")))


def score_bands(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("score") >= 0.6).alias("high"), F.count_if((F.col("score") >= 0.35) & (F.col("score") < 0.6)).alias("medium"), F.count_if(F.col("score") < 0.35).alias("low"))


def saturation_curve(total: float, tau: float, last: int, points: int = 101) -> list[tuple[float, float]]:
    """Points of total (1 - exp(-n / tau))."""
    import math

    return [(n, total * (1 - math.exp(-n / tau))) for n in (last * i / (points - 1) for i in range(points))]


def markdown(title: str, counters: dict, rows: list[dict]) -> str:
    """A short report of counters and the first records, rendered on the driver."""
    head = [f"# {title}", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in counters.items()), "", "| Year | Title | Score |", "|---|---|---|"]
    return "\n".join(head + [f"| {r.get('year') or ''} | {str(r.get('title') or '').replace('|', ' ')} | {r.get('score') if r.get('score') is not None else ''} |" for r in rows]) + "\n"


def script_json(data: object) -> str:
    """JSON that is safe within a script element."""
    return json.dumps(data, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def hydrate(page: str, name: str, data: object) -> str:
    """The page with the data assigned to a global before its first script."""
    element = f"<script>window.{name}={script_json(data)}</script>"
    at = page.find("<script")
    return page + element if at < 0 else page[:at] + element + page[at:]


def cached(spark: SparkSession, root: str, request: dict, make, refresh: bool = False) -> DataFrame:
    """The result of ``make()``, kept as Parquet under the hash of the canonical request."""
    path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if refresh or not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
