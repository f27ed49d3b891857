"""Completeness of a collection by capture-recapture over retrieval occasions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import scoring as S


def informative_occasions(incidence: DataFrame, occasion: str, key: str) -> DataFrame:
    """The incidence rows of occasions that bring at least one key first. Occasions all of whose
    keys came before are derived ones; dropping them can't change what is first."""
    first = incidence.groupBy(key).agg(F.min(occasion).alias(occasion))
    return incidence.join(first.select(occasion).distinct(), occasion, "left_semi")


def frequency_counts(incidence: DataFrame, occasion: str, key: str) -> DataFrame:
    """One row: m occasions, u incidences, q1 and q2 keys seen once and twice, found keys."""
    each = incidence.select(occasion, key).distinct()
    freq = each.groupBy(key).agg(F.count("*").alias("f"))
    m = each.agg(F.countDistinct(occasion).alias("m"))
    counts = freq.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("u"), F.count_if(F.col("f") == 1).alias("q1"), F.count_if(F.col("f") == 2).alias("q2"), F.count("*").alias("found"))
    return counts.crossJoin(m)  # one row each


def estimate(counts: DataFrame) -> DataFrame:
    c = S.sample_coverage(F.col("m"), F.col("u"), F.col("q1"), F.col("q2"))
    return counts.withColumns({"coverage": c, "informative": S.informative(F.col("q1"), F.col("q2"))})


def snapshot(evaluated: Column, found: Column, coverage: Column) -> dict[str, Column]:
    """Capped coverage, estimated total and decay of one snapshot row."""
    capped = F.least(coverage, F.lit(0.99))
    return {"coverage_estimate": F.round(capped, 5), "estimated_total": F.round(F.try_divide(found, capped), 1), "lambda": F.round(F.try_divide(-F.log(1 - capped), evaluated), 5)}


def bootstrap_interval(incidence: DataFrame, occasion: str, key: str, reps: int = 200, seed: int = 0) -> DataFrame:
    """coverage, lower and upper: 1.96 standard deviations of bootstrap coverages. Works on the
    histogram of key frequencies, which has at most one row per occasion: the keys of one frequency
    are drawn together, as one multinomial over the times they are seen again."""
    each = incidence.select(occasion, key).distinct()
    m = each.select(occasion).distinct().count()
    hist = each.groupBy(key).agg(F.count("*").alias("f")).groupBy("f").agg(F.count("*").alias("n"))

    def cover(u: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
        a = (m - 1) * q1
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(q2 > 0, a / (a + 2 * q2), np.where(q1 > 1, (a - (m - 1)) / (a - (m - 1) + 2), 0.0))
            return np.where((u > 0) & (m >= 2), np.clip(1 - q1 / u * share, 0, 1), 0.0)

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, n = pdf["f"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
        u, q1, q2 = (f * n).sum(), n[f == 1].sum(), n[f == 2].sum()
        point = float(cover(np.array([u]), np.array([q1]), np.array([q2]))[0])
        unseen = math.ceil((m - 1) / m * (q1 * q1 / (2 * q2) if q2 else q1 * (q1 - 1) / 2)) if m else 0
        classes = [(x / m * point, int(k)) for x, k in sorted(zip(f, n, strict=True))]
        if unseen:
            classes.append((min(1.0, u / max(1, m) * (1 - point) / unseen), unseen))
        rng = np.random.default_rng(seed)
        total, ones, twos = np.zeros(reps), np.zeros(reps), np.zeros(reps)
        for p, k in classes:
            times = np.arange(m + 1)
            # the chance of each number of times, by logarithms: m may be large
            logs = np.array([math.lgamma(m + 1) - math.lgamma(t + 1) - math.lgamma(m - t + 1) for t in times])
            mass = np.where(times == (m if p >= 1 else 0), 1.0, 0.0) if p <= 0 or p >= 1 else np.exp(logs + times * math.log(p) + (m - times) * math.log1p(-p))
            drawn = rng.multinomial(k, mass / mass.sum(), size=reps)
            total += drawn @ times
            ones += drawn[:, 1] if m >= 1 else 0
            twos += drawn[:, 2] if m >= 2 else 0
        half = 1.96 * float(np.std(cover(total, ones, twos)))
        return pd.DataFrame({"coverage": [point], "lower": [max(0.0, point - half)], "upper": [min(1.0, point + half)]})

    return hist.groupBy().applyInPandas(run, "coverage double, lower double, upper double")


def banded_snapshot(incidence: DataFrame, occasion: str, key: str, scores: DataFrame, evaluated: int, bands: tuple[int, ...] = (7, 6), ceiling: float = 0.99, tau: float = 80.0) -> DataFrame:
    """One row: the coverage over the records of the first of ``bands`` that is informative, else the
    prior (method, relevance_band), found of the highest band, estimated total and decay. ``scores``
    has key and rcs."""
    found = scores.agg(F.count_if(F.col("rcs") >= bands[0]).alias("found"))
    tried = None
    for i, floor in enumerate(bands):
        inside = incidence.join(scores.filter(F.col("rcs") >= floor).select(key), key, "left_semi")
        counts = frequency_counts(inside, occasion, key).drop("m").crossJoin(incidence.agg(F.countDistinct(occasion).alias("m")))  # one row each
        one = estimate(counts).select(F.lit(i).alias("turn"), F.lit(floor).alias("relevance_band"), "coverage", (F.col("informative") & F.col("coverage").isNotNull()).alias("fits"))
        tried = one if tried is None else tried.unionByName(one)
    best = tried.agg(F.min_by(F.struct("relevance_band", "coverage"), F.when(F.col("fits"), F.col("turn"))).alias("b"))
    n = F.lit(evaluated)
    point = F.when(F.col("b").isNotNull(), F.least("b.coverage", F.lit(ceiling))).otherwise(S.no_evidence_coverage(n))
    rate = F.when((point > 0) & (point < 1) & (n > 0), -F.log(1 - point) / n).otherwise(F.lit(1 / tau))
    return best.crossJoin(found).select(
        F.when(F.col("b").isNotNull(), "sample_coverage").otherwise("prior").alias("method"), F.col("b.relevance_band").alias("relevance_band"), F.round(point, 3).alias("coverage_estimate"),
        F.round(F.coalesce(F.try_divide(F.col("found"), point), F.col("found").cast("double")), 1).alias("n_total_estimate"), F.round(rate, 5).alias("lambda"), F.col("found").alias("highly_relevant_count"),
    )


def marginal_rates(snapshots: DataFrame, order: str, evaluated: str, relevant: str) -> DataFrame:
    """rate: relevant gained per evaluated, between neighbours; steps without progress are left out.
    Snapshots are a handful of rows per run."""
    w = Window.orderBy(order)
    step = snapshots.select(order, (F.col(evaluated) - F.lag(evaluated).over(w)).alias("d_eval"), (F.col(relevant) - F.lag(relevant).over(w)).alias("d_rel"))
    return step.filter("d_eval > 0").select(order, F.try_divide("d_rel", "d_eval").alias("rate"))


def low_progress(rates: DataFrame, order: str, last: int = 5, slack: float = 0.005, below: float = 0.02) -> DataFrame:
    """One row: whether the last rates don't rise by more than the slack and end low."""
    w = Window.orderBy(order)
    marked = rates.withColumns({"prev": F.lag("rate").over(w), "back": F.row_number().over(Window.orderBy(F.desc(order)))}).filter(F.col("back") <= last)
    falls = F.bool_and(F.when(F.col("back") < last, F.col("rate") <= F.col("prev") + slack))
    return marked.agg(F.count("*").alias("n_rates"), F.coalesce(falls, F.lit(False)).alias("falling"), F.max(F.when(F.col("back") == 1, F.col("rate"))).alias("last_rate")).withColumn("warn", F.col("falling") & (F.col("n_rates") >= last) & (F.col("last_rate") < below))
