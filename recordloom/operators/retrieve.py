"""Retrieval legs, date windows, top-k search and the funnel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.functions import scoring as S


def in_years(year: Column, low: int | None, high: int | None, on_unknown: str = "drop") -> Column:
    """Inclusive range; an empty range is false, which Catalyst turns into an empty scan."""
    if low is not None and high is not None and low > high:
        return F.lit(False)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (year >= low)
    if high is not None:
        inside = inside & (year <= high)
    return F.coalesce(inside, F.lit(on_unknown == "keep"))


def recent_window(today: dt.date, low: int | None = None, high: int | None = None, days: int = 365) -> tuple[dt.date, dt.date] | None:
    """The last ``days``, clipped to the years; None where nothing is left."""
    start, end = today - dt.timedelta(days=days), today
    start = max(start, dt.date(low, 1, 1)) if low else start
    end = min(end, dt.date(high, 12, 31)) if high else end
    return (start, end) if start <= end else None


def mid_window(today: dt.date, low: int | None = None, high: int | None = None, days: int = 730) -> tuple[dt.date, dt.date] | None:
    """The ``days`` that end on the day before the recent window."""
    recent = recent_window(today, low, high)
    if recent is None:
        return None
    end = recent[0] - dt.timedelta(days=1)
    start = end - dt.timedelta(days=days)
    start = max(start, dt.date(low, 1, 1)) if low else start
    return (start, end) if start <= end else None


def leg(rows: DataFrame, name: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their depth (from 1) and the leg's name."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("depth", F.row_number().over(Window.orderBy(*order))).withColumn("leg", F.lit(name))  # n rows


def scored(records: DataFrame, query: str, title: str, abstract: str, cites: str, year: str, now: int) -> DataFrame:
    """Adds score and label of a query."""
    terms = N.query_terms(F.lit(query))
    t, a = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(abstract), F.lit(""))
    score = S.relevance(S.coverage(terms, N.tokens(t), F.lower(t)), S.coverage(terms, N.tokens(a), F.lower(a)), S.citation_signal(F.col(cites)), S.recency_signal(F.col(year), now))
    return records.withColumn("score", score).withColumn("label", S.label(F.col("score")))


def search(records: DataFrame, query: str, limit: int, min_score: float, title: str, abstract: str, cites: str, year: str, now: int, tie: str) -> DataFrame:
    out = scored(records, query, title, abstract, cites, year, now).filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), F.desc(cites), tie).limit(limit)
