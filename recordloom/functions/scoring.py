"""Relevance, coverage and report formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and caps of the relevance score.
W_TITLE, W_ABSTRACT, W_CITATION, W_RECENCY = 0.50, 0.25, 0.15, 0.10
CITATION_CAP, RECENCY_YEARS = 2000.0, 25.0
HIGH, MEDIUM = 0.6, 0.35


def coverage(terms: Column, words: Column, text: Column) -> Column:
    """Share of the terms found: Latin terms as words, others as substrings."""
    def share(s: Column) -> Column:
        hits = F.filter(s["terms"], lambda t: F.when(t.rlike("^[a-z0-9]+$"), F.array_contains(s["words"], t)).otherwise(F.contains(s["text"], t)))
        return F.when(F.size(s["terms"]) > 0, F.size(hits) / F.size(s["terms"])).otherwise(F.lit(0.0))

    # Bound first: inside of the filter, the words would be worked out again for each term.
    return F.transform(F.array(F.struct(terms.alias("terms"), words.alias("words"), text.alias("text"))), share)[0]


def citation_signal(cites: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce(cites, F.lit(0)), F.lit(0)) + 1) / F.log10(F.lit(CITATION_CAP + 1)))


def recency_signal(year: Column, now: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - year)
    return F.when(year.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - age / RECENCY_YEARS))


def relevance(title: Column, abstract: Column, cites: Column, recency: Column) -> Column:
    raw = W_TITLE * title + W_ABSTRACT * abstract + W_CITATION * cites + W_RECENCY * recency
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def label(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def tier(rcs: Column) -> Column:
    return F.when(rcs >= 8.5, "core").when(rcs >= 7, "high").when(rcs >= 5.5, "medium").when(rcs >= 4.5, "low").otherwise("peripheral")


def prior_coverage(n: Column, tau: float = 80.0) -> Column:
    return 1 - F.exp(-n / F.lit(min(160.0, max(40.0, tau))))


def no_evidence_coverage(n: Column) -> Column:
    return F.least(F.lit(0.5), prior_coverage(n))


def sample_coverage(m: Column, u: Column, q1: Column, q2: Column) -> Column:
    """Incidence-based sample coverage (Chao and Jost 2012); null below two occasions."""
    a, b = (m - 1) * q1, 2.0 * q2
    share = F.when(q2 > 0, a / (a + b)).when(q1 > 1, (m - 1) * (q1 - 1) / ((m - 1) * (q1 - 1) + 2.0)).otherwise(F.lit(0.0))
    return F.when((m >= 2) & (u > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(q1, u) * share)))


def informative(q1: Column, q2: Column) -> Column:
    return (q1 > 1) | ((q1 == 1) & (q2 > 0))


def decay(coverage_: Column, n: Column) -> Column:
    """tau of y = R (1 - exp(-n / tau)) at a coverage."""
    return F.when(coverage_ >= 0.999, n / 7.0).when(coverage_ <= 0, n * 10.0).otherwise(-n / F.log(1 - coverage_))
