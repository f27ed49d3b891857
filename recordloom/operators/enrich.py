"""Enrichment of records by another source's table: joins with per-field rules.

The lookup side has one row per key (see ``one_per_key``). Spark broadcasts it where it is
small; the records keep their rows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import normalize as N


def one_per_key(found: DataFrame, key: Column, order: str) -> DataFrame:
    """The last row of each key by ``order``, with the key as ``_key``; rows without one go."""
    rows = found.withColumn("_key", key).filter(F.col("_key").isNotNull())
    return rows.groupBy("_key").agg(F.max_by(F.struct(*found.columns), order).alias("f"))


def selected(rcs: Column, least: int | None) -> Column:
    """Whether a record is to be enriched: any, or those scored ``least`` or more."""
    return F.lit(True) if least is None else F.coalesce(rcs >= least, F.lit(False))


def _filled(c: Column, kind: str) -> Column:
    return c.isNotNull() & ((c != "") if kind == "string" else (F.size(c) > 0) if kind.startswith("array") else F.lit(True))


def _update(records: DataFrame, found: DataFrame, key: Column, source: str | Column, overwrite: dict[str, str], fill: dict[str, str], where: Column, only_if: Column | None = None) -> DataFrame:
    """``overwrite`` and ``fill`` name the found fields of record columns: the former replace by what
    isn't empty, the latter fill what is empty."""
    kinds = dict(records.dtypes)
    joined = records.withColumn("_key", F.when(where, key)).join(found, "_key", "left")
    hit = F.col("f").isNotNull()
    out = {}
    for c, name in overwrite.items():
        out[c] = F.when(hit & _filled(F.col(f"f.{name}"), kinds[c]), F.col(f"f.{name}")).otherwise(F.col(c))
    for c, name in fill.items():
        out[c] = F.when(hit & ~F.coalesce(_filled(F.col(c), kinds[c]), F.lit(False)), F.coalesce(F.col(f"f.{name}"), F.col(c))).otherwise(F.col(c))
    marked = F.when(hit if only_if is None else hit & only_if, F.array_distinct(F.concat("sources", F.array(F.lit(source) if isinstance(source, str) else source)))).otherwise(F.col("sources"))
    return joined.select(*[out.get(c, marked if c == "sources" else F.col(c)).alias(c) for c in records.columns])


def by_semantic_scholar(records: DataFrame, found: DataFrame, least: int | None = None) -> DataFrame:
    """By DOI (never an arXiv one): influential citations, id and tldr replace, abstract, venue and
    ISSNs fill. ``found`` has doi and the record's column names."""
    key = N.doi_for_lookup(F.col("doi"))
    table = one_per_key(found, N.doi_for_lookup(F.col("doi")), "ss_paper_id")
    return _update(records, table, key, "semantic_scholar", {c: c for c in ("influential_citation_count", "ss_paper_id", "tldr")}, {c: c for c in ("abstract", "venue", "issn", "issns")}, selected(F.col("rcs"), least))


def abstract_fallback(own: Column, found: Column, tldr: Column) -> Column:
    """The record's abstract, else the other source's, else its one-sentence summary."""
    return F.coalesce(N.blank_to_null(own), N.blank_to_null(found), N.blank_to_null(tldr))


def by_pubmed(records: DataFrame, found: DataFrame) -> DataFrame:
    """By PMID: MeSH terms and publication types replace, even by nothing; pmcid and abstract fill."""
    table = one_per_key(found, N.blank_to_null(F.col("pmid")), "pmcid")
    filled = _update(records, table, N.blank_to_null(F.col("pmid")), "pubmed", {}, {"pmcid": "pmcid", "abstract": "abstract"}, F.lit(True))
    again = filled.withColumn("_key", N.blank_to_null(F.col("pmid"))).join(table, "_key", "left")
    return again.select(*[F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) if c in ("mesh_terms", "publication_types") else F.col(c) for c in records.columns])


def by_crossref(records: DataFrame, found: DataFrame, threshold: int | None = None) -> DataFrame:
    """By DOI: funders, license and trial number replace where there are any; the reference count only
    by a strictly larger one (and only below ``threshold``, if given). The source is named where
    anything changed."""
    is_arxiv = F.contains(F.lower(F.coalesce("doi", F.lit("arxiv"))), F.lit("arxiv"))
    table = one_per_key(found, N.doi(F.col("doi")), "referenced_works_count")
    joined = records.withColumn("_key", F.when(~is_arxiv, N.doi(F.col("doi")))).join(table, "_key", "left")
    own = F.coalesce("referenced_works_count", F.lit(0))
    more = F.coalesce(F.col("f.referenced_works_count") > own, F.lit(False)) & (F.lit(True) if threshold is None else F.col("referenced_works_count").isNull() | (own < threshold))
    new = {"funders": F.coalesce(F.size("f.funders") > 0, F.lit(False)), "license": F.coalesce(F.size("f.license") > 0, F.lit(False)), "clinical_trial_number": F.coalesce(F.col("f.clinical_trial_number") != "", F.lit(False)), "referenced_works_count": more}
    changed = new["funders"] | new["license"] | new["clinical_trial_number"] | more
    out = {c: F.when(w, F.col(f"f.{c}")).otherwise(F.col(c)) for c, w in new.items()}
    out["sources"] = F.when(changed, F.array_distinct(F.concat("sources", F.array(F.lit("crossref"))))).otherwise(F.col("sources"))
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in records.columns])


def citation_conflicts(records: DataFrame, found: DataFrame, key: str, own: str, other: str, threshold: float = 30.0) -> DataFrame:
    """key, both counts and gap_pct where they differ by more than ``threshold`` percent of the
    record's own, which must be positive."""
    both = records.select(key, F.col(own).alias("own")).filter(F.col("own") > 0).join(found.select(key, F.col(other).alias("other")), key)
    gap = F.abs(F.col("other") - F.col("own")) / F.col("own") * 100
    return both.filter(gap > threshold).select(key, "own", "other", F.round(gap, 1).alias("gap_pct"))


def backfill(records: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """``records`` whose empty ``column`` is filled by key from ``known``, with attempted (it has the
    key, but not the value) and recovered."""
    lacking = F.col(key).isNotNull() & F.coalesce(F.col(column) == "", F.lit(True))
    joined = records.join(known.select(key, F.col(column).alias("_v")), key, "left")
    filled = F.when(lacking, F.coalesce("_v", F.col(column))).otherwise(F.col(column))
    return joined.select(*[filled.alias(c) if c == column else F.col(c) for c in records.columns], lacking.alias("attempted"), (lacking & F.col("_v").isNotNull()).alias("recovered"))


def backfill_counts(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count_if("attempted").alias("attempted"), F.count_if("recovered").alias("recovered"), F.count("*").alias("n"))


def open_impact(records: DataFrame, key: str, impacts: DataFrame, values: list[str]) -> DataFrame:
    """``records`` with the impact values of their ISSN: looked up once per distinct one."""
    wanted = records.select(key).filter(F.col(key).isNotNull()).distinct()
    return records.join(wanted.join(impacts.select(key, *values), key), key, "left")


def journal_metric(records: DataFrame, row_id: str, issns: str, ranks: DataFrame, category: str | None = None) -> DataFrame:
    """row_id, sjr_quartile (of the category, else the best), category_quartiles and backfill_needed:
    the first ISSN of a row that the rank table (issn, best_quartile, quartiles map) has."""
    from .rank import first_match, quartile_for

    found = first_match(records, row_id, issns, ranks.select("issn", "best_quartile", "quartiles"), "issn")
    lacking = records.select(row_id, (F.coalesce(F.size(issns), F.lit(0)) <= 0).alias("backfill_needed"))
    return found.join(lacking, row_id).select(row_id, quartile_for(F.col("quartiles"), F.col("best_quartile"), category).alias("sjr_quartile"), F.col("quartiles").alias("category_quartiles"), "backfill_needed")
