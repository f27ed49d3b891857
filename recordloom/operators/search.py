"""Retrieval plans over a table of records, and ``search``, the whole way from query to answer.

A corpus has paper_id, title, abstract, year, published (date), citation_count, venue, type,
issns, sources and the identifiers. Ties are broken by paper_id, so that results repeat.
"""

from __future__ import annotations

import datetime as dt
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom import scratch
from recordloom.functions import normalize as N
from recordloom.functions import scoring as S
from recordloom.operators import rank, resolve, retrieve, verify
from recordloom.plans import intent

LEGS = ("cited", "recent", "relevance")


# ---- matching ----------------------------------------------------------------------------


def query_groups(query: str) -> list[list[str]]:
    """A query as groups that must all match; the terms of a group (joined by OR) are alternatives.
    Quoted phrases are one term; parentheses group."""
    groups, joined, i, text = [], False, 0, query.replace("(", " ").replace(")", " ")
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        quoted = text[i] == '"'
        end = text.find('"', i + 1) if quoted else i
        if quoted and end > i:
            term, i = text[i + 1 : end], end + 1
        else:
            end = i
            while end < len(text) and not text[end].isspace():
                end += 1
            term, i = text[i:end].strip('"'), end
            if term in ("OR", "|"):
                joined = bool(groups)
                continue
            if term == "AND":
                continue
        if term.strip():
            if joined:
                groups[-1].append(" ".join(term.lower().split()))
            else:
                groups.append([" ".join(term.lower().split())])
        joined = False
    return groups


def words_of(term: str) -> list[str]:
    """The words of a query's term, as ``matches`` has them: runs of letters and digits."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in term).split()


def matches(query: str, *texts: Column) -> Column:
    """Whether each group of the query has a word, or a phrase in order, in the joined texts."""
    low = F.lower(F.concat_ws(" \n ", *texts))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.lit(True)
    for group in query_groups(query):
        one = F.lit(False)
        for term in group:
            clean = F.array_join(F.regexp_extract_all(F.lit(term), F.lit(r"[\p{L}\p{N}]+"), 0), " ")
            one = one | F.contains(spaced, F.concat(F.lit(" "), clean, F.lit(" ")))
        out = out & one
    return out


def in_venues(corpus: DataFrame, venue: str, names: list[str]) -> DataFrame:
    """The records of the listed venues, whatever the names' case."""
    listed = corpus.sparkSession.createDataFrame([(n.strip().lower(),) for n in dict.fromkeys(names)], "v string")
    return corpus.join(F.broadcast(listed), F.lower(F.trim(F.col(venue))) == F.col("v"), "left_semi")  # a list in a call


def of_type(kind: Column, wanted: str) -> Column:
    return F.coalesce(F.lower(kind) == wanted.lower(), F.lit(False))


def has_any(terms: Column, wanted: list[str]) -> Column:
    """Whether MeSH terms or publication types hold one of those asked for, whatever the case."""
    return F.coalesce(F.exists(terms, lambda t: F.lower(t).isin(*[w.lower() for w in wanted])), F.lit(False))


def fresh(corpus: DataFrame, published: str, today: dt.date, days: int = 4, limit: int = 30, tie: str = "paper_id") -> DataFrame:
    """The newest records of the last ``days``, newest first."""
    return corpus.filter(F.col(published) >= F.lit(today - dt.timedelta(days=days))).orderBy(F.desc(published), tie).limit(limit)


def dated(corpus: DataFrame, published: str, low: dt.date | None, high: dt.date | None, order: str, limit: int, tie: str = "paper_id") -> DataFrame:
    """Records between two dates by ``order`` (published, updated or score), newest or best first."""
    inside = F.lit(True)
    if low:
        inside = inside & (F.col(published) >= F.lit(low))
    if high:
        inside = inside & (F.col(published) <= F.lit(high))
    return corpus.filter(inside).orderBy(F.desc(order), tie).limit(limit)


def drop_after(year: Column, high: int | None) -> Column:
    """An end year that keeps records whose year isn't known."""
    return retrieve.in_years(year, None, high, "keep")


def shows(needle: str, texts: list[str], authors: str) -> Column:
    """Whether a text or an author's name holds the needle, in any case; nulls hold nothing."""
    low = F.lit(needle.lower())
    hits = [F.contains(F.lower(F.col(t)), low) for t in texts] + [F.exists(authors, lambda a: F.coalesce(F.contains(F.lower(a["name"]), low), F.lit(False)))]
    return F.exists(F.array(*hits), lambda h: F.coalesce(h, F.lit(False)))


# ---- ranked retrieval ----------------------------------------------------------------------


def scored(corpus: DataFrame, query: str, now: int) -> DataFrame:
    return retrieve.scored(corpus, query, "title", "abstract", "citation_count", "year", now)


def crawl(corpus: DataFrame, query: str, n: int, sort: str = "cited", low: int | None = None, high: int | None = None, now: int = 2026) -> DataFrame:
    """The first ``n`` matches in title and abstract by citations, date or relevance."""
    rows = corpus.filter(retrieve.in_years(F.col("year"), low, high)).filter(matches(query, F.col("title"), F.col("abstract")))
    order = {"cited": [F.desc("citation_count")], "date": [F.desc("published")], "relevance": [F.desc("score"), F.desc("citation_count")]}[sort]
    return (scored(rows, query, now) if sort == "relevance" else rows).orderBy(*order, "paper_id").limit(n).select(*corpus.columns)


def seminal(corpus: DataFrame, query: str, before: int = 2015, n: int = 10) -> DataFrame:
    return crawl(corpus, query, n, "cited", None, before)


def reviews(corpus: DataFrame, query: str, n: int = 10, low: int | None = None, high: int | None = None, now: int = 2026) -> DataFrame:
    return crawl(corpus.filter(of_type(F.col("type"), "review")), query, n, "relevance", low, high, now)


def pool_count(corpus: DataFrame, query: str, high: int, low: int | None = None) -> DataFrame:
    """One row: count of matches, year_min and year_max; by default the last two years."""
    low = high - 1 if low is None else low
    rows = corpus.filter(retrieve.in_years(F.col("year"), low, high)).filter(matches(query, F.col("title"), F.col("abstract")))
    return rows.agg(F.count("*").alias("count")).select("count", F.lit(low).alias("year_min"), F.lit(high).alias("year_max"))


def topped_up(first: DataFrame, more: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """Up to ``n`` rows: those of ``first`` before those of ``more`` that it lacks, each by ``order``.
    Adds tier (0 or 1)."""
    both = first.withColumn("tier", F.lit(0)).unionByName(more.join(first.select(key), key, "left_anti").withColumn("tier", F.lit(1)))
    return both.orderBy("tier", *order).limit(n)


def windowed(corpus: DataFrame, query: str, n: int, window: tuple[dt.date, dt.date], now: int) -> DataFrame:
    """The ``n`` most relevant records of a date window: matches first, then the best others with a
    query term. Adds tier and score."""
    inside = scored(corpus.filter(F.col("published").between(F.lit(window[0]), F.lit(window[1]))), query, now)
    terms = S.coverage(N.query_terms(F.lit(query)), N.tokens(F.concat_ws(" ", "title", "abstract")), F.lower(F.concat_ws(" ", "title", "abstract")))
    precise = inside.filter(matches(query, F.col("title"), F.col("abstract")))
    return topped_up(precise, inside.filter(terms > 0), "paper_id", n, [F.desc("score"), F.desc("citation_count"), F.col("paper_id")])


def run_leg(corpus: DataFrame, leg: str, query: str, n: int, today: dt.date, low: int | None = None, high: int | None = None) -> DataFrame:
    """One leg of the search with depth (from 1): the most cited matches, the most relevant of the
    recent window and then half as many of the one before it, or the most relevant of all."""
    high = today.year if high is None else high
    empty = corpus.limit(0).withColumn("depth", F.lit(0).cast("long"))
    if low is not None and low > high:
        return empty
    if leg != "recent":
        rows = scored(crawl(corpus, query, n, "cited" if leg == "cited" else "relevance", low, high, today.year), query, today.year)
        order = [F.desc("citation_count")] if leg == "cited" else [F.desc("score"), F.desc("citation_count")]
        return rows.withColumn("depth", F.row_number().over(Window.orderBy(*order, "paper_id")).cast("long")).select(*corpus.columns, "depth")  # n rows
    recent, mid = retrieve.recent_window(today, low, high), retrieve.mid_window(today, low, high)
    if recent is None:
        return empty
    rows = windowed(corpus, query, n, recent, today.year).withColumn("part", F.lit(0))
    if mid is not None and n // 2:
        rows = rows.unionByName(windowed(corpus, query, n // 2, mid, today.year).withColumn("part", F.lit(1)).join(rows.select("paper_id"), "paper_id", "left_anti").select(*rows.columns))
    order = Window.orderBy("part", "tier", F.desc("score"), F.desc("citation_count"), "paper_id")
    return rows.withColumn("depth", F.row_number().over(order).cast("long")).select(*corpus.columns, "depth")  # 1.5 n rows


def legs(corpus: DataFrame, query: str, n: int, today: dt.date, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of all legs with leg (its number) and depth."""
    out = None
    for i, name in enumerate(LEGS):
        one = run_leg(corpus, name, query, n, today, low, high).withColumn("leg", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def ranked_legs(corpus: DataFrame, query: str, most: int, today: dt.date, low: int | None = None, high: int | None = None) -> DataFrame:
    """What ``legs`` finds for every depth up to ``most``, matched and scored once and written: the
    legs' rows with part (0, or 1 for the older window of the recent leg) and at, the place in the
    part. At most 3.5 ``most`` rows. A deeper search goes on from here with ``at_depth``."""
    found = legs(corpus, query, most, today, low, high)
    mid = retrieve.mid_window(today, low, today.year if high is None else high)
    older = (F.col("leg") == LEGS.index("recent")) & (F.col("published") <= F.lit(mid[1])) if mid else F.lit(False)
    parts = found.withColumn("part", F.coalesce(older, F.lit(False)).cast("int"))
    return scratch.cut(parts.withColumn("at", F.row_number().over(Window.partitionBy("leg", "part").orderBy("depth"))), "ranked-legs")  # 3.5 most rows


def at_depth(ranked: DataFrame, n: int) -> DataFrame:
    """The rows of ``legs`` for the depth ``n`` out of ``ranked_legs``: half as many of the older window."""
    rows = ranked.filter(F.col("at") <= F.when(F.col("part") == 1, n // 2).otherwise(n))
    return rows.withColumn("depth", F.row_number().over(Window.partitionBy("leg").orderBy("part", "at")).cast("long")).drop("part", "at")  # 3.5 n rows


def double_sort(corpus: DataFrame, query: str, n: int, today: dt.date, low: int | None = None, high: int | None = None) -> DataFrame:
    """paper_id, votes, cites and place of what the legs find: shared records first, then the others
    in turn."""
    return resolve.vote_merge(legs(corpus, query, n, today, low, high), "paper_id", "leg", "depth", "citation_count")


def single(corpus: DataFrame, column: str, value: str) -> DataFrame:
    return corpus.filter(F.col(column) == value).orderBy("paper_id").limit(1)


def author_profile(corpus: DataFrame, name: str) -> DataFrame:
    """One row of an author: papers, citations, the first three affiliations and five topics by count."""
    rows = corpus.withColumn("a", F.explode(F.filter("authors", lambda a: F.lower(a["name"]) == name.lower())))
    counts = lambda each, label: each.groupBy(label).agg(F.count("*").alias("n")).filter(F.col(label).isNotNull()).orderBy(F.desc("n"), label)
    places = counts(rows.select(F.col("a.affiliation").alias("x")), "x").limit(3)
    topics = counts(rows.select(F.explode("topics").alias("x")), "x").limit(5)
    listed = lambda df: df.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "x"))), lambda s: s["x"]).alias("l"))
    head = rows.agg(F.count("*").alias("papers"), F.sum("citation_count").alias("citations"))
    return head.crossJoin(listed(places).toDF("affiliations")).crossJoin(listed(topics).toDF("topics"))  # one row each


def batches(records: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """Adds batch (from 1): ``size`` records each, in order, for labelling."""
    return resolve.numbered(records.withColumn("_o", F.struct(*order)), "_o", "_n").withColumn("batch", F.ceil(F.col("_n") / size).cast("long")).drop("_o", "_n")


# ---- the whole search ------------------------------------------------------------------------


@dataclass
class Options:
    """What a search may be told; see the functions above for the meaning."""

    today: dt.date = field(default_factory=dt.date.today)
    year_min: int | None = None
    year_max: int | None = None
    per_strategy: int = 50
    limit: int = 10
    min_relevance: float = 0.0
    quartiles: list[str] = field(default_factory=list)
    min_impact: float | None = None
    rank_platform: str | None = None
    keep_tiers: list[str | int] = field(default_factory=list)
    rank_category: str | None = None
    default_platform: str = "jcr"
    deepen_target: int | None = None
    max_deepen_rounds: int = 3
    lang: str | None = None
    config_lang: str = "auto"
    with_sources: list[str] = field(default_factory=list)


def language_plan(query: str, lang: str | None, config_lang: str, with_sources: list[str]) -> dict:
    """Which language to search in: the flag, the configured one, or the query's. A Chinese query
    without either is ambiguous; Chinese sources add Chinese to an English scope."""
    reader = any("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0002ffff" for c in query or "")
    own, config = "zh" if reader else "en", config_lang if config_lang in ("en", "zh", "both") else "auto"
    scope, by = (lang, "flags") if lang else (config, "config") if config != "auto" else (own, "query_passthrough")
    upgraded = bool(with_sources) and scope == "en"
    engaged = bool(lang or with_sources or config != "auto" or own == "zh")
    return {"query_lang": own, "scope_used": "both" if upgraded else scope, "scope_source": by, "ambiguous": by == "query_passthrough" and own == "zh", "chinese_sources_used": list(with_sources), "upgraded": upgraded, "engaged": engaged}


def source_plan(primary: str, quota: dict | None = None, threshold: float = 0.05, fallback: bool = True, override: str | None = None) -> tuple[str, bool]:
    """The source to ask first, and whether a nearly spent budget switched it."""
    name = (override or primary or "openalex").lower()
    if name == "semantic_scholar":
        return name, False
    spent = quota is not None and quota.get("ok") and quota.get("remaining_usd") is not None and quota["remaining_usd"] <= threshold
    return ("semantic_scholar", True) if name == "auto" and fallback and spent else ("openalex", False)


def pool(found: DataFrame, o: Options, supplements: list[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """The deduplicated records of the legs' rows and the supplements, and each list's new keys."""
    for i, extra in enumerate(supplements):
        rows = extra.filter(drop_after(F.col("year"), o.year_max)).withColumns({"leg": F.lit(len(LEGS) + i), "depth": F.monotonically_increasing_id()})
        found = found.unionByName(rows, allowMissingColumns=True)
    named = {"doi": "doi", "arxiv": "arxiv_id", "pmid": "pmid", "openalex": "openalex_id"}
    ids = {k: F.col(c) for k, c in named.items() if c in found.columns}
    keyed = found.withColumn("key", resolve.canonical_key(ids, F.col("title"), F.col("year")))
    yields = resolve.marginal_yield(keyed, "leg", "key")
    # paper_id ends the order: a supplement's depth alone isn't unique across tasks
    return resolve.merge_records(keyed, "key", ["leg", "depth", "paper_id"], o.today.year).join(keyed.groupBy("key").agg(F.min_by("paper_id", F.struct("leg", "depth", "paper_id")).alias("paper_id")), "key"), yields


def search(corpus: DataFrame, query: str, options: Options | None = None, ranks: DataFrame | None = None, impacts: DataFrame | None = None, supplements: list[DataFrame] = ()) -> dict:
    """From a query in plain language to ranked records. Returns data (the records, with score, label,
    rank outcome, markers and place), funnel (one row), yields, saturation (one row), plan and
    language. ``ranks`` has issn and a struct column per platform; ``impacts`` has issn and
    two_year_mean_citedness.

    Filters run in the order relevance, journal, rank, limit. With a rank filter on, retrieval gets
    deeper (twice the depth, up to ``max_deepen_rounds`` times) until enough records survive or
    nothing new comes. The corpus is matched and scored once for four rounds; each takes more of the ranked rows."""
    o = options or Options()
    wish = intent.parse(query)
    plan = intent.plan({"platform": o.rank_platform, "keep": o.keep_tiers, "category": o.rank_category}, wish, o.default_platform)
    language = language_plan(query, o.lang, o.config_lang, o.with_sources)
    topic, filtering = plan["cleaned"], plan["filter"] and ranks is not None and not plan["ambiguous"]

    def ranked(records: DataFrame) -> DataFrame:
        rows = scored(records, topic, o.today.year)
        if ranks is None:
            return rows.withColumns({"rank": F.lit(None).cast("string"), "outcome": F.lit("unranked")})
        candidates = F.array_distinct(F.concat(F.array_compact(F.array("issn")), F.coalesce("issns", F.array())))
        hits = rank.first_match(rows.withColumn("_c", candidates), "key", "_c", ranks, "issn")
        slot = F.col(plan["platform"])
        fine = rank.passes(plan["platform"], slot, plan["tiers"], plan["quartiles"], plan["top"], plan["category"])
        return rows.join(hits.select("key", rank.outcome(slot.isNotNull(), fine if filtering else F.lit(True)).alias("outcome"), F.to_json(slot).alias("rank"), *(["sjr"] if "sjr" in ranks.columns and plan["platform"] != "sjr" else []), *([plan["platform"]])), "key")

    depth, rounds, last, saturated = o.per_strategy, 0, None, False
    reach, found = 0, None
    while True:
        if depth > reach:  # ranked for this round and up to three deeper ones
            reach = depth * 2 ** (min(o.max_deepen_rounds - rounds, 3) if filtering else 0)
            found = ranked_legs(corpus, topic, reach, o.today, o.year_min, o.year_max)
        records, yields = pool(at_depth(found, depth), o, supplements)
        rows = ranked(records).persist()
        size, kept = rows.agg(F.count("*"), F.count_if(F.col("outcome") == "kept")).first()
        saturated = last is not None and size <= last
        if not filtering or kept >= (o.deepen_target or o.limit or 10) or rounds >= o.max_deepen_rounds or saturated:
            break
        depth, rounds, last = depth * 2, rounds + 1, size
        rows.unpersist()
    grounded = F.size(N.query_terms(F.lit(topic))) > 0
    relevant = (F.col("score") >= o.min_relevance) & grounded | F.lit(o.min_relevance <= 0) | ~grounded
    quartile = F.col("sjr.best_quartile") if ranks is not None and "sjr" in ranks.columns else F.lit(None).cast("string")
    impact = F.lit(None).cast("double")
    if impacts is not None:
        from recordloom.operators.enrich import open_impact

        rows, impact = open_impact(rows, "issn", impacts, ["two_year_mean_citedness"]), F.col("two_year_mean_citedness")
    journal = relevant & rank.journal_filter(quartile, impact, o.quartiles, o.min_impact)
    passed = journal & ((F.col("outcome") == "kept") if filtering else F.lit(True))
    order = [F.desc("citation_count"), F.desc("score")] if filtering else [F.desc("score"), F.desc("citation_count")]
    top = rows.filter(passed).orderBy(*order, "key").limit(o.limit)
    marks = verify.markers(F.col("doi"), F.col("abstract"), F.col("sources"))
    data = top.withColumn("place", F.row_number().over(Window.orderBy(*order, "key"))).withColumns(marks)  # ``limit`` rows
    raw = at_depth(found, depth).agg(F.count("*").alias("retrieved_raw"))
    funnel = rows.agg(F.count("*").alias("deduplicated"), F.count_if(relevant).alias("relevant"), F.count_if(journal).alias("journal_passed"), F.count_if(passed).alias("rank_passed")).crossJoin(raw)  # one row each
    funnel = funnel.select("retrieved_raw", "deduplicated", "relevant", "journal_passed", "rank_passed", F.least("rank_passed", F.lit(o.limit)).alias("returned"))
    from recordloom.sources.reports import saturation, score_bands

    signal = saturation(yields).crossJoin(score_bands(rows))
    return {"data": data, "funnel": funnel, "yields": yields, "saturation": signal, "plan": {**plan, "deepen_rounds": rounds, "deepen_saturated": saturated or (filtering and rounds >= o.max_deepen_rounds)}, "language": language if language["engaged"] else None}


def verify_refs(refs: DataFrame, sources: list[tuple[str, DataFrame]], at_least: float = 0.85) -> DataFrame:
    """refs (ref_id, doi, title) with status, matched_source, match_type: by DOI in the sources' order,
    else by the most similar title, else not_found; references with neither are unchecked.
    ``sources``: (name, table with doi, title, paper_id)."""
    keyed = refs.withColumn("_doi", N.doi(F.col("doi")))
    by_doi = verify.by_priority(keyed.select("ref_id", "_doi"), "_doi", [(n, t.select(N.doi(F.col("doi")).alias("_doi")).filter(F.col("_doi").isNotNull()), "_doi") for n, t in sources])
    out = keyed.join(by_doi.select("ref_id", F.col("matched_source").alias("_by_doi")), "ref_id")
    left = keyed.join(by_doi.filter("found").select("ref_id"), "ref_id", "left_anti").filter(F.coalesce("title", F.lit("")) != "")
    for name, table in sources:
        best = verify.similar_titles(left, table, "ref_id", "paper_id", "title", "title", at_least)
        out = out.join(best.select("ref_id", F.lit(name).alias(f"_t_{name}")), "ref_id", "left")
    title = F.coalesce(*[F.col(f"_t_{n}") for n, _ in sources])
    checked = F.col("_doi").isNotNull() | (F.coalesce("title", F.lit("")) != "")
    status = F.when(~checked, "unchecked").when(F.col("_by_doi").isNotNull() | title.isNotNull(), "verified").otherwise("not_found")
    return out.select("ref_id", status.alias("status"), F.coalesce("_by_doi", title).alias("matched_source"), F.when(F.col("_by_doi").isNotNull(), "doi").when(title.isNotNull(), "title").alias("match_type"))


def refs_summary(verified: DataFrame) -> DataFrame:
    """One row: total, verified, not_found and unchecked."""
    return verified.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "not_found", "unchecked")])


def refs_by_source(verified: DataFrame) -> DataFrame:
    """matched_source and how many references it verified."""
    return verified.filter(F.col("status") == "verified").groupBy("matched_source").agg(F.count("*").alias("verified"))
