"""Entity resolution: canonical keys, ordered merge, conflict guard, vote merge, absorption."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.operators.greedy import decided
from recordloom.scratch import cut

#: Identifier columns in the order in which they become keys.
ID_ORDER = ("doi", "arxiv", "pmid", "openalex", "ss", "native")


def _clean_ids(ids: dict[str, Column]) -> list[Column]:
    clean = {"doi": N.doi, "arxiv": N.arxiv_id, "openalex": lambda c: N.blank_to_null(F.replace(c, F.lit("https://openalex.org/"), F.lit("")))}
    return [F.concat(F.lit(f"{k}|"), clean.get(k, N.blank_to_null)(ids[k])) for k in ID_ORDER if k in ids]


def canonical_key(ids: dict[str, Column], title: Column, year: Column) -> Column:
    """kind|value[|year] of the first identifier there is; then title and year, then a hash. A title
    of which nothing is left by normalisation still makes a title key."""
    titled = F.when((title != "") & (year != 0), F.concat(F.lit("title|"), N.title(title), F.lit("|"), year.cast("string")))
    hashed = F.concat(F.lit("hash|"), F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 16))
    return F.coalesce(*_clean_ids(ids), titled, hashed)


def identity_keys(ids: dict[str, Column], title: Column, year: Column) -> Column:
    """All keys of a record, in the order in which they are looked up."""
    norm = N.blank_to_null(N.title(title))
    titled = F.when(year != 0, F.concat(F.lit("title|"), norm, F.lit("|"), year.cast("string")))
    return F.array_compact(F.array(*_clean_ids(ids), titled))


def paper_id(ids: dict[str, Column], title: Column) -> Column:
    arxiv = F.concat(F.lit("arxiv:"), ids["arxiv"]) if "arxiv" in ids else F.lit(None)
    pmid = F.concat(F.lit("pmid:"), ids["pmid"]) if "pmid" in ids else F.lit(None)
    get = lambda k: ids.get(k, F.lit(None).cast("string"))
    return F.coalesce(get("doi"), arxiv, get("openalex"), pmid, get("ss"), get("native"), F.concat(F.lit("untitled_"), F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 16)))


def first_where(value: Column, where: Column, order: Column) -> Column:
    """The value of the first row, by ``order``, on which ``where`` holds."""
    return F.min_by(F.when(where, value), F.when(where, order))


def ordered_union(records: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """key and the distinct elements of an array column, in the order in which they first come. A key's
    elements are made distinct before they meet, so that a key with most rows makes no long list."""
    each = records.select(key, *order, F.posexplode(column).alias("_place", "_v"))
    first = each.groupBy(key, "_v").agg(F.min(F.struct(*order, "_place")).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_v"))), lambda x: x["_v"]).alias(column))


def _with_unions(merged: DataFrame, records: DataFrame, key: str, order: list[str], unions: list[str]) -> DataFrame:
    for c in unions:
        lists = ordered_union(records, key, order, c).withColumnRenamed(key, "_key")
        merged = merged.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        merged = merged.withColumn(c, F.coalesce(c, F.array().cast(records.schema[c].dataType)))
    return merged


def merge(records: DataFrame, key: str, order: list[str], first_non_empty: list[str], unions: list[str] = (), maxima: list[str] = ()) -> DataFrame:
    """One row per key. Columns go by rule: first non-empty value, ordered distinct union of
    arrays, or maximum with 0 as null. ``order`` must be a total order."""
    at = F.struct(*order)
    out = [F.count("*").alias("n_records")]
    kinds = dict(records.dtypes)
    for c in first_non_empty:
        filled = F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else (F.size(c) > 0) if kinds[c].startswith("array") else F.lit(True))
        out.append(first_where(F.col(c), filled, at).alias(c))
    for c in maxima:
        out.append(F.nullif(F.max(c), F.lit(0)).alias(c))
    return _with_unions(records.groupBy(key).agg(*out), records, key, order, list(unions))


def preferred_text(value: Column, filled: Column, zh: Column, openalex: Column, order: Column) -> Column:
    """Title rule, as if the records were merged one after the other, where each may be merged already
    and have several sources. The first Chinese-source record overrides what is there, if filled; so
    does the first openalex one, if filled, unless a Chinese one came before it and it isn't Chinese
    itself. The later of the two stands, else the first filled value."""
    first_zh = F.min(F.when(zh, order))
    of_zh = F.min_by(F.when(zh, F.struct(value.alias("v"), filled.alias("f"))), F.when(zh, order))
    of_oa = F.min_by(F.when(openalex, F.struct(value.alias("v"), filled.alias("f"), order.alias("o"), zh.alias("zh"))), F.when(openalex, order))
    free = of_oa["f"] & (of_oa["zh"] | F.coalesce(of_oa["o"] < first_zh, F.lit(True)))
    later = F.coalesce(of_oa["o"] > first_zh, F.lit(False)) | ~F.coalesce(of_zh["f"], F.lit(False))
    return F.coalesce(F.when(free & later, of_oa["v"]), F.when(of_zh["f"], of_zh["v"]), first_where(value, filled, order))


def citation_count(cites: Column, openalex: Column, order: Column) -> Column:
    """The last openalex record's positive count, else the first that isn't 0."""
    good = openalex & (cites > 0)
    return F.coalesce(F.max_by(F.when(good, cites), F.when(good, order)), first_where(cites, F.coalesce(cites, F.lit(0)) != 0, order), F.lit(0))


def conflict_variants(records: DataFrame, key: str, ids: str | list[str], order: list[str]) -> DataFrame:
    """Adds variant: 1 for what merges into a key's base record, 2, 3, ... for rows of which one of
    ``ids`` (DOI, arXiv id) is known and differs from the base's, the first that is known.

    Only the keys with a clash are numbered by a window; the others never meet in one task."""
    ids = [ids] if isinstance(ids, str) else ids
    at = F.struct(*order)
    base = records.groupBy(key).agg(*[first_where(F.col(c), F.col(c).isNotNull(), at).alias(f"_b{i}") for i, c in enumerate(ids)], *[F.count_distinct(c).alias(f"_n{i}") for i, c in enumerate(ids)])
    base = base.filter(" or ".join(f"_n{i} > 1" for i in range(len(ids)))).drop(*[f"_n{i}" for i in range(len(ids))])
    joined = records.join(base, key, "left")
    clash = F.lit(False)
    for i, c in enumerate(ids):
        clash = clash | F.coalesce(F.col(c) != F.col(f"_b{i}"), F.lit(False))
    joined = joined.withColumn("_clash", clash).drop(*[f"_b{i}" for i in range(len(ids))])
    w = Window.partitionBy(key).orderBy(*order)
    out = joined.filter("_clash").withColumn("variant", 1 + F.row_number().over(w).cast("long"))
    return joined.filter("not _clash").withColumn("variant", F.lit(1).cast("long")).unionByName(out).drop("_clash")


def sketched_yield(rows: DataFrame, list_: str, key: str, lg_entries: int = 16) -> DataFrame:
    """list, new_keys and total like ``marginal_yield`` with its running count, from theta sketches of
    2^``lg_entries`` hashes (of 8 bytes) at most: tasks merge sketches, no key is shuffled.

    A sketch is exact up to its number of entries. A first one over all keys says how many there are;
    the keys are dealt by hash into so many parts that each has half as many as a sketch holds, and each
    part has its own sketch of each list. Parts share no key, so their counts add up, exactly."""
    of = F.col(key)
    about = rows.agg(F.theta_sketch_estimate(F.theta_sketch_agg(of, lg_entries)).alias("n")).first()["n"] or 0
    parts = 1 if about <= 2 ** (lg_entries - 1) else math.ceil(about / 2 ** (lg_entries - 1))
    part = F.pmod(F.xxhash64(of), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
    each = rows.groupBy(F.col(list_).alias("list"), part.alias("part")).agg(F.theta_sketch_agg(of, lg_entries).alias("own"))
    w = Window.partitionBy("part").orderBy("list")  # a row a list
    so_far = each.withColumn("all", F.theta_union_agg("own", lg_entries).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = so_far.withColumn("before", F.lag("all").over(w))
    new = F.when(F.col("before").isNull(), F.theta_sketch_estimate("own")).otherwise(F.theta_sketch_estimate(F.theta_difference("own", "before")))
    lists = so_far.groupBy("list").agg(F.sum(new.cast("long")).alias("new_keys"))
    return lists.select("list", "new_keys", F.sum("new_keys").over(Window.orderBy("list")).alias("total"))  # a row a list


def marginal_yield(records: DataFrame, list_idx: str, key: str) -> DataFrame:
    """list and new_keys: how many keys each list is the first to bring; 0 for none."""
    first = records.groupBy(key).agg(F.min(list_idx).alias("list"))
    new = first.groupBy("list").agg(F.count("*").alias("new_keys"))
    return records.select(F.col(list_idx).alias("list")).distinct().join(new, "list", "left").fillna(0, ["new_keys"])


def vote_merge(legs: DataFrame, key: str, leg: str, depth: str, cites: str, rounds: bool = True) -> DataFrame:
    """Shared keys by votes and citations; then the others in turn, last leg first (or by votes and
    citations alone, without ``rounds``). Adds place.

    Places are numbered by ranges of the order, so no task sees all keys."""
    one = legs.groupBy(key).agg(F.countDistinct(leg).alias("votes"), F.max(cites).alias("cites"), F.min(F.struct(F.col(leg).alias("leg"), F.col(depth).alias("depth"))).alias("at"))
    shared = F.col("votes") > 1
    apart = F.when(shared, 0).otherwise(F.col("at.depth")) if rounds else F.lit(0)
    turn = F.when(shared, 0).otherwise(-F.col("at.leg")) if rounds else F.lit(0)
    by_votes = shared if rounds else F.lit(True)
    order = [(~shared).cast("int"), F.when(by_votes, -F.col("votes")).otherwise(0), F.when(by_votes, -F.col("cites")).otherwise(0), apart, turn, F.col(key)]
    return numbered(one.select(key, "votes", "cites", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order")), "_order", "place").drop("_order")


def numbered(df: DataFrame, order: str, into: str) -> DataFrame:
    """Adds the row number (from 1) by ``order``, which must be unique: rows are sorted by range, and
    each range starts after the counts of those before it."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    in_part = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    kept = cut(ranged.withColumn("_row", in_part), "numbered")  # the ranges are sampled: both uses must see the same ones
    counts = kept.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).select("_part", "_before")  # a row for each task
    return kept.join(F.broadcast(before), "_part").withColumn(into, F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def absorb(records: DataFrame, is_guest: Column, title: str, year: str, order: str, is_preprint: Column, max_gap: int = 1) -> DataFrame:
    """guest, host: each guest record's host, of equal normalised title and a year within the
    gap; preprint-like hosts first, then by order. Generic and empty titles are never hosts.

    The best host of each title and year is found once, for every year within the gap of its own, and
    guests look it up: hosts and guests of one title aren't paired."""
    rows = records.select(F.col(order).alias("id"), N.title(F.col(title)).alias("t"), F.col(year).alias("y"), is_guest.alias("g"), is_preprint.alias("p")).filter(F.col("y").isNotNull() & (F.col("t") != "") & ~F.col("t").isin(*N.GENERIC_TITLES))
    guests, hosts = rows.filter("g"), rows.filter("not g")
    near = F.explode(F.sequence(F.col("y") - max_gap, F.col("y") + max_gap))
    best = hosts.select("t", near.alias("y"), F.struct((~F.col("p")).alias("late"), F.col("id").alias("host")).alias("h")).groupBy("t", "y").agg(F.min("h").alias("h"))
    return guests.join(best, ["t", "y"]).select(F.col("id").alias("guest"), F.col("h.host").alias("host"))


def append_new(first: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``first`` and what of ``more`` has another key."""
    return first.unionByName(more.join(first.select(key), key, "left_anti"))


#: Sources of Chinese records.
CHINESE = ("nssd", "yiigle")


def merge_records(records: DataFrame, key: str, order: list[str], now: int = 2026) -> DataFrame:
    """One record per key by the field rules. ``records`` has sources and any of the canonical fields;
    ``order`` is a total order within a key. The result is that of merging a key's records one after
    the other into the first, also where they were merged before and have several sources: the rules
    that depend on what was there so far come down to which record is the first Chinese one, the
    first openalex one or the first filled one, so no task has to go through a key's records.

    Identifiers, type, counts and links: first that isn't empty. Title and authors: see
    ``preferred_text``.
    Abstract and venue: the first Chinese record's, else the first filled. DOI and arXiv id: those of
    later records in their normal form. Year: the first, later ones
    only up to ``now``. Citations: the last positive openalex count, else the first other than 0.
    sources and issns: ordered unions. Scores: of the first scored record, with reason and flag.
    What isn't named is the first record's."""
    at, kinds = F.struct(*order), dict(records.dtypes)
    first = records.groupBy(key).agg(F.min(at).alias("_first"))
    rows = records.join(first, key).withColumn("_is_first", at == F.col("_first"))
    zh = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in CHINESE]))
    oa = F.array_contains("sources", "openalex")

    def filled(c: str) -> Column:
        there = F.col(c).isNotNull()
        return there & (F.col(c) != "") if kinds[c] == "string" else there & (F.size(c) > 0) if kinds[c].startswith(("array", "map")) else there

    def chinese_first(c: str) -> Column:
        mine = F.min_by(F.struct(F.col(c).alias("v"), filled(c).alias("f")), F.when(zh, at))
        return F.coalesce(F.when(mine["f"], mine["v"]), first_where(F.col(c), filled(c), at))

    rules: dict[str, Column] = {}
    for c in records.columns:
        if c == key or c in order:
            continue
        if c in ("title", "authors"):
            there = filled(c) if c == "authors" else F.col(c).isNotNull() & ((F.col("_is_first") & (F.col(c) != "")) | (F.trim(c) != ""))
            rules[c] = preferred_text(F.col(c), there, zh, oa, at)
        elif c in ("abstract", "venue"):
            rules[c] = chinese_first(c)
        elif c == "year":
            rules[c] = first_where(F.col(c), F.col("_is_first") & (F.col(c) != 0) | (F.col(c) > 0) & (F.col(c) <= now), at)
        elif c == "citation_count":
            rules[c] = citation_count(F.col(c), oa, at)
        elif c == "referenced_works_count":
            rules[c] = F.nullif(F.max(c), F.lit(0))
        elif c in ("sources", "issns"):
            continue
        elif c in ("doi", "arxiv_id"):
            later = N.blank_to_null((N.doi if c == "doi" else N.arxiv_id)(F.col(c)))
            value = F.when(F.col("_is_first"), N.blank_to_null(F.col(c))).otherwise(later)
            rules[c] = first_where(value, value.isNotNull(), at)
        elif c in ("rcs", "rcs_reasoning", "rcs_flag"):
            rules[c] = F.min_by(c, F.when(F.col("rcs").isNotNull(), at))
        elif c in ("discovery_path", "journal_metric", "journal_rank"):
            rules[c] = F.min_by(c, at)
        else:
            rules[c] = first_where(F.col(c), filled(c), at)
    merged = rows.groupBy(key).agg(*[r.alias(c) for c, r in rules.items()])
    merged = _with_unions(merged, records, key, order, [c for c in ("sources", "issns") if c in records.columns])
    return merged.select(key, *[c for c in records.columns if c != key and c not in order])


def federate(lists: list[DataFrame], now: int = 2026, order: str | None = None) -> DataFrame:
    """Deduplicated records of ordered lists with the canonical fields: keys, conflict guard, field
    merge. A record that clashes with its key's base goes under the key and ``|v2``, ``|v3``, ...; those
    of one key with the same DOI and arXiv id are one.
    A list's records go by its column ``order``, which must be unique and isn't returned; without it as
    they are read, and the order in which Spark reads files isn't that of their names."""
    every = None
    for i, df in enumerate(lists):
        one = df.withColumns({"list_idx": F.lit(i), "pos": F.col(order) if order else F.monotonically_increasing_id()}).drop(*[order] if order else [])
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    named = {"doi": "doi", "arxiv": "arxiv_id", "pmid": "pmid", "openalex": "openalex_id", "ss": "ss_paper_id", "native": "source_native_id"}
    ids = {k: F.col(c) for k, c in named.items() if c in every.columns}
    keyed = every.withColumns({"key": canonical_key(ids, F.col("title"), F.col("year")), "_d": N.doi(ids["doi"]), "_a": N.arxiv_id(ids["arxiv"])})
    keyed = conflict_variants(keyed, "key", ["_d", "_a"], ["list_idx", "pos"])
    named_so = keyed.withColumn("_ids", F.concat_ws("\n", F.coalesce("_d", F.lit("")), F.coalesce("_a", F.lit("")))).drop("_d", "_a")
    apart = named_so.filter("variant > 1")
    same = apart.groupBy("key", "_ids").agg(F.min("variant").alias("variant"))
    keyed = named_so.filter("variant = 1").unionByName(apart.drop("variant").join(same, ["key", "_ids"])).drop("_ids")
    keyed = keyed.withColumn("key", F.when(F.col("variant") > 1, F.concat("key", F.lit("|v"), "variant")).otherwise(F.col("key"))).drop("variant")
    return merge_records(keyed, "key", ["list_idx", "pos"], now)


#: What a preprint's venue is called.
PREPRINT_VENUES = ("arxiv", "biorxiv", "medrxiv", "ssrn", "research square", "preprint", "preprints", "openreview")


def looks_preprint(venue: Column, kind: Column) -> Column:
    v = F.lower(F.coalesce(venue, F.lit("")))
    words = F.regexp_extract_all(v, F.lit(r"\w+"), 0)
    named = F.lit(False)
    for name in PREPRINT_VENUES:
        named = named | (F.array_contains(words, name) if name.startswith("preprint") else F.contains(v, F.lit(name)))
    return (v == "") | named | (F.lower(F.coalesce(kind, F.lit(""))) == "preprint")


def absorb_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """Guest records (native id ``openreview:``) go into their host (see ``absorb``): a preprint-like
    host takes the guest's venue and becomes an article; its sources and empty fields are filled."""
    guest = F.coalesce(F.col("source_native_id").startswith("openreview:"), F.lit(False))
    pairs = absorb(records, guest, "title", "year", order, looks_preprint(F.col("venue"), F.col("type")))
    found = pairs.join(records.select(F.col(order).alias("guest"), F.struct("venue", "abstract", "tldr", "sources", "keywords").alias("g")).hint("merge"), "guest")
    found = found.groupBy("host").agg(F.min_by("g", "guest").alias("g"))
    joined = records.join(found, records[order] == found["host"], "left")
    was = looks_preprint(F.col("venue"), F.col("type"))
    takes = F.col("g").isNotNull() & was & (F.col("g.venue") != "")
    out = joined.withColumns({
        "venue": F.when(takes, F.col("g.venue")).otherwise(F.coalesce(N.blank_to_null(F.col("venue")), F.col("g.venue"))),
        "type": F.when(takes & (F.lower("type") == "preprint"), F.lit("article")).otherwise(F.col("type")),
        "abstract": F.coalesce(N.blank_to_null(F.col("abstract")), F.col("g.abstract")),
        "tldr": F.coalesce(N.blank_to_null(F.col("tldr")), F.col("g.tldr")),
        "keywords": F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.coalesce("g.keywords", "keywords")),
        "sources": F.array_distinct(F.concat("sources", F.coalesce("g.sources", F.array()))),
    })
    return out.select(*records.columns).join(pairs.select(F.col("guest").alias(order)), order, "left_anti").select(*records.columns)


def distinct_by_first_key(rows: DataFrame, keys: list[Column], order: list[str], keep: Column | None = None) -> DataFrame:
    """The first row of each key, a row's key being the first of ``keys`` it has; rows that ``keep``
    rejects go before, rows without a key all stay."""
    kept = rows if keep is None else rows.filter(F.coalesce(keep, F.lit(False)))
    marked = kept.withColumn("_k", F.coalesce(*keys))
    w = Window.partitionBy("_k").orderBy(*order)
    known = marked.filter(F.col("_k").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return known.unionByName(marked.filter(F.col("_k").isNull())).drop("_k")


def distinct_by_any_key(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The rows that are left when, in their order, each is dropped that has the ``a`` or the ``b`` of a
    row kept before it (a null equals a null). ``order`` must be unique."""
    at = F.struct(*order)
    value = lambda c: F.struct(F.lit(c).alias("of"), F.col(c).isNull().alias("none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("is"))
    members = rows.select(at.alias("item"), F.explode(F.array(value(a), value(b))).alias("group"))
    kept = decided(members, "group", "item").filter("kept").select("item")
    return rows.withColumn("_item", at).join(kept, F.col("_item") == F.col("item"), "left_semi").drop("_item")


def display_order(records: DataFrame, by: str, tie: str) -> DataFrame:
    """Records by citation_count, year or influential_citation_count, largest first, then by ``tie``."""
    return records.orderBy(F.desc(F.coalesce(F.col(by), F.lit(0)).alias("by")), tie)


def match_known(raw: DataFrame, raw_id: str, keys: str, known: DataFrame, known_key: str, known_keys: str) -> DataFrame:
    """raw_id and key: the known record that the first unambiguous key of a raw record points at, else
    the raw record's own first key. Identifiers that two known records share point at none."""
    owners = known.select(F.col(known_key).alias("key"), F.explode(known_keys).alias("k")).distinct()
    clear = owners.groupBy("k").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").drop("n")
    each = raw.select(F.col(raw_id).alias("id"), F.posexplode(keys).alias("pos", "k"))
    hit = each.join(clear, "k").groupBy("id").agg(F.min_by("key", "pos").alias("key"))
    own = raw.filter(F.size(keys) > 0).select(F.col(raw_id).alias("id"), F.col(keys)[0].alias("own"))
    return own.join(hit, "id", "left").select(F.col("id").alias(raw_id), F.coalesce("key", "own").alias("key"))
