"""Verification: markers, reference lookup by source priority, title similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import normalize as N


def markers(doi: Column, abstract: Column, sources: Column) -> dict[str, Column]:
    has_doi, has_abstract, multi = F.coalesce(doi != "", F.lit(False)), F.coalesce(abstract != "", F.lit(False)), F.coalesce(F.size(sources) > 1, F.lit(False))
    flags = F.array_compact(F.array(F.when(~has_doi, "no_doi"), F.when(~has_abstract, "no_abstract"), F.when(~multi, "single_source")))
    return {"has_doi": has_doi, "has_abstract": has_abstract, "multi_source": multi, "flags": flags}


def by_priority(refs: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """refs with matched_source (the first source, in order, that has the key) and found."""
    out = refs
    for name, table, column in sources:
        known = table.select(F.col(column).alias(key)).distinct().withColumn(f"_in_{name}", F.lit(name))
        out = out.join(known, key, "left")
    hits = [F.col(f"_in_{name}") for name, _, _ in sources]
    return out.withColumn("matched_source", F.coalesce(*hits)).withColumn("found", F.col("matched_source").isNotNull()).drop(*[f"_in_{n}" for n, _, _ in sources])


def passages_found(gold: DataFrame, item: str, passage: str, docs: DataFrame, key: str, text: str, chars: int = 12) -> DataFrame:
    """item and found: in how many texts each passage stands, as plain text.

    A passage of ``chars`` or more holds one whole block of that many characters at a multiple of it
    in the text, or so do its shifts: the passage's windows meet the text's blocks by hash within each
    row's array, which only keeps blocks that some passage has. Shorter passages are looked for in
    every text: they and the windows' hashes are bounded by the gold set, which is broadcast up to
    Spark's limit."""
    long_, short = gold.filter(F.length(passage) >= 2 * chars), gold.filter(F.length(passage) < 2 * chars)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"))
    # chars windows of a passage cover every alignment: one of them is a whole block of the text
    windows = long_.select(F.col(item).alias("i"), F.col(passage).alias("p"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(chars)), lambda s: F.xxhash64(F.substr(F.col(passage), s, F.lit(chars))))).alias("h")).distinct()
    blocks = F.array_distinct(F.transform(F.regexp_extract_all("x", F.lit(f"(?s).{{{chars}}}"), 0), lambda b: F.xxhash64(b)))
    each = rows.select("k", F.explode(blocks).alias("h")).join(windows.select("h").distinct(), "h", "left_semi")
    pairs = each.join(windows, "h").select("k", "i", "p").distinct()
    hits = rows.join(pairs, "k").filter(F.contains("x", "p")).select("k", "i").distinct()
    few = short.select(F.col(item).alias("i"), F.col(passage).alias("p")).filter("p <> ''")
    if not few.isEmpty():
        hits = hits.unionByName(rows.join(few, F.contains("x", "p")).select("k", "i").distinct())
    blank = gold.filter(F.col(passage) == "")
    counts = hits.groupBy("i").agg(F.count("*").alias("found"))
    if not blank.isEmpty():  # stands everywhere
        counts = counts.unionByName(blank.select(F.col(item).alias("i")).crossJoin(rows.agg(F.count("x").alias("found"))))
    return gold.select(F.col(item).alias("i")).join(counts, "i", "left").fillna(0, ["found"]).withColumnRenamed("i", item)


def similar_titles(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, at_least: float = 0.85) -> DataFrame:
    """The best right row of each left row by the Jaccard similarity of significant tokens.

    Equal token sets are one node. A prefix filter: sets that similar share one of the rarest
    n - ceil(at_least n) + 1 tokens, so only those are joined; a pair must also be of fitting sizes,
    and what follows the shared tokens must leave room. The whole sets decide, within the join. Ties
    go to the smaller right id."""
    a = left.select(F.col(left_id).alias("id"), F.array_sort(N.significant_tokens(F.col(left_text))).alias("ts")).filter(F.size("ts") > 0)
    b = right.select(F.col(right_id).alias("id"), F.array_sort(N.significant_tokens(F.col(right_text))).alias("ts")).filter(F.size("ts") > 0)
    one, other = a.select("ts").distinct(), b.groupBy("ts").agg(F.min("id").alias("r"))
    often = other.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("f"))

    def posted(rows: DataFrame, *kept: str) -> DataFrame:
        each = rows.select("ts", *kept, F.explode("ts").alias("t")).join(often.hint("merge"), "t", "left").groupBy("ts", *kept).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("all"))
        room = F.size("all") - F.ceil(F.lit(at_least) * F.size("all")).cast("int") + 1
        return each.select("ts", *kept, F.size("ts").alias("n"), F.posexplode(F.slice("all", F.lit(1), room).getField("t")).alias("at", "t"))

    x, y = posted(one).alias("x"), posted(other, "r").alias("y")
    need = F.lit(at_least) / (1 + F.lit(at_least)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    fits = (F.least("x.n", "y.n") >= at_least * F.greatest("x.n", "y.n")) & (1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) - 1 >= need)
    shared = F.size(F.array_intersect("x.ts", "y.ts"))
    ratio = shared / (F.col("x.n") + F.col("y.n") - shared)
    pairs = x.join(y.hint("merge"), (F.col("x.t") == F.col("y.t")) & F.when(fits, ratio >= at_least)).select("x.ts", F.col("y.r").alias("r"), ratio.alias("similarity"))
    best = pairs.groupBy("ts").agg(F.max("similarity").alias("similarity"), F.min_by("r", F.struct(-F.col("similarity"), "r")).alias("r"))
    return a.join(best.hint("merge"), "ts").select(F.col("id").alias(left_id), F.col("r").alias(right_id), "similarity")
