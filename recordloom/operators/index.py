"""A positional inverted index over the texts of a corpus, as a table.

``build`` gives a row for each word and record, with the word's places in the record's joined texts
(see ``search.matches``). The table is written in parts by the word's hash, sorted by word, so that a
query reads the parts of its own words and in them, by the statistics of Parquet, their row groups.
A word's rows lie in several files, by the record's hash: one that most records have is read and
written by several tasks. ``matching`` then answers a query from postings alone: it gathers, for each
record, the places of the query's words, and checks phrases on them. No text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import retrieve, search
from recordloom.scratch import cut

WORD = r"[\p{L}\p{N}]+"
PARTS, FILES = 64, 4


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def postings(words: Column) -> Column:
    """term and places (ascending) of each distinct word of an array, within its row: words are sorted
    with their places and cut where the word changes."""
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place"))))

    def runs(rows: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.coalesce(F.get(rows, i)["term"] != F.get(rows, i - 1)["term"], F.lit(True)))
        one = lambda all_: F.transform(all_, lambda a, k: F.struct(F.get(rows, a)["term"].alias("term"), F.transform(F.slice(rows, a + 1, F.coalesce(F.get(all_, k + 1), F.size(rows)) - a), lambda x: x["place"]).alias("places")))
        return bound(begins, one)

    return F.when(F.size(words) > 0, bound(placed, runs))


def build(corpus: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """part, term, key and places (ascending) of each word in each record. Texts that are null have no
    words; records of one key are one."""
    joined = F.lower(F.concat_ws(" \n ", *[F.col(c) for c in texts]))
    words = F.regexp_extract_all(joined, F.lit(WORD), 0)
    found = corpus.select(F.col(key).alias("key"), F.explode(postings(words)).alias("p")).select("key", "p.term", "p.places")
    if not corpus.groupBy(key).count().filter("count > 1").isEmpty():
        found = found.groupBy("key", "term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    rows = found.withColumn("part", _part(F.col("term")))
    dealt = rows.repartition(PARTS, "part", F.pmod(F.xxhash64("key"), F.lit(FILES))).sortWithinPartitions("part", "term", "key")
    return cut(dealt.select("term", "key", "places", "part"), "postings", by=["part"])


def matching(index: DataFrame, query: str) -> DataFrame:
    """key of the records that match ``query``, as ``search.matches`` has it."""
    words = lambda term: [w for w in search.words_of(term)]
    groups = [[words(t) for t in g if words(t)] for g in search.query_groups(query)]
    terms = sorted({w for g in groups for t in g for w in t})
    if not terms or not all(groups):
        return index.select("key").limit(0)
    spark = index.sparkSession
    parts = [r["p"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t")).alias("p")).distinct().collect()]  # of a query's words
    read = index.filter(F.col("part").isin(parts) & F.col("term").isin(terms))
    at = {t: f"t{i}" for i, t in enumerate(terms)}
    held = read.groupBy("key").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(c) for t, c in at.items()])

    def has(term: list[str]) -> Column:
        rest = [(i, at[w]) for i, w in enumerate(term)][1:]
        if not rest:
            return F.col(at[term[0]]).isNotNull()

        def follows(p: Column) -> Column:
            out = F.lit(True)
            for i, c in rest:
                out = out & F.array_contains(F.col(c), p + i)
            return out

        return F.coalesce(F.exists(at[term[0]], follows), F.lit(False))

    fits = F.lit(True)
    for g in groups:
        one = F.lit(False)
        for t in g:
            one = one | has(t)
        fits = fits & one
    return held.filter(fits).select("key")


def crawl(corpus: DataFrame, index: DataFrame, key: str, query: str, n: int, order: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The first ``n`` matches by ``order``, largest first, then by key: ``search.crawl`` for citations and
    dates. Only the key, the year and the order are read before the last step."""
    narrow = corpus.filter(retrieve.in_years(F.col("year"), low, high)).select(F.col(key).alias("key"), F.col(order).alias("by"))
    first = narrow.join(matching(index, query), "key").orderBy(F.desc("by"), "key").limit(n)
    return corpus.join(F.broadcast(first.select(F.col("key").alias(key))), key, "left_semi").orderBy(F.desc(order), key)  # n rows
