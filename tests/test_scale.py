"""What larger tables and odd rows have shown: plans, chains, ties, keys."""

import duckdb
from pyspark.sql import functions as F

from recordloom import registry
from recordloom.operators import graph, index, rank, resolve, verify
from recordloom.plans import intent, strategy
from recordloom.sources import bundle, converters


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_similar_titles_broadcasts_no_sets(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")  # a small estimate
    rows = spark.read.parquet(f"{tmp_path}/t").select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(9)]).alias("t"))
    out = verify.similar_titles(rows, rows.withColumnsRenamed({"id": "r", "t": "rt"}), "id", "r", "t", "rt")
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(i, i, 1.0) for i in range(50)]


def test_journals_of_one_long_chain(spark):
    # every row shares an ISSN with the one before and has one of its own; 2 joins 1 and takes i0 along
    rows = spark.range(400).select("id", F.when(F.col("id") < 2, F.array(F.concat(F.lit("i"), "id"))).otherwise(F.array(F.concat(F.lit("i"), F.col("id") - 1), F.concat(F.lit("i"), F.col("id") - 2), F.concat(F.lit("i"), "id"), F.lit(None))).alias("issns"))
    table = rank.greedy_table([("p", "t", [x for x in r["issns"] if x]) for r in rows.orderBy("id").collect()])
    out = rank.journals(rows, "id", "issns")
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    got = dict(map(tuple, out.collect()))
    assert len(got) == 400 and got[0] == 0 and {got[n] for n in range(1, 400)} == {1} and set(table.values()) == {1}


def test_guests_and_hosts_of_one_title_are_not_paired(spark):
    rows = spark.range(60000).select("id", F.lit("One title").alias("t"), (2000 + F.col("id") % 3).alias("y"))
    out = resolve.absorb(rows, F.col("id") % 2 == 1, "t", "y", "id", F.col("id") % 10 == 4)
    wide = [line for line in plan(out).split("\n") if "Join" in line]
    assert len(wide) == 1 and "abs(" not in wide[0]  # 900 million pairs otherwise
    assert out.count() == 30000
    best = {r["guest"]: r["host"] for r in out.filter("guest < 7").collect()}
    assert best == {1: 4, 3: 4, 5: 4}


def with_documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


def test_canonical_key_of_odd_titles_equals_sql(spark, tmp_path):
    odd = [None, "", "!!!", "Привет", "(only)", "Title (x)", "Title (x)\x0b", "Title (x)\u0085", "Title (x) \r"]
    sf, con = with_documents(spark, tmp_path, [(3 * i + k, t, "en", "src1", 5) for i, t in enumerate(odd) for k in range(3)])
    got = registry.QUERIES["q_canonical_key"](spark, sf).orderBy("doc_id").collect()
    cur = con.execute(f"SELECT doc_id, key FROM ({registry.SQL['q_canonical_key']}) ORDER BY doc_id")
    assert [tuple(r) for r in got] == cur.fetchall()


def test_exported_places_are_settled_by_the_last_tie(spark):
    rows = spark.range(300).select((F.lit(299) - F.col("id")).alias("n"), F.lit("10.5/1").alias("paper_id"), F.lit(9).alias("rcs"), F.lit(1).alias("citation_count")).repartition(7)
    out = bundle.exported(rows, 8, ("paper_id", "n"))
    assert all(r["place"] == r["n"] + 1 for r in out.collect())


def test_sketched_yield_is_exact_beyond_a_sketch(spark):
    rows = spark.range(60_000).select((F.col("id") % 4).alias("l"), (F.col("id") * 31 % 40_009).alias("k"))
    plain_ = {r["list"]: r["new_keys"] for r in resolve.marginal_yield(rows, "l", "k").collect()}
    got = resolve.sketched_yield(rows, "l", "k", 8).orderBy("list").collect()  # 256 hashes a sketch
    assert {r["list"]: r["new_keys"] for r in got} == plain_ and got[-1]["total"] == 40_009


def test_federate_goes_by_its_order_and_joins_equal_ids(spark):
    kind = "n int, doi string, arxiv_id string, openalex_id string, title string, year int, citation_count long, sources array<string>, rcs int"
    rows = [(3, "d", "a2", None, "t", 2000, 3, ["x"], None), (2, "d", "a2", None, "t", 2000, 2, ["x"], None), (1, "d", "a1", None, "t", 2000, 1, ["x"], None)]
    out = resolve.federate([spark.createDataFrame(rows, kind)], order="n")
    assert sorted((r["arxiv_id"], r["citation_count"]) for r in out.collect()) == [("a1", 1), ("a2", 2)] and "n" not in out.columns


def test_federate_and_source_dedup_of_long_ids_equal_sql(spark, tmp_path):
    ids = [2275, 2475, 22475, 22755, 100005, 100009, 100010, 100015, 100405, 224755]
    sf, con = with_documents(spark, tmp_path, [(i, f"t{i}", "en", "src1", i % 1000) for i in ids])
    for name, columns in (("q_source_dedup", "doc_id"), ("q_federate", "doi, arxiv_id, citation_count, listed")):
        got = sorted((tuple(r) for r in registry.QUERIES[name](spark, sf).selectExpr(*columns.split(", ")).collect()), key=repr)
        assert got == sorted(con.execute(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall(), key=repr)


def test_neighbours_are_limited_before_they_move(spark):
    edges = spark.createDataFrame([(1, n) for n in range(9, 1, -1)] + [(1, 2), (1, 2), (3, 1), (4, 1)], "src int, dst int")
    out = graph.neighbours(edges, spark.createDataFrame([(1,)], "n int"), "n", 2, 1)
    assert plan(out).count("WindowGroupLimit") == 4  # before and after the shuffle, in both directions
    assert sorted((r["neighbour"], r["direction"]) for r in out.collect()) == [(2, "references"), (3, "cited_by"), (3, "references")]


def test_expand_makes_no_edge_distinct(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (5, 6)], "src int, dst int")
    out = graph.expand(edges, spark.createDataFrame([(1,)], "n int"), "n", 2)
    assert "Aggregate" not in plan(out).split("Scan parquet")[-1] and sorted(map(tuple, out.collect())) == [(1, 0), (2, 1), (3, 2)]
    assert "keys=[src" not in plan(out)


def test_rows_that_take_long_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select("id", F.lit("sleep Q2").alias("q"), F.lit("b").alias("b"), F.lit(2).alias("gap"))
    at_least = spark.sparkContext.defaultParallelism
    assert intent.parse_frame(rows, "q").select(F.spark_partition_id()).distinct().count() >= at_least
    made = strategy.compile_frame(rows, "id", ["q", "b"], "b", "gap")
    assert made.select(F.spark_partition_id()).distinct().count() >= at_least and made.count() == 800


def test_postings_are_made_within_rows(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "x")], "id int, t string").select("id", F.regexp_extract_all("t", F.lit(r"\w+"), 0).alias("w"))
    out = rows.select("id", F.explode(index.postings(F.col("w"))).alias("p")).select("id", "p.*")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a", [1]), (1, "b", [0, 2]), (4, "x", [0])]
    twice = spark.createDataFrame([(1, "a b"), (1, "b a a")], "id int, t string")
    assert sorted((r["term"], r["places"]) for r in index.build(twice, "id", ["t"]).collect()) == [("a", [0, 1, 2]), ("b", [0, 1])]


def test_invert_moves_no_words(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, None)], "id int, t string")
    out = converters.invert(rows, "id", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, out.collect())) == {1: {"a": [1], "b": [0, 2]}, 2: None}
