"""Search, enrichment, bundle and driver-side helpers on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordloom import registry_records as R
from recordloom.operators import coverage, enrich, rank, report, resolve, search
from recordloom.plans import compose
from recordloom.sources import bundle, plans, ranks, sinks, venues
from recordloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_search_runs_end_to_end(spark):
    o = search.Options(today=R.TODAY, per_strategy=20, limit=15, rank_platform="sjr", keep_tiers=[1, 2], max_deepen_rounds=1, min_relevance=0.05)
    found = search.search(R.corpus(spark, SF), R.LOOSE, o, R._rank_structs(spark, SF))
    rows = found["data"].orderBy("place").collect()
    assert rows and all(r["outcome"] == "kept" and r["score"] >= 0.05 for r in rows)
    assert [r["citation_count"] for r in rows] == sorted((r["citation_count"] for r in rows), reverse=True)
    f = found["funnel"].first()
    assert f["retrieved_raw"] >= f["deduplicated"] >= f["relevant"] >= f["journal_passed"] >= f["rank_passed"] >= f["returned"] == len(rows)
    assert found["plan"]["deepen_rounds"] <= 1 and found["language"] is None
    assert search.search(R.corpus(spark, SF), "学习", search.Options(today=R.TODAY))["language"]["ambiguous"]


@pytest.mark.parametrize("low", [None, 2025])
def test_legs_of_any_depth_come_from_those_ranked_once(spark, low):
    docs = R.corpus(spark, SF)
    ranked = search.ranked_legs(docs, R.LOOSE, 40, R.TODAY, low)
    rows = lambda df: sorted(df.select("leg", "depth", "paper_id").collect())
    for n in (1, 7):
        assert rows(search.at_depth(ranked, n)) == rows(search.legs(docs, R.LOOSE, n, R.TODAY, low)) != []
    assert not rows(search.ranked_legs(docs.limit(0), R.LOOSE, 5, R.TODAY)) and not rows(search.ranked_legs(docs, R.LOOSE, 5, R.TODAY, 2030))


def test_text_filter_with_nulls(spark):
    rows = spark.createDataFrame([(1, "A Xy", None, [("Bo",)]), (2, None, None, None), (3, None, "b", [(None,), ("oxY",)]), (4, "", "", [])], "id int, title string, tldr string, authors array<struct<name:string>>")
    assert [r["id"] for r in rows.filter(search.shows("XY", ["title", "tldr"], "authors")).orderBy("id").collect()] == [1, 3]
    assert rows.filter(~search.shows("XY", ["title", "tldr"], "authors")).count() == 2


def test_query_groups():
    assert search.query_groups('("short video" OR TikTok) AND attention span') == [["short video", "tiktok"], ["attention"], ["span"]]


def test_language_and_source_plans():
    assert search.language_plan("x", None, "auto", ["nssd"])["scope_used"] == "both"
    assert search.language_plan("机器", "en", "zh", [])["scope_source"] == "flags"
    assert search.source_plan("auto", {"ok": True, "remaining_usd": 0.01}) == ("semantic_scholar", True)
    assert search.source_plan("auto", {"ok": False, "remaining_usd": None}) == ("openalex", False)


def test_merge_keeps_first_record_and_unguarded_year(spark):
    rows = spark.createDataFrame([("k", 0, "", 2031, 0, ["arxiv"], None, "p0"), ("k", 1, "t", 2020, 4, ["openalex"], 7, "p1")], "key string, pos int, title string, year int, citation_count int, sources array<string>, rcs int, discovery_path string")
    r = resolve.merge_records(rows, "key", ["pos"]).first()
    assert (r["title"], r["year"], r["citation_count"], r["sources"], r["rcs"], r["discovery_path"]) == ("t", 2031, 4, ["arxiv", "openalex"], 7, "p0")


def test_numbering_has_no_gaps(spark):
    got = resolve.numbered(spark.range(1000).repartition(7).withColumn("o", F.struct("id")), "o", "n").collect()
    assert all(r["n"] == r["id"] + 1 for r in got)


def test_rank_rules(spark):
    cats = F.array(F.struct(F.lit("").alias("category"), F.lit("Q1").alias("quartile")), F.struct(F.lit("Art and Law").alias("category"), F.lit("Q2").alias("quartile")))
    assert spark.range(1).select(rank.pinned(cats, "law")["quartile"].alias("q")).first()["q"] == "Q2"
    assert rank.greedy_table([("cas", "A", ["1"]), ("jcr", "B", ["2"]), ("sjr", "AB", ["1", "2"]), ("sjr", "C", ["2"])]) == {"1": 0, "2": 0}


def test_match_known_ignores_shared_identifiers(spark):
    known = spark.createDataFrame([("k1", ["t|x", "doi|1"]), ("k2", ["t|x"])], "key string, keys array<string>")
    raw = spark.createDataFrame([(1, ["t|x"]), (2, ["t|x", "doi|1"]), (3, [])], "raw int, keys array<string>")
    got = {r["raw"]: r["key"] for r in resolve.match_known(raw, "raw", "keys", known, "key", "keys").collect()}
    assert got == {1: "t|x", 2: "k1"}


def test_abstract_fallback_and_selection(spark):
    row = spark.range(1).select(enrich.abstract_fallback(F.lit(""), F.lit(None).cast("string"), F.lit("t")).alias("a"), enrich.selected(F.lit(None).cast("int"), 5).alias("s")).first()
    assert (row["a"], row["s"]) == ("t", False)


def test_bootstrap_is_near_the_point(spark):
    rows = spark.createDataFrame([(d, k) for d in range(6) for k in range(40) if (k * 7 + d * 3) % 5 < 2], "day int, key int")
    r = coverage.bootstrap_interval(rows, "day", "key").first()
    assert 0 <= r["lower"] <= r["coverage"] <= r["upper"] <= 1


def test_snapshot_falls_back_to_the_prior(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "day int, key string")
    scores = spark.createDataFrame([("a", 9), ("b", 3)], "key string, rcs int")
    r = coverage.banded_snapshot(rows, "day", "key", scores, 40).first()
    assert r["method"] == "prior" and r["relevance_band"] is None and r["coverage_estimate"] == pytest.approx(0.393, abs=1e-3)


def test_bundle_exports_and_report(spark):
    rows = R.corpus(spark, SF).filter("doc_id < 60").withColumn("topics", F.array("venue"))
    files = bundle.export_files(rows, 8)
    assert files["papers.csv"].startswith("\ufeffpaper_id,title") and len(json.loads(files["papers.json"])) == files["papers.bib"].count("\n}\n")
    assert files["papers.ris"].count("ER  - ") == len(json.loads(files["papers.json"])) > 0
    out = bundle.report_bundle(rows, {"coverage_estimate": 0.5, "ci_lower": 0.4, "ci_upper": 0.6, "method": "sample_coverage"}, topic="t", seconds=3.21)
    assert set(out) == {"chart_data", "paper_list", "metadata", "prisma_log", "report_data"}
    assert len([k for k in out["prisma_log"] if k[0].isdigit()]) == 16
    assert out["metadata"]["papers_evaluated"] == len(out["paper_list"]) and out["metadata"]["wall_clock_total_s"] == 3.2
    scores = [r["rcs"] or 0 for r in out["paper_list"]]
    assert scores == sorted(scores, reverse=True) and out["chart_data"]["theme_treemap"]["themes"]
    assert "This report addresses: _t_" in bundle.markdown(out)
    one = json.loads(bundle.collection_json(spark.createDataFrame([("k", "t", None, 3)], "key string, title string, issn string, citation_count int"), "key").first()["value"].join("{}"))
    assert one == {"k": {"title": "t", "citation_count": 3}}


def test_method_log_takes_plan_and_strategies(spark):
    rows = spark.createDataFrame([([], "cites X", 3)], "sources array<string>, discovery_path string, rcs int")
    log = bundle.method_log(rows, plan={"strategies": [{"query": "q", "engine": "both"}], "year_min": 2020})
    assert log["1_database_information"]["databases"] == ["openalex", "semantic_scholar"] and log["9_limits_and_restrictions"]["filters_applied"] == ["publication_year 2020-"]
    assert [b["text"] for b in log["8_full_search_strategies"]["boolean_expressions"]] == ["q"]
    assert bundle.audit_status(log["6_contacts"]) == "skipped" and bundle.audit_status(log["2_multi_database_searching"]) == "performed" and bundle.audit_status(log["16_record_management"]) == "implicit"
    assert bundle.stop_reason(papers=5, most_papers=5) == "budget_max_papers (5)" and bundle.stop_reason() == "complete"
    assert bundle.wall_clock(None, "2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1, 0, 1)) == 60


def test_cache_expires_and_evicts(spark, tmp_path):
    import time

    at = [time.time()]
    cache = bundle.Cache(spark, str(tmp_path), days=1, most_bytes=1, now=lambda: at[0])
    cache.put({"q": 1}, spark.range(3))
    assert cache.get({"q": 1}).count() == 3
    cache.put({"q": 2}, spark.range(4))  # no room for both: the one used last stays
    assert cache.get({"q": 1}) is None and cache.get({"q": 2}).count() == 4
    at[0] += 2 * 86400
    assert cache.get({"q": 2}) is None


def test_rank_files_may_be_missing_or_stale(spark, tmp_path):
    (tmp_path / "sjr.csv").write_text("Title;Issn;SJR;SJR Best Quartile;Categories\nA;00280836;1,5;Q1;Art (Q1)\n")
    (tmp_path / "cas.csv").write_text("")
    files = {n: str(tmp_path / f"{n}.csv") for n in ("cas", "jcr", "sjr")}
    readers = {"cas": ranks.read_cas, "jcr": ranks.read_jcr, "sjr": ranks.read_sjr}
    today = dt.date.today()
    assert set(bundle.rank_tables(spark, files, readers, today)) == {"sjr"}
    assert not bundle.rank_tables(spark, files, readers, today + dt.timedelta(days=400))


def test_jcr_table(spark, tmp_path):
    (tmp_path / "jcr.csv").write_text("Journal,ISSN,eISSN,IF(2023),IF Quartile(2023),Category\nA,0028-0836,1476-4687,\"1,234.5\",Q1,Law\nB,1111-1111,,N/A,,Art\n")
    got = {r["issn"]: r for r in ranks.read_jcr(spark, str(tmp_path / "jcr.csv")).collect()}
    assert got["1476-4687"]["impact_factor"] == 1234.5 and got["0028-0836"]["quartile"] == "Q1" and got["1111-1111"]["impact_factor"] is None


def test_input_files():
    assert compose.references('{"refs": ["t", {"doi": "d"}, 3]}') == [{"title": "t"}, {"doi": "d"}, {"raw": 3}]
    assert compose.pool_counts('{"count": 3, "year_min": "2020", "year_max": 2021}') == {"count": 3, "year_min": 2020, "year_max": 2021}
    assert compose.pool_counts('{"count": null, "year_min": 1, "year_max": 2}') is None
    got = compose.card("# x\n```yaml\nhost: pubmed\ntags: [a, b]\nlist:\n  - one\nmap:\n  k: 2 # note\n```\n```yaml\nhost: no\n```")
    assert got == {"host": "pubmed", "tags": ["a", "b"], "list": ["one"], "map": {"k": 2}}
    assert compose.host_name("Web of Science") == "wos" and compose.merged_config({"a": 1, "b": 2}, {"a": None, "b": 3, "c": 4}) == {"a": 1, "b": 3}


def test_plans_as_tables(spark):
    texts = [
        ("a", '[{"text": "x", "source": "s", "filters": ["f"]}, {"query": "y"}]'),
        ("b", '{"queries": [{"query": "q", "engine": "both", "filters": "g"}], "year_range": {"max": 2024}, "rank_filter": {"platform": "jcr", "quartiles": ["Q1", "Q2"], "top": true}, "work_type_filter": " review "}'),
        ("c", '{"search_topic": "t", "year_min": 2020, "year_max": 2021}'),
        ("d", '{"search_topic": "t"}'),
        ("e", "not json"),
        ("f", None),
    ]
    planned = plans.strategies(spark.createDataFrame(texts, "id string, json string"), "id", "json")
    got = [(r["plan"], r["text"], r["source"], r["filters"]) for r in planned.orderBy("plan", "place").collect()]
    assert got == [("a", "x", "s", ["f"]), ("a", "y", None, []), ("b", "q", "both", ["g", "publication_year -2024", "journal rank: JCR top Q1,Q2", "work type: review"]), ("c", "t", None, ["publication_year 2020-2021"])]
    exported = spark.createDataFrame([("a", "pubmed", None, "x[tiab]", "none", None, "verified"), ("a", "wos", "WoS", None, None, "f", None)], "plan string, platform string, host string, expression string, limits string, filter string, status string")
    listed = plans.expressions(planned, exported).filter("plan = 'a'").collect()
    assert sorted((r["origin"], r["expression"] or "", r["withheld"]) for r in listed) == [("exported", "", True), ("exported", "x[tiab]", False), ("planned", "x", False), ("planned", "y", False)]


def test_status_and_floor():
    assert compose.status_kind("unverified") == "unverified" and compose.status_kind("verified-ish") == "unknown"
    assert compose.floor_model("q", [["a", " "], []]) == {"blocks": [{"id": "B1", "terms": ["a"]}], "operator_logic": "B1"}
    assert compose.floor_hosts(None, {"query_lang": "zh"}, None) == ["pubmed", "wos", "cnki"]
    press = compose.press_check([("L1", "error", "open")], "downgraded")
    assert press["boolean"]["verdict"] == "warning" and compose.review_points(press, ["p"]) == ["p", "downgraded", "L1: open"] or press
    assert compose.strategies_markdown("t", [{"host": "pubmed", "status": "ready", "query": "q", "link": None, "reasons": [], "review": ["r"]}]).count("##") == 1


def test_services():
    waits, answers = [], [compose.HttpError(429, {"Retry-After": "3"}), compose.HttpError(503), "fine"]

    def fetch():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert compose.call(fetch, waits.append) == "fine" and waits == [3, 2]
    answers[:] = [compose.HttpError(429, {"X-RateLimit-Remaining-USD": "0", "X-RateLimit-Reset": "4000"})]
    with pytest.raises(compose.Unavailable, match="resets in 1h06m"):
        compose.call(fetch, waits.append)
    with pytest.raises(compose.HttpError):
        answers[:] = [compose.HttpError(404)]
        compose.call(fetch, waits.append)
    assert compose.pages(lambda p: [{"id": 2 * p}, {"id": 2 * p + 1}] if p < 3 else [{"id": 9}], 10, 2) == [{"id": i} for i in (2, 3, 4, 5, 9)]
    assert compose.fetch_batches(["a", "b", "c"], lambda ids: [{"id": i} for i in ids], 2) == [{"id": i} for i in "abc"]

    def broken():
        raise compose.Unavailable("down", [{"id": 1}])

    got = compose.serve(broken, lambda: [{"id": 1}, {"id": 2}, {"id": 2}], "id")
    assert got["data"] == [{"id": 1}, {"id": 2}] and got["kept_partial"] == 1
    assert compose.envelope(error="network", empty={"references": []})["data"] == {"references": []} and compose.envelope([1])["ok"]
    assert compose.should_switch(compose.quota({"X-RateLimit-Remaining-USD": "0.01"}), "run") and not compose.should_switch(compose.quota({}), "run")
    assert compose.percent(None) == "n/a" and compose.duration(59) == "0m"


def test_new_records_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.new_records(spark, str(tmp_path / "in"), "key string, at timestamp", "key", "at")
    q = ingest.start(stream, str(tmp_path / "cp"), lambda df, i: seen.extend(r["key"] for r in df.collect()))
    q.awaitTermination(60)
    assert sorted(seen) == ["a", "b"]


def test_themes_fall_back_to_all(spark):
    rows = spark.createDataFrame([("p1", ["a"]), ("p2", ["b"])], "paper_id string, keywords array<string>")
    assert report.theme_list(rows, "paper_id") == [{"name": "All papers", "value": 2, "paper_ids": ["p1", "p2"]}]


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 30], [10, 20, 40, 41]])
def test_streamed_merge_equals_one_batch(spark, tmp_path, cuts):
    """Any split of the lists, through a stream of files, gives what one merge gives."""
    rows = [(f"k{i * 7 % 23}", i // 12, i, ["", f"t{i}"][i % 2], 2000 + i % 40, i * 5 % 9, ["openalex", "nssd", "arxiv", "crossref"][i * i % 4 : i * i % 4 + 1 + i % 2]) for i in range(60)]
    kind = "key string, list_idx int, pos int, title string, year int, citation_count long, sources array<string>"
    edges = [0, *cuts, 60]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], kind).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    merged = ingest.Merged(f"{tmp_path}/state", "key", ["list_idx", "pos"])
    for n in range(len(edges) - 1):
        merged.add(spark.read.parquet(f"{tmp_path}/in/b{n}"), n)
        merged.add(spark.read.parquet(f"{tmp_path}/in/b{n}"), n)  # a repeated batch counts once
    whole = spark.createDataFrame(rows, kind)
    names = ["key", "title", "year", "citation_count", "sources"]
    want = sorted(tuple(map(str, r)) for r in resolve.merge_records(whole, "key", ["list_idx", "pos"]).select(names).collect())
    assert sorted(tuple(map(str, r)) for r in merged.records(spark, len(edges) - 2).select(names).collect()) == want
    got = {r["list"]: r["new_keys"] for r in merged.marginal_yield(spark, len(edges) - 2).collect()}
    assert got == {r["list"]: r["new_keys"] for r in resolve.marginal_yield(whole, "list_idx", "key").collect() if r["new_keys"]}


def test_streamed_merge_through_a_stream(spark, tmp_path):
    rows = [("a", 0, 0, "t", ["x"]), ("b", 0, 1, "", ["openalex"]), ("b", 1, 0, "u", ["nssd"])]
    kind = "key string, list_idx int, pos int, title string, sources array<string>"
    for n in range(3):
        spark.createDataFrame(rows[n : n + 1], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merged = ingest.Merged(f"{tmp_path}/state", "key", ["list_idx", "pos"])
    ingest.start(stream, f"{tmp_path}/check", merged.add).awaitTermination()
    got = {r["key"]: (r["title"], r["first_list"]) for r in merged.records(spark, 2).collect()}
    assert got == {"a": ("t", 0), "b": ("u", 0)}


@pytest.mark.parametrize("least", [8, 99])
def test_written_exports_equal_the_collected_ones(spark, tmp_path, least):
    odd = F.when(F.col("doc_id") % 3 == 0, 'a "b", c').when(F.col("doc_id") % 3 == 1, "one\ntwo; é").otherwise(F.col("title"))
    rows = R.corpus(spark, SF).filter("doc_id < 120").withColumn("topics", F.array("venue")).withColumn("title", odd).repartition(7)
    want = bundle.export_files(rows, least)
    bundle.write_exports(rows, str(tmp_path), least)
    assert {p.name: p.read_bytes().decode() for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {n: t.encode().decode() for n, t in want.items()}


def test_single_file_in_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n")).repartition(9).select("n", F.col("n").cast("string").alias("t"))
    for _ in range(2):  # the second time over the first file
        sinks.write_single(rows, "n", "t", f"{tmp_path}/x.txt", "--", "<", ">")
    assert (tmp_path / "x.txt").read_text() == "<" + "--".join(map(str, range(5000))) + ">"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["x.txt"]
    blank = spark.createDataFrame([(1, None), (2, "")], "n int, t string")
    sinks.write_single(blank, "n", "t", f"{tmp_path}/y.txt", "\r\n", ends=True)
    assert (tmp_path / "y.txt").read_bytes() == b"\r\n\r\n"


def test_sketched_yield_is_exact_when_small_and_near_when_large(spark):
    rows = spark.range(60_000).select((F.col("id") % 4).alias("l"), (F.col("id") * 31 % 40_009).alias("k"))
    first = rows.groupBy("k").agg(F.min("l").alias("l")).groupBy("l").count()
    want = {r["l"]: r["count"] for r in first.collect()}
    exact = resolve.sketched_yield(rows, "l", "k").collect()
    assert {r["list"]: r["new_keys"] for r in exact if r["new_keys"]} == want and exact[-1]["total"] == sum(want.values())
    near = resolve.sketched_yield(rows, "l", "k", 12).collect()
    assert abs(near[-1]["total"] / sum(want.values()) - 1) < 4 / 2**6
    assert resolve.sketched_yield(rows.limit(0), "l", "k").collect() == []


def test_unknown_list_of_venues():
    assert [len(v) for v in venues.PRESETS.values()] == [24, 50, 4, 6, 6, 1]
    with pytest.raises(ValueError, match="FT50"):
        venues.preset("none")
