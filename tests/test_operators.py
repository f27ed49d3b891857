"""Operators on hand-made rows."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.operators import graph, index, labels, rank, resolve, retrieve, search
from recordloom.plans import intent, strategy
from recordloom.sources import converters, ranks, reports, sinks

MODEL = {"blocks": [{"id": "A", "terms": ["heart attack", "myocardial"], "truncation": {"myocardial": "myocard"}, "vocab": {"MeSH": ["Myocardial Infarction"]}}, {"id": "B", "terms": ["exercise"], "proximity": {"terms": ["physical", "training"], "gap": 2}}], "operator_logic": "A AND B"}


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given_", "want"),
    [
        (N.doi, " HTTPS://doi.org/10.1/AB ", "10.1/ab"),
        (N.doi, "10.48550/arXiv.2101.00001v3", "10.48550/arxiv.2101.00001"),
        (N.doi, "doi:", None),
        (N.arxiv_id, "https://arxiv.org/pdf/2101.00001v2.pdf", "2101.00001"),
        (N.title, "Deep Learning (2nd ed.)", "deeplearning"),
        (N.title, "X (a)!", "xa"),
        (N.issn, "0028-0836", "0028-0836"),
        (N.issn, "12345", None),
        (N.language_tag, "日本語の", "en"),
        (N.language_tag, "中文", "zh"),
    ],
)
def test_scalars(spark, function, given_, want):
    assert one(spark, function(F.col("a")), a=given_) == want


def test_query_terms(spark):
    assert one(spark, N.query_terms(F.col("a")), a="the role of Memory in 机器学习") == ["memory", "机器", "器学", "学习"]


def test_merge_takes_first_filled_and_unions(spark):
    rows = spark.createDataFrame([("k", 1, "", ["b"], 0), ("k", 0, "t", ["a"], 0), ("k", 2, "u", ["a", "c"], 5)], "key string, ord int, title string, sources array<string>, n int")
    got = resolve.merge(rows, "key", ["ord"], ["title"], ["sources"], ["n"]).first()
    assert (got["title"], got["sources"], got["n"], got["n_records"]) == ("t", ["a", "b", "c"], 5, 3)


def test_preferred_title(spark):
    rows = spark.createDataFrame([("x", "first", False, False, 0), ("x", "open", False, True, 1), ("x", "zh", True, False, 2), ("y", "a", False, False, 0), ("y", "", False, True, 1), ("y", "o", False, True, 2)], "k string, t string, zh boolean, oa boolean, o int")
    filled = F.col("t") != ""
    got = {r["k"]: r["t"] for r in rows.groupBy("k").agg(resolve.preferred_text(F.col("t"), filled, F.col("zh"), F.col("oa"), F.col("o")).alias("t")).collect()}
    assert got == {"x": "zh", "y": "a"}  # an empty openalex title uses the override up


def test_citations_take_last_positive_openalex(spark):
    rows = spark.createDataFrame([(5, False, 0), (7, True, 1), (3, True, 2), (0, True, 3)], "c int, oa boolean, o int")
    assert rows.agg(resolve.citation_count(F.col("c"), F.col("oa"), F.col("o")).alias("c")).first()["c"] == 3


def test_label_layers(spark):
    obj = {"paper_id": "a", "rcs": 7, "reasoning": "long enough reason", "flag": None}
    cases = [(json.dumps([obj]), "json"), (f"x\n```json\n{json.dumps([obj])}\n```", "fenced"), (f"so {json.dumps([obj])} [1]", "bracket"), (f"[1] so {json.dumps(obj)}", "strict"), ("nothing", "bottom"), (None, "bottom"), (json.dumps([{**obj, "rcs": 11}]), "bottom")]
    cases += [("Paper_ID = 'a'; RCS = 7; why not; reasoning = 'long enough reason'", "tolerant"), (json.dumps({"papers": [obj]}), "bracket"), (json.dumps([{**obj, "flag": "made_up"}]), "bottom")]
    df = spark.createDataFrame([(t, w, ["a"]) for t, w in cases], "t string, want string, ids array<string>")
    for r in labels.parse(df, "t", "ids").collect():
        assert r["layer"] == r["want"], r
        assert r["labels"][0]["rcs"] == (5 if r["layer"] == "bottom" else 7)
        assert r["labels"][0]["flag"] == ("parse_failed_uncertain" if r["layer"] == "bottom" else None)


def test_label_text_layers_keep_flags():
    one = '{"paper_id": "a", "rcs": 3, "reasoning": "long enough reason", "flag": "recent_unindexed"}'
    assert labels.recover(f"so: {one} and that is it", ["a"]) == ([{"paper_id": "a", "rcs": 3, "reasoning": "long enough reason", "flag": "recent_unindexed"}], "strict")
    assert labels.recover(json.dumps([{"paper_id": "a", "rcs": True, "reasoning": "long enough reason"}]), ["a"])[0][0]["rcs"] == 1


def test_batches_are_halved_until_read():
    got, layer = labels.recover(json.dumps([{"paper_id": "a", "rcs": 1, "reasoning": "long enough reason"}]), ["a", "b", "c"])
    assert layer == "halved" and [g["paper_id"] for g in got] == ["a", "b", "c"] and [g["rcs"] for g in got] == [1, 5, 5]


def test_last_label_wins_whichever_name_it_uses(spark):
    rows = spark.createDataFrame([("p1", "doi|1"), ("p2", "p1")], "paper_id string, key string")
    found = spark.createDataFrame([("p1", 0, 3), ("doi|1", 1, 7)], "name string, at int, rcs int")
    got = {r["paper_id"]: r["rcs"] for r in labels.apply_labels(rows, found, ["paper_id", "key"], "name", "at", ["rcs"]).collect()}
    assert got == {"p1": 7, "p2": None}


def test_windows():
    today = dt.date(2024, 6, 30)
    assert retrieve.recent_window(today) == (dt.date(2023, 7, 1), today)
    assert retrieve.mid_window(today)[1] == dt.date(2023, 6, 30)
    assert retrieve.recent_window(today, low=2025) is None


def test_first_match(spark):
    rows = spark.createDataFrame([(1, ["x", "b"]), (2, ["y"]), (3, ["b", "a"])], "id int, c array<string>")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, tier int")
    got = {r["id"]: (r["match"], r["tier"]) for r in rank.first_match(rows, "id", "c", table, "k").collect()}
    assert got == {1: ("b", 2), 2: (None, None), 3: ("b", 2)}


@given(st.sampled_from(sorted(strategy.PROXIMITY)), st.integers(0, 30))
def test_proximity_round_trip(host, gap):
    n = strategy.host_n(host, gap)
    assert n is None or strategy.gap_of(host, n) == gap


def test_proximity_equivalence():
    assert strategy.equivalent("ovid", 3, "ebsco", 2)
    assert not strategy.equivalent("wos", 3, "embase_com", 3)


@pytest.mark.parametrize(("query", "host", "rule"), [(q, h, r) for (q, h), r in zip(strategy.SAMPLES, ("L1", "L3", "L4", "L8", "L7", "L9", "L6", "L3"), strict=True)])
def test_lint(query, host, rule):
    assert rule in {f[0] for f in strategy.lint(query, host)}


def test_compile_withholds_mixed_logic():
    bad = {**MODEL, "operator_logic": "A AND B OR A"}
    assert strategy.compile_strategy(bad, "pubmed")["status"] == "withheld"
    assert strategy.compile_strategy(MODEL, "pubmed", {"MeSH": {"Myocardial Infarction"}})["status"] == "ready"


TOPIC = "情绪调节"


@pytest.mark.parametrize(
    ("query", "platform", "tiers", "quartiles", "cleaned"),
    [
        ("中科院一区 深度学习", "cas", [1], [], "深度学习"), ("JCR Q1 memory", "jcr", [], ["Q1"], "memory"), ("二区及以上 教育", "cas", [1, 2], [], "教育"), ("中科院 1-3区 x", "cas", [1, 2, 3], [], "x"),
        ("中科院 1、2 区的 情绪调节", "cas", [1, 2], [], TOPIC), ("中科院一区或者二区 情绪调节", "cas", [1, 2], [], TOPIC), ("中科院1到3区期刊 情绪调节", "cas", [1, 2, 3], [], TOPIC), ("1区 2区 情绪调节", "cas", [1, 2], [], TOPIC),
        ("中科院一区的文献综述", "cas", [1], [], "文献综述"), ("中科院1 depression", "cas", [1], [], "depression"), ("中科院 2023 年以来的研究", "cas", [], [], "2023 年以来的研究"), ("Web of Science 1、2区 情绪调节", "jcr", [], ["Q1", "Q2"], TOPIC),
        ("SSCI 一区或二区 情绪调节", None, [1, 2], [], TOPIC), ("Web of Science 分区 心理学", "jcr", [], [], "心理学"),
        *[(q, None, [], [], q) for q in ("broadcast case study", "二区供暖", "第一、二区 人口", "一区、二区供暖", "51区 外星人", "SJR-indexed", "WoS coverage", "三区的人口研究", "一区一带 倡议", "")],
    ],
)
def test_intent(query, platform, tiers, quartiles, cleaned):
    got = intent.parse(query)
    assert (got["platform"], got["tiers"], got["quartiles"], got["cleaned"]) == (platform, tiers, quartiles, cleaned)
    assert got["ambiguous"] == (platform is None and bool(tiers or quartiles or got["top"]))


def test_intent_top_and_plan():
    wish = intent.parse("只要顶刊的认知")
    assert wish["top"] and wish["ambiguous"] and wish["candidates"] == ["cas", "jcr", "sjr"] and wish["cleaned"] == "认知"
    assert intent.plan({}, wish)["filter"] is False
    assert intent.plan({"platform": "CAS", "keep": [1, "Q2"]}, intent.parse("JCR Q1 x")) | {} == {**intent.plan({"platform": "cas", "keep": ["1", "2"]}, intent.parse("JCR Q1 x"))}
    got = intent.plan({"keep": ["Q2"]}, intent.parse("JCR Q1 x"))
    assert (got["platform"], got["quartiles"], got["from"], got["filter"]) == ("jcr", ["Q2"], "query", True)
    assert intent.plan({}, intent.parse("plain"), "sjr")["filter"] is False


def test_payload_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "t1", "year": 2020, "extra": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"k": {"title": "t2"}}))
    (tmp_path / "c.json").write_text(json.dumps({"references": [{"title": "t3"}], "cited_by": [{"title": "t4"}]}))
    got = converters.read_payload(spark, str(tmp_path / "*.json"))
    assert sorted(r["title"] for r in got.collect()) == ["t1", "t2", "t3", "t4"]


def test_payloads_with_broken_members(spark):
    cases = [
        (1, '[{"title":"a","year":2001,"authors":["X",{"name":"Y","is_first":true},5]},"text",7,null]'),
        (2, '{"z":{"title":"b","year":"soon"},"a":{"title":"c","keywords":["k",1]},"l":[{"title":"no"}]}'),
        (3, '{"refs":[{"title":"d"},[1]],"cited":[{"title":"e","year":null}]}'),
        (4, '[{"title":"cut off"'), (5, "5"), (6, ""), (7, "[]"), (8, "{}"), (9, None), (10, '{"x":[]}'), (11, "[{}]"),
    ]
    rows = spark.createDataFrame(cases, "file int, value string")
    got = sorted((r["file"], r["pos"], r["title"], r["year"], tuple(r["misfits"])) for r in converters.decode(rows).collect())
    assert got == [(1, 0, "a", 2001, ()), (2, 0, "b", None, ("year",)), (2, 1, "c", None, ()), (3, 0, "d", None, ()), (3, 2, "e", None, ()), (11, 0, None, None, ())]
    first = converters.decode(rows).filter("title = 'a'").first()["authors"]
    assert [(a["name"], a["is_first"]) for a in first] == [("X", None), ("Y", True), ("5", None)]
    left = sorted(((r["file"], r["pos"], r["problem"]) for r in converters.rejected(rows).collect()), key=repr)
    bad, none = "member is no object", "no list or object"
    assert left == sorted([(1, 1, bad), (1, 2, bad), (1, 3, bad), (2, 2, bad), (3, 1, bad), (4, None, none), (5, None, none), (6, None, none), (9, None, none)], key=repr)
    few = converters.decode(rows, schema="title string, year string")
    assert few.columns == ["file", "pos", "title", "year", "misfits"] and few.filter("year = 'soon'").count() == 1


def test_rank_tables(spark, tmp_path):
    (tmp_path / "sjr.csv").write_text('Title;Issn;SJR;SJR Best Quartile;Categories\nA;"00280836, 14764687";18,500;-;Education (Q2); x\n', encoding="utf-8")
    got = ranks.read_sjr(spark, str(tmp_path / "sjr.csv")).orderBy("issn").collect()
    assert [r["issn"] for r in got] == ["0028-0836", "1476-4687"] and got[0]["sjr"] == 18.5 and got[0]["best_quartile"] == "Q2"
    (tmp_path / "cas.csv").write_text("Journal,ISSN/EISSN,大类分区,Top,小类1,小类1分区\nB,0028-0836/1476-4687,1 [2/74],是,Water,2 [3/9]\n", encoding="utf-8")
    r = ranks.read_cas(spark, str(tmp_path / "cas.csv")).first()
    assert r["tier"] == 1 and r["top"] and r["minor"][0]["tier"] == 2


def test_bibtex(spark):
    rows = spark.createDataFrame([(1, "Ann Lee", 2020), (2, "Bo Lee", 2020), (3, None, None)], "id int, a string, y int")
    got = {r["id"]: r["bibtex_key"] for r in sinks.bibtex_keys(rows, "a", "y", ["id"]).collect()}
    assert got == {1: "Lee2020", 2: "Lee2020b", 3: "Anonn.d."}


def test_venue_label(spark):
    label = converters.venue_label(F.col("a"), F.col("b"), converters.accepted_kind(F.col("b")))
    cases = [("NeurIPS 2025 poster", "NeurIPS.cc/2025/Conference", "NeurIPS 2025 Poster"), ("KSMI 2026 ShortOralPoster", "KSMI.org/2026/Conference", "KSMI 2026"), ("x", "ICLR.cc/2024/Conference", "ICLR 2024"), ("Findings EMNLP oral", "EMNLP/2023/Conference", "EMNLP 2023 Findings"), ("any", "TMLR", "TMLR"), ("y", "NeurIPS.cc/2023/Track/Datasets_and_Benchmarks", "NeurIPS 2023 Datasets & Benchmarks")]
    for venue, venueid, want in cases:
        assert one(spark, label, a=venue, b=venueid) == want
    for rejected in ("ICLR.cc/2024/Conference/Rejected", "ICLR.cc/2024/Workshop/X", "TMLR/Rejected", "/2024/Conference", "NeurIPS.cc/2023/Track/Datasets_and_Benchmarks/Rejected_Submission"):
        assert one(spark, converters.accepted_year(F.col("a")), a=rejected) is None


def test_journal_groups(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["a", "b"]), (4, ["d"])], "id int, issns array<string>")
    assert {r["id"]: r["journal"] for r in rank.journal_groups(rows, "id", "issns").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(["pubmed", "openalex"], "ref of W1", 8), (["arxiv"], "cites X", 3), (["arxiv"], None, None)], "sources array<string>, discovery_path string, rcs int")
    assert reports.databases_used(rows) == ["openalex", "arxiv", "pubmed"]
    log = reports.method_log(rows).first()
    assert (log["records"], log["seeds"], log["classified"], log["highly_relevant"], log["citation_expansion"]) == (3, 1, 2, 1, True)
    assert reports.hydrate("<p><script>x</script>", "DATA", {"a": "</script>"}).count("</script>") == 2
    made = []
    for _ in range(2):
        got = reports.cached(spark, str(tmp_path), {"q": 1}, lambda: made.append(1) or spark.range(3))
    assert got.count() == 3 and made == [1]
    assert reports.markdown("T", {"papers": 1}, [{"title": "a|b", "year": 2020}]).endswith("| 2020 | a b |  |\n")


def fold(records):
    """A key's records merged one after the other into the first, by the rules for each field."""
    out = None
    for r in records:
        r = {**r, "sources": list(r["sources"]), "issns": list(r["issns"])}
        if out is None:
            out = r
            continue
        was_zh, is_zh = (bool({"nssd", "yiigle"} & set(x["sources"])) for x in (out, r))
        first_oa = "openalex" in r["sources"] and "openalex" not in out["sources"]
        for c in ("title", "authors"):
            if (r[c].strip() if c == "title" else r[c]) and (not out[c] or (is_zh and not was_zh) or (first_oa and not (was_zh and not is_zh))):
                out[c] = r[c]
        for c in ("abstract", "venue"):
            if r[c] and (not out[c] or (is_zh and not was_zh)):
                out[c] = r[c]
        if not out["year"] and 0 < (r["year"] or 0) <= 2026:
            out["year"] = r["year"]
        if ("openalex" in r["sources"] and r["citation_count"] > 0) or not out["citation_count"]:
            out["citation_count"] = r["citation_count"]
        if not out["doi"] and r["doi"]:
            out["doi"] = r["doi"].strip().lower().removeprefix("https://doi.org/")
        for c in ("sources", "issns"):
            out[c] += [x for x in dict.fromkeys(r[c]) if x not in out[c]]
    return out


def test_merge_equals_one_after_the_other(spark):
    """10 000 random groups of records, merged before or not."""
    rng, rows = random.Random(4), []
    for key in range(10_000):
        for pos in range(rng.randrange(1, 7)):
            some = lambda c: rng.choice(["", "", f"{c}{pos}"])  # noqa: B023, E731
            sources = rng.sample(["openalex", "nssd", "yiigle", "crossref", "arxiv"], rng.choice([1, 1, 2, 3]))
            issns = [f"{rng.randrange(4)}" for _ in range(rng.randrange(3))] if pos else [f"{x}" for x in range(rng.randrange(3))]
            doi = rng.choice([None, "", f" HTTPS://doi.org/10.1/X{pos}"])
            rows.append((key, pos, rng.choice(["", " ", f"t{pos}"]), some("a"), some("v"), [some("n")] if rng.random() < 0.7 else [], rng.choice([None, 0, 2000 + pos, 2030]), rng.choice([0, 0, pos + 5]), doi, sources, issns))
    names = ["key", "pos", "title", "abstract", "venue", "authors", "year", "citation_count", "doi", "sources", "issns"]
    df = spark.createDataFrame(rows, "key int, pos int, title string, abstract string, venue string, authors array<string>, year int, citation_count long, doi string, sources array<string>, issns array<string>")
    got = {r["key"]: r.asDict() for r in resolve.merge_records(df, "key", ["pos"]).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    for key, records in groups.items():
        want = fold(records)
        for c in names[2:]:
            assert (got[key][c] or None) == (want[c] or None), (c, records)


def test_two_keys_are_taken_in_order(spark):
    df = spark.createDataFrame([(1, "a1", "b1"), (2, "a1", "b2"), (3, "a2", "b2")], "n int, a string, b string")
    assert sorted(r["n"] for r in resolve.distinct_by_any_key(df, "a", "b", ["n"]).collect()) == [1, 3]
    rng = random.Random(6)
    rows = [(n, rng.choice([None, *map(str, range(40))]), rng.choice([None, *map(str, range(30))])) for n in range(300)]
    seen_a, seen_b, want = set(), set(), []
    for n, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(n)
    assert sorted(r["n"] for r in resolve.distinct_by_any_key(spark.createDataFrame(rows, "n int, a string, b string"), "a", "b", ["n"]).collect()) == want


def test_journals_equal_the_greedy_table(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(n, [f"i{rng.randrange(60)}" for _ in range(rng.randrange(4))]) for n in range(80)]
        table = rank.greedy_table([("p", "t", issns) for _, issns in rows])
        df = spark.createDataFrame([(n, issns, rng.choice(["cas", "jcr"]), rng.choice([None, n])) for n, issns in rows], "n int, issns array<string>, platform string, slot int")
        got = {r["issn"]: r["journal"] for r in rank.rank_table(df, "n", "platform", "issns", "slot").collect()}
        same = lambda t: {frozenset(k for k in t if t[k] == v) for v in t.values()}
        assert same(got) == same(table)


def test_chasing_has_a_falling_bar_and_a_budget(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (2, 5), (5, 6), (9, 8)], "src int, dst int")
    scores = spark.createDataFrame([(1, 6), (2, 9), (3, 1), (4, 7), (5, 8), (8, 5)], "node int, score int")
    known = spark.createDataFrame([(1,), (8,)], "node int")
    got = lambda *a, **b: sorted((r["node"], r["hop"]) for r in graph.chase(edges, scores, known, *a, **b).collect())
    assert got(0) == [] and got(1) == [(2, 1), (3, 1), (4, 1)]
    assert got(2) == [(2, 1), (3, 1), (4, 1), (5, 2)]  # 8 is below the bar, 1 has been a seed
    assert got(2, budget=2) == got(1) and got(1, references=1) == [(2, 1), (4, 1)] and got(1, cited_by=0) == [(2, 1), (3, 1)]


def test_index_answers_like_a_scan(spark):
    rng = random.Random(2)
    words = "the of tide sea ice Été melting north-west 42".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4))), None if rng.random() < 0.1 else ", ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, title string, abstract string")
    table = index.build(df, "id", ["title", "abstract"])
    for query in ("tide", '"sea ice"', '("sea ice" OR été) AND melting', "north-west", '"the of the"', "nowhere", "ice OR 42", '"ice ice" sea'):
        want = {r["id"] for r in df.filter(search.matches(query, F.col("title"), F.col("abstract"))).collect()}
        assert {r["key"] for r in index.matching(table, query).collect()} == want, query
    plan = index.matching(table, '"sea ice"')._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "In(term, [ice,sea])" in plan


@pytest.mark.parametrize(
    ("function", "given_", "want"),
    [
        (N.required_terms, "graph colouring bounds", "all:graph AND all:colouring AND all:bounds"),
        (N.required_terms, '"sea ice" of spring', 'all:"sea ice" AND all:spring'),
        (N.required_terms, "ti:x AND y", "ti:x AND y"),
        (N.required_terms, 'stray "quote here', "all:stray AND all:quote AND all:here"),
        (N.required_terms, '"a OR b" tide', 'all:"a OR b" AND all:tide'),
        (N.required_terms, "tide", "tide"),
        (N.required_terms, "", ""),
        (N.plain_terms, "one word", "one word"),
        (N.plain_terms, '("sea ice" OR glacier) AND (melting OR Ice)', "sea ice glacier melting"),
        (N.plain_terms, '"OR gate" NOT x', "OR gate x"),
        (N.plain_terms, "", ""),
    ],
)
def test_query_strings(spark, function, given_, want):
    assert one(spark, function(F.col("q")), q=given_) == want


def test_block_and_category_queries(spark):
    rows = spark.createDataFrame([([["a", ' "b" ', None], [""], ["c"]],), ([],)], "b array<array<string>>")
    got = [r["x"] for r in rows.select(N.block_query(F.col("b")).alias("x")).collect()]
    assert got == ['(IKTE="a" OR IKST="a" OR IKSE="a" OR IKTE="b" OR IKST="b" OR IKSE="b") AND (IKTE="c" OR IKST="c" OR IKSE="c")', ""]
    want = "(all:sea AND all:ice) AND (cat:a.b OR cat:c) AND submittedDate:[199101010000 TO 202602032359]"
    assert one(spark, N.category_query(F.col("q"), ["a.b", "c"], None, "2026-02-03"), q="sea ice") == want
