"""The training-data operators on small fixtures: brute force, round trips, edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordloom.llm import ann, bpe, decontamination, html_extract, language_id, line_dedup, near_dedup, sharding, shingles, toxicity, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, node string, label string")  # clashing names come along


EDGE = [(1, None, "a", "x"), (2, "", "b", None), (3, " \n ", None, "y"), (None, "w1 w2", "c", "z"), (4, "same text here for two rows of it", "d", "q"), (4, "same text here for two rows of it", "d", "q")]


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(1000 + i, prose(rng, i % 7), "n", "l") for i in range(500)] + EDGE
    got = sharding.shard_records(docs(spark, rows), "doc_id", "text", [1.0] * 4, [1.0] * 5, rows_per_bucket=20).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in got)
    heavy = sharding.shard_records(docs(spark, rows), "doc_id", "text", [1.0, 3.0], [1.0, 3.0, 1.0]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in heavy}[1] > 300
    assert sharding.shard_records(docs(spark, []), "doc_id", "text", [1.0], [1.0] * 2).count() == 0


def test_url_rules_and_templates(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/2?x", "http://x.net/es/1#t", "http://x.net", None, "no scheme", "http://b.org/p/9"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    host, path = url_filter.split_url(F.coalesce("url", F.lit("")))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    rows = df.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", url_filter.match_rules(F.col("host"), F.col("path"), rules)).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in rows] == [("a.example.com", "/en/1"), ("www.example.com", "/en/2"), ("x.net", "/es/1"), ("x.net", ""), ("", ""), ("", ""), ("b.org", "/p/9")]
    assert [r["fit"] and r["fit"]["rule"] for r in rows] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None]
    many = [("h.org", f"/spam/{i}", 1) for i in range(40)] + [("h.org", f"/news/{i}", 0) for i in range(40)] + [("h.org", f"/u/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x", None) for i in range(60)]
    found = url_filter.template_verdicts(spark.createDataFrame(many, "host string, path string, bad int")).collect()
    verdict = {r["template"]: r["verdict"] for r in found}
    assert verdict["h.org/spam/#"] == "block" and verdict["h.org/news/#"] == "allow"
    assert any(t.endswith("/*") for t in verdict)
    assert url_filter.template_verdicts(spark.createDataFrame([], "host string, path string, bad int")).count() == 0


def test_url_templates_need_labels_of_their_own(spark):
    many = [("bad.org", f"/spam/{i}", 1) for i in range(40)] + [("bad.org", f"/wiki/{i}", None) for i in range(40)] + [("new.org", f"/p/{i}", None) for i in range(40)]
    many += [("mixed.org", f"/{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8]}x", 1 if i % 2 else None) for i in range(60)]
    found = url_filter.template_verdicts(spark.createDataFrame(many, "host string, path string, bad int")).collect()
    verdict = {r["template"]: r["verdict"] for r in found}
    assert verdict == {"bad.org/spam/#": "block", "bad.org/wiki/#": "allow", "new.org/p/#": "allow", "mixed.org/*": "block"}


def test_bpe_equals_the_library(spark):
    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(7)
    texts = ["", " ", "<|endoftext|>", "naïve — 🙂🙂\n\n  x", "a" * 5000, "".join(rng.choice("abcdé🙂 '") for _ in range(20000))]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in range(1, 140)]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()
    rows = bpe.round_trip(docs(spark, EDGE), "text", RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(EDGE)
    assert all(bytes(r["decoded"]).decode() in {(t[1] or "") for t in EDGE} for r in rows)
    assert bpe.encode_texts(docs(spark, []), "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_language(spark):
    rng = random.Random(3)
    vocab = {"l1": "the of and with ing ion er".split(), "l2": "der und die nicht ung keit ein".split()}
    rows = [(i, " ".join(rng.choice(vocab[x]) + rng.choice(vocab[x]) for _ in range(30)), "n", x) for i, x in enumerate(["l1", "l2"] * 60)]
    model = language_id.fit(docs(spark, rows[:80]), "doc_id", "text", "label")
    got = {r["doc_id"]: r for r in language_id.predict(docs(spark, rows[80:] + EDGE[:3]), "doc_id", "text", model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, _, x in rows[80:])
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.fit(docs(spark, EDGE[:1]), "doc_id", "text", "label") is None
    assert language_id.predict(docs(spark, EDGE), "doc_id", "text", None).count() == len(EDGE)


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + (" vileword nastyterm" if i % 5 == 0 else ""), "n", "l") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(250)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, "doc_id", "text", "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows + EDGE[:3]), "text", model).collect() if r["doc_id"] is not None}
    wrong = sum((got[i] >= 0.3) != (i % 5 == 0) for i in range(250, 400))
    assert wrong <= 3
    assert toxicity.fit(docs(spark, rows), labels.filter("toxic = 0"), "doc_id", "text", "toxic") is None
    assert toxicity.score(docs(spark, EDGE), "text", None).count() == len(EDGE)


def test_html():
    page = '<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a>Home</a></nav><article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five</p><div class="comments"><p>Nice</p></div></article><footer>f</footer>'
    assert html_extract.main_text(html_extract.parse(page)) == "Head & more\n\nOne two three four\n\nFive"
    assert html_extract.main_text(html_extract.parse(None)) == ""


def test_html_templates(spark):
    page = "<body><div id=x><ul class=menu><li>m{0}</li></ul><div class=story><p>{1}</p><p>more {0}</p></div></div><footer>f</footer></body>"
    rng = random.Random(5)
    rows = [(i, "u", "h", page.format(i, prose(rng, 30))) for i in range(6)] + [(7, None, "h", None), (8, "u", None, "")]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, "page_id", "url", "host", "html").collect()}
    assert got[2].startswith(rows[2][3].split("<p>")[1].split("</p>")[0]) and got[2].endswith("more 2") and "m2" not in got[2]
    assert got[7] == "" and got[8] == ""


def test_html_keeps_all_of_the_article():
    page = "<article><h2 id='related-work'>Related</h2><div id='ad-hoc'><p>Ad hoc</p></div><div class='navy'><p>Navy</p></div><p class='share'>Share prices</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><object><p>Fallback</p></object><div class='share'>Tweet</div><div class='site-nav'>Home</div></article>"
    assert html_extract.main_text(html_extract.parse(page)).split("\n\n") == ["Related", "Ad hoc", "Navy", "Share prices", "so x=1 holds", "Fallback"]


def test_html_keeps_titles_and_columns_beside_the_main_slot(spark):
    page = "<body><div class=top>The site</div><div class=post><h1>Title {0}</h1><div class=entry><p>{1}</p><p>more {0}</p></div><div class=column><p>Aside {0}</p></div></div></body>"
    rng = random.Random(6)
    rows = [(i, "u", "h", page.format(i, prose(rng, 30))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, html string")
    for r in html_extract.extract(df, "page_id", "url", "host", "html").collect():
        i, first = r["page_id"], rows[r["page_id"]][3].split("<p>")[1].split("</p>")[0]
        assert r["text"].split("\n\n") == [f"Title {i}", " ".join(first.split()), f"more {i}", f"Aside {i}"]


def edited(rng, s, k):
    for _ in range(k):
        i, r = rng.randrange(len(s) + 1), rng.random()
        s = s[:i] + rng.choice("abé") + s[i + (r < 0.5) :] if r < 0.75 else s[: max(0, i - 1)] + s[i:]
    return s


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng, pairs = random.Random(edits), []
    while len(pairs) < 200:
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 30)))
        a, b = sorted((a, edited(rng, a, rng.randrange(edits + 3))), key=len)
        if len(b) - len(a) <= edits:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("r", line_dedup.edit_distance_at_most(F.col("a"), F.col("b"), edits)).collect():
        assert r["r"] == (distance(r["a"], r["b"]) <= edits)
    assert line_dedup.within(df, "a", "b", edits).count() == sum(distance(a, b) <= edits for a, b in pairs)


def test_line_dedup(spark):
    line, other = "a line that is long enough to be compared at all", "another line that is also long enough to count"
    rows = [(1, f"{line}\nshort\n{line}", "n", "l"), (2, f"{line[:-1]}X\nshort\n{other}", "n", "l"), (3, f"  {other}  \n{line}", "n", "l"), (5, None, "n", "l"), (6, "", None, None)]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.deduplicated(docs(spark, rows), "doc_id", "text").collect()}
    assert got[1] == (f"{line}\nshort", 1)
    assert got[2] == (f"short\n{other}", 1)
    assert got[3] == ("", 2) and got[5] == (None, 0) and got[6] == ("", 0)
    assert line_dedup.repeated_lines(docs(spark, []), "doc_id", "text").count() == 0


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "All rights reserved.\n\nx\nfirst", "n", "l"), (2, "second\n\n All rights reserved.\nfirs", "n", "l"), (3, "x\n\nx", "n", "l"), (4, "own\nown", "n", "l")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(docs(spark, rows), "doc_id", "text", equal_from=1).collect()}
    assert got == {2: [2], 3: [0, 2], 4: [1]}


def test_near_dedup_equals_brute_force(spark):
    rng, rows = random.Random(6), []
    for i in range(150):
        if i % 3 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
            rows.append((i, " ".join(words), "n", "l"))
        else:
            rows.append((i, prose(rng, rng.randrange(3, 90)), "n", "l"))
    rows += [(900, None, "n", "l"), (901, " ", "n", "l"), (902, "One two", "n", "l"), (903, "one TWO", "n", "l")]
    sets = {i: set(shingles.shingle_set(t).tolist()) for i, t, *_ in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, rows), "doc_id", "text").collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (find(i) == i) for i, r in got.items())
    assert near_dedup.near_duplicates(docs(spark, EDGE), "doc_id", "text").count() == len(EDGE)
    assert near_dedup.near_duplicates(docs(spark, []), "doc_id", "text").count() == 0


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(6, 40))) for i in range(30)] + [(40, None), (41, "two words")]
    rows = []
    for i in range(60):
        words = prose(rng, 60).split()
        if i % 3 == 0:
            inserted = items[i % 30][1].split()
            if i % 2:
                inserted[0] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = inserted
        rows.append((i, " ".join(words), "n", "l"))
    rows += [(70, "so two words here", "n", "l"), (71, None, "n", "l"), (72, "", "n", "l")]
    want = set()
    for d, text, *_ in rows:
        w = shingles.word_hashes(text)
        for item, t in items:
            v = shingles.word_hashes(t)
            if not len(v) or not len(w):
                continue
            n = min(5, len(v))
            bag, s = decontamination.Counter(shingles.sequence_hashes(v, n).tolist()), shingles.sequence_hashes(w, n)
            length = min(len(v) - n + 1, len(s))
            if max(decontamination.similarity(decontamination.Counter(s[k : k + length].tolist()), bag) for k in range(len(s) - length + 1)) >= 0.75:
                want.add((d, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, rows), bench, "doc_id", "text", "item_id", "text").collect()}
    assert got == want and (70, 41) in got and len(got) > 15
    assert decontamination.leaks(docs(spark, rows), bench.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_ann(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] * 4), (1080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, top=5).collect()
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(400), -np.round(s, 12))) if i != q][:5]
        hits += len(set(best) & {r["vec_id"] for r in mine})
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
    assert hits >= 0.9 * 100 and len(got) == 100
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


def test_ann_reads_every_list_that_matters(spark):
    """Unclustered vectors, far more lists than the first reading takes; all sorts of lengths."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, size=(3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for extra in ({}, {"list_size": 8, "lists": 2}, {"list_size": 2000, "top": 2500}):
        top = extra.get("top", 20)
        got = ann.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0, **extra).collect()
        found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
        for q in range(0, 3000, 100):
            best = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:top]
            assert [found[q, k + 1] for k in range(top)] == best
