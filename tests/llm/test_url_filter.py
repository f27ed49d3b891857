"""Rules and the path-template tree against brute force."""

import random
import re

from pyspark.sql import functions as F

from recordloom.llm import queries, url_filter


def brute_tree(urls, least=20, variable=0.5, z=2.58, prior=0.1, weight=8.0, at=0.5, depth=8):
    """(host, shape) -> (template, verdict), node by node."""
    rows = []
    for host, path, bad in urls:
        shape = re.sub(r"\d+", "#", path)
        parts = [x for x in shape.split("/") if x]
        rows.append([host, shape, parts if len(parts) <= depth else [*parts[: depth - 1], "/".join(parts[depth - 1 :])], "", bad])
    for i in range(depth):
        nodes = {}
        for r in rows:
            if len(r[2]) > i:
                nodes.setdefault((r[0], r[3]), {}).setdefault(r[2][i], []).append(r)
        for children in nodes.values():
            count = {s: (len(rs), sum(r[4] is not None for r in rs), sum(r[4] or 0 for r in rs)) for s, rs in children.items()}
            n, known, bad = (sum(c[k] for c in count.values()) for k in range(3))
            for s, rs in children.items():
                name, (_, own, own_bad) = s, count[s]
                if len(children) > 1 and len(children) >= least and len(children) >= variable * n:
                    name = "*"
                elif len(children) > 1 and own and known - own:
                    p = bad / known
                    error = (p * (1 - p) * (1 / own + 1 / (known - own))) ** 0.5
                    if not abs(own_bad / own - (bad - own_bad) / (known - own)) > z * error:
                        name = "~"
                for r in rs:
                    r[3] += "/" + name
    judged = {}
    for r in rows:
        judged.setdefault((r[0], r[3]), []).append(r[4])
    out = {}
    for r in rows:
        labels = [x for x in judged[r[0], r[3]] if x is not None]
        purity = (sum(labels) + weight * prior) / (len(labels) + weight)
        out[r[0], r[1]] = (r[0] + r[3], "block" if labels and purity >= at else "allow")
    return out


def test_tree_equals_brute_force(spark):
    rng = random.Random(5)
    urls = []
    for _ in range(900):
        host = rng.choice(["a.org", "b.org", "b.org", ""])
        first = rng.choice(["spam", "wiki", "p", "q", "news"])
        second = rng.choice(["x1", "y", "".join(rng.choice("abcdef") for _ in range(6))])
        path = "".join(f"/{s}" for s in [first, second, str(rng.randrange(99))][: rng.randrange(4)])
        bad = None if rng.random() < 0.4 else int(rng.random() < {"spam": 0.95, "p": 0.5, "q": 0.5}.get(first, 0.05))
        urls.append((host, path, bad))
    urls += [("deep.org", "/" + "/".join(f"s{k}" for k in range(d)), 1) for d in (8, 9, 40, 2000)] * 3 + [("deep.org", "//" * 3000, None)]
    got = {(r["host"], r["shape"]): (r["template"], r["verdict"]) for r in url_filter.template_verdicts(spark.createDataFrame(urls, "host string, path string, bad int")).collect()}
    assert got == brute_tree(urls)
    assert {"/*", "/~"} <= {t[-2:] for t, _ in got.values()}


def test_unlabelled_urls_get_both_verdicts(spark):
    """Where a template has labels of its own, they decide on its urls without one."""
    pages = [(f"http://a.example.com/en/{i}", i) for i in range(30)] + [(f"http://b.net/{x}/{i}", 100 + i) for i in range(30) for x in ("es", "en")]
    pages += [("http://a.example.org/en/1", 900), (None, 901), ("x", 902), ("http://U.net?q", 903)]
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for u, i in pages], "page_id long, url string, host string, verdict string, fit string")
    rules = [("block", "example.com", "/en/1"), ("block", "example.com", "/en/2"), ("block", "net", "/es/")]
    got = url_filter.judged_urls(df, "page_id", "url", rules).collect()
    by = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got}
    assert by["a.example.com", "/en/3"] == (None, "block")  # 22 of its template's 30 urls have labels, all bad
    assert by["b.net", "/en/3"] == (None, "allow") and by["b.net", "/es/3"] == ("net/es/", "block")
    assert by["a.example.org", "/en/1"] == (None, "allow") and by["", ""] == (None, "allow") and by["u.net", ""] == (None, "allow")
    assert len(got) == len(pages)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op6_url_filters(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and got.count() == pages.count()
    assert got.filter("verdict not in ('allow', 'block') or host is null or path is null").count() == 0
    ruled = {r["rule"]: r["verdict"] for r in got.filter("rule is not null").select("rule", F.col("verdict")).distinct().collect()}
    assert ruled == {h + p: v for v, h, p in queries.URL_RULES if h + p in ruled}
