"""Template deduction and extraction of main text, piece by piece and against brute force."""

import random
import time

from pyspark.sql import functions as F

from recordloom.llm import html_extract as H
from recordloom.llm import queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "page_id int, url string, host string, html string, text string, k string, tokens string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def extracted(spark, pages, **how):
    """pages: (host, html)"""
    df = spark.createDataFrame([(i, "u", h, x, "clash", "clash", "clash") for i, (h, x) in enumerate(pages)], SCHEMA)
    return {r["page_id"]: r["text"] for r in H.extract(df, "page_id", "url", "host", "html", **how).collect()}


def test_offsets_survive_letters_that_grow_in_lower_case():
    assert H.main_text(H.parse("<body><p>" + "İ" * 12 + "<SCRIPT>x</p>y</Script >Hello world text</p>")) == "İ" * 12 + "Hello world text"


def test_cost_is_linear_in_nesting():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        page = H.parse("<div class=a>" * n + "<b>" * n + "deep</q></p></td>" + "</i>" * n)
        H.main_text(page)
        took.append(time.perf_counter() - start)
    assert len(page.names) == 160_000 and took[1] < 12 * took[0] + 1


def brute_classes(pages):
    """Tokens (paths of tags, and of blocks with their text) by occurrence vector."""
    vectors = {}
    for i, page in enumerate(pages):
        for t in page.tokens + [page.mark(b) for b in page.blocks if not b[1]]:
            vectors.setdefault(t, [0] * len(pages))[i] += 1
    classes = {}
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(H.LEAST_PAGES, H.LEAST_SHARE * len(pages)):
            classes.setdefault(tuple(v), set()).add(t)
    return {frozenset(ts) for ts in classes.values()}


def test_classes_equal_brute_force(spark):
    rng = random.Random(1)
    html = []
    for i in range(12):
        more = "".join(f"<section><h2>Part {k}</h2><p>{prose(rng, 6)}</p></section>" for k in range(rng.randrange(1, 4)))
        extra = "<div class=extra><p>seen often</p></div>" if i % 3 else ""
        html.append(f"<html><body><div class=top>Site</div><div class=story><h1>{prose(rng, 3)}</h1>{more}</div>{extra}</body></html>")
    html[5] = html[4]  # equal pages count twice, they don't cancel out
    df = spark.createDataFrame([("h", x) for x in html], "host string, html string")
    tokens = H.templates(df, "host", "html").collect()[0]["tokens"]
    got = {}
    for t in tokens:
        got.setdefault((t["low"], t["high"]), set()).add(t["token"])
    assert {frozenset(v) for v in got.values()} == brute_classes([H.parse(x) for x in html])


def test_classes_are_nested(spark):
    """Rows repeat within the story, which stands once on each page; the pager is apart from both."""
    rng = random.Random(2)
    html = [f"<html><body><div class=story>{''.join(f'<section><h2>x</h2><p>{prose(rng, 5)}</p></section>' for _ in range(1 + i % 3))}</div><div class=pager>{'<em><u>n</u></em>' * (1 + i % 3)}</div></body></html>" for i in range(9)]
    df = spark.createDataFrame([("h", x) for x in html], "host string, html string")
    row = H.templates(df, "host", "html").collect()[0]["tokens"]
    found = H.nested([(t["token"], t["around"], (t["low"], t["high"]), t["pages"], t["share"]) for t in row])
    page = H.parse(html[0])
    of = {page.names[e] + str(e): found.classes[page.tokens[e]] for e in range(len(page.names))}
    assert of["html0"] == of["body1"] == of["div2"]
    assert of["section3"] == of["h24"] == of["p5"] != of["em7"] == of["u8"]  # one vector, two places
    assert found.within[of["section3"]] == found.within[of["em7"]] == of["html0"] and found.within[of["html0"]] == -1


def test_a_token_out_of_order_is_in_no_class(spark):
    html = [f"<html><body>{a}<h1>t{i}</h1>{b}</body></html>" for i, (a, b) in enumerate([("<ins></ins>", "<del></del>"), ("<del></del>", "<ins></ins>")] * 3)]
    df = spark.createDataFrame([("h", x) for x in html], "host string, html string")
    tokens = {t["token"] for t in H.templates(df, "host", "html").collect()[0]["tokens"]}
    page = H.parse(html[0])
    of = dict(zip(page.names, page.tokens, strict=True))
    assert of["html"] in tokens and of["body"] in tokens and not {of["ins"], of["del"], of["h1"]} & tokens


def test_text_of_the_template_goes_from_articles_and_copies_stay(spark):
    rng = random.Random(3)
    note = "<div class=x><p>Subscribe to our letter today</p></div>"
    own = [prose(rng, 40) for _ in range(8)]
    pages = [("h", f"<body><article><h1>Title {i}</h1><p>{own[i]}</p>{note}<p>end {i}</p></article></body>") for i in range(8)]
    copy = prose(rng, 40)
    pages += [("copies", f"<body><article><h1>Same</h1><p>{copy}</p></article><div class=y>{i}</div></body>") for i in range(7)]
    pages += [("free", f"<body><div class=post><h1>Same</h1><p>{copy}</p></div></body>") for i in range(7)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(8)] == [f"Title {i}\n\n{own[i]}\n\nend {i}" for i in range(8)]
    assert {got[i] for i in range(8, 22)} == {f"Same\n\n{copy}"}


def test_pages_of_hot_hosts_are_dealt_out(spark):
    rng = random.Random(4)
    pages = [("hot" if i % 3 else f"h{i % 2}", f"<body><div class=top>The site</div><div class=post><h1>T {i}</h1><div><p>{prose(rng, 30)}</p></div></div></body>") for i in range(60)] + [(None, None), (None, ""), ("hot", "<p>")]
    wide, dealt = extracted(spark, pages), extracted(spark, pages, broadcast_tokens=9, pages_at_once=7)
    assert wide == dealt and len(wide) == 63
    assert all("The site" not in t for t in wide.values()) and wide[60] == wide[61] == ""


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.op4_html_extraction(spark, sf)
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert df.filter("text is null or n_chars <> length(text)").count() == 0
    assert df.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert df.limit(0).select(F.sum("n_chars")).first()[0] is None


def text_of(inner):
    return H.main_text(H.parse(f"<html><body><article><h1>Title</h1><p>The text of the article, long enough to be its main part.</p>{inner}</article></body></html>"))


BASE = "Title\n\nThe text of the article, long enough to be its main part."


def test_names_of_what_goes():
    for name in "reader-comments user-comments comment-thread ad-slot ad-unit sponsored-content newsletter-signup notice-board page-header comments sidebar advert cookie-banner".split():
        assert text_of(f"<div class='{name}'><p>Something else, in whole sentences.</p></div>") == BASE, name
    assert text_of("<p class='notice'>Subscribers only.</p>") == BASE
    assert text_of("<div class=trending><ul><li><a href=x>One story</a></li><li><a href=y>Two stories</a></li></ul></div>") == BASE
    said = "".join(f"<div class=post><span>{n}</span><p>I say that {n} is right.</p></div>" for n in ("Ann", "Ben", "Cem"))
    assert text_of(f"<div class=discussion>{said}</div>") == BASE
    assert text_of("<div class=share><span>Send</span> <span>Print</span></div>") == BASE


def test_names_of_what_stays():
    for inner, want in [
        ("<section id='share'><p>Shares rose</p></section>", "Shares rose"),
        ("<table class='widget'><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>", "a\n\n1\n\nb\n\n2"),
        ("<div class='no-sidebar'><p>In one column.</p></div>", "In one column."),
        ("<section id='comments-on-the-proposal'><p>Much was said.</p></section>", "Much was said."),
        ("<section class='discussion'><p>We discuss what we found.</p><p>It is much.</p></section>", "We discuss what we found.\n\nIt is much."),
        ("<div class='related-work'><p>Others did this too.</p></div>", "Others did this too."),
    ]:
        assert text_of(inner) == f"{BASE}\n\n{want}", inner


def test_broken_tags():
    read = lambda x: H.main_text(H.parse(f"<body><div><p>{x}</p></div></body>"))
    assert read('un <i title="q>closed</i> end') == "un closed end"
    assert read("a < b and <i title='x > y'>c</i> > d") == "a < b and c > d"
    assert read("five <b data-x=\"<p>no</p>\">six</b> sev<en") == "five six sev"
    for source in ('<a "' * 8000, '<a title="' * 8000, "<a title='x" * 8001, "<" * 30000, "<!-" * 10000, "<a b= " + " " * 32000, "</" * 16000):
        start = time.perf_counter()
        H.parse(source)
        assert time.perf_counter() - start < 0.5, source[:20]
    start = time.perf_counter()
    H.parse('<a "' * 250_000)
    assert time.perf_counter() - start < 10


def test_text_equals_an_independent_reading(spark):
    """200 built pages: what is put into the article, in order, and nothing else."""
    rng, pages, want = random.Random(8), [], []
    for i in range(200):
        own = [prose(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6))]
        inner = ""
        for x in own:
            tag = rng.choice(["p", "p", "li", "h2", "blockquote"])
            inner += f"<ul><li>{x}</li></ul>" if tag == "li" else f"<{tag}>{x}</{tag}>"
            if rng.random() < 0.3:
                inner += rng.choice(["<div class=ad-slot>Buy now</div>", "<aside>See also</aside>", "<script>x='<p>'</script>", "<form>Name <input></form>", "<!-- <p>no</p> -->"])
        said = "".join(f"<li><b>{prose(rng, 1)}</b><p>{prose(rng, 6)}</p></li>" for _ in range(rng.randrange(4)))
        shell = ("<nav><a href=/>Home</a></nav>", f"<div class='reader-comments'><ul>{said}</ul></div><footer>End</footer>")
        title = prose(rng, 3)
        pages.append((f"h{i % 7}", f"<html><body>{shell[0]}<article><h1>{title}</h1>{inner}</article>{shell[1]}</body></html>"))
        want.append("\n\n".join([title, *own]))
    got = extracted(spark, pages)
    assert [got[i] for i in range(200)] == want
