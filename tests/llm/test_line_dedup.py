"""The line join against brute force, and the work it makes on lines of one template."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.llm import common, line_dedup, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    for _ in range(k):
        i, r = rng.randrange(len(s) + 1), rng.random()
        s = s[:i] + rng.choice("abé") + s[i + (r < 0.5) :] if r < 0.75 else s[: max(0, i - 1)] + s[i:]
    return s


def order(doc):
    return (doc is None, doc or 0)


def brute_force(rows, edits, least, equal_from=1):
    """The removed positions of each row, in the order of ``rows``, which is that of equal keys too."""
    bands, kept, seen, out = line_dedup.bands_of(edits, least), [], set(), [[] for _ in rows]

    def near(a, b):
        n = min(len(a), len(b))
        tau = max((e for low, high, e in bands if n >= low and (high is None or n < high)), default=-1)
        return abs(len(a) - len(b)) <= tau and distance(a, b) <= tau

    for row in sorted(range(len(rows)), key=lambda i: (order(rows[i][0]), i)):
        for pos, line in enumerate((rows[row][1] or "").split("\n")):
            x = line.strip(" ")
            if len(x) < equal_from:
                continue
            if x in seen or any(near(x, k) for k in kept):
                out[row].append(pos)
            else:
                kept.append(x)
            seen.add(x)
    return out


def removed(spark, rows, edits, least, **more):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, nr int").coalesce(1)
    got = line_dedup.repeated_lines(df, "doc_id", "text", edits, least, 1, **more)
    return [r["removed"] for r in got.orderBy("nr").collect()]


@pytest.mark.parametrize(("edits", "pairs"), [(1, 4096), (2, 4096), (3, 4096), (2, 6), (((16, 1), (40, 2)), 6)])
def test_equals_brute_force(spark, monkeypatch, edits, pairs):
    """With few pairs allowed in a group, shared segments are taken apart to the end."""
    monkeypatch.setattr(line_dedup, "SAMPLED", 2)
    monkeypatch.setattr(line_dedup, "SHARED", 3)
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(10, 60))) for _ in range(8)]
    lines = [edited(rng, rng.choice(base), rng.randrange(5)) if rng.random() < 0.6 else "the template of all these lines: " + "".join(rng.choice("0123") for _ in range(4)) for _ in range(70)]
    rows = [(i + 1, f"{x}\n\nshort {i % 3}") for i, x in enumerate(lines)] + [(None, lines[3] + "q"), (None, "one that only a null key has"), (900, None), (901, "")]
    rows += [(5, lines[9] + "\nown\nown"), (5, "line\n" + lines[7] + "\n" + lines[7])]  # repeated keys
    assert removed(spark, rows, edits, 16) == brute_force(rows, edits, 16)


@pytest.mark.parametrize("pairs", [6, 10**6])
def test_classes_of_lines_that_differ_at_one_place(spark, monkeypatch, pairs):
    """Where hundreds of lines differ in one or two characters, classes stand for their pairs."""
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    rng = random.Random(2)
    rows = [(rng.randrange(40), f"a line that all of these share, from here {rng.choice('abcdefgh')}{rng.choice('xyz')} to there{rng.choice(['', '', '!'])}") for _ in range(120)]
    for edits in (1, 2):
        assert removed(spark, rows, edits, 16) == brute_force(rows, edits, 16)


def test_a_line_goes_only_for_one_that_stays(spark):
    """A chain: each line is one edit from the one before."""
    base = "a chain of lines, each of them one edit from the line before it"
    chain = [base, base + "b", base + "bc", base + "bcd", base + "bcde"]
    assert removed(spark, list(enumerate(chain)), 1, 16) == [[], [0], [], [0], []]


def test_repeated_and_null_keys_lose_no_unique_line(spark):
    rows = [(1, "A\nB"), (1, "C\nA"), (None, "own one\nD"), (None, "D\nown two"), (None, "D\nown two")]
    assert removed(spark, rows, 1, 16) == [[], [1], [], [0], [0, 1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r["text"] for r in line_dedup.deduplicated(df, "doc_id", "text", equal_from=1).collect()] == ["A\nB", "C", "own one\nD", "own two", ""]


def test_no_rows(spark):
    assert removed(spark, [], 2, 16) == []
    assert removed(spark, [(1, None), (2, "")], 2, 16) == [[], []]


def test_lines_of_one_template_make_no_candidates(spark, monkeypatch):
    """Three quarters in common, then a random id."""
    seen = []

    def cut(df, label):
        out = common.cut(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "cut", cut)
    rng = random.Random(3)
    rows = [(i, "the same three quarters of a line: then comes " + "".join(rng.choice("abcdefghijklmnop") for _ in range(16))) for i in range(2000)]
    assert line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").filter("size(removed) > 0").count() == 0
    pairs = [n for label, n in seen if label == "line-pairs"]
    assert len(pairs) == 1 and pairs[0] <= 2000


@pytest.mark.parametrize("edits", [2, 3, 4])
def test_verification_of_long_lines(spark, edits):
    """Edits at the ends of long rests, which the cheap condition must let pass."""
    rng, pairs = random.Random(edits), []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(2, 60)))
        b = a
        for _ in range(rng.randrange(edits + 2)):
            i = rng.choice([0, 1, len(b) // 2, max(0, len(b) - 1), len(b)])
            b = b[:i] + rng.choice(["", "x", "ab"]) + b[i + rng.randrange(2) :]
        a, b = sorted((a, b), key=len)
        if a and len(b) - len(a) <= edits:
            pairs.append((a, b, edits))
    df = spark.createDataFrame(pairs, "a string, b string, e int")
    want = sum(distance(a, b) <= edits for a, b, _ in pairs)
    assert line_dedup.within(df, "a", "b", edits).count() == want
    assert line_dedup.within(df, "a", "b", [1, edits], "e").count() == want


def test_null_keys_come_last_and_names_may_clash(spark):
    line = "a line that is long enough to be compared with others"
    rows = [(None, line, "r", 1, "k"), (5, line + "!", "s", 2, "l"), (7, "own\nown", None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, _removed long, _key string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(df, "doc_id", "text", equal_from=1).collect()}
    assert got[None]["text"] == "" and got[5]["text"] == line + "!" and got[7]["text"] == "own"
    assert [got[k]["removed"] for k in (None, 5, 7)] == ["r", "s", None] and got[5]["_removed"] == 2 and got[5]["_key"] == "l"
    with pytest.raises(ValueError):
        line_dedup.deduplicated(df.withColumn("removed_lines", F.lit(1)), "doc_id", "text")


def test_query_has_a_row_for_each_document(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op5_line_dedup(spark, sf)
    assert [f.name for f in got.schema][:2] == ["doc_id", "n_lines"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["n_removed"] == len(r["removed_lines"]) <= r["n_lines"] for r in rows)


def test_the_query_joins_no_texts(spark):
    """Its result needs the number of lines alone; texts would go through the last join's exchange."""
    plan = queries.op5_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "n_lines" in plan and "text" not in plan


def test_keys_are_compiled(spark):
    """The JVM doesn't compile methods of more than 8000 bytes."""
    rows = spark.createDataFrame([(1, 1, "a line\nof two")], "row long, key long, text string")
    plan = line_dedup._keyed(line_dedup._lines(rows, 1), line_dedup.bands_of(line_dedup.EDITS, line_dedup.MIN_CHARS))[0]._jdf.queryExecution().executedPlan()
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    assert all(int(n) <= 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))
