"""What the operators leave in the shared folder."""

import os
import random

from recordloom import scratch
from recordloom.llm import line_dedup, near_dedup
from recordloom.llm.components import components


def tables(spark):
    root = f"{scratch.scratch_root(spark)}/recordloom".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def new(spark, before):
    return sorted(d.rpartition("-")[0] for d in tables(spark) - before)


def test_near_dedup_leaves_its_result_alone(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[i % 3 * 20 : i % 3 * 20 + 20] + [f"own{i}"] * (i > 5))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = tables(spark)
    out = near_dedup.near_duplicates(df, "doc_id", "text")
    assert new(spark, before) == ["near-classes"]
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i % 3 for i in range(30)}


def test_line_dedup_leaves_rows_and_result(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ijkl") for _ in range(60)) for _ in range(40)]
    rows = [(i, "\n".join([*rng.sample(lines, 3), lines[0][:-1] + rng.choice("XYZ")])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = tables(spark)
    out = line_dedup.repeated_lines(df, "doc_id", "text")
    assert new(spark, before) == ["line-gone", "line-rows"]
    assert out.count() == 120 and out.filter("size(removed) > 0").count() > 100


def test_components_leave_their_labels_alone(spark):
    """A long path in random order, a star and a pair: several rounds."""
    rng = random.Random(5)
    path = rng.sample(range(100, 400), 300)
    links = [*zip(path, path[1:]), *[(1000 + i, 1000) for i in range(1, 50)], (7, 9), (9, 7), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    before = tables(spark)
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert new(spark, before) == ["labels"]
    assert got == {p: 100 for p in path} | {1000 + i: 1000 for i in range(50)} | {7: 7, 9: 7}


def test_settled_keeps_results_within_results(spark):
    before = tables(spark)
    inner = []

    def make():
        scratch.cut(spark.range(3), "deep")
        inner.append(scratch.settled(lambda: scratch.cut(spark.range(4), "deeper").filter("id > 0"), "inner"))
        assert new(spark, before) == ["deep", "inner"]
        return inner[0].union(scratch.settled(lambda: scratch.cut(spark.range(1), "written"), "not again"))

    out = scratch.settled(make, "outer")
    scratch.cut(spark.range(2), "later")
    assert new(spark, before) == ["later", "outer"] and out.count() == 4
