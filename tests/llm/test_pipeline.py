"""The pipeline on the smallest tables, and against brute force on planted documents."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_line_dedup import brute_force

from recordloom.llm import bpe, decontamination, line_dedup, queries, shingles, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_encode(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.cut(stage(spark, docs, SF), "test")
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
        before = docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == before and tokens.filter("n_tokens <> size(token_ids) or not decodes_back").count() == 0


def test_line_dedup_stage_takes_short_lines(spark):
    rows = [(1, "Les.\na line that only the first of them has", 42), (2, "Les.\nanother one that only the second has", 42), (3, "Les.", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {1: (rows[0][1], 42), 2: ("another one that only the second has", 36)}


def components(docs):
    sets = {d: set(shingles.shingle_set(t).tolist()) for d, t in docs.items()}
    group = {d: d for d in docs}

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {d: find(d) for d in docs}


def holds(text, item):
    w, v = shingles.word_hashes(text), shingles.word_hashes(item)
    if not len(w) or not len(v):
        return False
    n = min(5, len(v))
    bag, s = decontamination.Counter(shingles.sequence_hashes(v, n).tolist()), shingles.sequence_hashes(w, n)
    length = min(len(v) - n + 1, len(s))
    return any(decontamination.similarity(decontamination.Counter(s[k : k + length].tolist()), bag) >= 0.75 for k in range(len(s) - length + 1))


def test_run_equals_brute_force(spark, tmp_path):
    """Planted copies, lines, leaks and toxic rows; nulls, blanks and columns with clashing names."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "ka lo mi ne ru sa to vi".split() for b in "ban der fon gul hip".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(14)) for i in range(6)]
    shared = prose(20)
    texts = {}
    for i in range(120):
        lines = [prose(rng.randrange(12, 30)) for _ in range(3)]
        if i % 6 == 1:
            lines[1] = shared
        if i % 10 == 2:
            lines[0] = "utterly vileword nastyterm " + lines[0]
        if i % 13 == 3:
            lines[2] += " " + items[i % 6][1]
        texts[i] = "\n".join(lines)
    for i in range(120, 140):  # near copies: some words changed in one line
        lines = texts[i - 100].split("\n")
        w = lines[2].split()
        w[0], w[len(w) // 2] = f"new{i}", f"other{i}"
        texts[i] = " ".join([*lines[:2], " ".join(w)])
        texts[i - 100] = " ".join(lines)
    texts |= {200: None, 201: "", 202: "  "}
    rows = [(d, t, "en", "s", len(t or ""), "x", 1.5, 7) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, removed_lines string, _score double, _hits int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 2)) for i in range(0, 110)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, "text", model).collect()}
    left = {d: t for d, t in texts.items() if not (t or "").strip(" ") or scores[d] < queries.TOXIC_AT}
    ordered = sorted(left.items())
    gone = {d: p for (d, _), p in zip(ordered, brute_force(ordered, line_dedup.EDITS, line_dedup.MIN_CHARS), strict=True) if p}
    cleaned = {}
    for d, t in left.items():
        if d in gone:
            t = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d])
            if not t.strip(" "):
                continue
        cleaned[d] = t
    firsts = components({d: t or "" for d, t in cleaned.items()})
    kept = {d: t for d, t in cleaned.items() if firsts[d] == d and not any(holds(t, x) for _, x in items)}
    assert set(got) == set(kept)
    assert {200, 201, 202} <= set(got) and sum(d % 10 == 2 and d < 120 for d in got) <= 3
    assert len(left) < len(texts) and len(gone) > 10 and any(firsts[d] != d for d in firsts) and any(firsts[d] == d and d not in kept for d in firsts)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[d]["token_ids"] == library.encode_ordinary(t or "") and got[d]["decodes_back"] for d, t in kept.items())


def test_near_dedup_judges_rows_with_repeated_and_null_keys(spark):
    x, y = "one two three four five six seven eight nine ten", "red green blue white black brown grey pink gold lime"
    rows = [(2, x, 1), (5, x, 2), (5, y, 3), (7, y + " more", 4), (5, x, 5), (None, x, 6), (None, "only here is this one text", 7), (9, None, 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").coalesce(1)
    got = sorted(r["_row"] for r in corpus_pipeline.keep_one_of_near_copies(spark, df, "").collect())
    assert got == [1, 3, 7, 8, 9]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.cut(stage(spark, docs, SF), "test")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
