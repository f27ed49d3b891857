"""The queries' contracts on the smallest tables: columns, rows and what holds for each of them."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontamination, language_id, near_dedup, queries, shingles, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def kinds(df, *names):
    return [dict(df.dtypes)[n] for n in names]


def test_op1_finds_whole_items(spark, docs):
    got = queries.op1_decontamination(spark, SF)
    rows = got.collect()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(found) == len(rows) and all(0.75 <= r["similarity"] <= 1 for r in rows)
    assert {(d["doc_id"], i) for d in docs for i, t in items.items() if t.strip() and t.strip().lower() in (d["text"] or "").lower() and f" {t.strip()} " in f" {d['text']} "} <= found


@pytest.mark.parametrize("n", [1, 6, 7, 14, 28, 35, 63, 126, 196])
def test_op1_recall_of_the_radius(n):
    """Fingerprints of bags of n shingles at similarity 0.75 are within the radius, but for a few in
    ten thousand. Bags of one size are that similar when they share 6 of 7; below 7 they are equal."""
    rng, missed, shared = np.random.default_rng(n), 0, -(-6 * n // 7)
    for _ in range(4000):
        a = rng.integers(1 << 63, size=n, dtype=np.uint64)
        b = np.concatenate([a[n - shared :], rng.integers(1 << 63, size=n - shared, dtype=np.uint64)])
        x, y = (decontamination.fingerprints(shingles.mix(s), np.zeros(1, dtype=np.int64), n)[0] for s in (a, b))
        missed += int(np.bitwise_count(x ^ y)) > decontamination.RADIUS
    assert missed <= 4


def test_op1_takes_the_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 3)
    words = [f"w{i}" for i in range(200)]
    items = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 10])) for i in range(10)] + [(None, "w1 w2 w3")], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(["x", *words[10 * i : 10 * i + 10], "y"]), "c", 1) for i in range(12)] + [(99, None, "c", 1)], "doc_id long, text string, hit string, _hits int")
    got = decontamination.leaks(rows, items, "doc_id", "text", "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(10)}
    left = decontamination.without_leaks(rows, items, "text", "item_id", "text")
    assert sorted(r["doc_id"] for r in left.collect()) == [10, 11, 99] and left.columns == rows.columns


def test_op2_slots_and_laws(spark, docs):
    got = queries.op2_sharding(spark, SF)
    assert kinds(got, "size", "text_crc32", "law", "shard", "slot", "grown_shard") == ["bigint", "bigint", "string", "int", "bigint", "int"]
    rows = got.collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"} and all(0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) for r in rows)
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in rows)


def test_op3_scores_every_row(spark, docs):
    got = queries.op3_toxicity(spark, SF)
    assert kinds(got, "held_out", "score", "predicted") == ["boolean", "double", "int"]
    rows = got.collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert sum(r["predicted"] for r in rows if r["doc_id"] in toxic) >= 0.7 * len(toxic)  # a few dozen labels suffice
    assert sum(r["predicted"] for r in rows) <= 0.2 * len(rows)


def test_op3_risk_is_not_negative():
    """The corrected risk stops pushing unlabelled texts down at its floor: with all of them positive
    in truth, they keep scores like the confirmed ones."""
    rows = [np.array([0])] * 40
    weights, bias = toxicity.train(rows, np.arange(40) < 20, 1, 0.5)
    assert weights[0] + bias > -5


def test_op7_equals_the_library(spark, docs):
    got = queries.op7_bpe(spark, SF)
    assert kinds(got, "n_tokens", "ids_sha256", "decoded_sha256") == ["bigint", "string", "string"]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), digest(" ".join(map(str, ids)).encode()), digest((d["text"] or "").encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want


def test_op8_knows_the_languages(spark, docs):
    rows = queries.op8_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    lang = {d["doc_id"]: d["lang"] for d in docs}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != language_id.UNKNOWN]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_op9_equals_brute_force(spark, docs):
    sets = {d["doc_id"]: set(shingles.shingle_set(d["text"]).tolist()) for d in docs}
    group = {i: i for i in sets}

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    rows = queries.op9_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_op9_takes_long_texts_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text, 0, "a"), (2, text + " end", 0, "b"), (3, "short one", 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, node string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, "doc_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_op10_equals_brute_force(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and None not in r["embedding"]]
    rows = sorted((r for r in rows if len(r[1]) and np.isfinite(r[1]).all() and r[1].any()), key=lambda r: r[0])
    x = np.stack([v for _, v in rows])
    got = queries.op10_ann(spark, SF)
    assert kinds(got, "query_id", "rank", "vec_id", "score") == ["bigint", "int", "bigint", "double"]
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for k, (i, v) in enumerate(rows):
        if i % 20 == 0:
            s = x @ v
            best = [j for j in np.lexsort((np.arange(len(rows)), -np.round(s, 10))) if j != k][:20]
            assert len(found[i]) == len(best)
            assert sum(rows[j][0] in {n for n, _ in found[i].values()} for j in best) >= 0.9 * len(best)
            assert all(abs(found[i][n + 1][1] - s[j]) < 1e-9 for n, j in enumerate(best))
    assert got.filter(F.col("rank") > 20).count() == 0


def test_op8_kernel_equals_brute_force():
    """Presence of 1- to 3-grams, as sets of strings; emoji and digits are spaces."""
    texts = ["Ça va, les amis? 42", "les amies \U0001f600 de Ça", "der Hund", "\U00010400\U00010401 x"]
    plain = lambda t: " ".join("".join(c if c.isalpha() else " " for c in f" {t.lower()} ").split(" "))

    def sets(t):
        t = re.sub(" +", " ", plain(t))
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    last = np.zeros(language_id._SPACE, dtype=np.int32)
    kernel = language_id.Kernel.of([language_id._presence(t, last) for t in texts[:3]])
    got = kernel.rows(texts, last)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:3]):
            assert abs(got[i, j] - len(sets(a) & sets(b)) / np.sqrt(len(sets(a)) * len(sets(b)))) < 1e-5


def test_op8_learns_every_language(spark, monkeypatch):
    """More languages than landmarks allow for: fewer of each, none left out."""
    monkeypatch.setattr(language_id, "MOST_LANDMARKS", 6)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(alphabet[2 * (i % 12)] + alphabet[2 * (i % 12) + 1] * (1 + j % 3) for j in range(30)), f"l{i % 12}") for i in range(480)]
    df = spark.createDataFrame(rows + rows[:5] + [(900, None, "l1"), (901, "xx", None)], "k long, t string, l string")
    model = language_id.fit(df, "k", "t", "l")
    assert model.languages == sorted({f"l{i}" for i in range(12)})
    got = language_id.predict(df, "k", "t", model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == truth[r["k"]] for r in got if r["k"] in truth) >= 0.9 * 485 and next(r for r in got if r["k"] == 900)["lang_pred"] == "und"


def test_op3_risk_falls_and_is_not_negative():
    """The trained weights against the risk written out: pi * R_p+ + max(0, R_u- - pi * R_p-)."""
    rng, prior = np.random.default_rng(5), 0.2
    rows = [np.unique(rng.integers(20, size=6)) if k >= 40 else np.unique(np.append(rng.integers(20, size=5), 20 + k % 2)) for k in range(200)]
    positive = np.arange(200) < 30

    def risk(w, b):
        s = np.array([1 / (1 + np.exp(-(w[r].sum() + b))) for r in rows])
        plus, minus = (1 - s), s  # sigmoid losses of calling a text toxic or clean
        return prior * plus[positive].mean() + max(0.0, minus[~positive].mean() - prior * minus[positive].mean())

    w, b = toxicity.train(rows, positive, 22, prior)
    first = risk(np.zeros(22), np.log(prior / (1 - prior)))
    assert 0 <= risk(w, b) < 0.5 * first and w[20] > 0 and w[21] > 0
    step = risk(w, b)
    assert all(risk(w + d, b) > step - 0.02 for d in 0.1 * rng.normal(size=(20, 22)))
