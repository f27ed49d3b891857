"""Budgeted windows against a plain version, read back from what was written."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, chapter int, window string"
PIECES = ["</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\ROLE]", "<", "[", "s>", "word", "été", "😀", "\n", " ", "<s>", "[SYS]"]


def rows_of(rng, convs):
    out = []
    for c in convs:
        for t in range(rng.choice([0, 1, 2, 7, 40])):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool", None, "a[/ROLE]b", ""])
            text = None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 30])))
            out.append((c, None if rng.random() < 0.03 else t // rng.choice([1, 1, 2]), role, text, 1, "x"))
        if out and rng.random() < 0.5:
            out.append(out[-1])  # a repeated row
    return out


def plain(rows, budget, history, chapter):
    """conv: its turns in order, and its windows as (context turns, new turns)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(t is None, t or 0, hashlib.md5(f"{r or ''}\n{x or ''}".encode()).hexdigest(), r or "", x or "") for c, t, r, x, *_ in rows if c == conv]
        turns = [(t[3], t[4]) for t in sorted(turns)]
        size = [len(re.findall(r"[^\W_]+|[^\s]", x.replace("\\", "-"))) + 2 for _, x in turns]
        p = [sum(size[:i]) for i in range(len(turns) + 1)]
        system, windows, room = turns[0][0] == "system", [], -1
        for i, k in enumerate(size):
            if i == 0 or p[i] // chapter != p[i - 1] // chapter or k > room:
                beside = size[0] if system and i else 0
                most = min(history, budget - beside - k)
                first = min([j for j in range(1 if system else 0, i) if p[i] - p[j] <= most], default=i)
                windows.append([([0] if system and i else []) + list(range(first, i)), []])
                room = budget - beside - (p[i] - p[first])
            windows[-1][1].append(i)
            room -= k
        out[conv] = turns, windows
    return out


@pytest.mark.parametrize(("budget", "history", "chapter"), [(40, 12, 10**6), (40, 12, 60), (10, 0, 25), (30, 24, 25)])
def test_windows_equal_a_plain_version(spark, budget, history, chapter):
    rows = rows_of(random.Random(budget + chapter), [*range(12), None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = chat_format.windows(df, "conv_id", "turn", "role", "text", budget, history, chapter=chapter, per_range=30)
    got = found.withColumns({"turns": chat_format.turns_of(F.col("text")), "learnt": chat_format.learnt(F.col("text"), F.col("loss"))}).collect()
    want = plain(rows, budget, history, chapter)
    assert {r["conv_id"] for r in got} == set(want)
    for conv, (turns, windows) in want.items():
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["chapter"], r["window"]))
        assert [([turns[i] for i in a], [turns[i] for i in b]) for a, b in windows] == [([tuple(t) for t in r["turns"][: r["n_context"]]], [tuple(t) for t in r["turns"][r["n_context"] :]]) for r in mine]
        assert [x for r in mine for x in r["learnt"]] == [x for role, x in turns if role == "assistant"]
        for r in mine:
            assert r["text"].startswith("<s>") and r["text"].count("</s>") == len(r["turns"]) and (r["n_tokens"] <= budget or r["n_new"] == 1)


def test_long_and_short_conversations_go_one_way(spark):
    """What counts as long decides the plan alone: two conversations of which one is long have the
    windows that they have apart."""
    rows = [(1, i, "user", f"a{i} b c", 0, "") for i in range(50)] + [(2, 0, "user", "hello", 0, "")]
    both = chat_format.windows(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text", 20, 6, chapter=40, per_range=7)
    assert [r["text"] for r in both.filter("conv_id = 2").collect()] == ["<s>[INST]hello</s>"]
    new = both.filter("conv_id = 1").orderBy("chapter", "window").collect()
    assert sum(r["n_new"] for r in new) == 50 and all(r["n_context"] == 1 for r in new[1:])


def test_no_rows_and_a_very_long_text(spark):
    empty = chat_format.windows(spark.createDataFrame([], SCHEMA), "conv_id", "turn", "role", "text")
    assert empty.count() == 0
    text = "<s>[INST] x" * 100_000
    df = spark.createDataFrame([(1, 0, "system", "s", 0, ""), (1, 1, "assistant", text, 0, ""), (1, 2, "user", "y", 0, "")], SCHEMA)
    got = chat_format.windows(df, "conv_id", "turn", "role", "text")
    rows = got.withColumn("learnt", chat_format.learnt(F.col("text"), F.col("loss"))).orderBy("chapter", "window").collect()
    assert [x for r in rows for x in r["learnt"]] == [text] and sum(r["n_new"] for r in rows) == 3


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]", r["e"])


def test_op11_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["conv_id"]: r for r in queries.op11_chat_format(spark, sf).collect()}
    given = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert set(rows) == {r["conv_id"] for r in given} | {-1}
    for conv, r in rows.items():
        turns = [(g["role"], g["text"] or "") for g in given if g["conv_id"] == conv] or [("user", queries.CONTROL), ("assistant", queries.CONTROL)]
        learnt = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
