r"""Chat formatting in budgeted windows. Native: DataFrame functions alone.

A window is ``<s>`` and its turns, each a header, the text and ``</s>``. Headers are ``[SYS]``,
``[INST]`` (user), ``[/INST]`` (assistant) and ``[ROLE]name[/ROLE]`` for any other role. Where a text
or name holds one of these strings, a backslash goes after its first character, and one more where
there are some already; reading takes one away, so texts come back as they were.

Turns go in order of turn, with prefix sums of their tokens. A window takes new turns while they fit
the budget, always whole ones. It starts with the conversation's system turn (its first turn, if that
is a system's) and with the turns before its own, as many as fit ``history`` tokens, but no more than
leave room for the first new one. Repeated turns are masked: ``loss`` lists the places of the
assistant texts that are new, so every one is learnt once. Windows end, besides, where the prefix
sum passes a multiple of ``chapter``; the windows of a chapter are chosen from its own turns and the
history before them, so a conversation of any length is spread over its chapters. The prefix sums of
those longer than a chapter are taken over ranges of turns, with a table of offsets, one a range at most.

Cases: null texts are empty, null roles are the role ''; null turns come last; turns that tie go by
MD5 of role and text; repeated rows are turns of their own; rows without a conversation are one
conversation; a turn over the budget has a window of its own, over the budget, uncut; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUDGET, HISTORY, CHAPTER = 512, 128, 64 * 512
#: Turns of long conversations that a range holds, about; long conversations up to which their ids are broadcast.
RANGE, BROADCAST_IDS = 50_000, 200_000
BEGIN, END = "<s>", "</s>"
HEADERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
_MARK = r"<(?=\\{0}/?s>)|\[(?=\\{0}/?(?:INST|SYS|ROLE)\])"
#: Tokens are counted as words and single other signs, as a stand-in for a tokenizer's count.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\t\n\f\r \p{L}\p{M}\p{N}]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, f"({_MARK.format('*+')})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"({_MARK.format('++')})\\", "$1")


def word_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def _header(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))
    for name, mark in HEADERS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


_TURN = ("head", "body", "k", "own", "system", "target")


def _turn(own: Column, system: Column) -> Column:
    return F.struct("head", "body", "k", own.alias("own"), system.alias("system"), "target")


def _short(rows: DataFrame) -> DataFrame:
    """One chapter, with all turns, for each conversation."""
    ordered = F.sort_array(F.collect_list(F.struct("late", "turn", "h", "head", "body", "k", "target")))
    grouped = rows.groupBy("conv").agg(ordered.alias("all"))
    turns = F.transform("all", lambda t, i: F.struct(t["head"].alias("head"), t["body"].alias("body"), t["k"].alias("k"), F.lit(True).alias("own"), ((i == 0) & (t["head"] == HEADERS["system"])).alias("system"), t["target"].alias("target")))
    return grouped.select("conv", F.lit(0).cast("long").alias("chapter"), turns.alias("turns"))


def _long(rows: DataFrame, history: int, chapter: int, per_range: int) -> DataFrame:
    """The chapters of conversations that have several: the system turn, the turns that may be
    repeated, and their own turns."""
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()), "chat-long")
    ranges = rows.count() // per_range + 1
    dealt = rows.repartitionByRange(ranges, "conv", "late", "turn", "h", "tie").withColumn("range", F.spark_partition_id())
    dealt = cut(dealt, "chat-ranges")
    sums = dealt.groupBy("range", "conv").agg(F.sum("k").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")
    # A range goes on with one conversation at most, so this table has a row for each range at most.
    offsets = sums.withColumn("offset", before).filter("offset > 0").select(F.col("range").alias("_range"), F.col("conv").alias("_conv"), "offset")
    inside = F.sum("k").over(Window.partitionBy("range", "conv").orderBy("late", "turn", "h", "tie").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("inside", F.coalesce(inside, F.lit(0)))
    placed = placed.join(F.broadcast(offsets), (F.col("range") == F.col("_range")) & F.col("conv").eqNullSafe(F.col("_conv")), "left")
    placed = placed.withColumn("start", F.col("inside") + F.coalesce("offset", F.lit(0))).withColumn("chapter", F.floor(F.col("start") / chapter))
    placed = cut(placed.select("conv", "chapter", "start", "head", "body", "k", "target"), "chat-placed")

    first = (F.col("start") == 0) & (F.col("head") == HEADERS["system"])
    own = placed.select("conv", "chapter", "start", _turn(F.lit(True), first).alias("turn"))
    near_end = ~first & (F.col("start") >= (F.col("chapter") + 1) * chapter - history)
    earlier = placed.filter(near_end).select("conv", (F.col("chapter") + 1).alias("chapter"), "start", _turn(F.lit(False), F.lit(False)).alias("turn"))
    last = placed.groupBy("conv").agg(F.max("chapter").alias("last")).filter("last > 0").select(F.col("conv").alias("_conv"), "last")
    systems = placed.filter(first).drop("chapter").join(last, F.col("conv").eqNullSafe(F.col("_conv"))).withColumn("chapter", F.explode(F.expr("sequence(1L, last)")))
    systems = systems.select("conv", "chapter", "start", _turn(F.lit(False), F.lit(True)).alias("turn"))
    # A turn that passes several chapters leaves those between without turns of their own.
    grouped = own.unionByName(earlier).unionByName(systems).groupBy("conv", "chapter").agg(F.sort_array(F.collect_list(F.struct("start", "turn"))).alias("all"))
    return grouped.select("conv", "chapter", F.transform("all", lambda t: t["turn"]).alias("turns")).filter(F.exists("turns", lambda t: t["own"]))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _spans(turns: Column, budget: int, history: int) -> Column:
    """from (the first repeated turn but the system's), start and end of each window."""
    sums = F.aggregate(turns, F.array(F.lit(0).cast("long")), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["k"])))
    return _let(sums, lambda p: _chosen(turns, p, budget, history))


def _chosen(turns: Column, sums: Column, budget: int, history: int) -> Column:
    indexed = F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["k"].alias("k"), t["own"].alias("own")))
    system = F.coalesce(F.get(turns, F.lit(0))["system"], F.lit(False))
    kept, low = F.when(system, F.get(turns, F.lit(0))["k"]).otherwise(F.lit(0)).cast("long"), F.when(system, F.lit(1)).otherwise(F.lit(0))
    start = F.struct(F.lit(-1).cast("long").alias("room"), F.array().cast("array<struct<from:int,start:int>>").alias("spans"))

    def opened(state: Column, t: Column) -> Column:
        """Prefix sums choose the earliest turn from which what is before ``t`` fits."""
        i = t["i"]
        beside = F.when(i == 0, F.lit(0).cast("long")).otherwise(kept)
        least = F.get(sums, i) - F.least(F.lit(history).cast("long"), F.lit(budget) - beside - t["k"])
        skipped = _let(least, lambda v: F.size(F.filter(F.slice(sums, 1, i), lambda p, j: (j >= low) & (p < v))))
        first = F.when(i == 0, F.lit(0)).otherwise(low + skipped).cast("int")
        room = lambda f: F.lit(budget) - beside - (F.get(sums, i) - F.get(sums, f)) - t["k"]
        return _let(first, lambda f: F.struct(room(f).alias("room"), F.concat(state["spans"], F.array(F.struct(f.alias("from"), i.alias("start")))).alias("spans")))

    def step(state: Column, t: Column) -> Column:
        same = F.struct((state["room"] - t["k"]).alias("room"), state["spans"].alias("spans"))
        return F.when(~t["own"], state).when(t["k"] <= state["room"], same).otherwise(opened(state, t))

    def ended(state: Column) -> Column:
        end = lambda i: F.coalesce(F.get(state["spans"], i + 1)["start"], F.size(turns))
        return F.transform(state["spans"], lambda s, i: F.struct(s["from"].alias("from"), s["start"].alias("start"), end(i).alias("end")))

    return F.aggregate(indexed, start, step, ended)


def windows(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = word_tokens, chapter: int = CHAPTER, per_range: int = RANGE) -> DataFrame:
    """conv, chapter and window (in their order), n_context (turns at the start that are repeated),
    n_new, n_tokens, text and loss (start, from 0, and length in code points of each new assistant
    text). ``tokens`` counts a text's tokens; header and end count two more."""
    if not 0 <= history < chapter:
        raise ValueError("history must be less than a chapter")
    role_, text_ = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").isNull().alias("late"), F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(role_, F.lit("\n"), text_).cast("binary")).alias("h"), _header(role_).alias("head"), escape(text_).alias("body"),
        (tokens(text_) + 2).cast("long").alias("k"), (role_ == "assistant").alias("target"),
    )
    counts = df.select(F.col(f"`{conv}`").alias("_conv"), (tokens(text_) + 2).cast("long").alias("k"))
    many = cut(counts.groupBy("_conv").agg(F.sum("k").alias("k")).filter(F.col("k") > chapter).select("_conv"), "chat-many")
    n_many = many.count()
    if n_many:
        ids = F.broadcast(many) if n_many <= BROADCAST_IDS else many
        at = F.col("conv").eqNullSafe(F.col("_conv"))
        chapters = _short(rows.join(ids, at, "left_anti")).unionByName(_long(rows.join(ids, at, "left_semi"), history, chapter, per_range))
    else:
        chapters = _short(rows)
    chapters = chapters.withColumn("spans", _spans(F.col("turns"), budget, history))

    def window(s: Column, i: Column) -> Column:
        retained = F.filter(F.slice("turns", 1, 1), lambda t: t["system"] & (s["start"] > 0))
        return F.struct(i.alias("window"), (s["end"] - s["start"]).alias("n_new"), F.concat(retained, F.slice("turns", s["from"] + 1, s["end"] - s["from"])).alias("turns"))

    each = chapters.select("conv", "chapter", F.explode(F.transform("spans", window)).alias("w")).select("conv", "chapter", "w.window", "w.n_new", "w.turns")
    each = each.withColumn("n_context", F.size("turns") - F.col("n_new"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    marked = F.transform("turns", lambda t, i: F.struct(t["head"].alias("head"), t["body"].alias("body"), (t["target"] & (i >= F.col("n_context"))).alias("target")))
    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def place(state: Column, t: Column) -> Column:
        begin, length = state["at"] + F.length(t["head"]), F.length(t["body"])
        one = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct((begin + length + len(END)).alias("at"), F.when(t["target"], F.concat(state["loss"], one)).otherwise(state["loss"]).alias("loss"))

    loss = F.aggregate(marked, start, place, lambda s: s["loss"])
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["k"])
    return each.select(F.col("conv").alias(conv), "chapter", "window", "n_context", "n_new", n_tokens.alias("n_tokens"), F.concat(F.lit(BEGIN), F.array_join(pieces, "")).alias("text"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns (role and text) that a formatted window holds."""
    parts = F.split(F.substr(text, F.lit(len(BEGIN) + 1)), END)

    def read(p: Column) -> Column:
        name = F.regexp_extract(p, r"(?s)\A\[ROLE\](.*?)\[/ROLE\]", 1)
        role, head = unescape(name), F.length(name) + len("[ROLE][/ROLE]")
        for known, mark in HEADERS.items():
            role, head = F.when(p.startswith(mark), F.lit(known)).otherwise(role), F.when(p.startswith(mark), F.lit(len(mark))).otherwise(head)
        return F.struct(role.alias("role"), unescape(F.substr(p, head + 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), read)


def learnt(text: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"])))
