"""Line deduplication across documents by a segment-partition edit join. Native: DataFrame
functions alone.

Two lines are the same when their edit distance is at most the threshold that ``edits`` gives
for the length of the shorter one. An indexed line is split into threshold + 1 segments; a line
within the distance holds one of them unchanged, near its place. So lines are indexed by
(length, segment number, segment) and probe with their own substrings for each length that
isn't larger than theirs by more than the threshold, at the starts which the edits before and
after the segment allow. Candidates are verified by a banded bit-parallel edit distance.
Shorter lines take part in the comparison of equal lines, from ``equal_from`` code points on,
and in no join.

Segments that many lines share (templates, near copies) aren't joined. Their lines meet by blocks
of their character pairs: an edit changes at most four pairs, so of 4 * threshold + 1 blocks, dealt
by the pairs' hashes, one is the same in both lines. Where even such a block is shared by more
lines than may be paired, the lines are taken apart: what lies left and right of a shared segment
has a share of the threshold each and is split into segments again, until a group's pairs are few,
or until the pieces are no longer than their thresholds. Then all lines of the group are within the
threshold of each other, and it is one class of lines instead of pairs. So lines that have most of
their text in common, but differ by more than the threshold, make hardly any candidates, and no
pair is lost. A sample decides which segments are shared; both ways find the same pairs.

Lines are trimmed and equal ones collapsed before the join, which moves hashes, not texts;
only candidates' texts are fetched. Lines go in order of their first occurrence (by document key,
row, position): a line is kept unless a line that is kept comes before it within the distance.
So a line goes only for one that stays. Of a kept line, the first occurrence stays; of the others,
none. Shorter lines go for equal ones alone.

Cases: null and empty texts have no lines to remove; null keys come last; rows are told apart even
where keys repeat or are null (they get a number, written once); other columns are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.greedy import decided
from .common import cut, forget, fresh, settled

MIN_CHARS = 32
#: The least length of a line and the edits allowed from there on.
EDITS = ((MIN_CHARS, 1), (256, 2))
BUCKETS = 1 << 20
#: One line of so many is counted to find segments that many lines share, and the count from
#: which such a segment is taken apart. Pairs that a group makes at most after that.
SAMPLED, SHARED, PAIRS = 8, 4, 1024

#: (least length, least length that has another threshold or None, threshold)
Band = tuple[int, int | None, int]


def bands_of(edits: int | Sequence[tuple[int, int]], least: int) -> list[Band]:
    steps = [(least, edits)] if isinstance(edits, int) else sorted((max(n, least), e) for n, e in edits)
    return [(low, steps[k + 1][0] if k + 1 < len(steps) else None, e) for k, (low, e) in enumerate(steps)]


def _threshold(length: Column, bands: list[Band]) -> Column:
    """The edits allowed for a length; null where there are none."""
    out = F.lit(None).cast("int")
    for low, _, e in bands:
        out = F.when(length >= low, F.lit(e)).otherwise(out)
    return out


def edit_distance_at_most(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings, whose lengths differ by ``edits`` at most, are within ``edits``.

    Bit k of a column's vectors is the row ``edits - k`` above the diagonal. The distance is
    followed down the lower edge of the band, then along the last row."""
    split = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("m"), F.length(b).alias("n"))
    distance = F.transform(F.array(split), lambda s: _distance(s["x"], s["y"], s["m"], s["n"], edits))[0]  # split once
    m, n = F.length(a), F.length(b)
    return F.when(F.greatest(m, n) <= edits, F.lit(True)).when(F.least(m, n) <= edits, F.levenshtein(a, b) <= edits).otherwise(distance <= edits)


def _distance(x: Column, y: Column, m: Column, n: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = (1 << width) - 1

    def match(j: Column) -> Column:
        bits = [F.when(F.get(x, j - edits + k) == F.get(y, j), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        out = bits[0]
        for bit in bits[1:]:
            out = out + bit
        return out

    def flip(c: Column) -> Column:
        return c.bitwiseXOR(F.lit(full))

    def step(state: Column, at: Column) -> Column:
        vp, vn, eq, j = state["vp"], state["vn"], at["eq"], at["j"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.transform(F.array(d0), lambda d: after(state, j, d))[0]

    def after(state: Column, j: Column, d0: Column) -> Column:
        vp, vn, score = state["vp"], state["vn"], state["score"]
        hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        place = m - j - 1 + edits  # of the last row, once the band has reached it
        bit = lambda v: F.expr("1").bitwiseAND(F.call_function("shiftright", v, F.greatest(place, F.lit(0))))
        on_edge = F.lit(1) - F.shiftright(d0, width - 1).bitwiseAND(F.lit(1))
        score = score + F.when(j + edits < m, on_edge).otherwise(bit(hp) - bit(hn))
        return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

    columns = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(match(j).alias("eq"), j.alias("j")))
    rows_above = (1 << edits) - 1  # rows that lie outside of the table before the first column
    start = F.struct(F.lit(full & ~rows_above).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(edits)).alias("score"))
    return F.aggregate(columns, start, step, lambda s: s["score"])


def _common(a: Column, b: Column) -> Column:
    """The length of the longest common prefix, by halving steps."""
    grow = lambda n, step: F.when((n + step <= F.least(F.length(a), F.length(b))) & (F.substr(a, n + 1, step) == F.substr(b, n + 1, step)), n + step).otherwise(n)
    most = F.floor(F.log2(F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), grow)


def within(pairs: DataFrame, a: str, b: str, edits: int | Sequence[int], of: str | None = None) -> DataFrame:
    """The pairs of strings within ``edits``; ``a`` is the shorter one of each. With several
    thresholds, column ``of`` says which one a pair has. Common ends, which don't change the
    distance, are cut off before it is computed."""
    rows = pairs.withColumn("_low", _common(F.col(a), F.col(b)))
    rows = rows.withColumns({"_x": F.expr(f"substr({a}, _low + 1)"), "_y": F.expr(f"substr({b}, _low + 1)")})
    rows = rows.withColumn("_high", _common(F.reverse("_x"), F.reverse("_y")))
    rows = rows.withColumns({"_x": F.expr("left(_x, length(_x) - _high)"), "_y": F.expr("left(_y, length(_y) - _high)")})
    # Written before it is filtered: the optimizer would copy these columns into the filters.
    rows = cut(rows.drop("_low", "_high"), "line-rests")
    near = F.lit(False)
    for e in [edits] if isinstance(edits, int) else edits:
        x, y = F.col("_x"), F.col("_y")
        fits = F.when(_possible(x, y, e), edit_distance_at_most(x, y, e)).otherwise(F.lit(False))
        near = F.when(F.col(of) == e, fits).otherwise(near) if of else fits
    return rows.filter(near).drop("_x", "_y")


def _possible(x: Column, y: Column, edits: int) -> Column:
    """A cheap necessary condition for two rests without common ends, ``x`` being the shorter one.
    The first and the last edit touch the ends, so one of edits - 1 segments of what is between
    the ends of ``x`` stands in ``y``, moved by less than ``edits``."""
    n = F.length(x)
    if edits == 1:
        return F.length(y) <= 1
    size = F.floor((n - 2) / (edits - 1)).cast("int")
    alike = F.lit(False)
    for k in range(edits - 1):
        start = size * k + 2
        length = size if k < edits - 2 else n - 2 - size * k
        for shift in range(1 - edits, edits):
            alike = alike | (F.substr(x, start, length) == F.substr(y, start + shift, length))
    return (n <= edits) | alike


def _segment(length: Column, i: int | Column, edits: int | Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0) of a line: the longer ones come last."""
    parts = edits + 1
    short, longer = F.floor(length / parts), length % parts
    start = short * i + F.greatest(F.lit(0), longer - (parts - i)) + 1
    return start.cast("int"), (short + (longer >= parts - i).cast("int")).cast("int")


Names = list[tuple[str, str | None]]


def _keyed(lines: DataFrame, bands: list[Band]) -> tuple[DataFrame, Names, Names]:
    """key, h1, h2 of ``lines`` and the keys that each is indexed under, then the further ones that it
    probes with (it probes with the former too, for lines of its length); null where it has fewer.
    Also the names of these columns, each with that of its rest or None.

    For one edit, a rest is two hashes of what is beside the segment: of the part from the rest's
    start and of the one from its end. One edit leaves one of them as it is.

    Segments are cut from four bytes a sign, where they are found without going through the line.
    One expression serves all thresholds. With the lambda of the rests, Spark makes several methods
    of these columns; of one that long, the JVM would interpret every step."""
    top = max(e for _, _, e in bands)
    rows = lines.select("at.key", "h1", "h2", F.encode("line", "UTF-32").alias("wide"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = rows.select("*", *[F.coalesce(_threshold(F.col("n") - d, bands), F.lit(-1)).alias(f"e{d}") for d in range(top + 1)])
    shorts = [F.when(F.col(f"e{d}") >= 0, F.floor((F.col("n") - d) / (F.col(f"e{d}") + 1))).otherwise(0).cast("int").alias(f"s{d}") for d in range(top + 1)]
    rows = rows.select("*", *shorts)
    n, signs = F.col("n"), lambda start, size: F.substring("wide", 4 * start - 3, 4 * size)

    def segment(i: int, d: int) -> tuple[Column, Column]:
        e, short = F.col(f"e{d}"), F.col(f"s{d}")
        over = n - d - short * (e + 1) - (e + 1 - i)  # the longer segments come last
        return short * i + F.greatest(F.lit(0), over) + 1, short + (over >= 0).cast("int")

    def rest(i: int, d: int) -> Column:
        short = F.col(f"s{d}")
        size, begin = (n - d - short, short + 1) if i == 0 else (short, F.lit(1))
        head = F.shiftright(size, 1)
        parts = F.array(*[F.struct(at.alias("at"), long.alias("size")) for at, long in ((begin, head), (begin + head + d, size - head))])
        one = lambda p: F.hash(signs(p["at"], p["size"])).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: F.shiftleft(s, 32).bitwiseOR(one(p)))

    index, probes, columns = [], [], []
    for d in range(top + 1):  # how much longer the line is than the indexed one
        for i in range(top + 1):
            for shift in range(max(-i, d - (top - i)), min(i, d + (top - i)) + 1):
                least = max(i, d, d + i - shift, i + shift - d)  # edits that allow this segment here
                own, name = (index, f"i{i}") if d == shift == 0 else (probes, f"p{len(probes)}")
                start, size = segment(i, d)
                columns.append(F.when(F.col(f"e{d}") >= least, F.xxhash64(n - d, F.lit(i), signs(start + shift, size))).alias(name))
                beside = f"{name}_rest" if least <= 1 and any(e == 1 for _, _, e in bands) else None
                if beside:
                    columns.append(F.when(F.col(f"e{d}") == 1, rest(i, d)).otherwise(F.lit(0).cast("long")).alias(beside))
                own.append((name, beside))
    return rows.select("key", "h1", "h2", *columns), index, probes


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """A row for each line: where it stands (``at``, in order), its hashes and length."""
    lines = rows.select("row", F.col("key").isNull().alias("no"), "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).withColumn("n", F.length("line")).filter(F.col("n") >= least)
    return lines.select("row", F.struct("no", "key", "row", "pos").alias("at"), "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(5), "line").alias("h2"))


def _texts(lines: DataFrame, distinct: DataFrame, ids: DataFrame) -> DataFrame:
    """h1, h2, at (of the first occurrence), line and n of the lines ``ids`` (h1, h2)."""
    wanted = cut(distinct.select("h1", "h2", "key").join(ids.distinct(), ["h1", "h2"]), "line-ids")
    # Most lines aren't candidates: a set of at most BUCKETS numbers keeps their texts from the shuffle.
    bucket = F.pmod("h1", F.lit(BUCKETS)).cast("int").alias("bucket")
    some = lines.select("at", "h1", "h2", "line", "n", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi")
    found = some.join(wanted, (some["h1"] == wanted["h1"]) & (some["h2"] == wanted["h2"]) & some["at.key"].eqNullSafe(wanted["key"]), "left_semi")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("at", "line", "n")).alias("x"))
    out = cut(first.select("h1", "h2", "x.*"), "line-texts")
    forget(wanted)
    return out


def _block_pairs(texts: DataFrame, bands: list[Band], pairs_at_most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``texts`` that have a block of character pairs in common and may be within
    the distance, and the ids of lines whose blocks too many lines share."""
    blocks, signs = 4 * max(e for _, _, e in bands) + 1, F.split("line", "")
    hashed = F.zip_with(F.slice(signs, F.lit(1), F.col("n") - 1), F.slice(signs, F.lit(2), F.col("n") - 1), lambda a, b: F.hash(a, b).cast("long"))
    rows = texts.select("h1", "h2", "n", hashed.alias("grams"))
    one = lambda b: F.xxhash64(F.lit(b), F.aggregate(F.filter("grams", lambda v: F.pmod(v, F.lit(blocks)) == b), F.lit(0).cast("long"), lambda s, v: s + v))
    parity = F.aggregate("grams", F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))))
    rows = cut(rows.select("h1", "h2", "n", parity.alias("p"), F.explode(F.array(*[one(b) for b in range(blocks)])).alias("g")), "line-blocks")
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g", (F.col("k") * F.col("k") > pairs_at_most).alias("open")), "line-block-sizes")
    few = rows.join(sizes.filter("not open"), "g")
    left, right = (few.select("g", *[F.col(c).alias(f"{c}{t}") for c in ("h1", "h2", "n", "p")]) for t in "ab")
    edits = _threshold(F.least("na", "nb"), bands)
    may = (F.abs(F.col("na") - F.col("nb")) <= edits) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 4 * edits)
    pairs = left.join(right, "g").filter(F.expr("(h1a, h2a) < (h1b, h2b)") & may).select("h1a", "h2a", "h1b", "h2b")
    return pairs, rows.join(sizes.filter("open"), "g", "left_semi").select("h1", "h2").distinct()


_PIECES = "array<struct<x:int,n:int,y:int,m:int,t:int>>"


def _piece(x: Column, n: Column, y: Column, m: Column, t: Column) -> Column:
    return F.struct(*[c.cast("int").alias(k) for k, c in zip("xnymt", (x, n, y, m, t), strict=True)])


def _taken_apart(rows: DataFrame) -> DataFrame:
    """A row for each segment of the longest piece. ``rows``: probe (whether the line probes), even
    (whether for lines of its own length), h1, h2, line, g (what it has in common with its group) and pieces: what isn't in g, from code
    point x, n long, in the indexed line and from y, m long, in the probing one, with at most t
    edits."""
    longest = F.array_max(F.transform("pieces", lambda p, i: F.struct(F.when(p["n"] > p["t"], p["n"]).otherwise(F.lit(-1)).alias("n"), i.alias("i"))))
    rows = rows.withColumn("i", longest["i"]).withColumn("p", F.col("pieces")[F.col("i")])
    p = {k: F.col(f"p.{k}") for k in "xnymt"}
    others = F.filter("pieces", lambda _, k: k != F.col("i"))
    longer = p["m"] - p["n"]

    def at(j: Column, shift: Column) -> Column:
        start, size = _segment(p["n"], j, p["t"])
        before = start - 1
        left = _piece(p["x"], before, p["y"], before + shift, j)
        right = _piece(p["x"] + before + size, p["n"] - before - size, p["y"] + before + shift + size, p["m"] - before - shift - size, p["t"] - j)
        key = F.xxhash64("g", "i", j, F.substr(F.col("line"), (p["y"] + before + shift + 1).cast("int"), size))
        return F.struct(key.alias("g"), F.concat(others, F.filter(F.array(left, right), lambda q: (q["t"] > 0) & (q["n"] > 0))).alias("pieces"))

    def starts(j: Column) -> Column:
        shifts = F.sequence(F.greatest(-j, longer - p["t"] + j), F.least(j, longer + p["t"] - j))
        return F.transform(F.when(F.col("probe"), shifts).otherwise(F.array(F.lit(0))), lambda s: at(j, s))

    each = F.flatten(F.transform(F.sequence(F.lit(0), p["t"]), starts))
    return rows.select("probe", "even", "h1", "h2", "line", F.explode(each).alias("one")).select("probe", "even", "h1", "h2", "line", "one.g", "one.pieces")


def _apart_pairs(texts: DataFrame, bands: list[Band], pairs_at_most: int) -> list[DataFrame]:
    """Tables of pairs (h1a, h2a, h1b, h2b, class) that hold all pairs of ``texts`` within the distance.
    Those with a class are a class's first line and its other ones."""
    whole = lambda length, edits: F.array(_piece(F.lit(0), length, F.lit(0), F.col("n"), edits)).cast(_PIECES)
    row = lambda probe, length, edits: F.struct(F.lit(probe).alias("probe"), (length == F.col("n")).alias("even"), F.xxhash64(length, edits).alias("g"), whole(length, edits).alias("pieces"), (edits >= F.col("n") - length).alias("fits"))
    n = F.col("n")
    most = max(e for _, _, e in bands)
    starts = F.array(row(False, n, _threshold(n, bands)), *[row(True, n - d, _threshold(n - d, bands)) for d in range(most + 1)])
    state = _taken_apart(texts.select("h1", "h2", "line", F.explode(F.filter(starts, lambda s: F.coalesce(s["fits"], F.lit(False)))).alias("s")).select("s.probe", "s.even", "h1", "h2", "line", "s.g", "s.pieces"))
    out, state = [], cut(state, "line-pieces")
    while True:
        able, whole = F.exists("pieces", lambda p: p["n"] > p["t"]), ~F.exists("pieces", lambda p: F.greatest(p["n"], p["m"]) > p["t"])
        sizes = state.groupBy("g").agg(F.count_if(~F.col("probe")).alias("a"), F.count_if("probe").alias("b"), F.max(able).alias("able"), F.min(whole).alias("whole"), F.min(F.struct("h1", "h2")).alias("first")).filter("a > 0 and b > 0")
        sizes = cut(sizes.select("g", "whole", "first", (F.col("able") & (F.col("a") * F.col("b") > pairs_at_most)).alias("open")), "line-groups")
        classes = state.join(sizes.filter("whole"), "g").filter(F.struct("h1", "h2") != F.col("first"))
        classes = classes.select(F.col("first.h1").alias("h1a"), F.col("first.h2").alias("h2a"), F.col("h1").alias("h1b"), F.col("h2").alias("h2b"), F.xxhash64(F.lit(len(out)), "g").alias("class"))
        few = state.join(sizes.filter("not open and not whole"), "g")
        left, right = few.filter("not probe").select("g", "h1", "h2").toDF("g", "h1a", "h2a"), few.filter("probe").select("g", "h1", "h2", "even").toDF("g", "h1b", "h2b", "even")
        pairs = left.join(right, "g").filter("(h1a, h2a) < (h1b, h2b) or (not even and (h1a, h2a) <> (h1b, h2b))")  # lines of one length meet both ways
        # Written level by level: one plan of all levels would be a burden to the driver.
        out.append(cut(classes.unionByName(pairs.select("h1a", "h2a", "h1b", "h2b", F.lit(None).cast("long").alias("class"))), "line-level"))
        many = sizes.filter("open")
        if many.isEmpty():
            forget(state, sizes)
            return out
        deeper = cut(_taken_apart(state.join(many.select("g"), "g", "left_semi")), "line-pieces")
        forget(state, sizes)
        state = deeper


def _candidates(distinct: DataFrame, lines: DataFrame, index: Names, probes: Names, bands: list[Band]) -> DataFrame:
    """h1a, h2a, h1b, h2b: pairs of different lines, the smaller hashes first."""

    def side(rows: DataFrame, columns: Names, tag: str) -> DataFrame:
        entries = F.array(*[F.struct(F.col(k).alias("key"), (F.col(r) if r else F.lit(0).cast("long")).alias("rest")) for k, r in columns])
        each = rows.select(F.explode(entries).alias("x"), "h1", "h2").filter(F.col("x.key").isNotNull())
        return each.select("x.key", F.col("x.rest").alias(f"rest{tag}"), F.col("h1").alias(f"h1{tag}"), F.col("h2").alias(f"h2{tag}"))

    sampled = side(distinct.filter(F.pmod("h1", F.lit(SAMPLED)) == 0), index, "a")
    shared = cut(sampled.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED).select("key"), "shared-segments")
    any_shared = not shared.isEmpty()
    rare = (lambda rows: rows.join(shared, "key", "left_anti")) if any_shared else (lambda rows: rows)
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    alike = (low("resta") == low("restb")) | (high("resta") == high("restb"))
    left = rare(side(distinct, index, "a"))
    found = [left.join(rare(side(distinct, names, "b")), "key").filter(alike).select("h1a", "h2a", "h1b", "h2b") for names in (index, probes)]
    found[0] = found[0].filter("(h1a, h2a) < (h1b, h2b)")
    none = F.lit(None).cast("long").alias("class")
    if any_shared:
        everything = side(distinct, index + probes, "")
        texts = _texts(lines, distinct, everything.join(shared, "key", "left_semi").select("h1", "h2"))
        by_block, crowded = _block_pairs(texts, bands, PAIRS)
        found.append(by_block)
        crowded = cut(crowded, "line-crowded")
        apart = [] if crowded.isEmpty() else _apart_pairs(texts.join(crowded, ["h1", "h2"], "left_semi"), bands, PAIRS)
    else:
        apart = []
    pairs = found[0].withColumn("class", none)
    for more in [*(f.withColumn("class", none) for f in found[1:]), *apart]:
        pairs = pairs.unionByName(more)
    one, other = F.struct("h1a", "h2a"), F.struct("h1b", "h2b")
    swap = F.col("class").isNull() & (one > other)
    ordered = pairs.select("class", *[F.when(swap, F.col(f"{h}{b}")).otherwise(F.col(f"{h}{a}")).alias(f"{h}{a}") for a, b in ("ab", "ba") for h in ("h1", "h2")])
    return cut(ordered.filter("h1a <> h1b or h2a <> h2b").distinct(), "line-pairs")


def _removed(rows: DataFrame, edits: int | Sequence[tuple[int, int]], least: int, equal_from: int | None) -> DataFrame:
    """row and removed for each row (row, key, text) with lines to remove."""
    bands = bands_of(edits, least)
    lines = _lines(rows, least if equal_from is None else min(least, equal_from))
    keyed, *names = _keyed(lines, bands)
    distinct = keyed.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("n"), *[F.max(n).alias(n) for n in keyed.columns[3:]])
    distinct = cut(distinct, "lines")
    pairs = settled(lambda: _candidates(distinct, lines, *names, bands), "line-pairs")
    texts = _texts(lines, distinct, pairs.select(F.explode(F.array(F.struct(F.col("h1a").alias("h1"), F.col("h2a").alias("h2")), F.struct(F.col("h1b").alias("h1"), F.col("h2b").alias("h2")))).alias("x")).select("x.*"))
    of = lambda t: texts.select(F.col("h1").alias(f"h1{t}"), F.col("h2").alias(f"h2{t}"), F.struct("line", "n", F.struct("at.*", "h1", "h2").alias("at")).alias(t))
    both = pairs.join(of("a"), ["h1a", "h2a"]).join(of("b"), ["h1b", "h2b"])
    both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h1a", "h2b")  # costly rows: not to be coalesced by size
    shorter = F.col("a.n") <= F.col("b.n")
    group = F.struct(F.coalesce("class", F.lit(0)).alias("class"), "h1a", "h2a", F.when(F.col("class").isNull(), F.col("h1b")).alias("h1"), F.when(F.col("class").isNull(), F.col("h2b")).alias("h2"))
    sized = both.select(group.alias("group"), F.col("a.at").alias("one"), F.col("b.at").alias("two"), F.when(shorter, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(shorter, F.col("b")).otherwise(F.col("a")).alias("l"))
    sized = cut(sized.select("group", "one", "two", F.col("s.line").alias("x"), F.col("l.line").alias("y"), _threshold(F.col("s.n"), bands).alias("edits"), (F.col("l.n") - F.col("s.n")).alias("gap")), "line-candidates")
    forget(texts)
    near = settled(lambda: within(sized.filter("gap <= edits"), "x", "y", sorted({e for _, _, e in bands}), "edits").select("group", "one", "two"), "line-near")
    forget(sized, pairs)
    rivals = decided(near.select("group", F.explode(F.array("one", "two")).alias("at")), "group", "at").filter("not kept").select("at.h1", "at.h2")

    counted = distinct.select("h1", "h2", F.col("key").alias("least"), "n").join(rivals.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    marked = cut(counted.filter("n > 1 or near").select("h1", "h2", "least", F.coalesce("near", F.lit(False)).alias("near")), "line-marked")
    forget(distinct, near)
    # A line that most rows have is one key of this join; adaptive execution splits it, as it is an inner
    # join of two exchanges (``marked`` was written, else the join that it comes from would be in one stage with this one).
    seen = lines.select("row", "at", "h1", "h2").join(marked, ["h1", "h2"])
    seen = cut(seen.select("row", "at.pos", "h1", "h2", "near", F.col("at.key").eqNullSafe(F.col("least")).alias("early")), "line-seen")
    forget(marked)
    # Of the occurrences with the smallest key, only the first one stays.
    early = seen.filter("early and not near").select("h1", "h2", F.struct("row", "pos").alias("at"))
    first = early.groupBy("h1", "h2").agg(F.min("at").alias("first"))
    later = early.join(first, ["h1", "h2"]).filter(F.col("at") != F.col("first")).select("at.row", "at.pos")
    gone = seen.filter("near or not early").select("row", "pos").unionByName(later)
    return gone.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number for each row, written once, and the number's column."""
    at = fresh(df, "_row")
    return cut(df.withColumn(at, F.monotonically_increasing_id()), "line-rows"), at


def repeated_lines(df: DataFrame, key: str, text: str, edits: int | Sequence[tuple[int, int]] = EDITS, least: int = MIN_CHARS, equal_from: int | None = None, into: str = "removed") -> DataFrame:
    """The rows of ``df``, with the positions (from 0) of the lines to remove in ``into``, which
    mustn't be a column. ``edits``: the threshold, or (least length, threshold) pairs.
    ``equal_from``: the length from which equal lines are compared; ``least`` unless given."""
    if into.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"{into} is a column already")
    numbered, at = _numbered(df)
    rows = numbered.select(F.col(at).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    other = fresh(numbered, "_of")
    gone = settled(lambda: _removed(rows, edits, least, equal_from), "line-gone").toDF(other, into)
    return numbered.join(gone, F.col(at) == F.col(other), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(into, F.array().cast("array<int>")).alias(into))


def deduplicated(df: DataFrame, key: str, text: str, edits: int | Sequence[tuple[int, int]] = EDITS, least: int = MIN_CHARS, equal_from: int | None = None, into: str = "removed_lines") -> DataFrame:
    """``df`` with ``text`` rid of repeated lines, and their number in ``into``, which mustn't be a column."""
    found = repeated_lines(df, key, text, edits, least, equal_from, into)
    left = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(F.col(into), i))
    cleaned = F.when(F.size(into) == 0, F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return found.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns], F.size(into).alias(into))
