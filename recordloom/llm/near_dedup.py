"""MinHash near-deduplication by an inverted join of signature coordinates.

A text is the set of its distinct 5-word shingles; texts are linked when the Jaccard
similarity of their sets is at least ``num / den``. Steps:

1. Sign: each set gets COORDINATES min-hashes. Equal sets are one node from here on.
2. Post: a node is posted under its coordinate-value pairs. A linked pair shares MATCHES
   or more of them (all but about one in 10**5 at the very threshold), so each node is
   posted only under its rarest pairs, COORDINATES - MATCHES + 1 less those that no other
   node has (prefix), and not at all if too few are left (skip).
3. Prune: shingles that occur in no other posted node are counted. They bound a node's
   intersection with any other, as do bitmaps, and so rule out nodes and, later, pairs.
4. Lead: in every list the node with most shared pairs leads. A few rounds compare each
   node with one leader and merge what is linked, so that large groups of near copies
   become one component without all their pairs.
5. Rest: nodes that share a list but are in different components yet are compared with
   each other, at the first list that they share.

Every comparison first counts the matching coordinates, then takes both whole sets. Links
within a component that is known already add nothing and aren't looked for.

Cases: null and blank texts have no shingles and stand alone; fewer words than five are
one shingle; equal texts and repeated rows share a component; null keys don't become a
component's id unless all its keys are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import cut, forget, settled
from .components import components

COORDINATES = 64
MATCHES = 33
ROUNDS = 3
#: Bits of a set's bitmap.
BITS = 2048
_rng = np.random.default_rng(9)
_XOR = _rng.integers(1 << 63, size=(COORDINATES, 1), dtype=np.uint64) * np.uint64(2)
_TIMES = _rng.integers(1 << 63, size=(COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 4096


def signature(ids: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs: the min-hash in the upper 58 bits, the coordinate below."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(ids), _BLOCK):
        low = np.minimum(low, ((ids[k : k + _BLOCK] ^ _XOR) * _TIMES).min(axis=1))
    return ((low & ~np.uint64(63)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """uid, key, the text's digest, n_shingles, two hashes of the set and the signature (null for empty sets)."""
    kind = df.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                sets = [shingles.shingle_set(t) for t in part["t"]]
                mixed = [shingles.mix(s) for s in sets]
                yield pd.DataFrame({
                    "key": part["key"],
                    "digest": part["digest"],
                    "n_shingles": [len(s) for s in sets],
                    "s1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in mixed],
                    "s2": [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in mixed],
                    "signature": [signature(s) if len(s) else None for s in sets],
                })

    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("t")).mapInPandas(sign, f"key {kind}, digest long, n_shingles long, s1 long, s2 long, signature array<long>")
    return rows.withColumn("uid", F.monotonically_increasing_id())


def _bar(num: int, den: int, inter: Column, a: Column, b: Column) -> Column:
    return den * inter >= num * (a + b - inter)


def _postings(reps: DataFrame) -> DataFrame:
    """node, shared (how many of its pairs other nodes have), prefix (its posted pairs, rarest first)."""
    pairs = reps.select("node", F.explode("signature").alias("pair"))
    often = pairs.groupBy("pair").agg(F.count("*").alias("freq")).filter("freq > 1")
    found = pairs.join(often, "pair").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "pair"))).alias("found"))  # at most COORDINATES each
    room = F.size("found") - (MATCHES - 1)  # COORDINATES - MATCHES + 1, less the pairs of its own
    return found.filter(F.size("found") >= MATCHES).select("node", F.size("found").alias("shared"), F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["freq"]).alias("weight"), F.slice("found", F.lit(1), room).getField("pair").alias("prefix"))


def bitmap(ids: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its low bits: a bit of one set that another lacks stands for a
    shingle at least that the other lacks."""
    flags = np.zeros(BITS, dtype=np.uint8)
    flags[(ids & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.int64)


def _sets(df: DataFrame) -> DataFrame:
    """node, its sorted shingles and their bitmap, from node and text."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                sets = [shingles.shingle_set(t) for t in part["t"]]
                yield pd.DataFrame({"node": part["node"], "ids": [s.view(np.int64) for s in sets], "bits": [bitmap(s) for s in sets]})

    return df.mapInPandas(build, "node long, ids array<long>, bits array<long>")


def _only(a: Column, b: Column) -> Column:
    """How many bits of bitmap ``a`` are not in ``b``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def _roomy(num: int, den: int, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the shingles that each of two nodes shares with any node suffice for a link."""
    return _bar(num, den, F.least(a["common"], b["common"]), a["n_shingles"], b["n_shingles"])


def _possible(num: int, den: int, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the shingles that the bitmaps don't tell apart suffice for a link."""
    tight = F.least(a["n_shingles"] - _only(a["bits"], b["bits"]), b["n_shingles"] - _only(b["bits"], a["bits"]))
    return _bar(num, den, tight, a["n_shingles"], b["n_shingles"])


_SIDE = ("n_shingles", "common", "bits", "signature")


def _shared(sets: DataFrame) -> DataFrame:
    """node, bits and common: how many of its shingles occur in another node. The intersection with
    any other set is no larger."""
    each = sets.select("node", F.explode("ids").alias("id"))
    own = each.groupBy("id").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", "ids", "bits").join(own, "node", "left").select("node", "bits", (F.size("ids") - F.coalesce("own", F.lit(0))).alias("common"))


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): sizes and coordinates first, then the sets."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct(*_SIDE).alias(f"of_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    a, b = ({n: F.col(f"of_{c}.{n}") for n in _SIDE} for c in "ab")
    alike = F.aggregate(F.zip_with(a["signature"], b["signature"], lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = both.filter(F.when(_roomy(num, den, a, b), F.when(alike >= MATCHES, _possible(num, den, a, b)))).select("a", "b")
    near = close.join(sets.select(F.col("node").alias("a"), F.col("ids").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("ids").alias("ib")), "b")
    return near.filter(_bar(num, den, F.size(F.array_intersect("ia", "ib")), F.size("ia"), F.size("ib"))).select("a", "b")


def _new(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def _links(nodes: DataFrame, sets: DataFrame, num: int, den: int, rounds: int) -> DataFrame:
    """node and label of every node that has a link. ``nodes``: node, n_shingles, common, bits, signature, weight, prefix."""
    lists = nodes.select("node", "weight", F.explode("prefix").alias("pair"))
    leaders = lists.groupBy("pair").agg(F.max(F.struct("weight", "node")).alias("first"))
    rivals = lists.select("node", "pair").join(leaders, "pair").filter(F.col("node") != F.col("first.node")).groupBy("node", "first").agg(F.count("*").alias("hits"))
    rivals = cut(rivals.select(F.col("node").alias("a"), F.col("first.node").alias("b"), F.struct("hits", "first.weight", F.col("first.node").alias("b")).alias("merit")), "rivals")
    labels = links = tried = None
    turns = []
    for k in range(rounds):
        left = rivals if labels is None else _new(rivals, labels).join(tried, ["a", "b"], "left_anti")
        turn = cut(left.groupBy("a").agg(F.max("merit").alias("merit")).select("a", F.col("merit.b").alias("b")), f"turn-{k}")
        turns.append(turn)
        found = cut(_verified(turn, nodes, sets, num, den), f"links-{k}")
        tried, links = (turn, found) if k == 0 else (tried.union(turn), links.union(found))
        if k == 0 or not found.isEmpty():
            labels, before = components(links), labels
            if k:
                forget(before)
    forget(rivals, *turns)
    # What the leaders left open: pairs of one list in different components, at their first common list.
    placed = lists.select("node", "pair").join(nodes.select("node", "n_shingles", "common", "bits", "prefix"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("pair").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("pair")
    open_ = cut(placed.join(mixed, "pair").select("pair", "node", "label", "n_shingles", "common", "bits", "prefix"), "open-lists")
    x, y = open_.alias("x"), open_.alias("y")
    one, other = ({n: F.col(f"{t}.{n}") for n in _SIDE[:3]} for t in "xy")
    pairs = x.join(
        y,
        (F.col("x.pair") == F.col("y.pair")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
        # Nested, so that the dearer tests run only where the cheaper ones pass.
        & F.when(_roomy(num, den, one, other), F.when(F.array_min(F.array_intersect("x.prefix", "y.prefix")) == F.col("x.pair"), _possible(num, den, one, other))),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = cut(pairs, "open-pairs")
    forget(open_)
    rest = cut(_verified(pairs, nodes, sets, num, den), "links-rest")
    forget(pairs)
    return labels if rest.isEmpty() else components(links.union(rest))


def near_duplicates(df: DataFrame, key: str, text: str, num: int = 75, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) and kept."""
    return settled(lambda: _classes(df, key, text, num, den, rounds), "near-classes")


def _classes(df: DataFrame, key: str, text: str, num: int, den: int, rounds: int) -> DataFrame:
    rows = cut(signed(df, key, text), "signed")
    groups = cut(rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("uid").alias("node"), F.min("key").alias("least")), "set-groups")
    reps = rows.join(groups.select(F.col("node").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "node")
    posted = cut(_postings(reps), "postings")
    placed = cut(reps.select("node", "key", "digest", "n_shingles", "signature").join(posted, "node"), "posted-nodes")
    forget(posted)
    source = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("t"))
    texts = source.join(placed.select("key", "digest", "node"), (source["digest"] == placed["digest"]) & source["key"].eqNullSafe(placed["key"]))
    sets = cut(_sets(texts.select("node", "t")).dropDuplicates(["node"]), "sets")
    nodes = placed.join(_shared(sets), "node").filter(den * F.col("common") >= num * F.col("n_shingles"))
    nodes = cut(nodes.select("node", "n_shingles", "common", "bits", "signature", "weight", "prefix"), "able-nodes")
    forget(placed)
    labels = _links(nodes, sets, num, den, rounds)
    least = groups.join(labels, "node").groupBy("label").agg(F.min("least").alias("component_id"))
    found = groups.join(labels.join(least, "label"), "node", "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(found, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
