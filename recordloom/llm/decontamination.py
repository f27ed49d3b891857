"""Benchmark decontamination by SimHash of item-sized windows.

A window of as many words as an item has, and the item, get 64-bit SimHash fingerprints of
their 5-word shingles (counted as often as they occur). Fingerprints are cut into BLOCKS
blocks: two within RADIUS differ by at most RADIUS // BLOCKS bits in one of them, so a table
per block from every value to the items that near misses none. Candidates are verified by
the exact weighted similarity of the shingle bags, sum of minima by sum of maxima.

Windows that hold no shingle of an item of their size have similarity 0 to it and aren't
fingerprinted. The items are handled in blocks of about ITEMS_AT_ONCE items and BYTES_AT_ONCE
bytes: a block alone is gathered and broadcast at a time, its tables have a fixed size, and it
is one pass over the documents, in tasks of its own.

Cases: null and empty texts and items have no windows; items below five words are one
shingle; texts shorter than an item are one window; repeated items are hit each by
itself; items without an id are left out; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .shingles import WORDS, sequence_hashes, word_hashes

BLOCKS = 4
RADIUS = 23
ITEMS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 24
_RUN = 4096
_WIDTH = 64 // BLOCKS
HIT = "array<struct<item_id:long,similarity:double,word_start:int,n_words:int>>"


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of ``length`` shingles from each start; ``starts`` is sorted."""
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), _RUN):
        part = starts[k : k + _RUN]
        if part[-1] - part[0] <= 4 * _RUN:  # one running sum for near starts
            low = part[0]
            sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(_signs(shingles[low : part[-1] + length]), axis=0, dtype=np.int32)])
            out[k : k + _RUN] = _pack(sums[part - low + length] - sums[part - low])
        else:
            out[k : k + _RUN] = _pack(np.stack([_signs(shingles[s : s + length]).sum(axis=0, dtype=np.int32) for s in part]))
    return out


def similarity(a: Counter, b: Counter) -> float:
    """The sum of the smaller weights by the sum of the larger."""
    low = sum(min(n, b[x]) for x, n in a.items())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


class Matcher:
    """The fingerprint index of one block of items: (item id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], at_least: float) -> None:
        self.at_least = at_least
        words = [(i, word_hashes(t)) for i, t in items]
        words = [(i, w) for i, w in words if len(w)]
        self.ids, self.sizes = [i for i, _ in words], np.array([len(w) for _, w in words], dtype=np.int64)
        shingles = [sequence_hashes(w) for _, w in words]
        self.bags = [Counter(s.tolist()) for s in shingles]
        self.prints = np.array([fingerprints(s, np.zeros(1, dtype=np.int64), len(s))[0] for s in shingles], dtype=np.uint64)
        self.groups = {int(size): np.flatnonzero(self.sizes == size) for size in np.unique(self.sizes)}
        self.anchors = {size: np.unique(np.concatenate([shingles[k] for k in group])) for size, group in self.groups.items()}
        long_ = [self.anchors[size] for size in self.groups if size >= WORDS]
        self.any = np.unique(np.concatenate(long_)) if long_ else np.empty(0, dtype=np.uint64)
        values = np.arange(1 << _WIDTH, dtype=np.uint64)
        self.tables = []
        for b in range(BLOCKS):
            part = (self.prints >> np.uint64(b * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)
            near = np.stack([np.bitwise_count(values ^ x) <= RADIUS // BLOCKS for x in part], axis=1) if len(part) else np.zeros((1 << _WIDTH, 0), dtype=bool)
            self.tables.append(np.packbits(near, axis=1))

    def _candidates(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of ``group`` whose fingerprints are within the radius."""
        mask = np.uint64((1 << _WIDTH) - 1)
        rows = self.tables[0][(prints & mask).astype(np.int64)]
        for b in range(1, BLOCKS):
            rows = rows | self.tables[b][((prints >> np.uint64(b * _WIDTH)) & mask).astype(np.int64)]
        window, column = np.nonzero(np.unpackbits(rows, axis=1, count=len(self.ids))[:, group])
        item = group[column]
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of each item found."""
        words = word_hashes(text)
        if not len(words):
            return []
        of_length: dict[int, np.ndarray] = {WORDS: sequence_hashes(words)}
        seen = len(words) >= WORDS and len(self.any) and (self.any[np.minimum(np.searchsorted(self.any, of_length[WORDS]), len(self.any) - 1)] == of_length[WORDS]).any()
        out = []
        for size, group in self.groups.items():
            n = min(WORDS, size)
            if n == WORDS and len(words) >= WORDS and not seen:
                continue
            if n not in of_length:
                of_length[n] = sequence_hashes(words, n)
            shingles = of_length[n]
            anchors = self.anchors[size]
            held = anchors[np.minimum(np.searchsorted(anchors, shingles), len(anchors) - 1)] == shingles
            at = np.flatnonzero(held)
            if not len(at):
                continue
            length = min(size - n + 1, len(shingles))
            last = len(shingles) - length
            edge = np.zeros(last + 2, dtype=np.int64)
            np.add.at(edge, np.clip(at - length + 1, 0, last), 1)
            np.add.at(edge, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            window, item = self._candidates(fingerprints(shingles, starts, length), group)
            inside = np.concatenate([[0], np.cumsum(held)])
            for k in np.unique(item):
                some = starts[window[item == k]]
                most = inside[some + length] - inside[some]  # bounds the shingles in common
                best, where, total = 0.0, 0, sum(self.bags[k].values())
                for j in np.lexsort((some, -most)):
                    low = min(int(most[j]), total)
                    if low / (length + total - low) <= best:
                        break
                    found = similarity(Counter(shingles[some[j] : some[j] + length].tolist()), self.bags[k])
                    if found > best:
                        best, where = found, int(some[j])
                if best >= self.at_least:
                    out.append((self.ids[k], best, where, min(size, len(words))))
        return out


def _blocks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one after the other."""
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-size["bytes"] // BYTES_AT_ONCE))
    for b in range(n_blocks):
        yield sorted((r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect())


def _hits(df: DataFrame, block: list[tuple[int, str]], text: str, at_least: float) -> Column:
    """An array of the items of a block found in each text, with their best windows."""
    shared = df.sparkSession.sparkContext.broadcast(block)  # about ITEMS_AT_ONCE items

    @F.pandas_udf(HIT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, at_least)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "similarity", "word_start", "n_words"), h, strict=True)) for h in matcher.hits(t)] for t in texts], dtype=object)

    return find(F.col(f"`{text}`"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, at_least: float = 0.75) -> DataFrame:
    """A row for each document and item found in it: key, item_id, similarity, word_start, n_words."""
    out = None
    for block in _blocks(benchmark, item, item_text):
        found = docs.select(F.col(f"`{key}`").alias("_key"), F.explode(_hits(docs, block, text, at_least)).alias("hit")).select(F.col("_key").alias(key), "hit.*")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, at_least: float = 0.75) -> DataFrame:
    """The documents in which no item is found."""
    names, done = docs.columns, False
    for block in _blocks(benchmark, item, item_text):
        docs = cut(docs, "unleaked") if done else docs  # so that no task holds two blocks
        at = fresh(docs, "_hits")
        docs, done = docs.withColumn(at, _hits(docs, block, text, at_least)).filter(F.size(at) == 0).select(*[F.col(f"`{c}`") for c in names]), True
    return docs
