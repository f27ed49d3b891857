"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf stands for a live byte position and holds the rank of the pair that starts
there; an inner node holds the smaller of its children, the left one on ties, so the
root is the leftmost pair of lowest rank. A merge unlinks one position and updates the
merged position and its live left neighbour: O(log n) each, O(n log n) for a piece,
however long. Pieces are the matches of a split pattern, encoded one by one.

Cases: a null text is the empty text and has no tokens; special tokens are ordinary
text; lone surrogates can't occur in Spark strings; other columns are left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Pieces whose ids a Python worker keeps; the store is emptied when it is larger.
CACHED_PIECES = 300_000
#: Code points of text that are split before their unknown pieces are encoded together.
CHUNK_CHARS = 400_000
#: Bytes of a column that go through the codec before their results leave the Python worker.
CHUNK_BYTES = 2_000_000
#: Pieces of more bytes are encoded one by one.
TOGETHER_BYTES = 64
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece of any length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    get = ranks.get

    def leaf(at: int, to: int) -> int:
        rank = get(piece[at:to])
        return _NONE if rank is None else rank * size + at  # smaller position first on equal ranks

    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = leaf(i, i + 2)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours; after is also a token's end
    while tree[1] != _NONE:
        i = tree[1] % size
        gone = after[i]
        end = after[i] = after[gone]
        if end < n:
            before[end] = i
        changed = [(gone, _NONE), (i, leaf(i, after[end]) if end < n else _NONE)]
        if (left := before[i]) >= 0:
            changed.append((left, leaf(left, end)))
        for at, value in changed:
            k = size + at
            tree[k] = value
            while k > 1:
                k //= 2
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of one rank table and split pattern.

    Unknown pieces of a chunk of texts go through the same tree together, a numpy row for
    each piece: a step merges the best pair of every row that still has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE where they don't merge."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _together(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The ids of pieces of 2 to ``size`` bytes; ``size`` is a power of two."""
        count = len(pieces)
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        columns = np.arange(size)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(count, size)
        token = np.zeros((count, size + 1), dtype=np.int64)
        token[:, :size] = self.of_byte[raw]
        after = np.tile(np.arange(1, size + 2), (count, 1))
        before = np.tile(np.arange(-1, size), (count, 1))
        alive = columns < n[:, None]
        tree = np.full((count, 2 * size), _NONE, dtype=np.int64)
        first = self._rank(token[:, : size - 1], token[:, 1:size])
        tree[:, size : 2 * size - 1] = np.where((first < _NONE) & (columns[1:] < n[:, None]), first * size + columns[:-1], _NONE)
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = tree[:, 2 * half : 4 * half].reshape(count, half, 2).min(axis=2)
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while rows.size:
            best = tree[rows, 1]
            at = best & (size - 1)
            merged = best // size
            gone = after[rows, at]
            end = after[rows, gone]
            token[rows, at] = merged
            after[rows, at] = end
            before[rows, end] = at
            alive[rows, gone] = False
            left = before[rows, at]
            right = self._rank(merged, token[rows, end])
            tree[rows, size + gone] = _NONE
            tree[rows, size + at] = np.where((end < n[rows]) & (right < _NONE), right * size + at, _NONE)
            has = left >= 0
            joined = self._rank(token[rows[has], left[has]], merged[has])
            tree[rows[has], size + left[has]] = np.where(joined < _NONE, joined * size + left[has], _NONE)
            nodes = np.stack([size + gone, size + at, size + np.where(has, left, at)])
            while nodes[0, 0] > 1:
                nodes //= 2
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            rows = rows[tree[rows, 1] < _NONE]
        flat, ends = token[:, :size][alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = (whole,)
            elif len(data) > TOGETHER_BYTES:
                self.known[piece] = tuple(encode_piece(data, self.ranks))
            else:
                by_size.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, some in by_size.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                self.known.update(zip((p for p, _ in part), self._together([d for _, d in part], size), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        k = 0
        while k < len(texts):
            split, chars = [], 0
            while k < len(texts) and (not split or chars + len(texts[k]) <= CHUNK_CHARS):
                split.append(self.split.findall(texts[k]))
                chars += len(texts[k])
                k += 1
            if len(self.known) > CACHED_PIECES:
                self.known.clear()
            self._learn(set().union(*split).difference(self.known))
            for pieces in split:
                yield np.fromiter(chain.from_iterable(map(self.known.__getitem__, pieces)), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(name: str, pattern: str) -> Codec:
    """One codec per Python worker, from the copy of the file that Spark sent to it."""
    if (name, pattern) not in _codecs:
        _codecs[name, pattern] = Codec(load_ranks(SparkFiles.get(name)), pattern)
    return _codecs[name, pattern]


def _ship(spark: SparkSession, path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(path)
    return name


def _pass(df: DataFrame, ranks_path: str, pattern: str, column: str, out: dict[str, str], work: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` without ``column``, with the columns ``out``. Batches are cut into pieces of about
    CHUNK_BYTES of ``column`` before the work, which bounds a task's memory."""
    name = _ship(df.sparkSession, ranks_path)
    kept = [f for f in df.schema.fields if f.name != column and f.name not in out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{k}` {v}" for k, v in out.items())])
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias(fresh(df, "_in")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            at, step = 0, max(1, batch.num_rows * CHUNK_BYTES // max(1, batch.column(len(kept)).nbytes))
            while at < batch.num_rows:
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(codec, part.columns[-1])], names=[f.name for f in kept] + list(out))
                at += step

    return rows.mapInArrow(run, schema)


def _encoded(codec: Codec, texts: pa.Array) -> list[np.ndarray]:
    return list(codec.encode_all([t or "" for t in texts.to_pylist()]))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def encode_texts(df: DataFrame, text: str, ranks_path: str, pattern: str, into: str = "token_ids") -> DataFrame:
    """``df`` with an array<int> column of ids in place of the texts. ``ranks_path`` is a file of
    the driver or a URI."""
    return _pass(df, ranks_path, pattern, text, {into: "array<int>"}, lambda codec, texts: [_lists(_encoded(codec, texts))])


def decode_ids(df: DataFrame, ids: str, ranks_path: str, into: str = "decoded") -> DataFrame:
    """``df`` with a column of decoded bytes in place of the ids; null ids decode to nothing."""
    return _pass(df, ranks_path, "", ids, {into: "binary"}, lambda codec, rows: [pa.array([codec.decode(x or []) for x in rows.to_pylist()], pa.binary())])


def round_trip(df: DataFrame, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` with token_ids and decoded, the bytes that those ids stand for, in place of the
    texts: both ways in one pass."""

    def work(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        ids = _encoded(codec, texts)
        return [_lists(ids), pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())]

    return _pass(df, ranks_path, pattern, text, {"token_ids": "array<int>", "decoded": "binary"}, work)
