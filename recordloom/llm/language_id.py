"""Language identification by string kernels.

A text is the set of its character 1-, 2- and 3-grams (blended spectrum, presence only).
The kernel of two texts is the number of n-grams they share, divided by the geometric
mean of their set sizes. Nyström landmarks turn kernel rows into features, on which one
ridge regression per language (one against the rest) is solved in closed form. Scoring is
two matrix products per batch of texts: presence by landmarks, then by regression weights.

The model is fitted on a bounded sample: ``per_language`` rows of each language on
average, ``landmarks`` of them landmarks; with very many languages fewer of each, so that the
driver's matrices stay below MOST_LANDMARKS landmarks and MOST_NUMBERS numbers, but at least one
of every language. All languages are learnt. Whole texts are used throughout.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text when
there is nothing to learn from; null languages aren't learnt; repeated rows count as they
stand; other columns of the input are dropped, but for the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .common import cut

UNKNOWN = "und"
_BITS = {1: 12, 2: 18, 3: 20}
_OFFSET = {1: 0, 2: 1 << 12, 3: (1 << 12) + (1 << 18)}
_SPACE = (1 << 12) + (1 << 18) + (1 << 20)
_BATCH = 64
#: Landmarks, and numbers in the sample's kernel rows, that the driver holds.
MOST_LANDMARKS, MOST_NUMBERS = 4096, 1 << 27
#: Rows that are sampled of a language, on average, whatever their number.
FEWEST = 16


def _presence(text: str, last: np.ndarray) -> np.ndarray:
    """The distinct n-gram ids of a text, all orders in one id space. Runs of spaces are one."""
    c = grams.codes(text, letters_only=True)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    return grams.distinct(np.concatenate([grams.hashes(c, n, b) + _OFFSET[n] for n, b in _BITS.items()]), last)


@dataclass
class Kernel:
    """The landmarks: ``column`` maps an n-gram id to a column of the presence matrix, or -1."""

    column: np.ndarray
    presence: np.ndarray  # n-grams of any landmark x landmarks
    norm: np.ndarray

    @classmethod
    def of(cls, landmarks: list[np.ndarray]) -> Kernel:
        ids = np.unique(np.concatenate(landmarks))
        column = np.full(_SPACE, -1, dtype=np.int32)
        column[ids] = np.arange(len(ids))
        presence = np.zeros((len(ids), len(landmarks)), dtype=np.float32)
        for j, x in enumerate(landmarks):
            presence[column[x], j] = 1
        return cls(column, presence, np.sqrt([float(len(x)) for x in landmarks]).astype(np.float32))

    def rows(self, texts: list[str], last: np.ndarray) -> np.ndarray:
        """The kernel of each text with each landmark."""
        dense, sizes = np.zeros((len(texts), len(self.presence)), dtype=np.float32), np.ones(len(texts), dtype=np.float32)
        for i, text in enumerate(texts):
            ids = _presence(text, last)
            at = self.column[ids]
            dense[i, at[at >= 0]] = 1
            sizes[i] = max(1, len(ids))
        return dense @ self.presence / np.sqrt(sizes)[:, None] / self.norm


@dataclass
class Model:
    languages: list[str]
    kernel: Kernel
    weights: np.ndarray  # landmarks x languages


def fit(df: DataFrame, key: str, text: str, lang: str, per_language: int = 800, landmarks: int = 40, ridge: float = 0.1, seed: int = 8) -> Model | None:
    """The model of the rows with a language and a letter; None if there are none.

    ``landmarks`` is the number per language, all texts where a language has fewer. What reaches
    the driver are the landmarks' n-gram ids and a kernel row for each sampled text."""
    labelled = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    per_language = max(landmarks, FEWEST, min(per_language, MOST_NUMBERS // (landmarks * len(languages)) // len(languages)))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("k").cast("string"), F.col("t")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    of = lambda shares: F.get(F.array(*map(F.lit, shares)), F.array_position(F.array(*map(F.lit, languages)), F.col("l")).cast("int") - 1)
    share = of([min(1.0, per_language / counts[x]) for x in languages])
    sample = cut(labelled.withColumn("draw", draw).filter(F.col("draw") < share).select("t", "l", (F.col("draw") / share).alias("draw")), "language-sample")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.zeros(_SPACE, dtype=np.int32)
        for b in batches:
            yield pd.DataFrame({"l": b["l"], "ids": [_presence(t, last).astype(np.int32).tobytes() for t in b["t"]]})

    # A language's sampled rows are few: they can be numbered together.
    number = F.row_number().over(Window.partitionBy("l").orderBy("draw", "t"))
    first = sample.withColumn("number", number).filter(F.col("number") <= landmarks).select("t", "l")
    chosen = sorted(first.mapInPandas(presence, "l string, ids binary").collect())
    kernel = Kernel.of([np.frombuffer(r["ids"], dtype=np.int32) for r in chosen])
    shared = df.sparkSession.sparkContext.broadcast(kernel)

    def kernel_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.zeros(_SPACE, dtype=np.int32)
        for b in batches:
            for k in range(0, len(b), _BATCH):
                part = b.iloc[k : k + _BATCH]
                yield pd.DataFrame({"l": part["l"], "x": [x.astype(np.float32).tobytes() for x in shared.value.rows(part["t"].tolist(), last)]})

    rows = sorted(sample.mapInPandas(kernel_rows, "l string, x binary").collect())
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).astype(np.float64)
    own = kernel.presence.T @ kernel.presence / np.outer(kernel.norm, kernel.norm)
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    kept = values > 1e-6 * values.max()
    half = vectors[:, kept] / np.sqrt(values[kept])
    z = x @ half
    y = np.array([[1.0 if r["l"] == lang_ else -1.0 for lang_ in languages] for r in rows])
    weights = half @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return Model(languages, kernel, weights.astype(np.float32))


def predict(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """key, lang_pred and score (0 to 1: how far the best regression is from -1 towards 1)."""
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double"
    rows = df.select(key, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_t"))
    if model is None:
        return rows.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, m = np.zeros(_SPACE, dtype=np.int32), shared.value
        names = np.array(m.languages, dtype=object)
        for b in batches:
            for k in range(0, len(b), _BATCH):
                part = b.iloc[k : k + _BATCH]
                known = part["_t"].notna().to_numpy()
                found = m.kernel.rows(part["_t"].fillna("").tolist(), last) @ m.weights
                best = found.argmax(axis=1)
                value = np.clip((found[np.arange(len(part)), best] + 1) / 2, 0, 1)
                yield pd.DataFrame({key: part[key], "lang_pred": np.where(known, names[best], UNKNOWN), "score": np.where(known, value, 0.0)})

    return rows.mapInPandas(score, out)
