"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the distinct hashed character 4- to 6-grams of its words (word ends
included). Those whose share among confirmed toxic texts is most above that among unlabelled
ones are kept, by a smoothed two-proportion statistic: all from ``z`` on and, where that are
few, as with few labels, the best ``fewest``. A linear scorer is trained in numpy on the risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the sigmoid loss, whose bound keeps mislabelled examples from taking over. Labels 0
serve for the class prior alone, unless it is given; it is held between 1e-4 and 0.5, since
labelled rows may be chosen for their toxicity.

The model is fitted on a bounded sample: ``positives`` toxic and ``unlabelled`` other rows
on average. Whole texts are used throughout.

Cases: null and empty texts have no features and get the score of the bias; without a
toxic example every score is 0; repeated rows count as they stand; other columns are
dropped, but for the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import cut

ORDERS = (4, 5, 6)
#: The statistic that any feature must exceed; the share of its log odds that a weight starts with.
Z_LEAST, START = 2.0, 0.25
BITS = 22


def _features(text: str, last: np.ndarray) -> np.ndarray:
    c = grams.codes(text)
    return grams.distinct(np.concatenate([grams.hashes(c, n, BITS)[grams.inside_words(c, n)] for n in ORDERS]), last)


@dataclass
class Model:
    ids: np.ndarray  # of the kept features
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, dtype=np.int16)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def score(self, text: str | None, slots: np.ndarray, last: np.ndarray) -> float:
        if not text:
            g = self.bias
        else:
            c = grams.codes(text)
            found = np.concatenate([slots[grams.hashes(c, n, BITS)[grams.inside_words(c, n)]] for n in ORDERS])
            found = found[found >= 0].astype(np.int64)
            g = self.bias + float(self.weights[grams.distinct(found, last)].sum())
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def train(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, start: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk. ``rows`` holds the feature numbers
    of each text, ``positive`` which texts are confirmed; the others are unlabelled. The loss isn't
    convex: ``start`` are weights to begin with, from which unlabelled texts score the prior."""
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p, u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    if start is not None and len(rows):
        w[:-1] = start
        w[-1] = -(u @ np.bincount(owner, weights=w[flat], minlength=len(rows)))
    w[-1] += np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(owner, weights=w[flat], minlength=len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        slope = -prior * p
        if u @ s > prior * (p @ s):  # else the corrected risk of the negatives is at its floor
            slope = slope + u - prior * p
        slope = slope * s * (1 - s)
        grad = np.append(np.bincount(flat, weights=slope[owner], minlength=n_features), slope.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, positives: int = 3000, unlabelled: int = 9000, kept: int = 4096, fewest: int = 256, least: int = 2, z: float = 6.0, prior: float | None = None, seed: int = 3) -> Model | None:
    """The model of ``docs``, all of which are unlabelled text; ``labels`` has the label of some
    keys, one row each, and label 1 marks confirmed texts. None without a confirmed one.

    The keys of the confirmed sample (a bounded number) are chosen first, so that no text is
    shuffled."""
    known = labels.select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull())
    total = known.agg(F.count("*").alias("labelled"), F.count_if(F.col("y") == 1).alias("toxic")).first()
    if not total["toxic"]:
        return None
    prior = min(0.5, max(1e-4, prior or total["toxic"] / total["labelled"]))
    n = docs.count()
    draw = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    confirmed = [r["k"] for r in known.filter((F.col("y") == 1) & (draw("k") < positives / total["toxic"])).select("k").distinct().collect()]
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(k, True) for k in confirmed], "k string, in_p boolean"))  # about ``positives`` rows
    sample = rows.join(chosen, "k", "left").select("t", F.coalesce("in_p", F.lit(False)).alias("in_p"), (draw("k", "t") < unlabelled / max(1, n)).alias("in_u"))
    sample = cut(sample.filter("in_p or in_u"), "toxicity-sample")
    sizes = sample.agg(F.count_if("in_p").alias("p"), F.count_if("in_u").alias("u")).first()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sums = np.zeros(1 << BITS, dtype=np.int32), np.zeros((2, 1 << BITS), dtype=np.int32)
        for b in batches:
            for t, in_p, in_u in zip(b["t"], b["in_p"], b["in_u"], strict=True):
                ids = _features(t, last)
                sums[0, ids] += int(in_p)
                sums[1, ids] += int(in_u)
        ids = np.flatnonzero(sums[0])  # others can't be kept: no confirmed text has them
        yield pd.DataFrame({"id": ids, "p": sums[0, ids], "u": sums[1, ids]})

    if not sizes["p"]:
        return None
    a, b = (F.col("p") + 0.5) / (sizes["p"] + 1), (F.col("u") + 0.5) / (sizes["u"] + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (sizes["p"] + sizes["u"] + 2)
    score = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / (sizes["p"] + 1) + 1 / (sizes["u"] + 1)))
    by_id = sample.mapInPandas(count, "id int, p int, u int").groupBy("id").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    best = by_id.filter(F.col("p") >= least).withColumn("z", score).filter(F.col("z") > Z_LEAST).orderBy(F.desc("z"), "id").limit(kept).collect()
    best = [r for k, r in enumerate(best) if r["z"] >= z or k < fewest]
    ids = np.array([r["id"] for r in best], dtype=np.int64)
    start = START * np.array([np.log((r["p"] + 0.5) / (sizes["p"] + 1) * (sizes["u"] + 1) / (r["u"] + 0.5)) for r in best])
    blank = Model(ids, np.zeros(len(ids)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, slots = np.zeros(1 << BITS, dtype=np.int32), shared.value.slots()
        for b in batches:
            found = [slots[_features(t, last)] for t in b["t"]]
            yield pd.DataFrame({"in_p": b["in_p"], "in_u": b["in_u"], "x": [np.sort(x[x >= 0]).astype(np.int32).tobytes() for x in found]})

    # At most ``kept`` numbers of 4 bytes for each of the sampled texts.
    table = sorted((bytes(r["x"]), r["in_p"], r["in_u"]) for r in sample.mapInPandas(numbers, "in_p boolean, in_u boolean, x binary").collect())
    pairs = [(x, True) for x, in_p, _ in table if in_p] + [(x, False) for x, _, in_u in table if in_u]
    weights, bias = train([np.frombuffer(x, dtype=np.int32) for x, _ in pairs], np.array([y for _, y in pairs]), len(ids), prior, start)
    return Model(ids, weights, bias)


def score(df: DataFrame, text: str, model: Model | None, into: str = "score") -> DataFrame:
    """``df`` with a double column: the score, 0 to 1."""
    if model is None:
        return df.withColumn(into, F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        slots, last = m.slots(), np.zeros(1 << 15, dtype=np.int32)
        for b in batches:
            yield pd.Series([m.score(t, slots, last) for t in b], dtype="float64")

    return df.withColumn(into, score_of(F.col(text)))
