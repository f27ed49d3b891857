"""Nearest neighbours by balanced posting lists, read until no further list can matter.

Centroids come from a balanced k-means on a bounded sample and are searched through an
in-memory neighbour graph. A vector is posted in the list of its nearest centroid and, as a
boundary vector, in further ones that are nearly as near (at most ``replicas``), unless a
list chosen already stands for them. Largest inner products become smallest distances by
one more coordinate, which lifts every vector to the largest norm.

A query first reads the nearest lists whose distance is within a ratio of the nearest one's.
The score of the last row found there is a floor: the second reading takes every list whose
centroid and radius leave room for such a score, and keeps the vectors that reach it. So the
result is that of reading everything, at any size; the first reading decides the work alone.
Where vectors aren't clustered, few lists can be left out, and the products computed (not
the rows made) grow with queries times vectors.

Equal vectors are one entry with their TOP + 1 smallest ids, which is all that a result of
TOP rows can need. Lists and their queries are dealt out in parts of bounded size. Every
vector is indexed; scores are inner products of the original vectors in double precision.

Cases: vectors that are null, empty or zero, hold null or non-finite components, have a
null id or another length than most take no part; copies tie and go by id; with fewer
candidates than asked for, all come; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the fitted index: centroids, and sampled vectors for each.
MOST_CENTROIDS, SAMPLED = 8192, 16
#: Vectors and queries that meet in one task at once, about.
PART, QUERIES = 2048, 1024
#: The same of the second reading, as numbers: 32 768 vectors of 64 and 8 192 queries.
BLOCK, BLOCK_QUERIES = 1 << 21, 1 << 19


@dataclass
class Index:
    """Lifted centroids, their neighbour graph and the places where searches start."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float  # the largest norm of any vector
    scale: float = 0.0  # mean squared distance of the sample to its centroids

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        scale = np.sqrt((x**2).sum(axis=1)) / self.norm if query else np.ones(len(x))  # a query's length doesn't matter
        return np.column_stack([x / scale[:, None], last])

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the nearest ``beam`` centroids of each lifted row,
        nearest first: best-first walks over the graph, in step for all rows."""
        c, rows = self.centroids, np.arange(len(x))
        beam = min(beam, len(c))
        squares = (c**2).sum(axis=1)
        own = (x**2).sum(axis=1)
        width = max(beam, len(self.entries))
        ids = np.full((len(x), width), -1)
        far = np.full((len(x), width), np.inf)
        ids[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = own[:, None] + squares[self.entries] - 2 * x @ c[self.entries].T
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        done = ids < 0
        while not done.all():
            pick = np.argmin(np.where(done, np.inf, far), axis=1)
            live = ~done[rows, pick]
            done[rows, pick] = True
            near = np.where(live[:, None], self.graph[np.maximum(ids[rows, pick], 0)], -1)
            fresh = (near >= 0) & ~(near[:, :, None] == ids[:, None, :]).any(axis=2)
            to = np.where(fresh, own[:, None] + squares[near] - 2 * np.einsum("rd,rkd->rk", x, c[near]), np.inf)
            ids, far, done = np.hstack([ids, np.where(fresh, near, -1)]), np.hstack([far, to]), np.hstack([done, ~fresh])
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(v, order, 1) for v in (ids, far, done))
        return ids, np.maximum(far, 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, far = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for k in range(0, len(x), 1024):
        d = (c**2).sum(axis=1) - 2 * x[k : k + 1024] @ c.T
        best[k : k + 1024] = d.argmin(axis=1)
        far[k : k + 1024] = d[np.arange(len(d)), best[k : k + 1024]]
    return best, far


def balanced_centroids(x: np.ndarray, count: int, steps: int = 8, seed: int = 10) -> np.ndarray:
    """k-means whose empty and smallest clusters are moved into the largest after each step."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), count, replace=False)].copy()
    for step in range(steps):
        best, _ = _nearest(x, c)
        sizes = np.bincount(best, minlength=count)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        if step < steps - 1:
            order = np.argsort(sizes, kind="stable")
            for small, large in zip(order[: count // 10 + 1], order[::-1], strict=False):
                if sizes[large] > 2 * max(1, sizes[small]) + 2:
                    c[small] = x[rng.choice(np.flatnonzero(best == large))]
    return c


def build(sample: np.ndarray, count: int, norm: float, degree: int = 24, entries: int = 32) -> Index:
    count = max(1, min(count, len(sample)))
    index = Index(np.empty((0, 0)), np.empty((0, 0)), np.empty(0), norm)
    lifted = index.lift(sample)
    c = balanced_centroids(lifted, count)
    scale = float(np.mean(np.maximum(_nearest(lifted, c)[1] + (lifted**2).sum(axis=1), 0)))
    k = min(degree, count - 1)
    graph = np.full((count, max(1, 2 * k)), -1)
    back: list[list[int]] = [[] for _ in range(count)]
    for i in range(0, count, 1024):
        d = (c**2).sum(axis=1) - 2 * c[i : i + 1024] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        graph[i : i + len(d), :k] = np.argsort(d, axis=1)[:, :k]
    for i in range(count):  # edges back keep the graph connected around hubs
        for j in graph[i, :k]:
            back[j].append(i)
    for i in range(count):
        extra = [j for j in back[i] if j not in graph[i, :k]][:k]
        graph[i, k : k + len(extra)] = extra
    starts = np.unique(np.linspace(0, count - 1, min(entries, count)).astype(int))
    return Index(c, graph, starts, norm, scale)


def neighbourhoods(centroids: np.ndarray, count: int) -> np.ndarray:
    """For each centroid the number of its group, of about ``count`` groups of near ones."""
    count = max(1, min(count, len(centroids)))
    return _nearest(centroids, balanced_centroids(centroids, count))[0]


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col(vector)
    fine = F.size(x) > 0
    fine = fine & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & fine)
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("x") == (size["d"] if size else 0))


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, top: int = 20, list_size: int = 128, replicas: int = 4, boundary: float = 1.2, lists: int = 32, ratio: float = 3.0, seed: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows of each query row but its own.
    ``is_query`` is a condition on the key's values, named ``id`` there.

    ``boundary`` bounds the squared distance of a further list by that of the first one for
    vectors; ``ratio`` does so for queries (or by the mean distance to a centroid, if that is
    larger), which read ``lists`` at most at first."""
    spark = df.sparkSession
    rows = _usable(df, key, vector).withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(7), "x")})
    first = Window.partitionBy("k1", "k2").orderBy("id")
    least = rows.dropDuplicates(["id", "k1", "k2"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top + 1)
    entries = least.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("x").alias("x")).withColumn("entry", F.col("ids")[0])
    # One id may stand for several vectors where ids repeat: the hash makes the entry unique.
    entries = cut(entries.select(F.struct("entry", "k1", "k2").alias("e"), "k1", "k2", "ids", "x", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("norm")), "entries")
    total = entries.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    count = int(min(MOST_CENTROIDS, max(1, total["n"] // list_size)))
    share = min(1.0, count * SAMPLED / total["n"])
    draw = (F.pmod(F.xxhash64(F.lit(seed), "k1"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sample = sorted(tuple(r["x"]) for r in entries.filter(draw < share).select("x").collect()) or [tuple(entries.first()["x"])]
    index = spark.sparkContext.broadcast(build(np.array(sample), count, total["norm"]))

    def post(x: pd.Series) -> pd.DataFrame:
        out, radius = [], []
        for k in range(0, len(x), 512):
            part = np.array(x.iloc[k : k + 512].tolist(), dtype=np.float64)
            ids, far = index.value.search(index.value.lift(part), max(8, 2 * replicas))
            c = index.value.centroids
            for some, d in zip(ids, far, strict=True):
                chosen = [some[0]]
                for j, dj in zip(some[1:], d[1:], strict=True):
                    if len(chosen) == replicas or j < 0 or dj > boundary * d[0]:
                        break
                    if all(((c[i] - c[j]) ** 2).sum() > dj for i in chosen):
                        chosen.append(j)
                out.append([int(i) for i in chosen])
            radius += np.sqrt(((part - c[[i[0] for i in out[k:]], : part.shape[1]]) ** 2).sum(axis=1)).tolist()
        return pd.DataFrame({"lists": pd.Series(out, dtype=object), "radius": pd.Series(radius, dtype=float)})

    def probe(x: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(x), 512):
            part = np.array(x.iloc[k : k + 512].tolist(), dtype=np.float64)
            ids, far = index.value.search(index.value.lift(part, query=True), lists)
            out += [[int(i) for i, d in zip(some, away, strict=True) if i >= 0 and d <= ratio * max(away[0], index.value.scale)] for some, away in zip(ids, far, strict=True)]
        return pd.Series(out, dtype=object)

    places = entries.select("e", "x", F.pandas_udf(post, "lists array<int>, radius double")("x").alias("p"))
    posted = cut(places.select("e", "x", "p.radius", F.posexplode("p.lists").alias("nth", "list")), "posted")
    asked = rows.select("id", "k1", "k2").filter(is_query).distinct()
    wanted = entries.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    probes = cut(wanted.select(F.col("e").alias("q"), F.col("x").alias("y"), F.explode(F.pandas_udf(probe, "array<int>")("x")).alias("list")), "probes")
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("v_parts")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("q_parts")), "list")
    parts = F.broadcast(parts)  # a row for each list: MOST_CENTROIDS at most
    part_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = posted.join(parts, "list").select("list", "e", "x", part_of("e", "v_parts").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)).alias("w"))
    right = probes.join(parts, "list").select("list", "q", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_parts") - 1)).alias("v"), part_of("q", "q_parts").alias("w"))
    kind = "struct<entry:long,k1:long,k2:long>"

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return pd.DataFrame({"q": [], "e": [], "score": []})
        x, y = np.array(vectors["x"].tolist(), dtype=np.float64), np.array(queries["y"].tolist(), dtype=np.float64)
        order = np.argsort([e["entry"] for e in vectors["e"]], kind="stable")  # ties to the smaller id
        x, e = x[order], vectors["e"].to_numpy()[order]
        near = np.argsort(-(y @ x.T), axis=1, kind="stable")[:, : top + 1]
        score = np.array([(x[n] * v).sum(axis=1) for n, v in zip(near, y, strict=True)])
        return pd.DataFrame({"q": np.repeat(queries["q"].to_numpy(), near.shape[1]), "e": e[near.ravel()], "score": score.ravel()})

    met = left.groupBy("list", "v", "w").cogroup(right.groupBy("list", "v", "w")).applyInPandas(meet, f"q {kind}, e {kind}, score double")
    met = met.groupBy("q", "e").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    floors = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") == top + 1).select("q", F.col("score").alias("floor"))
    floors = cut(wanted.select(F.col("e").alias("q"), F.col("x").alias("y")).join(floors, "q", "left"), "floors")  # null: too few found

    # The second reading: each vector in its first list, lists in groups, queries by group.
    own, d = posted.filter("nth = 0"), index.value.centroids.shape[1] - 1
    sizes = own.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()  # MOST_CENTROIDS at most
    block, group = max(1, BLOCK // d), neighbourhoods(index.value.centroids, -(-total["n"] * d // BLOCK))
    radii, n_parts = np.full(len(group), -1.0), np.zeros(len(group), dtype=np.int64)
    for r in sizes:
        radii[r["list"]] = r["radius"]
        n_parts[group[r["list"]]] += r["n"]
    n_parts = -(-n_parts // block)
    plan = spark.sparkContext.broadcast((group, radii, n_parts))
    slack = 1e-9 * total["norm"]

    def block_of(lists: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        group, _, n_parts = plan.value
        g = group[lists.to_numpy()]
        return pd.DataFrame({"g": g, "v": hashes.to_numpy() % n_parts[g]})

    def blocks_of(y: pd.Series, floor: pd.Series) -> pd.Series:
        """Groups with a list that may hold a score of the floor, and their parts."""
        (group, radii, n_parts), c, out = plan.value, index.value.centroids, []
        for k in range(0, len(y), 512):
            part = np.array(y.iloc[k : k + 512].tolist(), dtype=np.float64)
            least = floor.iloc[k : k + 512].fillna(-np.inf).to_numpy(dtype=np.float64)
            norm = np.sqrt((part**2).sum(axis=1))[:, None]
            able = (radii >= 0) & (part @ c[:, :-1].T + norm * (radii + slack) >= least[:, None])
            for row in able:
                out.append([{"g": int(g), "v": v} for g in np.unique(group[row]) for v in range(n_parts[g])])
        return pd.Series(out, dtype=object)

    q_parts = max(1, -(-floors.count() * d // BLOCK_QUERIES))
    place = F.pandas_udf(block_of, "g long, v long")("list", F.xxhash64("e"))
    left = own.select("e", "x", place.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("w")).select("e", "x", "p.g", "p.v", "w")
    right = floors.select("q", "y", "floor", F.explode(F.pandas_udf(blocks_of, "array<struct<g:long,v:long>>")("y", "floor")).alias("p"), F.pmod(F.xxhash64("q"), F.lit(q_parts)).cast("int").alias("w")).select("q", "y", "floor", "p.g", "p.v", "w")

    def reach(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The vectors that reach their query's floor; of more than can be wanted, the best."""
        qs, es, scores = [], [], []
        if len(vectors) and len(queries):
            x = np.array(vectors["x"].tolist(), dtype=np.float64)
            order = np.argsort([e["entry"] for e in vectors["e"]], kind="stable")  # ties to the smaller id
            x, e = x[order], vectors["e"].to_numpy()[order]
            for k in range(0, len(queries), 64):
                some = queries.iloc[k : k + 64]
                y = np.array(some["y"].tolist(), dtype=np.float64)
                least = some["floor"].fillna(-np.inf).to_numpy(dtype=np.float64) - slack * np.sqrt((y**2).sum(axis=1))
                products = y @ x.T
                for q, v, p, at in zip(some["q"], y, products, least, strict=True):
                    near = np.flatnonzero(p >= at)
                    if len(near) > top + 1:
                        near = near[np.argsort(-p[near], kind="stable")[: top + 1]]
                    qs += [q] * len(near)
                    es += e[near].tolist()
                    scores += (x[near] * v).sum(axis=1).tolist()
        return pd.DataFrame({"q": pd.Series(qs, dtype=object), "e": pd.Series(es, dtype=object), "score": pd.Series(scores, dtype=float)})

    met = left.groupBy("g", "v", "w").cogroup(right.groupBy("g", "v", "w")).applyInPandas(reach, f"q {kind}, e {kind}, score double")
    met = cut(met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top + 1).select("q", "e", "score"), "met")
    ids = met.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= top + 1).select(F.col("q.k1").alias("k1"), F.col("q.k2").alias("k2"), "score", "vec_id")
    each = asked.join(ids, ["k1", "k2"]).filter("id <> vec_id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
