"""Sort-means and whitening against brute force in numpy and Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from recordloom.llm import queries, sort_means, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string"


def table(spark, vectors, extra=()):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7, "x") for i, v in vectors] + list(extra), SCHEMA)


def odd(dims):
    bad = [None, [None] * dims, [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [0.0] * (dims - 1), []]
    return [(1000 + i, v) for i, v in enumerate(bad)]


def brute(vectors, k, rounds):
    x = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in vectors]
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in x)[:k]
    c = [list(v) for _, v in seeds]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [far(v)[1] for _, v in x]
        for j in range(len(c)):
            if mine := [v for (_, v), a in zip(x, at, strict=True) if a == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((str(i), *far(v)[::-1]) for i, v in x), c


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sort_means_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 6)) / (8 if seed == 1 else 60)  # small ones tie a lot
    x[40:60] = x[0]  # repeated rows
    vectors = [(int(i), list(v)) for i, v in zip(rng.integers(100, size=120), x, strict=True)] + [(None, list(x[3]))]
    df = table(spark, vectors + odd(6)).repartition(4)
    done, centroids = sort_means.clusters(df, "vec_id", "embedding", k=9, dims=6)
    want, c = brute(vectors, 9, 3)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in done.collect()) == want
    assert centroids.tolist() == c


def test_sort_means_stops_only_strictly_beyond():
    """A centroid at exactly twice the distance ties and has the smaller number."""
    c = np.array([[0], [8], [4]])
    gaps, order = sort_means.orders(c)
    best, far = sort_means.assign(np.array([[4], [6], [2], [7]]), np.array([1, 1, 1, 2]), c, gaps, order)
    assert best.tolist() == [2, 1, 0, 1] and far.tolist() == [0, 4, 4, 1]


def test_sort_means_of_few_or_no_vectors(spark):
    done, c = sort_means.clusters(table(spark, odd(6)), "vec_id", "embedding", dims=6)
    assert sort_means.report(done, c, "vec_id").count() == 0
    done, c = sort_means.clusters(table(spark, [(1, [0.5] * 6), (2, [0.5] * 6)]), "vec_id", "embedding", dims=6)
    rows = sort_means.report(done, c, "vec_id").collect()
    assert [(r["cluster"], r["distance"], r["inertia"], r["centroid_sha256"]) for r in rows] == [(0, 0, 0, hashlib.sha256(b"32,32,32,32,32,32").hexdigest())] * 2
    with pytest.raises(Exception, match="exactly"):
        sort_means.clusters(table(spark, [(1, [1e30] * 6)]), "vec_id", "embedding", dims=6)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 8)) @ np.diag([4, 3, 2, 1.5, 1, 0.5, 0.25, 0])).astype(np.float32)  # one dimension without variance
    x[50:80] = x[1]
    vectors = [(i, list(v)) for i, v in enumerate(x)] + [(None, list(x[2])), (3, list(x[9]))]
    rows = whitening.components(table(spark, vectors + odd(8)).repartition(4), "vec_id", "embedding", 32).collect()
    ints = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors])
    n, sums = len(ints), ints.sum(axis=0)
    centred = (n * ints - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:7], v[:, ::-1][:, :7]
    deviations = {(str(i), int(((n * r - sums) ** 2).sum())) for (i, _), r in zip(vectors, ints, strict=True)}
    assert {(str(r["vec_id"]), r["deviation"]) for r in rows} == deviations and len(rows) == 7 * n
    assert {r["n"] for r in rows} == {n} and {r["identity_error"] for r in rows}.pop() < 1e-9
    for k in range(7):
        mine = [r for r in rows if r["component"] == k + 1]
        assert all(abs(r["explained"] - e[k] / np.trace(centred.T @ centred / n)) < 1e-9 for r in mine)
        got = sorted((r["deviation"], r["whitened"]) for r in mine)
        ours = centred @ v[:, k] / np.sqrt(e[k])
        best = min(np.abs(np.array([g[1] for g in got]) - np.array([w for _, w in sorted(zip([d for d in ((n * ints - sums) ** 2).sum(axis=1).tolist()], sign * ours, strict=True))])).max() for sign in (1, -1))
        assert best < 1e-8


def test_whitening_without_variance(spark):
    for vectors in ([], [(1, [0.5] * 4)], [(1, [0.5] * 4), (2, [0.5] * 4)]):
        out = whitening.components(table(spark, vectors), "vec_id", "embedding")
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits():
    x = np.array([[1, 2], [3, 1 << 40]])
    n, sums = 1 << 40, [5, 7]
    assert whitening._deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]


def test_op12_and_op13_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, c = brute([(r["vec_id"], r["embedding"]) for r in given], 16, 3)
    got = queries.op12_sort_means(spark, sf).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    assert all(r["centroid_sha256"] == sort_means.digest_of(c[r["cluster"]]) for r in got)
    white = queries.op13_whitening(spark, sf).filter("component in (1, 32)").collect()
    assert len(white) == 2 * len(given) and white[0]["identity_error"] < 1e-9
