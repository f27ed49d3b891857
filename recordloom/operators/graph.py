"""Citation graph: neighbourhoods, hop expansion, display edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.scratch import cut


def neighbours(edges: DataFrame, seeds: DataFrame, node: str, references: int, cited_by: int | None = None) -> DataFrame:
    """seed, neighbour, direction: for each seed at most so many in each direction (``references`` for
    both, unless ``cited_by`` is given), smallest ids first. ``edges``: src cites dst."""
    out = edges.join(seeds.select(F.col(node).alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("neighbour"), F.lit("references").alias("direction"))
    back = edges.join(seeds.select(F.col(node).alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("neighbour"), F.lit("cited_by").alias("direction"))

    def nearest(pairs: DataFrame, most: int) -> DataFrame:
        """Equal pairs have one rank; a rank below a number is a limit that Spark applies before it
        moves rows, so that a task holds little of a seed with many neighbours."""
        w = Window.partitionBy("seed").orderBy("neighbour")
        return pairs.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= most).drop("r").distinct()

    return nearest(out, references).unionByName(nearest(back, references if cited_by is None else cited_by))


#: Hops of citation chasing by tier.
TIER_HOPS = {"quick": 0, "standard": 1, "deep": 2, "audit": 2}


def chase(edges: DataFrame, scores: DataFrame, known: DataFrame, hops: int, per_hop: int = 10, references: int = 30, cited_by: int = 50, bar: float = 7, fewest: int = 3, budget: int | None = None) -> DataFrame:
    """node, hop, seeds and score of the records that citation chasing adds to the ``known`` ones (node).

    A hop starts from the ``per_hop`` best scored records there are that no hop started from yet: those
    with a score of ``bar`` or more, or of one less where fewer than ``fewest`` reach it. Their nearest
    ``references`` and ``cited_by`` are added, but for what is known already, which keeps its label; the
    new ones are looked up in ``scores`` (node, score) and may start the next hop. Chasing stops after
    ``hops``, without a seed, or once ``budget`` records are new."""
    held = cut(known.select("node").distinct().join(scores, "node", "left").select("node", "score", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("seeds")), "chase")
    used: list = []
    for hop in range(1, hops + 1):
        able = held.filter(F.col("score") >= bar - 1)
        least = bar if able.filter(F.col("score") >= bar).limit(fewest).count() >= fewest else bar - 1
        # per_hop ids a hop
        seeds = [r["node"] for r in able.filter((F.col("score") >= least) & ~F.col("node").isin(used)).orderBy(F.desc("score"), "node").limit(per_hop).collect()]
        if not seeds or (budget is not None and held.filter("hop > 0").count() >= budget):
            break
        used += seeds
        around = neighbours(edges, held.filter(F.col("node").isin(seeds)), "node", references, cited_by)
        new = around.groupBy(F.col("neighbour").alias("node")).agg(F.countDistinct("seed").alias("seeds")).join(held.select("node"), "node", "left_anti")
        new = new.join(scores, "node", "left").select("node", "score", F.lit(hop).alias("hop"), "seeds")
        held = cut(held.unionByName(new), "chase")
    return held.filter("hop > 0").select("node", "hop", "seeds", "score")


def expand(edges: DataFrame, seeds: DataFrame, node: str, hops: int) -> DataFrame:
    """node and hop: what is reached over undirected edges within ``hops``, at its first hop."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst")
    seen = seeds.select(F.col(node).alias("node")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        # edges aren't made distinct, what they reach is; the front is written, so that its true size is known
        new = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)), "front")
        seen = seen.union(front)
    return seen


def display_edges(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Undirected distinct edges between displayed nodes, without loops."""
    a, b = nodes.select(F.col(node).alias("src")), nodes.select(F.col(node).alias("dst"))
    kept = edges.filter("src <> dst").join(a, "src", "left_semi").join(b, "dst", "left_semi")
    return kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
