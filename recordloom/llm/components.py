"""Connected components of a table of links, by star contraction.

Each round joins every node to the smallest neighbour's label and then replaces labels by
their labels' labels. The state is one row per linked node, written to the shared folder
after each round; nothing is gathered on the driver but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node in ``links`` (a, b)."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").filter("a <> b").distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    # What a round uses twice is written: one plan would work it out again for each use.
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        hooked = cut(hooked, "labels-hooked")
        if hooked.filter("low < old").isEmpty():  # then both ends of each link have one label
            forget(edges, hooked)
            return labels
        # A label that learns of a smaller one passes it on to all nodes that bear it.
        roots = hooked.groupBy("old").agg(F.min("low").alias("root"))
        step = cut(hooked.join(roots, "old").select("node", "root"), "labels-roots")
        upper = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(step.join(upper, "root").select("node", F.least("root", "top").alias("label")), "labels")
        forget(labels, hooked, step)
        labels = after
