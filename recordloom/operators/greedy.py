"""The greedy choice over rivals, in rounds.

Taken in their order, an item is kept unless a kept one shares a group with it. A round keeps each
undecided item that comes first among the undecided ones of all its groups, and lets its rivals go;
the rest meets in the next round. The result is that of going through the items one by one. There
are as many rounds as the longest chain of items that wait for each other, few unless the groups
form long paths; each is a group minimum and joins, which combine on the map side or can be split,
so a group that holds most rows doesn't meet in one task, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, forget


def decided(members: DataFrame, group: str, item: str) -> DataFrame:
    """item and kept for every item. ``members`` has a row for each group of an item; items go in
    the order of their values, which must tell them apart. Both columns may be structs, not null."""
    live = cut(members.select(F.col(group).alias("g"), F.col(item).alias("o")).distinct(), "greedy")
    out = []
    while not live.isEmpty():
        first = live.groupBy("g").agg(F.min("o").alias("m"))
        marks = live.join(first, "g").groupBy("o").agg(F.bool_and(F.col("o") == F.col("m")).alias("kept"))
        kept = cut(marks.filter("kept").select("o"), "greedy-kept")
        over = cut(live.join(kept, "o", "left_semi").select("g").distinct(), "greedy-groups")
        gone = live.join(over, "g", "left_semi").select("o").distinct()  # kept ones and their rivals
        gone = gone.join(kept.withColumn("kept", F.lit(True)), "o", "left").select("o", F.coalesce("kept", F.lit(False)).alias("kept"))
        out.append(cut(gone, "greedy-decided"))
        rest = cut(live.join(out[-1].select("o"), "o", "left_anti"), "greedy")
        forget(live, over, kept)
        live = rest
    if not out:
        return members.limit(0).select(F.col(item), F.lit(True).alias("kept"))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole.withColumnRenamed("o", item)
