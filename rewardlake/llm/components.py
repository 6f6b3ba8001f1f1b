"""Connected components of a link table by alternating star operations, in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame

from rewardlake.llm.common import F, written


def _links(df: DataFrame, a, b) -> DataFrame:
    return df.select(a.alias("u"), b.alias("v")).where(F.col("u") != F.col("v"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u``, ``v``) that is not its own root; ``root``
    is the smallest node of the component.

    Each round links every node to the smallest neighbour known (first over larger neighbours,
    then over smaller ones) until nothing changes; the number of rounds grows with the logarithm
    of the longest chain. Each round's table is written to the shared folder. A hot centre's rows
    are pre-aggregated for the minimum and joined with skew splitting."""
    # a link from the larger to the smaller node
    cur = written(_links(links, F.greatest("u", "v"), F.least("u", "v")).distinct())
    size = cur.count()
    if not size:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _links(both.join(least, "u").where(F.col("v") > F.col("u")),
                       F.col("v"), F.col("m")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = _links(joined, F.col("v"), F.col("m")).unionByName(
            _links(least, F.col("u"), F.col("m"))).distinct()
        cur = written(small)
        now = cur.agg(F.count("*").alias("n"),
                      F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now["n"], now["h"])
