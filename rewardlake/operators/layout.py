"""Physical layout helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame

from rewardlake.operators.joins import planned_bytes

PARTITION_BYTES = 128 << 20
UNKNOWN_BYTES = 1 << 50         # the optimizer's stand-in for a size it does not know is larger


def spread(df: DataFrame, min_partitions: int | None = None, force: bool = False) -> DataFrame:
    """Round-robin the rows over at least ``min_partitions`` partitions
    (default: the cluster's parallelism) when the input has fewer.

    CPU-heavy per-row work (regex, n-grams, parsing) runs one task per
    partition; a table stored in one parquet row group scans as one
    partition and would keep a single core busy. Inputs that already have
    enough partitions (many files / row groups) are returned unchanged,
    so at scale this adds no shuffle.

    A partition count can hide skew (a union of byte splits where one
    split holds every row group); ``force=True`` always round-robins, for
    work whose output dwarfs its input (n-gram explosion), where one extra
    shuffle of the input buys evenly loaded tasks. The number of partitions
    then also grows with the planned size, at most ``PARTITION_BYTES`` each."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if force:
        size = planned_bytes(df)
        by_size = (-(-size // PARTITION_BYTES) if size < UNKNOWN_BYTES
                   else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(max(want, by_size))
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df
