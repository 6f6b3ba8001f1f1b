"""Positions and scans by range partitioning: row numbers, and per key running counts, previous and
next values.

Rows are range-partitioned by their order (Spark samples the quantiles of the key), so a partition
stays bounded whatever the key looks like: sparse, dense, text or skewed. What a row needs from its own
partition is a window there. What it needs from other partitions comes from one or two rows for each
partition: its count for row numbers, summed up in two levels; its first and last key for the scans, as
a key that spans partitions is the last of one and the first of the next. These small tables are
written, and joined back by broadcast behind a check of their size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlake.operators.joins import bounded_broadcast, null_safe_join, planned_bytes
from rewardlake.operators.layout import PARTITION_BYTES, UNKNOWN_BYTES
from rewardlake.session import cut_lineage

# Partition counts summed in one step; the second step sums the sums of so many.
FAN = 1024
# A row's place in its partition is the low part of its monotonic id.
_PLACE_BITS = 33


def range_partitions(df: DataFrame) -> int:
    """Partitions of at most ``PARTITION_BYTES`` of planned size; unknown sizes count as many as
    the session's shuffles."""
    size = planned_bytes(df)
    if size >= UNKNOWN_BYTES:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // PARTITION_BYTES))


def prefix_sums(counts: DataFrame, at: str, n: str, name: str) -> DataFrame:
    """``at, name``: the sum of ``n`` over all rows with a smaller ``at`` (unique, from 0). No
    window holds more than ``FAN`` rows below the top level, which has one row per ``FAN``."""
    block = F.floor(F.col(at) / FAN)
    inner = Window.partitionBy("_block").orderBy(at)
    parts = counts.select(at, n).withColumn("_block", block)
    blocks = parts.groupBy("_block").agg(F.sum(n).alias("_n"))
    before = blocks.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n"))
                           .alias("_before"))
    return parts.join(before, "_block").select(
        at, (F.col("_before") + F.sum(n).over(inner) - F.col(n)).cast("long").alias(name))


def laid_out(df: DataFrame, order: list[Column], tie: Column | None = None,
             partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, with ``_part``, the range of a row, and ``_place``, its number
    there from 0; written. ``tie`` tells rows of equal order apart and spreads them (where many rows
    are equal: ``F.monotonically_increasing_id()``)."""
    keys = [*order] + ([F.col("_tie").asc()] if tie is not None else [])
    src = df if tie is None else df.withColumn("_tie", tie)
    sorted_ = src.repartitionByRange(partitions or range_partitions(df), *keys)
    return cut_lineage(sorted_.sortWithinPartitions(*keys).drop("_tie").withColumn(
        "_id", F.monotonically_increasing_id()).withColumns({
            "_part": F.shiftright("_id", _PLACE_BITS),
            "_place": F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_id"))


def numbered(df: DataFrame, order: list[Column], name: str = "row_idx",
             tie: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, its 0-based row number in ``order`` (see :func:`laid_out`)."""
    rows = laid_out(df, order, tie, partitions)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = cut_lineage(prefix_sums(counts, "_part", "_n", "_first"))
    return rows.join(bounded_broadcast(first), "_part").withColumn(
        name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def by_part(rows: DataFrame) -> DataFrame:
    """Laid-out rows with each range in one task, for any number of :func:`scan` steps."""
    return rows.repartition("_part")


def scan(rows: DataFrame, keys: list[str], order: str, counts: dict[str, Column] | None = None,
         previous: dict[str, tuple[Column, Column]] | None = None,
         following: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (laid out by ``keys`` and ``order``) with one column for each entry:

    ``counts``: how many earlier rows of the key fulfil the condition; ``previous``: the value of the
    last earlier row of the key that fulfils the condition; ``following``: the value of the key's
    next row. No task holds more than a range, however many rows a key has."""
    counts, previous, following = counts or {}, previous or {}, following or {}
    here = Window.partitionBy("_part", *keys).orderBy(order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    # of every key in a range, what other ranges may need of it
    ends = rows.groupBy("_part", *keys).agg(
        F.min("_place").alias("_from"), F.max("_place").alias("_to"),
        *[F.count(F.when(c, 1)).alias(f"_c_{n}") for n, c in counts.items()],
        *[F.max_by(F.struct(v.alias("v")), F.when(c, F.col(order))).alias(f"_p_{n}")
          for n, (v, c) in previous.items()],
        *[F.min_by(F.struct(v.alias("v")), order).alias(f"_f_{n}") for n, v in following.items()])
    part = Window.partitionBy("_part")
    at_end = ((F.col("_from") == F.min("_from").over(part))
              | (F.col("_to") == F.max("_to").over(part)))
    ends = ends.withColumn("_end", at_end).where("_end")
    key = Window.partitionBy(*keys).orderBy("_part")
    earlier = key.rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(ends.select(
        "_part", *keys,
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in counts],
        *[F.last(f"_p_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(key).alias(f"_f_{n}") for n in following]))
    out = rows.withColumns({
        **{f"_hc_{n}": F.count(F.when(c, 1)).over(before) for n, c in counts.items()},
        **{f"_hp_{n}": F.last(F.when(c, F.struct(v.alias("v"))), ignorenulls=True).over(before)
           for n, (v, c) in previous.items()},
        **{f"_hf_{n}": F.lead(F.struct(v.alias("v"))).over(here) for n, v in following.items()}})
    out = null_safe_join(out, bounded_broadcast(carried), ["_part", *keys], "left")
    out = out.withColumns({
        **{n: F.col(f"_hc_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in counts},
        **{n: F.coalesce(f"_hp_{n}", f"_p_{n}")["v"] for n in previous},
        **{n: F.coalesce(f"_hf_{n}", f"_f_{n}")["v"] for n in following}})
    return out.drop(*[f"_{x}{k}_{n}" for k, names in (("c", counts), ("p", previous),
                                                      ("f", following))
                      for n in names for x in ("", "h")])
