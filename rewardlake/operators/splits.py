"""Ordering, splits and draws (T-01 .. T-06, F-01, F-10, U-01).

Positional splits need a global row number: ``positions.numbered``, in
ranges of the ordering key sampled from the data, without pulling the table
into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlake.functions.hashing import uniform
from rewardlake.operators.joins import null_safe_join
from rewardlake.operators.positions import numbered


def keyed_row_numbers(df: DataFrame, keys: list[str], order: str, width: int = 100_000,
                      name: str = "rn") -> DataFrame:
    """0-based row number within each key, in ``order`` (a unique integer
    column), without sending a hot key to one task: rows are numbered
    inside ``(key, order div width)`` buckets, and each bucket's offset is
    the running count of the key's earlier buckets, computed on the small
    bucket table (one row per bucket)."""
    # The rows themselves are shuffled once (for the in-bucket window); the
    # bucket sizes come from partial counts and the offsets table has one
    # row per bucket (AQE broadcasts it when its measured size is small).
    b = df.withColumn("_b", F.floor(F.col(order) / width))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    return (null_safe_join(b, offs.select(*keys, "_b", "_off"), [*keys, "_b"])
            .withColumn(name, (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
            .drop("_b", "_off"))


def keyed_lag(df: DataFrame, keys: list[str], order: str, cols: list[str], width: int = 100_000,
              prefix: str = "prev_") -> DataFrame:
    """``lag(col)`` within each key in ``order`` (an integer column) for
    every ``col``, without a single window over a hot key: lag inside
    ``(key, order div width)`` buckets, and the first row of a bucket takes
    the last row of the key's nearest earlier non-empty bucket, found on
    the small per-bucket table."""
    b = df.withColumn("_b", F.floor(F.col(order) / width))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    for c in cols:
        b = b.withColumn(f"_l_{c}", F.lag(c).over(w))
    b = b.withColumn("_first", F.row_number().over(w) == 1)
    last = b.groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.col(order)).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).select(
        *keys, "_b", "_carry")
    out = null_safe_join(b, carry, [*keys, "_b"])
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.when(F.col("_first"), F.col("_carry").getField(c))
                             .otherwise(F.col(f"_l_{c}")))
    return out.drop("_b", "_first", "_carry", *[f"_l_{c}" for c in cols])


def seeded_order(key: str, seed: int) -> Column:
    """T-01: a seeded shuffle key (uniform in [0, 1), H-5)."""
    return uniform(F.lit(str(seed)), F.col(key))


def shuffled_row_numbers(df: DataFrame, key: str, seed: int, name: str = "row_idx") -> DataFrame:
    """T-01 + row number in shuffled order."""
    d = df.withColumn("_u", seeded_order(key, seed))
    return numbered(d, [F.col("_u").asc(), F.col(key).asc()], name).drop("_u")


def source_row_numbers(df: DataFrame, order_key: str, name: str = "row_idx") -> DataFrame:
    """Row number in source order given a unique order key, sparse or dense, of any type."""
    return numbered(df, [F.col(order_key).asc()], name)


def range_split(df: DataFrame, n_train: int, n_heldout: int, idx: str = "row_idx") -> DataFrame:
    """T-02: [0, n) train, [n, n + h) held-out; other rows dropped."""
    i = F.col(idx)
    split = (F.when(i < n_train, "train").when(i < n_train + n_heldout, "heldout"))
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def capped_split(df: DataFrame, n_total: int, want_train: int, n_eval: int,
                 idx: str = "row_idx") -> DataFrame:
    """T-03: source-order split with train capped at min(N, n - eval).
    ``n_total`` is the row count (needs n > eval, F-09)."""
    if n_total <= n_eval:
        raise ValueError(f"Dataset too small: {n_total} problems, need at least {n_eval + 1}")
    end = min(want_train, n_total - n_eval)
    i = F.col(idx)
    return df.withColumn("split", F.when(i < end, "train").when(i < end + n_eval, "eval")).filter(
        F.col("split").isNotNull())


def within(limit: int | None, idx: str = "row_idx") -> Column:
    """T-04 as a condition: the first ``limit`` rows of a gapless 0-based row number; None and 0
    mean no limit."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    return F.col(idx) < limit if limit else F.lit(True)


def take(df: DataFrame, limit: int | None, idx: str = "row_idx") -> DataFrame:
    """T-04. A filter, so nothing is gathered in one task."""
    return df.filter(within(limit, idx))


def named_only(df: DataFrame, name: str = "function_name") -> DataFrame:
    """F-01: keep tasks with a parseable name (after the split)."""
    return df.filter(F.coalesce(F.col(name), F.lit("")) != "")


def draw_per_step(steps: DataFrame, tasks: DataFrame, n_tasks: int, seed: int,
                  step: str = "step", idx: str = "row_idx") -> DataFrame:
    """F-10: one task per step, uniform with replacement: the step's draw
    picks ``row_idx = floor(u * n)``."""
    pick = F.floor(uniform(F.lit(str(seed)), F.col(step)) * n_tasks).cast("long")
    return steps.withColumn(idx, pick).join(tasks, idx)


def concat_splits(*parts: tuple[str, DataFrame]) -> DataFrame:
    """U-01: union of splits with a split column."""
    out = None
    for name, d in parts:
        d = d.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out
