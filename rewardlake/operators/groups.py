"""Group-relative advantages and masks (W-01 .. W-03, F-02 .. F-04, F-11).

A group is bounded by ``G`` trajectories, so its statistics are window
aggregates over a partition that ``episodes.by_group`` already laid out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlake.functions.hashing import uniform
from rewardlake.functions.tokens import is_repetitive

STD_THRESHOLD = 1e-6   # fixed value: zero-variance test
ADV_EPS = 1e-8         # fixed value: normaliser epsilon
DELTA_EPS = 1e-5       # fixed value: epsilon of the toy 'normalized_rewards' mode


def varied(std: Column) -> Column:
    """F-02: the group has spread. A single sample has a NULL std in Spark
    (NaN in the reference) and a NaN reward a NaN one; all fail the test
    (H-2), although Spark orders NaN above every number."""
    return F.coalesce((std > STD_THRESHOLD) & ~F.isnan(std), F.lit(False))


def advantage(df: DataFrame, reward: str = "reward", keys=("run_id", "step"),
              scale=None, name: str = "advantage", only: str | None = None) -> DataFrame:
    """W-01 / W-03: ``(r - mean) / (std + 1e-8)`` when the group varies,
    else 0; with ``scale`` false, only ``r - mean`` (no std scaling).
    ``scale`` is a column name, a bool, or None (= always scale). With
    ``only``, the group statistics use just the rows where that column is
    true (one row per trajectory when rows are turns)."""
    w = Window.partitionBy(*keys)
    r = F.col(reward)
    sample = F.when(F.col(only), r) if only else r
    mean = F.avg(sample).over(w)
    std = F.stddev_samp(sample).over(w)
    scaled = F.when(varied(std), (r - mean) / (std + ADV_EPS)).otherwise(F.lit(0.0))
    if scale is None or scale is True:
        adv = scaled
    elif scale is False:
        adv = r - mean
    else:
        adv = F.when(F.col(scale), scaled).otherwise(r - mean)
    return df.withColumn(name, adv)


def delta(mode: str, r: Column, mean: Column, std: Column, top: Column) -> Column:
    """W-02: one of the toy's four delta modes from a prompt's statistics."""
    if mode == "rewards":
        return r
    if mode == "centered_rewards":
        return r - mean
    if mode == "normalized_rewards":
        return (r - mean) / (std + DELTA_EPS)
    if mode == "max_rewards":
        return F.when(r == top, r).otherwise(F.lit(0.0))
    raise ValueError(f"Unknown mode: {mode}")


def deltas(df: DataFrame, mode: str, reward: str = "reward", keys=("prompt_id",),
           name: str = "delta") -> DataFrame:
    """W-02 over the trials of one prompt, as windows: for prompts with few
    trials. :func:`rewardlake.plans.toy.all_deltas` is for any number."""
    w = Window.partitionBy(*keys)
    r = F.col(reward)
    return df.withColumn(name, delta(mode, r, F.avg(r).over(w), F.stddev_samp(r).over(w),
                                     F.max(r).over(w)))


def mask_draw(*key_cols: str) -> Column:
    """Deterministic stand-in for the trainer's random draw (H-5)."""
    return uniform(*key_cols)


def truncation_mask(df: DataFrame, adv: str = "advantage", truncated: str = "truncated",
                    ids: str = "comp_ids", m="repeat_check_len", rho="mask_prob",
                    enabled="variant_fixes", draw_keys=("run_id", "step", "g", "turn"),
                    name: str = "masked_advantage") -> DataFrame:
    """F-03 (per turn) / F-04 (per completion, with ``draw_keys`` without
    ``turn``): zero the advantage of truncated, non-repetitive rows when
    the draw falls below ``rho``."""
    col = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    hit = (col(enabled) & F.col(truncated) & ~is_repetitive(ids, col(m))
           & (mask_draw(*draw_keys) < col(rho)))
    return df.withColumn("masked", hit).withColumn(
        name, F.when(hit, F.lit(0.0)).otherwise(F.col(adv)))


def drop_truncated(df: DataFrame, flag="mask_truncated", truncated: str = "truncated") -> DataFrame:
    """F-11: with the flag set, truncated completions leave the loss."""
    f = F.col(flag) if isinstance(flag, str) else F.lit(flag)
    return df.filter(~(f & F.col(truncated)))
