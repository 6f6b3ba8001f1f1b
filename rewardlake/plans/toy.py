"""Sort-task toy (R-10 .. R-12, J-06, W-02, M-16)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.operators.groups import delta
from rewardlake.operators.joins import null_safe_join


def reward_matrix(prompts: DataFrame, trials: DataFrame, reward_fn, key: str = "prompt_id"
                  ) -> DataFrame:
    """R-12 / J-06: every trial joined to its prompt, scored by a pluggable
    column function (X-04). Rows whose lengths differ are not scored
    (F-09 quarantine: ``equal_len`` false)."""
    j = trials.join(prompts, key)
    eq = F.size("prompt") == F.size("response")
    return (j.withColumn("equal_len", eq)
            .withColumn("reward", F.when(eq, reward_fn(F.col("prompt"), F.col("response")))))


def all_deltas(scored: DataFrame, key: str = "prompt_id") -> DataFrame:
    """W-02: the four delta modes side by side. Statistics per prompt are
    partial aggregates joined back, so a prompt with most of the trials
    never gathers in one task."""
    stats = scored.groupBy(key).agg(F.avg("reward").alias("_mean"),
                                    F.stddev_samp("reward").alias("_std"),
                                    F.max("reward").alias("_top"))
    out = null_safe_join(scored, stats, [key])
    for mode in ("rewards", "centered_rewards", "normalized_rewards", "max_rewards"):
        out = out.withColumn(f"d_{mode}", delta(mode, F.col("reward"), F.col("_mean"),
                                                F.col("_std"), F.col("_top")))
    return out.drop("_mean", "_std", "_top")


REWARD_FNS = {"sort_distance": rw.sort_distance, "sort_inclusion_ordering": rw.sort_inclusion_ordering}
