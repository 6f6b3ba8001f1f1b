"""Training-step analytics over logged rollouts (stages 4-7 and 9).

turns -> run config -> episode trim (W-08) -> trajectory summary
(A-02..A-05) -> credit (A-06) -> group advantage (W-01/W-03).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.operators import episodes as ep
from rewardlake.operators import groups as gr
from rewardlake.operators.joins import join_dim

CONFIG_COLS = ("run_id", "group_size", "max_turns", "reward_mode", "scale_rewards")


def scored_trajectories(turns: DataFrame, run_config: DataFrame) -> DataFrame:
    """One row per trajectory with its credited reward and advantage."""
    cfg = run_config.select(*CONFIG_COLS)
    t = ep.by_group(join_dim(turns, cfg, "run_id"))
    t = ep.trim_episodes(t)
    traj = ep.trajectories(t, keys=(*ep.TRAJ_KEYS, "group_size", "reward_mode", "scale_rewards"))
    traj = traj.withColumn("reward", ep.credit("reward_mode"))
    return gr.advantage(traj, scale="scale_rewards")


def step_metrics(turns: DataFrame, run_config: DataFrame) -> DataFrame:
    """A-16 from turn rows: reward mean / sample std over trajectories
    (A-07), solve rate and mean turns over the configured G (A-08),
    temperature (M-15), and the surrogate averaged over *turns* (A-09).
    Logged log-probs are absent here, so old = current (the trainer's own
    detached copy, H-15): the ratio is 1 and each turn's surrogate is
    -advantage of its trajectory (J-04).

    Everything after ``by_group`` is keyed by ``(run_id, step)`` or finer:
    trajectory values reach their turns through window aggregates, group
    statistics take one value per trajectory (``is_head``), so the plan
    holds a single hash exchange after the input."""
    from rewardlake.functions import tokens as tk

    cfg = run_config.select(*CONFIG_COLS, "variant_fixes", "temperature", "temp_stage1",
                            "temp_stage2", "temp_switch_step", "epsilon_low", "epsilon_high")
    t = ep.by_group(join_dim(turns, cfg, "run_id"))
    t = ep.with_trajectory(ep.trim_episodes(t))
    t = t.withColumn("traj_reward", ep.credit("reward_mode"))
    t = gr.advantage(t, "traj_reward", scale="scale_rewards", only="is_head")
    t = t.withColumn("surrogate",
                     tk.surrogate(F.lit(1.0), "advantage", "epsilon_low", "epsilon_high"))
    head = F.col("is_head")
    temp = tk.temperature("step", "variant_fixes", "temperature", "temp_stage1", "temp_stage2",
                          "temp_switch_step")
    return t.groupBy(*ep.GROUP_KEYS).agg(
        F.avg(F.when(head, F.col("traj_reward"))).alias("reward_mean"),
        F.stddev_samp(F.when(head, F.col("traj_reward"))).alias("reward_std"),
        (F.sum(F.when(head, F.col("traj_solved").cast("int"))) / F.first("group_size")).alias("solve_rate"),
        (F.sum(F.when(head, F.col("n_turns"))) / F.first("group_size")).alias("mean_turns"),
        F.avg("surrogate").alias("pg_loss"),
        F.first(temp).alias("temperature"))


def full_step_metrics(logs: DataFrame, run_config: DataFrame) -> DataFrame:
    """A-16 complete, from logged turns with their tokens and log-probs
    (``run_id, step, g, turn, reward, solved, comp_ids, truncated, lp,
    old_lp, ref_lp, grad_norm``): W-08 trim, A-02..A-06, W-01, F-03 mask,
    M-06..M-13 per turn, then the ten fields of a step: mean reward and its
    spread, solve rate and mean turns over the configured G, clipped
    objective, KL over gated turns, entropy, total loss (M-17), temperature
    and the logged gradient norm.

    ``by_group`` gives the only exchange after the inputs: trajectory and
    group values are windows on it and the final aggregate has its keys."""
    from rewardlake.functions import tokens as tk
    from rewardlake.operators import objective as ob

    cfg = run_config.select(*CONFIG_COLS, "variant_fixes", "temperature", "temp_stage1",
                            "temp_stage2", "temp_switch_step", "epsilon_low", "epsilon_high",
                            "kl_coeff", "mask_prob", "repeat_check_len")
    t = ep.by_group(join_dim(logs, cfg, "run_id"))
    t = ep.with_trajectory(ep.trim_episodes(t))
    t = t.withColumn("traj_reward", ep.credit("reward_mode"))
    t = gr.advantage(t, "traj_reward", scale="scale_rewards", only="is_head")
    t = gr.truncation_mask(t)
    t = ob.sequence_terms(t, "masked_advantage", "epsilon_low", "epsilon_high", ob.kl_gate())
    head = F.col("is_head")
    temp = tk.temperature("step", "variant_fixes", "temperature", "temp_stage1", "temp_stage2",
                          "temp_switch_step")
    out = t.groupBy(*ep.GROUP_KEYS).agg(
        F.avg(F.when(head, F.col("traj_reward"))).alias("reward_mean"),
        F.stddev_samp(F.when(head, F.col("traj_reward"))).alias("reward_std"),
        (F.sum(F.when(head, F.col("traj_solved").cast("int"))) / F.first("group_size"))
        .alias("solve_rate"),
        (F.sum(F.when(head, F.col("n_turns"))) / F.first("group_size")).alias("mean_turns"),
        F.avg("surrogate").alias("pg_loss"),
        F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"),
        F.avg("entropy").alias("entropy"),
        F.first(temp).alias("temperature"),
        F.max("grad_norm").alias("grad_norm"),
        F.first("kl_coeff").alias("_kl_coeff"))
    return out.withColumn("loss", tk.total_loss("pg_loss", "kl", "_kl_coeff")).drop("_kl_coeff")
