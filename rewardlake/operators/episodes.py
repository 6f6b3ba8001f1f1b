"""Multi-turn episodes in batch form (W-07, W-08, W-10, A-02 .. A-06, F-07).

Turn rows are keyed by ``(run_id, step, g, turn)``. A GRPO group is
``(run_id, step)``; a trajectory adds ``g``. Callers should
``repartition('run_id', 'step')`` once: every window and aggregate here is
keyed by a superset of it, so none of them shuffles again. A trajectory
holds at most ``max_turns`` rows and a group ``G * max_turns``, so these
windows never see a hot key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_KEYS = ("run_id", "step")
TRAJ_KEYS = ("run_id", "step", "g")


def by_group(df: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """Hash-partition turn rows by GRPO group, once, up front."""
    return df.repartition(*keys)


def turn_index(df: DataFrame, order_col: str, keys=TRAJ_KEYS, name: str = "turn",
               width: int | None = None) -> DataFrame:
    """W-10: 0-based turn number within an episode, by arrival order.

    Episodes of at most ``max_turns`` turns use one window per episode; for
    unbounded ones pass ``width`` (integer, unique ``order_col``) to number
    rows in hot-key-safe buckets (``splits.keyed_row_numbers``)."""
    if width is not None:
        from rewardlake.operators.splits import keyed_row_numbers
        out = keyed_row_numbers(df, list(keys), order_col, width, "_tn")
        return out.withColumn(name, F.col("_tn").cast("int")).drop("_tn")
    w = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def episode_done(solved: Column, turn: Column, max_turns: Column) -> Column:
    """done = solved or the turn count reached ``max_turns``."""
    return solved | ((turn + 1) >= max_turns)


def trim_episodes(turns: DataFrame, max_turns="max_turns", keys=TRAJ_KEYS) -> DataFrame:
    """W-08: mark ``done`` and keep only the turns up to the first done one
    (the rollout loop stops stepping a finished episode, H-13)."""
    mt = F.col(max_turns) if isinstance(max_turns, str) else F.lit(max_turns)
    done = episode_done(F.col("solved"), F.col("turn"), mt)
    w = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.max(done.cast("int")).over(w)
    return (turns.withColumn("done", done).withColumn("_prior_done", prior)
            .filter((F.coalesce(F.col("_prior_done"), F.lit(0)) == 0) & (F.col("turn") < mt))
            .drop("_prior_done"))


def still_active(turns: DataFrame) -> DataFrame:
    """F-07: turns after which the episode goes on."""
    return turns.filter(~F.col("done"))


def previous_attempt(turns: DataFrame, keys=TRAJ_KEYS, width: int | None = None) -> DataFrame:
    """W-07: the last attempt and its feedback, as seen by the next turn.
    With ``width``, the bucketed form for unbounded episodes."""
    if width is not None:
        from rewardlake.operators.splits import keyed_lag
        return keyed_lag(turns, list(keys), "turn", ["action", "feedback"], width)
    w = Window.partitionBy(*keys).orderBy("turn")
    return (turns.withColumn("prev_action", F.lag("action").over(w))
            .withColumn("prev_feedback", F.lag("feedback").over(w)))


def attempts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-10 and W-07 for episodes of any length, from one layout: ``turn``, ``prev_action`` and
    ``prev_feedback`` of attempts laid out in ranges of ``keys`` and ``order``
    (``positions.laid_out``)."""
    from rewardlake.operators.positions import scan
    every = F.lit(True)
    out = scan(rows, keys, order, counts={"turn": every},
               previous={f"prev_{c}": (F.col(c), every) for c in ("action", "feedback")})
    return out.withColumn("turn", F.col("turn").cast("int"))


def trajectories(turns: DataFrame, keys=TRAJ_KEYS, extra_aggs=()) -> DataFrame:
    """A-02 .. A-05: final reward (last turn), best reward, solved on any
    turn, turn count. One row per trajectory."""
    return turns.groupBy(*keys).agg(
        F.coalesce(F.max_by("reward", "turn"), F.lit(0.0)).alias("final_reward"),
        F.coalesce(F.max("reward"), F.lit(0.0)).alias("best_reward"),
        F.coalesce(F.bool_or("solved"), F.lit(False)).alias("solved"),
        F.count(F.lit(1)).alias("n_turns"),
        *extra_aggs)


def with_trajectory(turns: DataFrame, keys=TRAJ_KEYS) -> DataFrame:
    """A-02 .. A-05 attached to every turn row by window aggregates over the
    trajectory (J-04 without a join: the turn rows stay where
    ``by_group`` put them). ``is_head`` marks one row per trajectory."""
    w = Window.partitionBy(*keys)
    return (turns
            .withColumn("final_reward", F.coalesce(F.max_by("reward", "turn").over(w), F.lit(0.0)))
            .withColumn("best_reward", F.coalesce(F.max("reward").over(w), F.lit(0.0)))
            .withColumn("traj_solved", F.coalesce(F.bool_or("solved").over(w), F.lit(False)))
            .withColumn("n_turns", F.count(F.lit(1)).over(w))
            .withColumn("is_head", F.col("turn") == F.min("turn").over(w)))


def credit(reward_mode="reward_mode") -> Column:
    """A-06: the trajectory reward the advantage is computed from."""
    mode = F.col(reward_mode) if isinstance(reward_mode, str) else F.lit(reward_mode)
    return F.when(mode == "best", F.col("best_reward")).otherwise(F.col("final_reward"))


def copies(df: DataFrame, group_size, name: str = "g") -> DataFrame:
    """J-05: G copies of each row (one per trajectory of the group)."""
    n = F.col(group_size) if isinstance(group_size, str) else F.lit(group_size)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))


def join_turn_tokens(turns: DataFrame, tokens: DataFrame, keys=(*TRAJ_KEYS, "turn")) -> DataFrame:
    """J-02: each turn row with its token record (prompt / completion ids,
    truncation flag) by position ``(run_id, step, g, turn)``."""
    return turns.join(tokens, list(keys), "inner")
