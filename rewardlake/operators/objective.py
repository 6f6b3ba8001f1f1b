"""Clipped objective, KL and entropy over logged log-probs (M-06 .. M-13,
M-17, J-03, F-08, A-09, A-11 .. A-15).

Inputs are rows with ``lp``, ``old_lp`` and optional ``ref_lp`` arrays;
every per-row quantity is an array expression inside whole-stage codegen,
every per-group one a partial aggregate.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.functions import tokens as tk


def join_logprobs(policy: DataFrame, old: DataFrame, ref: DataFrame | None, keys) -> DataFrame:
    """J-03: policy rows inner-join their old log-probs; the reference is a
    left join (absent when no KL is computed)."""
    out = policy.join(old, list(keys), "inner")
    return out.join(ref, list(keys), "left") if ref is not None else out.withColumn(
        "ref_lp", F.lit(None).cast("array<double>"))


def sequence_terms(df: DataFrame, adv: str = "adv", eps_low="epsilon_low",
                   eps_high="epsilon_high", kl_gate=None) -> DataFrame:
    """Per completion: M-06 means, M-07 ratio, M-09 clip, M-10 surrogate,
    M-12 mean k3 KL (only where the F-08 gate holds), M-13 entropy."""
    col = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    out = (df.withColumn("mean_lp", tk.mean_logprob("lp"))
           .withColumn("mean_old_lp", tk.mean_logprob("old_lp"))
           .withColumn("ratio", F.exp(F.col("mean_lp") - F.col("mean_old_lp")))
           .withColumn("clipped_ratio", tk.clip("ratio", col(eps_low), col(eps_high)))
           .withColumn("surrogate", tk.surrogate("ratio", adv, col(eps_low), col(eps_high)))
           .withColumn("entropy", tk.entropy("lp")))
    gate = F.col("ref_lp").isNotNull()
    if kl_gate is not None:
        gate = gate & kl_gate
    return out.withColumn("kl", F.when(gate, tk.array_mean(tk.k3_kl("lp", "ref_lp"))))


def kl_gate(variant_fixes="variant_fixes", kl_coeff="kl_coeff"):
    """F-08: baseline run, reference present, coefficient above zero."""
    return ~F.col(variant_fixes) & (F.col(kl_coeff) > 0)


def step_objective(terms: DataFrame, keys, kl_coeff="kl_coeff", group_size=None) -> DataFrame:
    """A-09 mean surrogate over all rows (turns) of a key, A-11 mean KL
    over gated rows (0 when none), A-12 KL sum / G, A-14 mean entropy,
    M-17 total loss."""
    aggs = [F.avg("surrogate").alias("pg_loss"),
            F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"),
            F.avg("entropy").alias("entropy"),
            F.first(kl_coeff).alias("_kl_coeff")]
    if group_size is not None:
        aggs.append((F.coalesce(F.sum("kl"), F.lit(0.0)) / F.first(group_size)).alias("kl_sum_per_g"))
    out = terms.groupBy(*keys).agg(*aggs)
    return out.withColumn("loss", tk.total_loss("pg_loss", "kl", "_kl_coeff")).drop("_kl_coeff")


def token_terms(df: DataFrame, delta: str = "delta", eps: float = 0.01) -> DataFrame:
    """Toy per-token losses: M-11 naive, M-08 unclipped ratio, clipped
    (eps 0.01), and the per-row KL sum used by A-13. The per-row delta is
    broadcast over positions (J-11)."""
    r = tk.token_ratio("lp", "old_lp")
    return (df.withColumn("naive", tk.naive_token_loss("lp", delta))
            .withColumn("unclipped", tk.token_surrogate(r, delta, None))
            .withColumn("clipped", tk.token_surrogate(r, delta, eps))
            .withColumn("kl_row_sum", tk.array_sum(tk.k3_kl("lp", "ref_lp")))
            .withColumn("n_pos", F.size("lp")))


def token_means(terms: DataFrame, keys) -> DataFrame:
    """A-15 mean over trial x position, A-13 KL sum over positions averaged
    over rows."""
    return terms.groupBy(*keys).agg(
        (F.sum(tk.array_sum("naive")) / F.sum("n_pos")).alias("loss_naive"),
        (F.sum(tk.array_sum("unclipped")) / F.sum("n_pos")).alias("loss_unclipped"),
        (F.sum(tk.array_sum("clipped")) / F.sum("n_pos")).alias("loss_clipped"),
        F.avg("kl_row_sum").alias("kl_penalty"))
