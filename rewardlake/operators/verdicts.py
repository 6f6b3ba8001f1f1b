"""Per-completion verdicts from per-test outcomes (A-01, P-14, P-15, T-05,
R-04 .. R-06 applied to verdict frames).

Per-test rows aggregate with partial (map-side) aggregation, so a
completion with very many tests never lands whole in one task before the
combine. Completions with no test rows survive through a left join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.functions import text as tx


def test_counts(results: DataFrame, keys=("completion_id",)) -> DataFrame:
    """n_passed / n_total per completion, plus the first failing test in
    test order (T-05) when the rows carry ``test_idx``/``test``/``error``."""
    aggs = [F.sum(F.col("passed").cast("int")).alias("n_passed"),
            F.count(F.lit(1)).alias("n_total")]
    if {"test_idx", "test", "error"} <= set(results.columns):
        fail_idx = F.when(~F.col("passed"), F.col("test_idx"))
        aggs.append(F.min_by(F.struct("test", "error"), fail_idx).alias("first_fail"))
    return results.groupBy(*keys).agg(*aggs)


def verdicts(completions: DataFrame, results: DataFrame, keys=("completion_id",),
             syntax_ok: str | None = "syntax_ok") -> DataFrame:
    """A-01: n_passed, n_total, fraction (0 with no tests), all_passed
    (false with no tests). A completion that does not parse fails every
    test (P-15), so its passes count 0."""
    counts = test_counts(results, keys)
    v = completions.join(counts, list(keys), "left")
    n_total = F.coalesce(F.col("n_total"), F.lit(0)).cast("long")
    n_passed = F.coalesce(F.col("n_passed"), F.lit(0)).cast("long")
    if syntax_ok is not None:
        n_passed = F.when(F.col(syntax_ok), n_passed).otherwise(F.lit(0).cast("long"))
    v = v.withColumn("n_total", n_total).withColumn("n_passed", n_passed)
    return (v.withColumn("fraction_passed",
                         F.when(F.col("n_total") > 0, F.col("n_passed") / F.col("n_total"))
                         .otherwise(F.lit(0.0)))
            .withColumn("all_passed", (F.col("n_total") > 0) & (F.col("n_passed") == F.col("n_total"))))


def with_feedback(v: DataFrame, syntax_ok: str = "syntax_ok") -> DataFrame:
    """P-14 over a verdict frame that carries ``first_fail``."""
    ff = F.col("first_fail")
    return v.withColumn("feedback", tx.failure_feedback(syntax_ok, ff.getField("test"),
                                                        ff.getField("error")))


def score(v: DataFrame, components=None, name: str = "reward",
          breakdown: str | None = None) -> DataFrame:
    """R-04: weighted rubric reward (and optional breakdown map)."""
    out = v.withColumn(name, rw.rubric_reward(components))
    if breakdown:
        out = out.withColumn(breakdown, rw.rubric_breakdown(components))
    return out
