"""Evaluation reports (A-17 .. A-22, U-01 .. U-07, J-08, J-10, F-05, S-15).

``eval_results(label, axis, task_id, passed)`` has one row per model,
benchmark axis and task. Paired comparisons are one pass over a pivot
by task (no set algebra over collected lists).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardlake.functions.text import signed_delta


def solved(df: DataFrame, passed: str = "passed") -> DataFrame:
    """F-05."""
    return df.filter(F.col(passed))


def pass_at_1(results: DataFrame, keys=("label", "axis")) -> DataFrame:
    """A-17 / A-18: pass@1, n and solved count per model and axis. A key
    with no tasks yields no row (the reference divides by zero)."""
    return results.groupBy(*keys).agg(
        F.avg(F.col("passed").cast("double")).alias("pass_at_1"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("passed").cast("long")).alias("n_passed"))


def passed_ids(results: DataFrame) -> DataFrame:
    """A-17 ids for the results line: ``label, axis, chunk, passed`` with at most
    ``passed_sets.CHUNK`` ids to a row; every model and axis has a row for chunk 0."""
    from rewardlake.operators import passed_sets as ps
    tasks = ps.task_numbers(results)
    found = ps.chunks(ps.passed_sets(results, tasks), tasks)
    # chunks of an axis count from its own first
    first = Window.partitionBy("label", "axis").orderBy("chunk")
    found = found.withColumn("chunk", F.row_number().over(first) - 1)
    heads = results.select("label", "axis").distinct()
    return (heads.join(found, ["label", "axis"], "left")
            .withColumns({"chunk": F.coalesce("chunk", F.lit(0)),
                          "passed": F.coalesce("passed", F.array().cast("array<string>"))}))


def two_axis(results: DataFrame, axes=("in_dist", "transfer")) -> DataFrame:
    """A-19: model x axis table of pass@1."""
    return (results.groupBy("label").pivot("axis", list(axes))
            .agg(F.avg(F.col("passed").cast("double"))))


def summary(p1: DataFrame, base_label: str = "base", total: str = "n") -> DataFrame:
    """A-20 + P-17: pass@1, solved / total and delta to the base model on
    the same axis."""
    base = p1.filter(F.col("label") == base_label).select(
        "axis", F.col("pass_at_1").alias("base_pass_at_1"))
    out = p1.join(base, "axis", "left")
    d = F.col("pass_at_1") - F.col("base_pass_at_1")
    return (out.withColumn("delta", d)
            .withColumn("delta_text", signed_delta(d, F.col("label") == base_label))
            .withColumn("solved_text", F.format_string("%d/%d", F.col("n_passed"), F.col(total))))


def run_delta(p1: DataFrame, a: str, b: str) -> DataFrame:
    """A-21: pass@1 of ``a`` minus ``b`` per axis (self-join on axis)."""
    x = p1.filter(F.col("label") == a).select("axis", F.col("pass_at_1").alias("a"))
    y = p1.filter(F.col("label") == b).select("axis", F.col("pass_at_1").alias("b"))
    return x.join(y, "axis").select("axis", (F.col("a") - F.col("b")).alias("delta"))


def paired(results: DataFrame, a: str, b: str, base: str = "base",
           keys=("axis", "task_id")) -> DataFrame:
    """U-02 .. U-05: one class per task from a pass pivot over the three
    models (missing = not passed)."""
    piv = results.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(F.when(F.col("label") == m, F.col("passed"))), F.lit(False)).alias(n)
          for m, n in ((base, "p_base"), (a, "p_a"), (b, "p_b"))])
    cls = (F.when(F.col("p_a") & ~F.col("p_b") & ~F.col("p_base"), "only_a")
           .when(F.col("p_b") & ~F.col("p_a") & ~F.col("p_base"), "only_b")
           .when(F.col("p_a") & F.col("p_b") & ~F.col("p_base"), "fixed_by_both")
           .when(F.col("p_base") & ~F.col("p_a") & ~F.col("p_b"), "broken_by_both"))
    return piv.withColumn("cls", cls)


def breakdown(pairs: DataFrame, keys=()) -> DataFrame:
    """U-06: class counts in one aggregation."""
    return pairs.groupBy(*keys).agg(
        *[F.count_if(F.col("cls") == c).alias(f"n_{c}")
          for c in ("only_a", "only_b", "fixed_by_both", "broken_by_both")])


def example_per_class(pairs: DataFrame) -> DataFrame:
    """U-07: a deterministic example (smallest task id) per class."""
    return (pairs.filter(F.col("cls").isNotNull())
            .groupBy("cls").agg(F.min("task_id").alias("task_id")))


def with_both_results(examples: DataFrame, outcomes: DataFrame, problems: DataFrame, a: str,
                      b: str) -> DataFrame:
    """J-08: the problem and both models' results of every example. Examples are at most one per
    class, so their ids go into the scans of outcomes and problems as a filter."""
    ids = [r["task_id"] for r in examples.select("task_id").distinct().collect()]   # four at most
    found = examples.join(problems.filter(F.col("task_id").isin(ids)), "task_id", "left")
    for label, side in ((a, "a"), (b, "b")):
        of = outcomes.filter((F.col("label") == label) & F.col("task_id").isin(ids)).select(
            "task_id", F.col("passed").alias(f"{side}_passed"),
            F.col("completion").alias(f"{side}_completion"))
        found = found.join(of, "task_id", "left")
    return found


def members(results: DataFrame, label: str, other: str, keep: bool) -> DataFrame:
    """J-10: tasks ``label`` solved that ``other`` also solved (semi) or
    did not (anti)."""
    x = solved(results.filter(F.col("label") == label)).select("axis", "task_id")
    y = solved(results.filter(F.col("label") == other)).select("axis", "task_id")
    return x.join(y, ["axis", "task_id"], "left_semi" if keep else "left_anti")
