"""Evaluation results as nested JSON lines (S-07 .. S-09, S-15)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlake.operators.evaluation import pass_at_1, passed_ids
from rewardlake.schemas import RESULTS_LINE

AXES = {"mbpp_heldout": "in_dist", "humaneval_transfer": "transfer"}


def results_lines(eval_results: DataFrame) -> DataFrame:
    """One nested row per model: ``{label, mbpp_heldout{pass@1, n, passed[]},
    humaneval_transfer{...}}``. Where a passed list is longer than a chunk, further rows of the
    model hold the rest; readers unite them."""
    p = pass_at_1(eval_results).join(passed_ids(eval_results), ["label", "axis"])
    block = F.struct(F.col("pass_at_1").alias("pass@1"), F.col("n"), F.col("passed"))
    per = p.select("label", "axis", "chunk", block.alias("b"))
    return per.groupBy("label", "chunk").agg(
        *[F.first(F.when(F.col("axis") == ax, F.col("b")), ignorenulls=True).alias(name)
          for name, ax in AXES.items()]).orderBy("label", "chunk").drop("chunk")


def append_results(eval_results: DataFrame, path: str, restart: bool = False) -> None:
    """S-07 append one line per model; S-08 ``restart`` clears earlier lines."""
    results_lines(eval_results).write.mode("overwrite" if restart else "append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """S-09: read lines back to ``(label, axis, task_id)`` rows of solved
    tasks, plus pass@1 and n per axis."""
    df = spark.read.schema(RESULTS_LINE).json(path)
    # a further chunk of one axis has nothing on the other
    parts = [df.where(F.col(name).isNotNull()).select("label", F.lit(ax).alias("axis"),
                                                      F.col(f"{name}.`pass@1`").alias("pass_at_1"),
                                                      F.col(f"{name}.n").alias("n"),
                                                      F.explode_outer(f"{name}.passed")
                                                      .alias("task_id"))
             for name, ax in AXES.items()]
    return parts[0].unionByName(parts[1])


def outcome_rows(df: DataFrame, task_id: str = "task_id", passed: str = "passed",
                 completion: str = "completion") -> DataFrame:
    """S-15: per-task outcome rows ``{task_id, passed, completion}``."""
    return df.select(task_id, passed, completion)
