"""Evaluation of several models in one job.

completions(label, axis, task_id, completion) -> code (P-02 or P-01) ->
program per test (P-13) -> run once per distinct program (X-07) ->
passed = every test passed (F-05) -> eval_results(label, axis, task_id,
passed, completion) (S-15) -> pass@1 / two-axis table / paired classes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.operators import evaluation as ev
from rewardlake.operators.execution import execution_verdicts


def eval_results(completions: DataFrame, tasks: DataFrame, style: str = "setup",
                 fence: str = "extract", timeout: float = 10.0, allow_exec: bool = False
                 ) -> DataFrame:
    """One row per (model, axis, task) with its greedy-completion outcome.

    ``style``/``fence`` pick the harness: ``setup``/``extract`` for the
    held-out split, ``check``/``extract`` for the transfer benchmark,
    ``prompt_check``/``strip`` for the older prompt-prefixed harness."""
    keyed = completions.withColumn(
        "completion_id", F.concat_ws("|", "label", "axis", "task_id"))
    v = execution_verdicts(keyed, tasks, ("completion_id",), "completion", style, fence,
                           timeout, allow_exec)
    return v.select("label", "axis", "task_id", F.col("all_passed").alias("passed"), "completion")


def reports(results: DataFrame, a: str, b: str, base: str = "base") -> dict[str, DataFrame]:
    """A-17/A-20 summary, A-19 two-axis table, U-06 paired breakdown."""
    return {"summary": ev.summary(ev.pass_at_1(results), base),
            "two_axis": ev.two_axis(results),
            "breakdown": ev.breakdown(ev.paired(results, a, b, base), ("axis",))}
