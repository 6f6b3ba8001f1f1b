"""Passed sets as bitmaps, results in chunks, and the example look-up."""
import pytest
from pyspark.sql import functions as F

from rewardlake.operators import evaluation as ev
from rewardlake.operators import passed_sets as ps
from rewardlake.sources import results as rs


@pytest.fixture(scope="module")
def results(spark):
    """70,000 tasks on two axes, three models: more than two chunks of numbers."""
    ids = spark.range(70_000)
    models = F.array(F.struct(F.lit("base").alias("label"), (F.col("id") % 2 == 0).alias("passed")),
                     F.struct(F.lit("A").alias("label"), (F.col("id") % 3 == 0).alias("passed")),
                     F.struct(F.lit("B").alias("label"), (F.col("id") % 35_000 == 1).alias("passed")))
    return ids.select(F.format_string("t%06d", "id").alias("task_id"),
                      F.when(F.col("id") < 60_000, "in_dist").otherwise("transfer").alias("axis"),
                      F.inline(models)).select("label", "axis", "task_id", "passed").cache()


def test_sets_hold_every_passed_task(spark, results):
    tasks = ps.task_numbers(results)
    sets = ps.passed_sets(results, tasks).cache()
    assert sets.agg(F.max(F.length("bits"))).first()[0] == 4096
    want = {(r.label, r.axis): r.n_passed for r in ev.pass_at_1(results).collect()}
    assert {(r.label, r.axis): r.n_passed for r in ps.sizes(sets).collect()} == {
        k: n for k, n in want.items() if n}
    back = ps.members_of(sets, tasks).select("label", "axis", "task_id")
    passed = results.where("passed").select("label", "axis", "task_id")
    assert back.count() == passed.count() and back.exceptAll(passed).isEmpty()


def test_class_counts_equal_the_pivot(spark, results):
    tasks = ps.task_numbers(results)
    parts = [ps.passed_sets(results.where(c), tasks) for c in
             (F.col("task_id") < "t03", (F.col("task_id") >= "t02") & (F.col("task_id") < "t05"),
              F.col("task_id") >= "t05")]                   # overlapping partial runs
    got = {r.axis: r.asDict() for r in ps.class_counts(ps.union(*parts), "A", "B").collect()}
    want = ev.breakdown(ev.paired(results, "A", "B"), ("axis",)).collect()
    assert got == {r.axis: r.asDict() for r in want}


def test_result_lines_come_in_bounded_chunks(spark, results, tmp_path):
    path = str(tmp_path / "lines")
    rs.append_results(results, path, restart=True)
    from rewardlake.schemas import RESULTS_LINE
    lines = spark.read.schema(RESULTS_LINE).json(path)
    longest = lines.select(F.greatest(*[F.coalesce(F.size(f"{n}.passed"), F.lit(0))
                                        for n in ("mbpp_heldout", "humaneval_transfer")]).alias("n"))
    assert longest.agg(F.max("n")).first()[0] <= ps.CHUNK
    back = rs.read_results(spark, path)
    solved = back.where("task_id is not null").select("label", "axis", "task_id")
    passed = results.where("passed").select("label", "axis", "task_id")
    assert solved.count() == passed.count() and solved.exceptAll(passed).isEmpty()
    heads = {(r.label, r.axis, r.n) for r in back.select("label", "axis", "n").distinct().collect()}
    assert heads == {(m, a, n) for m in ("base", "A", "B")
                     for a, n in (("in_dist", 60_000), ("transfer", 10_000))}


def test_examples_with_both_results_filter_the_scan(spark, results, tmp_path):
    path = str(tmp_path / "outcomes")
    results.withColumn("completion", F.concat("label", "task_id")).write.parquet(path)
    outcomes = spark.read.parquet(path)
    examples = ev.example_per_class(ev.paired(results, "A", "B"))
    problems = results.select("task_id").distinct().withColumn("text", F.lit("p"))
    got = ev.with_both_results(examples, outcomes, problems, "A", "B")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(task_id") >= 2 or plan.count("In(task_id, [") >= 2
    for r in got.collect():
        assert r.a_completion == f"A{r.task_id}" and r.b_completion == f"B{r.task_id}"
        assert (r.a_passed, r.b_passed) == {"only_a": (True, False), "only_b": (False, True),
                                            "fixed_by_both": (True, True),
                                            "broken_by_both": (False, False)}[r.cls]
