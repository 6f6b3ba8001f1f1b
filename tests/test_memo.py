"""X-07 with stored verdicts: what was run is not run again, and slow programs run alone."""
import os

from pyspark.sql import functions as F

from rewardlake.operators import execution as ex
from rewardlake.operators import memo as memos


def programs(spark, mark, names):
    """Programs that leave a line in the file ``mark`` each time they run."""
    body = "open({!r}, 'a').write('{}\\n')\n"
    return spark.createDataFrame([(n, body.format(mark, n) + ("1/0" if n.startswith("bad") else ""))
                                  for n in names], "name string, program string")


def lines(mark):
    return sorted(open(mark).read().split()) if os.path.exists(mark) else []


def test_second_run_executes_nothing(spark, tmp_path):
    mark, memo = str(tmp_path / "mark"), str(tmp_path / "memo")
    first = programs(spark, mark, ["a", "b", "bad1"])
    got = {r.name: r for r in ex.run_programs(first, allow_exec=True, memo=memo).collect()}
    assert lines(mark) == ["a", "b", "bad1"]
    assert (got["a"].ok, got["bad1"].ok, got["a"].from_memo) == (True, False, False)
    again = {r.name: r for r in ex.run_programs(first, allow_exec=True, memo=memo).collect()}
    assert lines(mark) == ["a", "b", "bad1"]
    assert all(r.from_memo for r in again.values())
    assert "ZeroDivisionError" in again["bad1"].stderr and not again["bad1"].ok
    more = programs(spark, mark, ["b", "c", "c", "bad2"]).union(
        spark.createDataFrame([("none", None)], "name string, program string"))
    got = ex.run_programs(more, allow_exec=True, memo=memo).collect()
    assert lines(mark) == ["a", "b", "bad1", "bad2", "c"]
    assert sorted((r.name, r.from_memo) for r in got if r.name != "none") == [
        ("b", True), ("bad2", False), ("c", False), ("c", False)]
    assert [r.ok for r in got if r.name == "none"] == [None]


def test_other_limits_are_other_verdicts(spark, tmp_path):
    mark, memo = str(tmp_path / "mark"), str(tmp_path / "memo")
    df = programs(spark, mark, ["a"])
    for timeout, limits, runs in ((5.0, None, 1), (7.0, None, 2), (5.0, {"cpu_s": 3}, 3),
                                  (5.0, {}, 3), (7.0, None, 3)):
        ex.run_programs(df, timeout=timeout, limits=limits, allow_exec=True, memo=memo).collect()
        assert len(lines(mark)) == runs


def test_slow_programs_get_tasks_of_their_own(spark, tmp_path):
    memo = str(tmp_path / "memo")
    spark.createDataFrame(
        [("x" * 64, "slow", True, 0, "", False, None, 9.0, "s", "r", "xx"),
         ("y" * 64, "quick", True, 0, "", False, None, 0.1, "s", "r", "yy")],
        memos.MEMO_SCHEMA).write.partitionBy("bucket").parquet(memo)
    cost = {r.cost_key: r.cost for r in memos.costs(memos.read(spark, memo)).collect()}
    assert cost == {"slow": 9.0, "quick": 0.1}
    todo = spark.createDataFrame([(f"{i:064x}", 9.0 if i < 3 else 0.1) for i in range(40)],
                                 "program_id string, cost double")
    progs = todo.select("program_id", F.lit("pass").alias("program"),
                        F.lit("k").alias("cost_key"))
    tasks = (ex._in_tasks(progs.union(progs), todo, spread=4)
             .select("program_id", F.spark_partition_id().alias("task")).collect())
    of = {}
    for r in tasks:
        of.setdefault(r.task, []).append(int(r.program_id, 16))
    assert sorted(i for t in of.values() for i in t) == list(range(40))     # each once
    slow = [t for t in of.values() if min(t) < 3]
    assert sorted(slow) == [[0], [1], [2]] and len(of) <= 7


def test_text_is_shuffled_once(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(9)], "program string")
    todo = df.select(F.sha2("program", 256).alias("program_id"), F.lit(0.1).alias("cost"))
    progs = df.select(F.sha2("program", 256).alias("program_id"), "program",
                      F.lit("k").alias("cost_key"))
    plan = ex._in_tasks(progs, todo, None)._jdf.queryExecution().executedPlan().toString()
    with_text = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in x for x in with_text) == 1
