"""Sources and sinks (S-06 .. S-15) and input guards (F-09)."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rewardlake.operators import episodes as ep
from rewardlake.operators import evaluation as ev
from rewardlake.operators import metrics as mt
from rewardlake.operators import splits as sp
from rewardlake.plans import toy
from rewardlake.functions import rewards as rw
from rewardlake.sources import results as rs
from rewardlake.sources import tasks as tl
from rewardlake.sources.config import read_run_config, run_config


def scratch():
    return tempfile.mkdtemp(prefix="rl-test-")


def test_run_config_defaults_and_overrides(spark):
    d = scratch()
    with open(os.path.join(d, "cfg.json"), "w") as fh:
        fh.write(json.dumps({"run_id": "x", "kl_coeff": 0.0, "group_size": 8}) + "\n")
    r = read_run_config(spark, d).first()
    assert (r.kl_coeff, r.group_size, r.max_turns, r.reward_mode) == (0.0, 8, 3, "final")
    rows = {r.run_id: r for r in run_config(spark).collect()}
    assert rows["variant"].epsilon_high == 0.5 and rows["base"].epsilon_high == 0.2


def eval_rows(spark):
    return spark.createDataFrame(
        [("base", "in_dist", "t1", True), ("base", "in_dist", "t2", False), ("m", "in_dist", "t1", True),
         ("m", "in_dist", "t2", True), ("base", "transfer", "h1", False), ("m", "transfer", "h1", True)],
        "label string, axis string, task_id string, passed boolean")


def test_results_lines_roundtrip(spark):
    d = os.path.join(scratch(), "results")
    e = eval_rows(spark)
    rs.append_results(e.filter(F.col("label") == "base"), d, restart=True)     # S-08
    rs.append_results(e.filter(F.col("label") == "m"), d)                      # S-07
    lines = [json.loads(x) for f in os.listdir(d) if f.endswith(".json") for x in open(os.path.join(d, f))]
    m = next(x for x in lines if x["label"] == "m")
    assert m["mbpp_heldout"] == {"pass@1": 1.0, "n": 2, "passed": ["t1", "t2"]}
    back = rs.read_results(spark, d)                                            # S-09
    got = sorted((r.label, r.axis, r.task_id) for r in back.filter(F.col("task_id").isNotNull()).collect())
    assert got == [("base", "in_dist", "t1"), ("m", "in_dist", "t1"), ("m", "in_dist", "t2"), ("m", "transfer", "h1")]
    rs.append_results(e.filter(F.col("label") == "m"), d, restart=True)
    assert rs.read_results(spark, d).select("label").distinct().count() == 1


def test_step_series_sinks(spark):
    d = scratch()
    log = spark.createDataFrame([("r", [0, 1, 2], [0.5, 0.4, 0.3], [0.1, 0.2, 0.3])],
                                "run_id string, steps array<int>, losses array<double>, rewards array<double>")
    rows = mt.rows_from_columnar(log, ["steps", "losses", "rewards"])           # S-11
    assert [tuple(r) for r in rows.orderBy("steps").collect()][1] == ("r", 1, 0.4, 0.2)
    longf = mt.long_form(rows, ["run_id", "steps"], ["losses", "rewards"])
    assert longf.count() == 6
    mt.write_series(rows.withColumnRenamed("steps", "step"), os.path.join(d, "m"))   # S-10
    assert os.path.isdir(os.path.join(d, "m", "run_id=r"))
    rec = spark.createDataFrame([(1, 2, 0.5, 0.25)], "epoch int, step int, loss double, mean_reward double")
    assert mt.records(rec, 10).first().step == 12                               # S-12
    mt.write_once(rec, os.path.join(d, "once"))                                 # S-13
    mt.write_once(rec.union(rec), os.path.join(d, "once"))
    assert spark.read.parquet(os.path.join(d, "once")).count() == 1
    lines = mt.text_log(rec.withColumn("epoch", F.lit(10)).withColumn("step", F.lit(5))).first()   # S-14
    assert lines.line == "epoch = 10, step = 5, loss = 0.500, reward = 0.250" and lines.detail
    arr = spark.range(1).select(mt.fmt_array(F.array(F.lit(1.0), F.lit(-0.12345))).alias("a")).first().a
    assert arr == "[1.000, -0.123]"


def test_outcome_rows_and_pass_at_1(spark):
    e = eval_rows(spark).withColumn("completion", F.lit("c"))
    assert rs.outcome_rows(e).columns == ["task_id", "passed", "completion"]    # S-15
    p = {(r.label, r.axis): r.pass_at_1 for r in ev.pass_at_1(e).collect()}
    assert p[("base", "in_dist")] == 0.5 and p[("m", "transfer")] == 1.0
    mid = e.withColumn("run_id", F.lit("r")).withColumn("step", F.lit(50))      # A-18
    assert ev.pass_at_1(mid, ("run_id", "step")).first().pass_at_1 == 4 / 6


def test_task_loaders(spark):
    raw = spark.createDataFrame([(7, "Write f.", ["assert f(1) == 2"])], "task_id long, prompt string, test_list array<string>")
    t = tl.mbpp_sanitized(raw).first()                                          # S-01
    assert (t.task_id, t.entry_point, t.source) == ("mbpp/7", "f", "mbpp")
    he = spark.createDataFrame([("HE/0", "def g():\n", "def check(c): pass", "g")],
                               "task_id string, prompt string, test string, entry_point string")
    h = tl.humaneval(he).first()                                                # S-02
    assert h.tests == ["def check(c): pass\n\ncheck(g)"] and h.meta["signature_prompt"] == "def g():\n"
    assert tl.humaneval_rows(he).count() == 1                                   # S-05
    full = spark.createDataFrame([(1, " Do it. ", ["x = 1"], None)],
                                 "task_id long, text string, test_list array<string>, test_setup_code string")
    r = tl.mbpp_full(full).first()                                              # S-03
    assert r.test_setup == "" and r.function_name == "" and r.prompt[1]["content"] == "Do it."
    assert tl.mbpp_text_tests(raw).columns == ["text", "tests"]                 # S-04


def test_guards(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k long")
    with pytest.raises(ValueError):
        sp.capped_split(sp.source_row_numbers(df, "k"), 5, 150, 30)             # F-09: need n > eval
    with pytest.raises(ValueError):
        sp.take(df, -1)
    assert sp.take(df, 0).count() == 5 and sp.take(df, None).count() == 5       # T-04
    prompts = spark.createDataFrame([(0, [2, 1])], "prompt_id int, prompt array<int>")
    trials = spark.createDataFrame([(0, [1, 2]), (0, [1])], "prompt_id int, response array<int>")
    out = sorted(toy.reward_matrix(prompts, trials, rw.sort_distance).collect(), key=lambda r: len(r.response))
    assert not out[0].equal_len and out[0].reward is None and out[1].reward == 2.0   # quarantine


def test_copies_and_turn_tokens(spark):
    steps = spark.createDataFrame([("r", 1, 3)], "run_id string, step long, group_size int")
    assert sorted(r.g for r in ep.copies(steps, "group_size").collect()) == [0, 1, 2]   # J-05
    turns = spark.createDataFrame([("r", 1, 0, 0, 0.5), ("r", 1, 0, 1, 1.0)],
                                  "run_id string, step long, g int, turn int, reward double")
    toks = spark.createDataFrame([("r", 1, 0, 1, [5, 6], True)],
                                 "run_id string, step long, g int, turn int, comp_ids array<int>, truncated boolean")
    j = ep.join_turn_tokens(turns, toks).collect()                              # J-02
    assert len(j) == 1 and j[0].comp_ids == [5, 6]


def test_log_readers(spark):
    from rewardlake.sources.logs import read_commits, read_completions, read_tasks
    d = scratch()
    with open(os.path.join(d, "c.json"), "w") as fh:
        fh.write(json.dumps({"run_id": "r", "step": 1, "g": 0, "turn": 0, "task_id": "t",
                             "completion": "def f(x): return x", "comp_ids": [1, 2], "finish_reason": "stop"}) + "\n")
    c = read_completions(spark, d, "json").first()
    assert (c.run_id, c.step, c.comp_ids, c.finish_reason) == ("r", 1, [1, 2], "stop")
    spark.createDataFrame([(1, 0, "import os")], "traj_id long, pos int, code string").write.parquet(os.path.join(d, "cm"))
    assert read_commits(spark, os.path.join(d, "cm")).first().code == "import os"
    spark.createDataFrame([("t", ["assert f(1) == 1"])], "task_id string, tests array<string>").write.parquet(os.path.join(d, "tk"))
    t = read_tasks(spark, os.path.join(d, "tk")).first()
    assert t.tests == ["assert f(1) == 1"] and t.entry_point is None
    with pytest.raises(ValueError):
        read_tasks(spark, d, "csv")
