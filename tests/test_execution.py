"""P-06, X-06, X-07 and the rewards on them (R-07 .. R-09, X-05).

They run stored code on the executors, so they pass ``allow_exec=True``."""
import time

import pytest
from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.functions.text import SYNTAX_FEEDBACK
from rewardlake.operators import execution as ex
from rewardlake.operators.verdicts import score

DOUBLE_TESTS = ["assert f(2) == 4", "assert f(3) == 6", "assert f(0) == 0"]
CASES = [
    ("all_pass", "def f(x):\n    return x * 2"),
    ("partial", "def f(x):\n    return x + 2"),
    ("syntax", "def f(x) return x"),
    ("fenced", "```python\ndef f(x):\n    return x * 2\n```"),
    ("exits_early", "import sys\nsys.exit(0)\ndef f(x):\n    return 0"),
    ("unicode", "def f(größe):\n    return größe * 2"),
    ("empty", ""),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    tasks = spark.createDataFrame([("t/double", DOUBLE_TESTS), ("t/none", [])],
                                  "task_id string, tests array<string>")
    rows = [(cid, "t/double", c) for cid, c in CASES] + [("no_tests", "t/none", "def f(x): return x")]
    comps = spark.createDataFrame(rows, "completion_id string, task_id string, completion string")
    v = ex.execution_verdicts(comps, tasks, allow_exec=True)
    v = score(v, rw.dense_components("completion"), "dense")
    return {r.completion_id: r for r in v.collect()}


EXPECTED = {  # completion: (parses, tests passed, tests in all)
    "all_pass": (True, 3, 3), "partial": (True, 1, 3), "syntax": (False, 0, 3),
    "fenced": (True, 3, 3), "exits_early": (True, 3, 3), "unicode": (True, 3, 3),
    "empty": (True, 0, 3), "no_tests": (True, 0, 0),
}


@pytest.mark.parametrize("cid", EXPECTED)
def test_a01_counts(verdicts, cid):
    r = verdicts[cid]
    ok, passed, total = EXPECTED[cid]
    assert (r.syntax_ok, r.n_passed, r.n_total) == (ok, passed, total)
    assert r.all_passed == (total > 0 and passed == total)
    assert abs(r.fraction_passed - (passed / total if total else 0.0)) < 1e-9


def test_p14_texts(verdicts):
    assert [verdicts[c].feedback for c in ("all_pass", "no_tests")] == ["", ""]
    assert verdicts["syntax"].feedback == SYNTAX_FEEDBACK
    lines = verdicts["partial"].feedback.split("\n")
    assert lines[:3] == ["Your code failed this test:", DOUBLE_TESTS[1], "Error:"]
    assert lines[-1] == "AssertionError"


def test_r06_dense_value(verdicts):
    assert verdicts["fenced"].dense == pytest.approx(0.9)


def test_x07_wall_clock(spark):
    tasks = spark.createDataFrame([("t", ["assert f(1) == 1"])], "task_id string, tests array<string>")
    comps = spark.createDataFrame([("c", "t", "def f(x):\n    while True:\n        pass")],
                                  "completion_id string, task_id string, completion string")
    r = ex.execution_verdicts(comps, tasks, timeout=2, allow_exec=True).first()
    assert r.n_passed == 0 and r.feedback.endswith("TimeoutExpired after 2s")


def test_execution_is_opt_in(spark):
    df = spark.createDataFrame([("print(1)",)], "program string")
    with pytest.raises(PermissionError):
        ex.run_programs(df)


def run(spark, programs, **kw):
    df = spark.createDataFrame([(p,) for p in programs], "program string")
    return {r.program: r for r in ex.run_programs(df, allow_exec=True, **kw).collect()}


PICKLE = ("import pickle\nclass A:\n    x = 1\n"
          "assert pickle.loads(pickle.dumps(A())).x == 1")
UNITTEST = ("import unittest\nclass T(unittest.TestCase):\n    def test_a(self):\n"
            "        self.assertEqual(1, 1)\nunittest.main()")
MAIN = "import __main__\nv = 3\nassert __main__.v == 3 and not hasattr(__main__, '_boot')"
BIG = "x = bytearray(1_200_000_000); x[-1] = 1"
FLOOD = "import sys\nfor _ in range(400):\n    sys.stdout.write('x' * 100_000)"
FILE = "open('f', 'wb').write(b'0' * (17 << 20))"
UNDECODABLE = "import sys\nsys.stdout.buffer.write(b'\\xff')"
SURROGATE = "s = 'gr\u00f6\u00dfe \u4e2d'\nassert len(s) == 7"


def test_x07_real_main_and_no_default_limits(spark):
    got = run(spark, [PICKLE, UNITTEST, MAIN, BIG, FLOOD, FILE, SURROGATE], timeout=60)
    assert [p[:40] for p, r in got.items() if not r.ok] == []
    assert {r.limit_hit for r in got.values()} == {None}


def test_x07_undecodable_output_and_null(spark):
    got = run(spark, [UNDECODABLE, None, "raise SystemExit(3)"])
    assert got[UNDECODABLE].ok is False and "UnicodeDecodeError" in got[UNDECODABLE].stderr
    assert got[None].ok is None and got["raise SystemExit(3)"].returncode == 3


def test_x07_limits_on_request(spark):
    got = run(spark, [BIG, FILE], limits={"mem_mb": 512, "file_mb": 16}, timeout=30)
    assert (got[BIG].limit_hit, got[FILE].limit_hit) == ("memory", "file")


def test_x07_leaves_no_process(spark, tmp_path):
    mark = tmp_path / "alive"
    child = f"import time; time.sleep(3); open({str(mark)!r}, 'w').write('x')"
    prog = ("import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', %r], "
            "stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)" % child)
    assert run(spark, [prog])[prog].ok
    time.sleep(5)
    assert not mark.exists()


def test_x06_any_parser_failure_is_a_result(spark):
    deep = "x = " + "+".join(["1"] * 50_000)
    unary = "x = " + "-" * 100_000 + "1"
    df = spark.createDataFrame([(deep,), (unary,), ("a\x00b",), ("x = 1",)], "code string")
    got = {r.code[:12]: r for r in ex.syntax_check(df, reason="why").collect()}
    assert got["x = 1"].syntax_ok and got["x = 1"].why == ""
    for c in (deep, unary, "a\x00b"):
        assert got[c[:12]].syntax_ok is False and got[c[:12]].why


def test_r08_null_completion_is_scored(spark):
    tasks = spark.createDataFrame([("m", ["assert g(1) == 1"], None)],
                                  "task_id string, tests array<string>, test_setup string")
    comps = spark.createDataFrame([("a", "m", None)], "completion_id string, task_id string, "
                                  "completion array<struct<role:string,content:string>>")
    r = ex.execution_reward(comps, tasks, allow_exec=True, messages=True).first()
    assert r.execution_reward == 0.0 and r.n_total == 1
    plain = spark.createDataFrame([("a", "m", None)],
                                  "completion_id string, task_id string, completion string")
    assert ex.execution_reward(plain, tasks, allow_exec=True).first().execution_reward == 0.0


def test_setup_style_reward(spark):
    tasks = spark.createDataFrame([("m/1", ["assert g(2) == 5"], "K = 1")],
                                  "task_id string, tests array<string>, test_setup string")
    msgs = "array<struct<role:string,content:string>>"
    comps = spark.createDataFrame(
        [("a", "m/1", [("assistant", "Here:\n```python\ndef g(x):\n    return 2 * x + K\n```\nok")]),
         ("b", "m/1", [("assistant", "def g(x) return 0")])],
        f"completion_id string, task_id string, completion {msgs}")
    out = {r.completion_id: r.execution_reward
           for r in ex.execution_reward(comps, tasks, allow_exec=True, messages=True).collect()}
    assert out == {"a": 1.0, "b": 0.0}


def test_syntax_udf(spark):
    df = spark.createDataFrame([("def f(:",), ("x = 1",), (None,)], "code string")
    got = [r.syntax_ok for r in ex.syntax_check(df, "code").orderBy(F.col("code").asc_nulls_first()).collect()]
    assert got == [None, False, True]


def test_error_text_matches_dash_c(spark):
    """Programs run from a file but report errors exactly as ``python -c``
    would (no scratch-folder path in the feedback)."""
    import subprocess
    import sys
    progs = ["def f(x):\n    return x + 2\n\nassert f(3) == 6", "raise ValueError('boom')"]
    df = spark.createDataFrame([(p,) for p in progs], "program string")
    got = {r.program: r.stderr for r in ex.run_programs(df, allow_exec=True).collect()}
    for p in progs:
        assert got[p] == subprocess.run([sys.executable, "-c", p], capture_output=True, text=True).stderr


def test_evaluation_plan_two_models(spark):
    """§3.2: two models, a held-out (setup harness) and a transfer task
    (check harness), scored in one job, then reported."""
    from rewardlake.plans.evaluation import eval_results, reports
    tasks = spark.createDataFrame(
        [("he/0", "def add(a, b):\n", ["def check(c):\n    assert c(1, 2) == 3"], "add")],
        "task_id string, prompt string, tests array<string>, entry_point string")
    good = "```python\ndef add(a, b):\n    return a + b\n```"
    bad = "def add(a, b):\n    return a - b"
    comps = spark.createDataFrame([("base", "transfer", "he/0", bad), ("tuned", "transfer", "he/0", good)],
                                  "label string, axis string, task_id string, completion string")
    res = eval_results(comps, tasks, style="check", fence="extract", allow_exec=True)
    got = {r.label: r.passed for r in res.collect()}
    assert got == {"base": False, "tuned": True}
    rep = reports(res, "tuned", "base")
    s = {r.label: r for r in rep["summary"].collect()}
    assert s["tuned"].delta_text == "+1.000" and s["base"].delta_text == "—"
    # older harness: prompt + body completion + test + check(entry)
    body = spark.createDataFrame([("v1", "transfer", "he/0", "    return a + b")],
                                 "label string, axis string, task_id string, completion string")
    # stripping the cleaned body also strips its indentation, as the older harness did
    assert eval_results(body, tasks, style="prompt_check", fence="strip", allow_exec=True).first().passed is False


def test_h7_program_runs_exactly_once_across_reuse(spark):
    """H-7: results are materialised once; reusing them (two actions, a
    join back) never re-runs the program."""
    import tempfile
    import os
    marker = os.path.join(tempfile.mkdtemp(prefix="rl-h7-"), "runs")
    prog = f"with open({marker!r}, 'a') as fh:\n    fh.write('x')"
    df = spark.createDataFrame([(prog,), (prog,), (prog,)], "program string")
    out = ex.run_programs(df, allow_exec=True)
    assert out.count() == 3 and out.filter("ok").count() == 3
    assert out.join(out.select("program_id").distinct(), "program_id").count() == 3
    assert open(marker).read() == "x"
