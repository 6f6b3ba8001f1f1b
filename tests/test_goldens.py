"""Goldens worked out by hand from the reference's arithmetic."""
import math

from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.operators import groups as gr
from rewardlake.operators import process as pr
from rewardlake.operators.execution import syntax_check


def test_sort_rewards(spark):
    df = spark.createDataFrame([([3, 1, 0, 2], [0, 1, 2, 3]), ([3, 1, 0, 2], [0, 3, 1, 2])],
                               "prompt array<int>, response array<int>")
    got = df.select(rw.sort_distance("prompt", "response").alias("d"),
                    rw.sort_inclusion_ordering("prompt", "response").alias("i")).collect()
    assert (got[0].d, got[0].i) == (4.0, 7.0)
    assert got[1].i == 6.0


def test_sort_inclusion_duplicates_and_length_one(spark):
    df = spark.createDataFrame([([1, 1, 2], [1, 2, 2]), ([5], [5])], "prompt array<int>, response array<int>")
    got = [r.i for r in df.select(rw.sort_inclusion_ordering("prompt", "response").alias("i")).collect()]
    # duplicates in the prompt each count; a single item has no adjacent pair
    assert got == [3.0 + 2.0, 1.0]


def test_group_advantage(spark):
    rows = [("r", 1, 0, 0.2), ("r", 1, 1, 0.4), ("r", 2, 0, 0.4), ("r", 2, 1, 0.4), ("r", 3, 0, 0.7)]
    df = spark.createDataFrame(rows, "run_id string, step long, g int, reward double")
    got = {(r.step, r.g): r.advantage for r in gr.advantage(df).collect()}
    assert math.isclose(got[(1, 0)], -0.70710678, abs_tol=1e-7)
    assert math.isclose(got[(1, 1)], 0.70710678, abs_tol=1e-7)
    assert got[(2, 0)] == 0.0 and got[(2, 1)] == 0.0
    assert got[(3, 0)] == 0.0          # single sample: NULL std fails the test (H-2)


def test_process_rewards(spark):
    codes = ["import os", "def f(x) return x", "import os\ndef f(x):\n    return x"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "traj_id long, pos int, code string")
    out = pr.step_rewards(syntax_check(df, "code")).orderBy("pos").collect()
    assert [round(r.reward, 6) for r in out] == [0.8, -0.1, 1.8]


def test_process_rewards_edges(spark):
    # invalid first, unchanged code, single commit
    rows = [(1, 0, "def f(x) return x"), (1, 1, "import os"), (1, 2, "import os"),
            (2, 0, "import os\ndef f(x):\n    return x")]
    df = spark.createDataFrame(rows, "traj_id long, pos int, code string")
    out = {(r.traj_id, r.pos): round(r.reward, 6) for r in pr.step_rewards(syntax_check(df, "code")).collect()}
    assert out[(1, 0)] == -0.1
    assert out[(1, 1)] == 0.8            # first valid state: diff + new test
    assert out[(1, 2)] == 0.1            # same code, no new test, final but not all required
    assert out[(2, 0)] == 0.1 + 0.2 + 0.5 + 1.0


def test_deltas_modes(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, 3.0)], "prompt_id int, reward double")
    for mode, want in [("rewards", [1, 3, 3]), ("centered_rewards", [-4 / 3, 2 / 3, 2 / 3]),
                       ("max_rewards", [0, 3, 3])]:
        got = sorted(r.delta for r in gr.deltas(df, mode).collect())
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, sorted(want)))
    got = sorted(r.delta for r in gr.deltas(df, "normalized_rewards").collect())
    std = math.sqrt(((1 - 7 / 3) ** 2 + 2 * (3 - 7 / 3) ** 2) / 2)
    assert math.isclose(got[0], (1 - 7 / 3) / (std + 1e-5), rel_tol=1e-9)
    try:
        gr.deltas(df, "bogus")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_rubric_duplicate_names(spark):
    comps = [rw.Component("tests", lambda: F.lit(1.0), 1.0), rw.Component("tests", lambda: F.lit(0.0), 1.0)]
    r = spark.range(1).select(rw.rubric_reward(comps).alias("r"), rw.rubric_breakdown(comps).alias("b")).first()
    assert r.r == 0.5                      # both count in the sum
    assert r.b == {"tests": 0.0}           # the last one wins in the breakdown (H-6)
    zero = [rw.Component("x", lambda: F.lit(1.0), 0.0)]
    assert spark.range(1).select(rw.rubric_reward(zero).alias("r")).first().r == 0.0


def test_bucketed_scans_equal_plain_windows(spark):
    """The hot-key-safe forms give what a single window per key gives."""
    import random
    from pyspark.sql import Window
    from rewardlake.operators.process import previous_valid
    from rewardlake.operators.splits import keyed_row_numbers
    random.seed(1)
    rows = [(t, p, random.random() < 0.6, f"c{t}_{p}") for t in range(5) for p in range(random.randint(1, 40))]
    df = spark.createDataFrame(rows, "traj_id long, pos int, ok boolean, code string")
    a = previous_valid(df, ["traj_id"], "pos", "ok", "code", width=3).select("traj_id", "pos", "prev_code", "is_final")
    w = Window.partitionBy("traj_id").orderBy("pos")
    b = df.select("traj_id", "pos",
                  F.last(F.when(F.col("ok"), F.col("code")), True).over(
                      w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_code"),
                  (F.col("pos") == F.max("pos").over(Window.partitionBy("traj_id"))).alias("is_final"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    ev = spark.createDataFrame([(i % 3, i) for i in range(300)], "user_id long, event_id long")
    x = keyed_row_numbers(ev, ["user_id"], "event_id", width=7).select("user_id", "event_id", "rn")
    y = ev.select("user_id", "event_id",
                  (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("rn"))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))


def test_bounded_broadcast_and_spread(spark):
    from rewardlake.operators.joins import bounded_broadcast
    from rewardlake.operators.layout import spread
    small = spark.range(5)
    assert bounded_broadcast(small, max_bytes=1) is small           # over the bound: no hint
    hinted = bounded_broadcast(small, max_bytes=1 << 20)
    assert hinted is not small and "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    one = spark.range(100).coalesce(1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(6)
    assert spread(many, 4) is many


def test_bucketed_turn_index_and_lag_equal_windows(spark):
    import random
    from rewardlake.operators import episodes as ep
    random.seed(3)
    rows = [("r", 0, c, t * 3 + random.randint(0, 2), f"a{c}_{t}", f"f{c}_{t}")
            for c in range(4) for t in range(random.randint(1, 30))]
    df = spark.createDataFrame(rows, "run_id string, step long, g int, arrival long, action string, feedback string")
    plain = ep.previous_attempt(ep.turn_index(df, "arrival"))
    bucketed = ep.previous_attempt(ep.turn_index(df, "arrival", width=4), width=3)
    cols = ["g", "arrival", "turn", "prev_action", "prev_feedback"]
    assert sorted(map(tuple, plain.select(*cols).collect())) == sorted(map(tuple, bucketed.select(*cols).collect()))
