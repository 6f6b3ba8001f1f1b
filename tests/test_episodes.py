"""The reference's environment protocol tests, re-expressed on turn rows
(W-07, W-08, P-07, P-08, F-07, F-09)."""
from pyspark.sql import functions as F

from rewardlake.functions import text as tx
from rewardlake.operators import episodes as ep
from rewardlake.streaming.episodes import episode_batch_twin

COLS = ("run_id string, step long, g int, turn int, reward double, solved boolean, action string, "
        "feedback string, max_turns int, entry_point string, prompt string")
FB = "Your code failed this test:\nassert f(3) == 6\nError:\nAssertionError"


def make(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_reset_prompt_names_function(spark):
    p = spark.range(1).select(tx.first_turn_prompt(F.lit("f"), F.lit("Return x doubled.")).alias("p")).first().p
    assert "`f`" in p


def test_single_turn_solve_is_done(spark):
    df = make(spark, [("r", 0, 0, 0, 1.0, True, "def f(x):\n    return x * 2", "", 3, "f", "Return x doubled."),
                      ("r", 0, 0, 1, 0.0, False, "later", "", 3, "f", "Return x doubled.")])
    out = episode_batch_twin(df).collect()
    assert len(out) == 1 and out[0].done and out[0].reward == 1.0 and out[0].next_prompt == ""


def test_multi_turn_revision_loop(spark):
    df = make(spark, [("r", 0, 0, 0, 0.5, False, "def f(x):\n    return x + 2", FB, 3, "f", "Return x doubled."),
                      ("r", 0, 0, 1, 1.0, True, "def f(x):\n    return x * 2", "", 3, "f", "Return x doubled.")])
    out = {r.turn: r for r in episode_batch_twin(df).collect()}
    assert not out[0].done and "previous attempt" in out[0].next_prompt.lower()
    assert "return x + 2" in out[0].next_prompt and FB in out[0].next_prompt
    assert out[1].done and out[1].solved
    prev = {r.turn: r for r in ep.previous_attempt(df).collect()}          # W-07
    assert prev[1].prev_action == "def f(x):\n    return x + 2" and prev[0].prev_action is None


def test_max_turns_terminates_unsolved(spark):
    df = make(spark, [("r", 0, 0, t, 0.0, False, "def f(x):\n    return 0", FB, 2, "f", "p") for t in range(3)])
    out = sorted(episode_batch_twin(df).collect(), key=lambda r: r.turn)
    assert [r.turn for r in out] == [0, 1] and out[-1].done and not out[-1].solved
    assert ep.still_active(ep.trim_episodes(df)).count() == 1             # F-07


def test_zero_test_task_repeats_first_prompt(spark):
    df = make(spark, [("r", 0, 0, 0, 0.0, False, "x", "", 3, "f", "p")])     # H-14: empty feedback
    nxt = episode_batch_twin(df).first().next_prompt
    assert nxt == spark.range(1).select(tx.first_turn_prompt(F.lit("f"), F.lit("p")).alias("x")).first().x


def test_turn_index(spark):
    df = spark.createDataFrame([("r", 0, 0, 30), ("r", 0, 0, 10), ("r", 0, 0, 20)],
                               "run_id string, step long, g int, arrival long")
    got = {r.arrival: r.turn for r in ep.turn_index(df, "arrival").collect()}
    assert got == {10: 0, 20: 1, 30: 2}
