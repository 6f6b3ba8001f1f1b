"""X-01 into X-02 as one streaming query against the batch twin."""
import os
import random

import pytest
from pyspark.sql import functions as F

from rewardlake.streaming import episodes as st
from rewardlake.streaming.run import TURN_SCHEMA, start_training_stream
from test_streaming import stream_rows

SCHEMA = f"{TURN_SCHEMA}, reward_mode string, group_size int"
T0 = 1_700_000_000


def turn_rows(seed=0):
    """Two runs of three steps with three trajectories each; one group lacks a trajectory and one
    trajectory its second turn."""
    rng = random.Random(seed)
    out = []
    for run, mode in (("a", "final"), ("b", "best")):
        for step in range(3):
            for g in range(3):
                if (run, step, g) == ("a", 2, 1):
                    continue
                for t in range(3):
                    if (run, step, g, t) == ("b", 1, 2, 1):
                        continue
                    reward = rng.choice([0.0, 0.25, 0.5, 1.0])
                    out.append((run, step, g, t, reward, reward == 1.0, f"x{t}", "fb", 3, "f", "p",
                                T0 + 60 * step + t, mode, 3))
    return out


def frame(spark, data):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = SCHEMA.replace("ts timestamp", "sec long")
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("sec")).select(
        *names)


def rounded(found):
    return sorted((r.run_id, r.step, r.g, round(r.reward, 9), round(r.advantage, 9)) for r in found)


def complete_twin(spark, data):
    return rounded(st.training_twin(frame(spark, data)).where("complete").collect())


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_one_query_equals_both_twins_out_of_order(spark, zone, tmp_path):
    data = turn_rows()
    random.Random(5).shuffle(data)
    frames = [frame(spark, data[:20]), frame(spark, data[20:])]
    got = stream_rows(spark, frames, st.training_stream, SCHEMA, str(tmp_path), zone)
    want = complete_twin(spark, data)
    assert rounded(r for r in got if r.complete) == want and len(want) >= 9
    assert all(r.complete for r in got)


def test_restart_and_state_sizes(spark, tmp_path):
    data = turn_rows(3)
    src, out, chk = (str(tmp_path / d) for d in ("src", "out", "chk"))
    os.makedirs(src)
    late = [r for r in data if r[3] == 0]
    for i, part in enumerate(([r for r in data if r[3] > 0], late)):
        d = str(tmp_path / f"p{i}")
        frame(spark, part).coalesce(1).write.parquet(d)
        name = next(n for n in os.listdir(d) if n.endswith(".parquet"))
        os.link(os.path.join(d, name), os.path.join(src, f"{i}.parquet"))
        q = start_training_stream(spark, src, out, "training_test", chk)
        q.awaitTermination(300)
        sizes = st.state_sizes(q)
        assert len(sizes) == 2 and all(s["memory_bytes"] >= 0 for s in sizes)
        by_rows = sorted(s["rows"] for s in sizes)
        # first run: every turn is held for its predecessor and no group is open
        assert (by_rows[0] == 0 and by_rows[1] >= len(part)) if i == 0 else by_rows[0] > 0
        if i == 0:
            assert spark.read.schema(st.GROUP_OUT).parquet(out).count() == 0
    assert rounded(spark.read.parquet(out).where("complete").collect()) == complete_twin(spark, data)


def test_unfinished_groups_are_flushed_by_their_timer(spark, tmp_path):
    """A group that lacks a trajectory comes out incomplete once the watermark has passed it."""
    def turn(run, g, sec):
        return (run, 0, g, 0, 1.0 if g else 0.5, True, "x", "", 3, "f", "p", sec, "final", 3)
    frames = [frame(spark, r) for r in (
        [turn("a", 0, T0), turn("a", 1, T0)], [turn("z", 0, T0 + 900)], [turn("z", 1, T0 + 1800)],
        [turn("y", 1, T0 + 2700)])]
    got = stream_rows(spark, frames, st.training_stream, SCHEMA, str(tmp_path), delay="1 minute",
                      expire_ms=60_000)
    a = sorted((r.g, round(r.advantage, 3), r.complete) for r in got if r.run_id == "a")
    assert a == [(0, -0.707, False), (1, 0.707, False)]


def test_held_turns_are_map_entries(spark, tmp_path):
    """Nulls in a turn's texts and reward pass; a redelivered turn does not replace the first."""
    def turn(t, reward, sec, max_turns=3):
        return ("r", 0, 0, t, reward, False, None, None, max_turns, None, "p", sec, None, None)
    frames = [frame(spark, r) for r in (
        [turn(1, 0.25, T0)], [turn(1, 0.75, T0 + 1), turn(None, 1.0, T0 + 1), turn(2, None, T0 + 1)],
        [turn(0, 0.5, T0 + 2), turn(4, 1.0, T0 + 2, None)])]
    got = stream_rows(spark, frames, st.episode_stream, SCHEMA, str(tmp_path))
    assert [(r.turn, r.reward, r.done) for r in sorted(got, key=lambda r: r.turn)] == [
        (0, 0.5, False), (1, 0.25, False), (2, None, True)]
    assert not any(r.expired for r in got)




def test_state_has_one_row_per_group_not_per_trajectory(spark, tmp_path):
    """X-01 keeps its progress by group; trajectories of one group still expire one by one."""
    data = [("a", step, g, t, 0.5, False, "x", "fb", 2, "f", "p", T0 + t, "final", 4)
            for step in range(5) for g in range(4) for t in range(2)]
    src = str(tmp_path / "src")
    frame(spark, data).coalesce(1).write.parquet(src)
    q = start_training_stream(spark, src, str(tmp_path / "out"), "rows_test", str(tmp_path / "chk"))
    q.awaitTermination(300)
    assert [s["rows"] for s in st.state_sizes(q)] == [5, 5]
    got = spark.read.schema(st.GROUP_OUT).parquet(str(tmp_path / "out"))
    assert got.where("complete").count() == 20


def test_a_group_full_within_a_batch_writes_no_rewards(spark, tmp_path):
    """X-02 writes the rewards of groups that wait for more, and of a group that a batch fills only
    its mark."""
    data = [("a", step, g, 0, g / 4, True, "x", "", 1, "f", "p", T0, "final", 4)
            for step, n in ((0, 4), (1, 3)) for g in range(n)]
    src = str(tmp_path / "src")
    frame(spark, data).coalesce(1).write.parquet(src)
    q = start_training_stream(spark, src, str(tmp_path / "out"), "full_test", str(tmp_path / "chk"))
    q.awaitTermination(300)
    updated = [[o["numRowsUpdated"] for o in p["stateOperators"]] for p in q.recentProgress
               if p["numInputRows"]]
    # X-02 first: two marks and three waiting rewards; X-01: two groups
    assert updated == [[5, 2]]
    got = spark.read.schema(st.GROUP_OUT).parquet(str(tmp_path / "out")).collect()
    assert rounded(got) == complete_twin(spark, data)
