"""X-01 / X-02: the keyed streaming operators equal their batch twins,
hold out-of-order turns, and restart from their checkpoint."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rewardlake.sources import fixtures as fx
from rewardlake.sources.config import run_config
from rewardlake.streaming import episodes as st

SCHEMA = ("run_id string, step long, g int, turn int, reward double, solved boolean, "
          "action string, feedback string, max_turns int, entry_point string, prompt string, ts timestamp")


def scored_turns(spark):
    return fx.scored_turns(spark, SF_SMALL, run_config(spark))


# Turns of the fixture spread over a month of event time and arrive out of
# order on purpose, so the watermark delay must cover that spread.
WIDE = "3650 days"


def run_stream(spark, src_dir, chk_dir, out_dir, op):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src_dir)
    q = (op(df, delay=WIDE).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", chk_dir).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.read.parquet(out_dir)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def turns(spark):
    return scored_turns(spark).cache()


def test_episode_stream_equals_batch_twin_out_of_order(spark, turns):
    base = tempfile.mkdtemp(prefix="rl-stream-")
    src = os.path.join(base, "src")
    # turns arrive in reverse order across files: later turns before earlier ones
    for t in (2, 1, 0):
        turns.filter(F.col("turn") == t).write.parquet(os.path.join(src, f"part_t{t}"))
    # the file source reads a flat folder: move the part files up
    flat = os.path.join(base, "flat")
    os.makedirs(flat)
    i = 0
    for t in (2, 1, 0):
        d = os.path.join(src, f"part_t{t}")
        for name in sorted(os.listdir(d)):
            if name.endswith(".parquet"):
                os.link(os.path.join(d, name), os.path.join(flat, f"{i:04d}_{name}"))
                i += 1
    out = run_stream(spark, flat, os.path.join(base, "chk"), os.path.join(base, "out"), st.episode_stream)
    twin = st.episode_batch_twin(turns)
    assert rows(out) == rows(twin)


def test_episode_stream_restarts_from_checkpoint(spark, turns):
    base = tempfile.mkdtemp(prefix="rl-restart-")
    src, chk, out = (os.path.join(base, x) for x in ("src", "chk", "out"))
    os.makedirs(src)
    turns.filter(F.col("turn") == 0).write.parquet(os.path.join(base, "t0"))
    turns.filter(F.col("turn") > 0).write.parquet(os.path.join(base, "t12"))
    for tag in ("t0", "t12"):
        d = os.path.join(base, tag)
        for name in os.listdir(d):
            if name.endswith(".parquet"):
                os.link(os.path.join(d, name), os.path.join(src, f"{tag}_{name}"))
        run_stream(spark, src, chk, out, st.episode_stream)   # second run resumes from state
    assert rows(spark.read.parquet(out)) == rows(st.episode_batch_twin(turns))


def test_group_barrier(spark):
    base = tempfile.mkdtemp(prefix="rl-barrier-")
    src = os.path.join(base, "src")
    fin = spark.createDataFrame(
        [("r", 1, 0, 0.2, 2, 1_700_000_000), ("r", 1, 1, 0.4, 2, 1_700_000_100),
         ("r", 2, 0, 1.0, 2, 1_700_000_200)],
        "run_id string, step long, g int, reward double, group_size int, sec long").select(
        "run_id", "step", "g", "reward", "group_size", F.timestamp_seconds("sec").alias("ts"))
    fin.write.parquet(src)
    df = spark.readStream.schema(fin.schema).parquet(src)
    q = (st.group_barrier(df).writeStream.format("memory").queryName("barrier_out")
         .option("checkpointLocation", os.path.join(base, "chk")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.step, r.g): r for r in spark.sql("SELECT * FROM barrier_out").collect()}
    assert set(got) == {(1, 0), (1, 1)}               # step 2 is still waiting for its second trajectory
    assert abs(got[(1, 0)].advantage + 0.70710678) < 1e-7 and got[(1, 0)].complete


def test_group_barrier_equals_twin_on_complete_groups(spark):
    """The stream emits exactly the twin's complete groups (others wait)."""
    base = tempfile.mkdtemp(prefix="rl-barrier2-")
    src = os.path.join(base, "src")
    rows = [("r", s, g, float((s * 7 + g * 3) % 4) / 3, 4, 1_700_000_000 + s) for s in range(6)
            for g in range(4 if s % 3 else 2)]
    fin = spark.createDataFrame(rows, "run_id string, step long, g int, reward double, group_size int, sec long").select(
        "run_id", "step", "g", "reward", "group_size", F.timestamp_seconds("sec").alias("ts"))
    fin.write.parquet(src)
    df = spark.readStream.schema(fin.schema).parquet(src)
    q = (st.group_barrier(df).writeStream.format("memory").queryName("barrier_out2")
         .option("checkpointLocation", os.path.join(base, "chk")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.step, r.g, round(r.advantage, 9)) for r in spark.sql("SELECT * FROM barrier_out2").collect())
    twin = st.group_barrier_twin(fin).filter("complete")
    want = sorted((r.step, r.g, round(r.advantage, 9)) for r in twin.collect())
    assert got == want and len(got) == 16


def test_stream_runner(spark, turns):
    from rewardlake.streaming.run import start_episode_stream
    base = tempfile.mkdtemp(prefix="rl-runner-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    turns.write.parquet(src)
    # a fixed name resumes from <spark.checkpoint.dir>/streams/<name>; a test
    # run must not resume an earlier one, so it names its own location
    q = start_episode_stream(spark, src, out, name="episodes_test", delay=WIDE,
                             checkpoint=os.path.join(base, "chk"))
    q.awaitTermination(300)
    assert rows(spark.read.parquet(out)) == rows(st.episode_batch_twin(turns))


def test_cluster_defaults_fill_only_unset(spark):
    from rewardlake.session import apply_cluster_defaults
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = apply_cluster_defaults(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert "spark.sql.shuffle.partitions" not in applied
    for k in applied:
        spark.conf.unset(k)


def test_episode_stream_ignores_turns_past_the_limit(spark):
    base = tempfile.mkdtemp(prefix="rl-limit-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    data = [("r", 0, 0, t, 0.0, False, "a", "fb", 2, "f", "p", 1_700_000_000 + t) for t in (5, 0, 1, 2)]
    df = spark.createDataFrame(data, SCHEMA.replace("ts timestamp", "sec long")).select(
        *[c.split()[0] for c in SCHEMA.split(", ")[:-1]], F.timestamp_seconds("sec").alias("ts"))
    df.write.parquet(src)
    got = run_stream(spark, src, os.path.join(base, "chk"), out, st.episode_stream)
    assert sorted(r.turn for r in got.collect()) == [0, 1]
    assert rows(got) == rows(st.episode_batch_twin(df))


def stream_rows(spark, frames, op, schema, base, zone="UTC", **kw):
    """Each frame arrives as one file, in order; the collected output of ``op``."""
    src = os.path.join(base, "src")
    os.makedirs(src)
    for i, f in enumerate(frames):
        d = os.path.join(base, f"f{i}")
        f.coalesce(1).write.parquet(d)
        name = next(n for n in os.listdir(d) if n.endswith(".parquet"))
        os.link(os.path.join(d, name), os.path.join(src, f"{i:03d}.parquet"))
        os.utime(os.path.join(src, f"{i:03d}.parquet"), (1_700_000_000 + i,) * 2)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (op(df, **kw).writeStream.format("parquet").option("path", os.path.join(base, "out"))
             .option("checkpointLocation", os.path.join(base, "chk")).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination(300)
        return spark.read.parquet(os.path.join(base, "out")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


FINISHED = "run_id string, step long, g int, reward double, group_size int, ts timestamp"


def finished(spark, rows):
    return spark.createDataFrame(rows, FINISHED.replace("ts timestamp", "sec long")).select(
        "run_id", "step", "g", "reward", "group_size", F.timestamp_seconds("sec").alias("ts"))


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_x02_zone_and_redelivery(spark, zone, tmp_path):
    """Rewards of one group within the limits give one complete group in any zone, and a
    redelivered trajectory does not open it again."""
    t0 = 1_700_000_000
    frames = [finished(spark, [("r", 1, 0, 0.2, 2, t0)]),
              finished(spark, [("x", 9, 0, 0.0, 2, t0 + 1800)]),
              finished(spark, [("r", 1, 1, 0.4, 2, t0 + 1900)]),
              finished(spark, [("r", 1, 1, 0.4, 2, t0 + 1950)]),
              finished(spark, [("x", 8, 0, 0.0, 2, t0 + 2000)])]
    got = stream_rows(spark, frames, st.group_barrier, FINISHED, str(tmp_path), zone)
    group = sorted((r.g, round(r.advantage, 3), r.complete) for r in got if r.step == 1)
    assert group == [(0, -0.707, True), (1, 0.707, True)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_x01_held_turns_are_not_lost(spark, zone, tmp_path):
    """Turns whose predecessor never comes are emitted as expired, also after an expiry."""
    t0 = 1_700_000_000

    def turn(t, g, sec):
        return ("r", 0, g, t, 0.0, False, "a", "fb", 3, "f", "p", sec)
    names = [c.split()[0] for c in SCHEMA.split(", ")[:-1]]
    frames = [spark.createDataFrame(r, SCHEMA.replace("ts timestamp", "sec long")).select(
        *names, F.timestamp_seconds("sec").alias("ts"))
        for r in ([turn(1, 0, t0), turn(0, 1, t0)], [turn(0, 7, t0 + 900)],
                  [turn(0, 8, t0 + 1800)], [turn(0, 9, t0 + 2700)])]
    got = stream_rows(spark, frames, st.episode_stream, SCHEMA, str(tmp_path), zone,
                      delay="1 minute", expire_ms=60_000)
    seen = {(r.g, r.turn, r.expired) for r in got}
    assert (0, 1, True) in seen and (1, 0, False) in seen and (0, 0, False) not in seen
