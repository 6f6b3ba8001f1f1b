"""Step series: stored by upsert, smoothed in blocks, logged as text, diversity sketches."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rewardlake.operators import diversity as dv
from rewardlake.operators import metrics as mt
from rewardlake.sources import config


def test_blocks_smooth_like_one_window(spark):
    rng = random.Random(1)
    rows = [(run, 3 * i, rng.random()) for run, n in (("long", 700), ("mid", 16), ("short", 15))
            for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, step long, v double")
    want = {(r.run_id, r.step): r.v_smooth for r in mt.smooth(df, "v").collect()}
    for block in (15, 64, 100_000):
        got = {(r.run_id, r.step): r.v_smooth for r in mt.smooth_blocks(df, "v", block=block).collect()}
        assert got.keys() == want.keys() and len(want) == 686 + 2
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        mt.smooth_blocks(df, "v", block=14)


def test_upsert_leaves_one_copy(spark, tmp_path):
    path, schema = str(tmp_path / "series"), "run_id string, step long, reward double"
    df = lambda rows: spark.createDataFrame(rows, schema)           # noqa: E731
    read = lambda kind: sorted(map(tuple, mt.read_series(spark, path, kind, schema).collect()))
    first = [("a", s, 0.0) for s in range(25)] + [("b", 3, 0.5)]
    for _ in range(2):
        mt.upsert_series(df(first), path, steps=10)
    mt.upsert_series(df([("a", 50, 0.7)]), path, "eval", steps=10)
    assert read("dense") == sorted(first) and read("eval") == [("a", 50, 0.7)]
    before = os.path.getmtime(str(tmp_path / "series/kind=dense/run_id=b/steps=0"))
    mt.upsert_series(df([("a", 7, 1.0), ("a", 25, 2.0)]), path, steps=10)
    want = [r for r in first if r[:2] != ("a", 7)] + [("a", 7, 1.0), ("a", 25, 2.0)]
    assert read("dense") == sorted(want) and read("eval") == [("a", 50, 0.7)]
    # partitions without new rows are not written
    assert os.path.getmtime(str(tmp_path / "series/kind=dense/run_id=b/steps=0")) == before


def test_text_log_golden(spark, tmp_path):
    heads = spark.createDataFrame([(10, 5, 0.25, 0.5), (9, 5, 1.0, 2.0), (10, 6, -0.125, 0.0)],
                                  "epoch int, step int, loss double, mean_reward double")
    details = spark.createDataFrame(
        [(e, s, b, t, [1, 2 + b], [3 + t, 4], [-0.5, 0.25], 0.75, -1.0)
         for e, s in ((10, 5), (9, 5), (10, 6)) for b in (1, 0) for t in (1, 0)],
        "epoch int, step int, batch int, trial int, prompt array<int>, response array<int>, "
        "log_probs array<double>, reward double, delta double")
    path = str(tmp_path / "log")
    mt.write_text_log(mt.text_lines(heads, details), path, files=3)
    got = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path))
                  if f.endswith(".txt"))
    assert got == """epoch = 9, step = 5, loss = 1.000, reward = 2.000
epoch = 10, step = 5, loss = 0.250, reward = 0.500
  prompt = [1, 2]
  response = [3, 4], log_probs = [-0.500, 0.250], reward = 0.750, delta = -1.000
  response = [4, 4], log_probs = [-0.500, 0.250], reward = 0.750, delta = -1.000
  prompt = [1, 3]
  response = [3, 4], log_probs = [-0.500, 0.250], reward = 0.750, delta = -1.000
  response = [4, 4], log_probs = [-0.500, 0.250], reward = 0.750, delta = -1.000
epoch = 10, step = 6, loss = -0.125, reward = 0.000
"""


def test_sketches_unite_and_keep_their_bound(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [("hot" if i % 2 else f"g{i % 5}", i % 7, " ".join(rng.choice(words) for _ in range(60)))
            for i in range(900)] + [("short", 0, "one two"), (None, 0, "a b c d e"), ("none", 0, None)]
    df = spark.createDataFrame(rows, "grp string, step int, text string")
    steps = dv.ngram_sketch(df, ("grp", "step"))
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "hll_sketch_agg" in plan.lower()
    # the n-grams do not leave the task that makes them: one exchange, of sketches
    physical = steps._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(grp") == 1 and "gram#" not in "".join(
        line for line in physical.splitlines() if "Exchange" in line)
    exact = {r.grp: r for r in dv.ngram_diversity(df.drop("step")).collect()}
    for merged in (dv.merged_sketches(steps), dv.ngram_sketch(df)):
        got = {r.grp: r for r in dv.sketch_diversity(merged).collect()}
        assert got.keys() == exact.keys()
        for g, r in got.items():
            assert r.n_total == exact[g].n_total
            assert abs(r.n_distinct - exact[g].n_distinct) <= dv.SKETCH_BOUND * exact[g].n_distinct
    assert got["short"].diversity == 1.0 and got[None].n_distinct == 2


def test_unknown_configuration_keys_pass_through(spark, tmp_path):
    rows = [{"run_id": "x", "kl_coeff": 0.5, "group_size": 8, "notes": {"who": "me"}, "seed": 7},
            {"run_id": "y", "group_size": "many", "tags": ["a", "b"]}]
    (tmp_path / "cfg.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    df = config.read_declared_config(spark, str(tmp_path))
    assert dict(df.dtypes)["given"] == "variant" and dict(df.dtypes)["group_size"] == "int"
    got = {r.run_id: r for r in df.select(
        "run_id", "kl_coeff", "group_size", config.given_key("seed", "int").alias("seed"),
        F.to_json("given").alias("given")).collect()}
    assert (got["x"].kl_coeff, got["x"].group_size, got["x"].seed) == (0.5, 8, 7)
    assert got["y"].group_size == config.DEFAULTS["group_size"] and got["y"].seed is None
    assert json.loads(got["x"].given) == rows[0] and json.loads(got["y"].given)["tags"] == ["a", "b"]
