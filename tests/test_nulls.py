"""Null keys and order values, NaN rewards, empty completions, unknown config keys, storage."""
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rewardlake import session
from rewardlake.functions import tokens as tk
from rewardlake.operators import diversity, groups, metrics, objective, process, splits
from rewardlake.sources import config

ROWS = [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), (None, 1, "p"), (None, 2, "q")]
SCHEMA = "k string, pos long, v string"


def by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_w10_keyed_row_numbers_keep_null_keys(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = splits.keyed_row_numbers(df, ["k"], "pos", width=1)
    w = Window.partitionBy("k").orderBy("pos")
    assert by(got, "k", "pos", "rn") == by(
        df.withColumn("rn", F.row_number().over(w) - 1), "k", "pos", "rn")


def test_w07_keyed_lag_keeps_null_keys(spark):
    df = spark.createDataFrame([r for r in ROWS if r[1]], SCHEMA)
    got = splits.keyed_lag(df, ["k"], "pos", ["v"], width=1)
    w = Window.partitionBy("k").orderBy("pos")
    assert by(got, "k", "pos", "prev_v") == by(
        df.withColumn("prev_v", F.lag("v").over(w)), "k", "pos", "prev_v")


def test_w04_previous_valid_keeps_null_keys(spark):
    df = spark.createDataFrame([(k, p, v, True) for k, p, v in ROWS if p], SCHEMA + ", ok boolean")
    got = process.previous_valid(df, ["k"], "pos", "ok", "v", width=1)
    assert by(got, "k", "pos", "prev_code", "is_final") == by(spark.createDataFrame(
        [("a", 1, None, False), ("a", 2, "x", True), (None, 1, None, False), (None, 2, "p", True)],
        "k string, pos long, prev_code string, is_final boolean"), "k", "pos", "prev_code", "is_final")


def test_t02_row_numbers_keep_null_order(spark):
    df = spark.createDataFrame([(None,), (3,), (7,)], "id long")
    assert splits.source_row_numbers(df, "id").count() == 3


def test_t04_take(spark):
    df = splits.source_row_numbers(spark.range(50), "id")
    assert sorted(r.id for r in splits.take(df, 5).collect()) == [0, 1, 2, 3, 4]


def test_f02_nan_group_gets_zero(spark):
    df = spark.createDataFrame([("r", 1, float("nan")), ("r", 1, 1.0), ("r", 2, 0.0), ("r", 2, 1.0)],
                               "run_id string, step long, reward double")
    got = {(r.step, str(r.reward)): r.advantage for r in groups.advantage(df).collect()}
    assert got[(1, "nan")] == 0.0 and got[(1, "1.0")] == 0.0 and got[(2, "1.0")] > 0.7


def test_m12_empty_completion_has_kl_zero(spark):
    df = spark.createDataFrame([([], [], []), ([-1.0], [-1.0], [-2.0])],
                               "lp array<double>, old_lp array<double>, ref_lp array<double>")
    rows = objective.sequence_terms(df.withColumn("adv", F.lit(1.0)), "adv", 0.2, 0.2).collect()
    assert rows[0].kl == 0.0 and rows[0].ratio == 1.0 and rows[1].kl > 0
    assert df.select(tk.array_mean("lp").alias("m")).first().m == 0.0


def test_a10_null_group(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d"), ("g", "a"), ("h", None)],
                               "grp string, text string")
    got = {r.grp: (r.n_distinct, r.n_total, r.diversity)
           for r in diversity.ngram_diversity(df).collect()}
    assert got == {None: (2, 3, 2 / 3), "g": (0, 0, 1.0), "h": (0, 0, 1.0)}


def test_j07_eval_points_follow_their_step(spark):
    dense = spark.createDataFrame([("r", s, float(s)) for s in (1, 2, 3)],
                                  "run_id string, step long, loss double")
    pts = spark.createDataFrame([("r", 1, 0.5), ("r", 3, 0.9)],
                                "run_id string, step long, acc double")
    base = spark.createDataFrame([("r", 0, 0.1)], "run_id string, step long, acc double")
    got = by(metrics.with_eval_points(dense, pts, base), "step", "loss", "acc")
    assert got == [(0, None, 0.1), (1, 1.0, None), (2, 2.0, 0.5), (3, 3.0, None)]


def test_s06_unknown_keys_pass_through(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(
        {"run_id": "a", "kl_coeff": 0.5, "note": "mine", "seed": 7}) + "\n")
    r = config.read_run_config(spark, str(tmp_path)).first()
    assert (r.kl_coeff, r.note, r.seed, r.group_size) == (0.5, "mine", 7, 4)


def test_storage_needs_a_shared_folder_off_local():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())
