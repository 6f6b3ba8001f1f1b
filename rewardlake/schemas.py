"""Declared schemas. Library code never infers a schema."""
from __future__ import annotations

from pyspark.sql import types as T

TASKS = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("tests", T.ArrayType(T.StringType())),
    T.StructField("test_setup", T.StringType()),
    T.StructField("entry_point", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

COMPLETIONS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("g", T.IntegerType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("comp_ids", T.ArrayType(T.IntegerType())),
    T.StructField("finish_reason", T.StringType()),
])

COMMITS = T.StructType([
    T.StructField("traj_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("code", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

RUN_CONFIG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("variant_fixes", T.BooleanType()),
    T.StructField("group_size", T.IntegerType()),
    T.StructField("max_turns", T.IntegerType()),
    T.StructField("epsilon_low", T.DoubleType()),
    T.StructField("epsilon_high", T.DoubleType()),
    T.StructField("kl_coeff", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("temp_stage1", T.DoubleType()),
    T.StructField("temp_stage2", T.DoubleType()),
    T.StructField("temp_switch_step", T.IntegerType()),
    T.StructField("mask_prob", T.DoubleType()),
    T.StructField("repeat_check_len", T.IntegerType()),
    T.StructField("reward_mode", T.StringType()),
    T.StructField("scale_rewards", T.BooleanType()),
    T.StructField("eval_every", T.IntegerType()),
])

PASS_BLOCK = T.StructType([
    T.StructField("pass@1", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("passed", T.ArrayType(T.StringType())),
])

RESULTS_LINE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("mbpp_heldout", PASS_BLOCK),
    T.StructField("humaneval_transfer", PASS_BLOCK),
])

STEP_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("reward_std", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("kl", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("solve_rate", T.DoubleType()),
    T.StructField("mean_turns", T.DoubleType()),
    T.StructField("diversity", T.DoubleType()),
])
