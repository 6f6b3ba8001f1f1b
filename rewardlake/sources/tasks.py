"""Task loaders: raw benchmark rows normalised to the task shape
(S-01 .. S-05). Inputs are DataFrames read by Spark (parquet/JSON)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.functions import text as tx


def mbpp_sanitized(raw: DataFrame) -> DataFrame:
    """S-01: ``task_id, prompt, test_list`` -> task shape; id prefixed
    'mbpp/', entry point from the asserts (P-04)."""
    return raw.select(
        F.concat(F.lit("mbpp/"), F.col("task_id").cast("string")).alias("task_id"),
        F.col("prompt"), F.col("test_list").alias("tests"),
        tx.entry_from_asserts("test_list").alias("entry_point"),
        F.lit("mbpp").alias("source"),
        F.create_map().cast("map<string,string>").alias("meta"))


def humaneval(raw: DataFrame) -> DataFrame:
    """S-02: ``task_id, prompt, test, entry_point`` -> task shape; the one
    test is ``test + '\\n\\ncheck(entry)'``; the prompt kept in meta."""
    return raw.select(
        "task_id", "prompt",
        F.array(F.concat(F.col("test"), F.lit("\n\ncheck("), F.col("entry_point"), F.lit(")")))
        .alias("tests"),
        "entry_point", F.lit("humaneval").alias("source"),
        F.create_map(F.lit("signature_prompt"), F.col("prompt")).alias("meta"))


def mbpp_full(raw: DataFrame) -> DataFrame:
    """S-03: ``task_id, text, test_list, test_setup_code`` -> rows with
    chat prompt (P-09), setup ('' when missing), function name (P-05)."""
    setup = (F.col("test_setup_code") if "test_setup_code" in raw.columns
             else F.lit(None).cast("string"))
    fn = tx.function_name("test_list")
    return raw.select(
        F.col("task_id"), tx.rft_messages("text", fn).alias("prompt"),
        F.col("test_list").alias("tests"), tx.setup_or_empty(setup).alias("test_setup"),
        F.coalesce(fn, F.lit("")).alias("function_name"), F.col("text"))


def mbpp_text_tests(raw: DataFrame) -> DataFrame:
    """S-04: {text, tests} projection of the sanitized rows."""
    return raw.select(F.col("prompt").alias("text"), F.col("test_list").alias("tests"))


def humaneval_rows(raw: DataFrame) -> DataFrame:
    """S-05: raw rows kept for evaluation."""
    return raw.select("task_id", "prompt", "test", "entry_point")
