"""Semantic hazards H-1 .. H-18."""
import math

import pytest

from pyspark.sql import functions as F

from rewardlake.functions import text as tx
from rewardlake.functions import tokens as tk


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_h1_strip_all_whitespace(spark):
    s = "\n\t  def f():\r\n   pass \x0b\x1c "
    assert one(spark, tx.py_strip(F.lit(s))) == s.strip()


def test_h3_nan_propagates(spark):
    nan = F.lit(float("nan"))
    assert math.isnan(one(spark, tk.clip(nan, 0.2, 0.2)))
    assert math.isnan(one(spark, tk.surrogate(nan, F.lit(1.0), 0.2, 0.2)))


def test_h4_short_texts_give_no_ngrams(spark):
    assert one(spark, tk.ngrams(tx.py_split(F.lit("  a b  c ")), 4)) == []
    assert one(spark, tk.ngrams(tx.py_split(F.lit("a b c d e")), 4)) == ["a b c d", "b c d e"]
    assert one(spark, tx.py_split(F.lit("  a  b "))) == ["a", "b"]


def test_h8_ansi_safe_accessors(spark):
    assert one(spark, tx.entry_from_asserts(F.array().cast("array<string>"))) == ""
    assert one(spark, tx.function_name(F.array().cast("array<string>"))) is None
    assert one(spark, tx.messages_to_text(F.array().cast("array<struct<role:string,content:string>>"))) == "[]"


def test_h9_builtin_name_is_captured(spark):
    tests = F.array(F.lit("assert set(f(1)) == {1}"), F.lit("assert f(2) == 2"))
    assert one(spark, tx.entry_from_asserts(tests)) == "set"
    assert one(spark, tx.entry_from_asserts(F.array(F.lit("assert not (f(1))")))) == "not"
    assert one(spark, tx.entry_from_asserts(F.array(F.lit("x = 1")))) == ""


def test_h10_unicode_names(spark):
    assert one(spark, tx.entry_from_asserts(F.array(F.lit("assert größe(1) == 1")))) == "größe"
    assert one(spark, tx.function_name(F.array(F.lit("assert größe(1) == 1")))) == "größe"


def test_p01_p02_fences(spark):
    raw = "Sure:\n```python\ndef f(x):\n    return x\n```\nThanks ```"
    assert one(spark, tx.extract_code(F.lit(raw))) == "def f(x):\n    return x"
    assert one(spark, tx.strip_fences(F.lit(raw))) == "Sure:\ndef f(x):\n    return x\nThanks"
    unclosed = "```python\ndef f(x): return x"
    assert one(spark, tx.extract_code(F.lit(unclosed))) == unclosed
    assert one(spark, tx.strip_fences(F.lit(unclosed))) == "def f(x): return x"
    two = "```python\na = 1\n```\n```python\nb = 2\n```"
    assert one(spark, tx.extract_code(F.lit(two))) == "a = 1"


def test_p03_messages(spark):
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content")))
    assert one(spark, tx.messages_to_text(msgs)) == ""


def test_p14_feedback(spark):
    fb = one(spark, tx.failure_feedback(F.lit(True), F.lit("assert f(3) == 6"), F.lit("  \n")))
    assert fb == "Your code failed this test:\nassert f(3) == 6\nError:\nassertion failed"
    long_err = "x" * 500 + "END"
    fb = one(spark, tx.failure_feedback(F.lit(True), F.lit("t"), F.lit(long_err)))
    assert fb.endswith("END") and len(fb.split("Error:\n")[1]) == 400
    assert "SyntaxError" in one(spark, tx.failure_feedback(F.lit(False), F.lit(None), F.lit(None)))
    assert one(spark, tx.failure_feedback(F.lit(True), F.lit(None).cast("string"), F.lit(None))) == ""


def test_p16_p17_p18(spark):
    assert one(spark, tx.preview(F.lit("a\n\n b"), 200)) == "  a\n\n   b"
    assert one(spark, tx.signed_delta(F.lit(0.01234), F.lit(False))) == "+0.012"
    assert one(spark, tx.signed_delta(F.lit(0.5), F.lit(True))) == "—"
    assert one(spark, tx.label_or_model(F.lit(""), F.lit("m"))) == "m"


def test_m_math(spark):
    assert one(spark, tk.mean_logprob(F.array().cast("array<double>"))) == -10.0
    assert one(spark, tk.is_repetitive(F.array(*[F.lit(x) for x in [1, 2, 1, 2]]), 2)) is True
    assert one(spark, tk.is_repetitive(F.array(*[F.lit(x) for x in [1, 2, 1]]), 2)) is False
    ids = F.array(*[F.lit(x) for x in [5, 7, 2, 7]])
    assert one(spark, tk.cut_at_eos(ids, 7)) == [5, 7]
    assert one(spark, tk.truncated_no_eos(F.array(F.lit(1), F.lit(2)), 9, 2)) is True
    lsm = one(spark, tk.log_softmax_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(2)))
    assert math.isclose(lsm, 3 - math.log(math.exp(1) + math.exp(2) + math.exp(3)), rel_tol=1e-12)
    assert one(spark, tk.temperature(F.lit(150), F.lit(True), F.lit(0.8), F.lit(0.7), F.lit(1.0), F.lit(100))) == 1.0
    assert one(spark, tk.temperature(F.lit(150), F.lit(False), F.lit(0.8), F.lit(0.7), F.lit(1.0), F.lit(100))) == 0.8
    assert one(spark, tk.snapshot_epoch(F.lit(27), 10)) == 20
    assert one(spark, tk.truncated_reason(F.lit("length"))) is True
    assert one(spark, tk.truncated_reason(F.lit("stop"))) is False


def test_filter_not_pushed_below_row_number(spark):
    """F-01 after T-02: the name filter must not shrink the split before numbering."""
    from rewardlake.operators import splits as sp
    df = spark.createDataFrame([(i, "" if i % 2 else "f") for i in range(10)], "k long, function_name string")
    rows = sp.source_row_numbers(df, "k")
    out = sp.named_only(sp.range_split(rows, 4, 2)).collect()
    assert sorted(r.k for r in out) == [0, 2, 4]


def test_prompt_and_program_texts(spark):
    """Exact texts of the prompt and program builders (P-07 .. P-13)."""
    row = spark.range(1).select(
        tx.first_turn_prompt(F.lit("f"), F.lit("Do.")).alias("p07"),
        tx.revision_prompt(F.lit("f"), F.lit("Do."), F.lit("A"), F.lit("FB")).alias("p08"),
        tx.rft_messages(F.lit("  Do. "), F.lit("f")).alias("p09"),
        tx.v1_messages(F.lit("Do."), F.lit("")).alias("p10"),
        tx.benchmark_messages(F.lit("def g():"), F.lit("g"), "named").alias("p11"),
        tx.turn_messages(F.lit("X")).alias("p12"),
        tx.test_program("env", F.lit("C"), F.lit("T")).alias("env"),
        tx.test_program("setup", F.lit("C"), F.lit("T"), setup=F.lit("S")).alias("setup"),
        tx.test_program("check", F.lit("C"), F.lit("T"), entry_point=F.lit("e")).alias("check"),
        tx.test_program("prompt_check", F.lit("C"), F.lit("T"), entry_point=F.lit("e"),
                        prompt=F.lit("P")).alias("pc")).first()
    assert row.p07 == "Solve this Python task. The function must be named `f`.\n\nDo."
    assert row.p08 == (row.p07 + "\n\nYour previous attempt was incorrect:\n\nA\n\nFB\n\n"
                       "Return a corrected, complete function.")
    assert row.p09[0]["role"] == "system" and row.p09[1]["content"] == "Do.\n\nThe function must be named `f`."
    assert row.p10[0]["content"] == tx.V1_SYSTEM_PROMPT and row.p10[1]["content"] == "Solve this Python task:\n\nDo."
    assert row.p11[1]["content"] == "def g():\n\nThe function must be named `g`."
    assert row.p12[0]["content"] == tx.ENV_SYSTEM_PROMPT and row.p12[1]["content"] == "X"
    assert (row.env, row.setup, row.check, row.pc) == ("C\n\nT", "S\nC\nT\n", "C\nT\ncheck(e)\n", "P\nC\n\nT\n\ncheck(e)")
    with pytest.raises(ValueError):
        tx.test_program("bogus", F.lit("C"), F.lit("T"))


def test_h11_length_counts_code_points(spark):
    s = "a\U0001F600é"
    assert one(spark, F.length(F.lit(s))) == len(s) == 3
