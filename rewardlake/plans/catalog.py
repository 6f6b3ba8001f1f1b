"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Names are ``<operator id>_<word>``. Each query reads the given tables
through ``sources.fixtures`` and runs the library's operators on them.
Floating columns are rounded to six places (H-18).
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.functions import text as tx
from rewardlake.functions import tokens as tk
from rewardlake.operators import diversity as dv
from rewardlake.operators import episodes as ep
from rewardlake.operators import evaluation as ev
from rewardlake.operators import execution as ex
from rewardlake.operators import groups as gr
from rewardlake.operators import metrics as mt
from rewardlake.operators import objective as ob
from rewardlake.operators import passed_sets as pset
from rewardlake.operators import positions as ps
from rewardlake.operators import process as pr
from rewardlake.operators import splits as sp
from rewardlake.operators import verdicts as vd
from rewardlake.operators.joins import join_dim
from rewardlake.operators.layout import spread
from rewardlake.plans import toy, training
from rewardlake.session import cut_lineage, ensure_checkpoint_dir
from rewardlake.sources import fixtures as fx
from rewardlake.sources import results as rs
from rewardlake.sources import tasks as tl
from rewardlake.sources.config import run_config
from rewardlake.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


@query("w01_advantage")
def w01_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-08 -> A-02..A-06 -> W-01/W-03 on the rollout turns."""
    traj = training.scored_trajectories(fx.rollouts(spark, sf_dir), run_config(spark))
    return traj.select("run_id", "step", "g", "n_turns", r6("final_reward"), r6("best_reward"),
                       "solved", r6("reward"), r6("advantage"))


@query("w08_episodes")
def w08_episodes(spark, sf_dir):
    """W-08 episode trim with the done flag, F-07 live flag."""
    cfg = run_config(spark).select("run_id", "max_turns")
    t = ep.trim_episodes(ep.by_group(join_dim(fx.rollouts(spark, sf_dir), cfg, "run_id")))
    return t.select("run_id", "step", "g", "turn", "done", (~F.col("done")).alias("active"))


@query("a16_step_metrics")
def a16_step_metrics(spark, sf_dir):
    """A-07, A-08, A-09, A-16, M-15, J-04, J-09 per (run, step)."""
    m = training.step_metrics(fx.rollouts(spark, sf_dir), run_config(spark))
    return m.select("run_id", "step", r6("reward_mean"), r6("reward_std"), r6("solve_rate"),
                    r6("mean_turns"), r6("pg_loss"), r6("temperature"))


@query("a16_full_step")
def a16_full_step(spark, sf_dir):
    """The composed training step: J-02 inputs, W-08, A-02..A-06, W-01, F-03,
    M-06..M-13, F-08, M-15, M-17 and all ten fields of A-16."""
    m = training.full_step_metrics(fx.turn_logs(spark, sf_dir), run_config(spark))
    return m.select("run_id", "step", *[r6(c) for c in (
        "reward_mean", "reward_std", "solve_rate", "mean_turns", "pg_loss", "kl", "entropy",
        "loss", "temperature", "grad_norm")])


def _verdict_frame(spark, sf_dir):
    return vd.verdicts(fx.completions_from_orders(spark, sf_dir), fx.test_results(spark, sf_dir))


@query("a01_verdicts")
def a01_verdicts(spark, sf_dir):
    """A-01 with P-15 syntax rule, R-01/R-02 and rubric rewards R-04..R-06, F-05."""
    v = _verdict_frame(spark, sf_dir)
    v = vd.score(v, rw.default_components(), "reward_default")
    v = vd.score(v, rw.dense_components(has_fence_col="has_fence"), "reward_dense")
    return v.select("completion_id", "syntax_ok", "n_passed", "n_total", r6("fraction_passed"),
                    "all_passed", r6("reward_default"), r6("reward_dense"))


@query("f05_solved")
def f05_solved(spark, sf_dir):
    """F-05 solved filter over verdicts."""
    return ev.solved(_verdict_frame(spark, sf_dir), "all_passed").select("completion_id", "n_total")


@query("p14_feedback")
def p14_feedback(spark, sf_dir):
    """P-14, P-15, T-05: error of each test and the feedback of each
    completion, from logged test rows with their error output."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
                    "l_partkey")
    comps = fx.completions_from_orders(spark, sf_dir)
    rows = li.select(F.col("l_orderkey").alias("completion_id"),
                     (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("test_idx"),
                     F.concat(F.lit("assert f("), F.col("l_linenumber").cast("string"), F.lit(")"))
                     .alias("test"), (F.col("l_quantity") > 25).alias("passed"),
                     F.when(F.col("l_quantity") % 3 != 0, F.concat(
                         F.lit("  AssertionError: part "), F.col("l_partkey").cast("string"),
                         F.lit("\n"))).alias("stderr"))
    per = rows.join(comps.select("completion_id", "syntax_ok"), "completion_id")
    per = per.select("completion_id", "test_idx", "test", "passed",
                     tx.test_error("passed", "stderr", "syntax_ok").alias("error"))
    v = vd.with_feedback(vd.verdicts(comps, per))
    return v.select("completion_id", "n_passed", "n_total",
                    F.col("first_fail.test").alias("first_test"),
                    F.col("first_fail.error").alias("first_error"), "feedback")


def _tasks(spark, sf_dir):
    return fx.tasks(spark, sf_dir)


@query("s01_tasks")
def s01_tasks(spark, sf_dir):
    """S-01, S-02, S-04, P-04, P-05, P-07, P-12, P-13 (four program styles)."""
    raw = _tasks(spark, sf_dir)
    t = tl.mbpp_sanitized(raw)
    he = tl.humaneval(raw.select(F.col("task_id").cast("string").alias("task_id"), "prompt",
                                 F.col("test_list")[0].alias("test"),
                                 tx.entry_from_asserts("test_list").alias("entry_point")))
    t = t.join(he.select(F.regexp_replace("task_id", "^", "mbpp/").alias("task_id"),
                         F.col("tests")[0].alias("he_test")), "task_id")
    first = F.col("tests")[0]
    return t.select(
        "task_id", "entry_point",
        tx.function_name("tests").alias("function_name"),
        F.size("tests").alias("n_tests"),
        F.md5(tx.first_turn_prompt("entry_point", "prompt")).alias("prompt_md5"),
        F.md5(tx.turn_messages(tx.first_turn_prompt("entry_point", "prompt"))[1]["content"])
        .alias("user_md5"),
        F.md5(tx.test_program("env", F.lit("pass"), first)).alias("prog_env_md5"),
        F.md5(tx.test_program("setup", F.lit("pass"), first, setup=F.lit(None))).alias("prog_setup_md5"),
        F.md5(tx.test_program("check", F.lit("pass"), F.col("he_test"), entry_point="entry_point"))
        .alias("prog_check_md5"),
        F.md5(tx.test_program("prompt_check", F.lit("pass"), F.col("he_test"),
                              entry_point="entry_point", prompt="prompt")).alias("prog_prompt_md5"),
        "source")


@query("p09_messages")
def p09_messages(spark, sf_dir):
    """S-03, S-04, P-09, P-10, P-11 chat message assembly."""
    raw = _tasks(spark, sf_dir).select("task_id", F.col("prompt").alias("text"), "test_list")
    full = tl.mbpp_full(raw)
    v1 = tx.v1_messages("text", "function_name")
    body = tx.benchmark_messages("text", "function_name", "body")
    named = tx.benchmark_messages("text", "function_name", "named")
    return full.select(
        "task_id", "function_name", "test_setup",
        F.md5(F.col("prompt")[0]["content"]).alias("rft_system_md5"),
        F.md5(F.col("prompt")[1]["content"]).alias("rft_user_md5"),
        F.md5(v1[0]["content"]).alias("v1_system_md5"),
        F.md5(v1[1]["content"]).alias("v1_user_md5"),
        F.md5(body[1]["content"]).alias("body_user_md5"),
        F.md5(named[1]["content"]).alias("named_user_md5"))


@query("p01_fences")
def p01_fences(spark, sf_dir):
    """P-01 strip all fences, P-02 first closed fence body, R-03 format,
    over every document wrapped in fences of several shapes."""
    d = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    k = F.col("doc_id") % 4
    wrapped = (F.when(k == 0, F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\nDone.")))
               .when(k == 1, F.concat(F.lit("```\n"), "text"))
               .when(k == 2, F.concat(F.lit("```python\na = 1\n```\n"), "text",
                                      F.lit("\n```python\nb = 2\n```")))
               .otherwise(F.concat(F.lit("\n\t"), "text", F.lit(" \n"))))
    c = d.select("doc_id", wrapped.alias("completion"))
    return c.select("doc_id", F.md5(tx.strip_fences("completion")).alias("stripped_md5"),
                    F.md5(tx.extract_code("completion")).alias("extracted_md5"),
                    rw.clean_format("completion").alias("format_reward"))


def _logprobs(spark, sf_dir):
    """J-03 over the three logged tables."""
    policy, old, ref = fx.logprob_tables(spark, sf_dir)
    return ob.join_logprobs(policy, old, ref, ["vec_id"])


@query("m07_objective")
def m07_objective(spark, sf_dir):
    """J-03, M-06, M-07, M-09, M-10, M-12, M-13 per completion; both clip
    settings (baseline 0.2/0.2, variant 0.2/0.5) from one pass."""
    t = ob.sequence_terms(_logprobs(spark, sf_dir), "adv", 0.2, 0.2)
    t = (t.withColumn("clip_variant", tk.clip("ratio", 0.2, 0.5))
         .withColumn("surr_variant", tk.surrogate("ratio", "adv", 0.2, 0.5)))
    return t.select("vec_id", r6("mean_lp"), r6("mean_old_lp"), r6("ratio"),
                    r6("clipped_ratio", "clip_base"), r6("clip_variant"),
                    r6("surrogate", "surr_base"), r6("surr_variant"), r6("kl"), r6("entropy"))


@query("a09_objective")
def a09_objective(spark, sf_dir):
    """J-03, J-09, F-08, A-09, A-11, A-12, A-14, M-17 per run and group."""
    j = _logprobs(spark, sf_dir)
    j = j.withColumn("run_id", F.when(F.col("grp") % 2 == 0, "base").otherwise("variant"))
    cfg = run_config(spark).select("run_id", "variant_fixes", "kl_coeff", "epsilon_low",
                                   "epsilon_high", "group_size")
    j = join_dim(j, cfg, "run_id")
    terms = ob.sequence_terms(j, "adv", "epsilon_low", "epsilon_high", ob.kl_gate())
    out = ob.step_objective(terms, ["run_id", "grp"], "kl_coeff", "group_size")
    return out.select("run_id", "grp", r6("pg_loss"), r6("kl"), r6("entropy"),
                      r6("kl_sum_per_g"), r6("loss"))


@query("m08_token_loss")
def m08_token_loss(spark, sf_dir):
    """M-08, M-11, J-11, A-13, A-15: toy per-token losses per group."""
    lp = _logprobs(spark, sf_dir).withColumnRenamed("adv", "delta")
    out = ob.token_means(ob.token_terms(lp, "delta", 0.01), ["grp"])
    return out.select("grp", r6("loss_naive"), r6("loss_unclipped"), r6("loss_clipped"),
                      r6("kl_penalty"))


@query("m14_logsoftmax")
def m14_logsoftmax(spark, sf_dir):
    """M-14 log-softmax gather over logged logits; M-16 snapshot epoch."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    logits = F.transform("embedding", lambda x: x.cast("double") * 10.0)
    idx = (F.col("vec_id") % 64).cast("int")
    return e.select("vec_id", r6(tk.log_softmax_at(logits, idx), "logp"),
                    tk.snapshot_epoch("vec_id", 10).alias("snapshot"))


@query("m01_tokens")
def m01_tokens(spark, sf_dir):
    """M-01, M-02, M-03, M-04 on token sequences (EOS 'the', budget 256, m 4)."""
    t = fx.tokens(spread(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    return t.select(
        "doc_id", F.size(tk.cut_at_eos("ids", "the")).alias("cut_len"),
        tk.truncated_no_eos("ids", "the", 256).alias("truncated"),
        tk.truncated_len("ids", 256).alias("trunc_len"),
        tk.truncated_exact("ids", 256).alias("trunc_exact"),
        F.size(tk.cap_prompt("ids", 64)).alias("capped_len"),
        tk.is_repetitive("ids", 4).alias("repetitive"))


@query("f03_mask")
def f03_mask(spark, sf_dir):
    """F-03/F-04 conditional truncation mask, F-11 unconditional drop."""
    t = fx.tokens(spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))).select(
        "doc_id", F.col("ids").alias("comp_ids"),
        tk.truncated_len("ids", 256).alias("truncated"),
        ((F.col("doc_id") % 5 - 2) / 2.0).alias("advantage"))
    m = gr.truncation_mask(t, enabled=True, m=4, rho=0.3, draw_keys=("doc_id",))
    kept = gr.drop_truncated(m, True).select("doc_id", F.lit(True).alias("kept"))
    m = m.join(kept, "doc_id", "left")
    return m.select("doc_id", "truncated", "masked", r6("masked_advantage"),
                    F.coalesce("kept", F.lit(False)).alias("kept"))


@query("a10_diversity")
def a10_diversity(spark, sf_dir):
    """M-05 + A-10 4-gram diversity per group of texts."""
    d = dv.ngram_diversity(fx.texts(spark, sf_dir))
    return d.select("grp", "n_total", "n_distinct", r6("diversity"))


@query("a10_sketch")
def a10_sketch(spark, sf_dir):
    """A-10 from mergeable sketches: per group and part of its texts, united
    per group; whether the estimate is within the stated bound of the exact
    count."""
    t = fx.texts(spark, sf_dir).withColumn("part", F.pmod(F.length("text"), F.lit(3)))
    about = dv.sketch_diversity(dv.merged_sketches(dv.ngram_sketch(t, ("grp", "part"))))
    exact = dv.ngram_diversity(fx.texts(spark, sf_dir)).select(
        "grp", F.col("n_distinct").alias("n_exact"))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.col("n_exact") * dv.SKETCH_BOUND
    return about.join(exact, "grp").select("grp", "n_total", F.col("n_exact"),
                                           near.alias("within_bound"))


@query("s14_text_log")
def s14_text_log(spark, sf_dir):
    """S-12, S-14: records over all embeddings (epoch = label, step within
    it), head and detail lines with their places."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    step = F.pmod("vec_id", F.lit(15)).cast("int")
    ints = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(F.abs(x) * 100).cast("int"))
    rows = e.select(F.col("label").cast("int").alias("epoch"), step.alias("step"),
                    F.floor(F.col("vec_id") / 15).cast("int").alias("batch"), F.lit(0).alias("trial"),
                    ints.alias("prompt"), F.reverse(ints).alias("response"),
                    F.array((F.pmod("vec_id", F.lit(8)) / 8.0), F.lit(-0.5)).alias("log_probs"),
                    (F.pmod("vec_id", F.lit(4)) / 4.0).alias("reward"), F.lit(0.25).alias("delta"))
    heads = rows.groupBy("epoch", "step").agg(F.lit(0.5).alias("loss"),
                                              F.max("reward").alias("mean_reward"))
    return mt.text_lines(heads, rows)


@query("s10_series")
def s10_series(spark, sf_dir):
    """S-10: the hourly series and its eval points stored twice by upsert,
    the second time from the middle on; each step is there once."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    log = cut_lineage(_hourly(spark, sf_dir))
    late = F.pmod("step", F.lit(2)) == 0
    for part in (log.withColumn("reward", F.when(late, -1.0).otherwise(F.col("reward"))),
                 log.where(late)):
        mt.upsert_series(part, path, steps=100)
        mt.upsert_series(part.where(mt.cadence(F.col("step"), 24)), path, "eval", steps=100)
    schema = "run_id string, step long, reward double"
    kinds = [mt.read_series(spark, path, k, schema).withColumn("kind", F.lit(k))
             for k in ("dense", "eval")]
    return kinds[0].unionByName(kinds[1]).select("kind", "run_id", "step", r6("reward"))


@query("r13_process")
def r13_process(spark, sf_dir):
    """X-06/P-06 syntax job, W-04..W-06, R-13..R-16 process rewards."""
    c = ex.syntax_check(fx.commits(spark, sf_dir), "code")
    r = pr.step_rewards(c)
    return r.select("traj_id", "pos", "syntax_ok", "diff_ok", F.size("new_tests").alias("n_new"),
                    "is_final", r6("reward"))


def _hourly(spark, sf_dir):
    return fx.step_log(spark, sf_dir).groupBy("run_id", "step").agg(F.avg("value").alias("reward"))


@query("w09_smooth")
def w09_smooth(spark, sf_dir):
    """W-09 trailing 15-point mean, valid mode, runs with > 15 points, in blocks with halo rows."""
    s = mt.smooth_blocks(_hourly(spark, sf_dir), "reward", block=1_000)
    return s.select("run_id", "step", r6("reward"), r6("reward_smooth"))


@query("j07_eval_series")
def j07_eval_series(spark, sf_dir):
    """S-10 series, F-06 cadence, J-07 dense + sparse eval points + base point."""
    ev_ = read_table(spark, sf_dir, "events", "ts", "event_type")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    hit = (F.col("event_type") == "purchase").cast("double")
    pts = (ev_.select(hour.alias("step"), hit.alias("hit")).filter(mt.cadence(F.col("step"), 24))
           .groupBy("step").agg(F.avg("hit").alias("eval_acc"))
           .select(F.lit("events").alias("run_id"), "step", "eval_acc"))
    base = ev_.agg(F.avg(hit).alias("eval_acc")).select(
        F.lit("events").alias("run_id"), F.lit(0).cast("long").alias("step"), "eval_acc")
    dense = _hourly(spark, sf_dir).filter(F.col("run_id") == "events")
    out = mt.with_eval_points(dense, pts, base)
    return out.select("run_id", "step", r6("reward"), r6("eval_acc"))


def _evals(spark, sf_dir):
    return fx.eval_results(spark, sf_dir)


@query("a17_pass1")
def a17_pass1(spark, sf_dir):
    """A-17 pass@1 per model and axis, A-20 summary with P-17 delta text."""
    s = ev.summary(ev.pass_at_1(_evals(spark, sf_dir)))
    return s.select("label", "axis", r6("pass_at_1"), "n", "n_passed", r6("delta"), "delta_text",
                    "solved_text")


@query("a19_two_axis")
def a19_two_axis(spark, sf_dir):
    """A-19 model x axis table."""
    t = ev.two_axis(_evals(spark, sf_dir))
    return t.select("label", r6("in_dist"), r6("transfer"))


@query("a21_run_delta")
def a21_run_delta(spark, sf_dir):
    """A-21 pass@1 delta between two runs per axis."""
    d = ev.run_delta(ev.pass_at_1(_evals(spark, sf_dir)), "A", "B")
    return d.select("axis", r6("delta"))


@query("u02_classes")
def u02_classes(spark, sf_dir):
    """U-02..U-05 class of every task."""
    p = ev.paired(_evals(spark, sf_dir), "A", "B")
    return p.filter(F.col("cls").isNotNull()).select("axis", "task_id", "cls")


@query("u06_breakdown")
def u06_breakdown(spark, sf_dir):
    """U-06 class counts."""
    return ev.breakdown(ev.paired(_evals(spark, sf_dir), "A", "B"))


@query("u07_examples")
def u07_examples(spark, sf_dir):
    """U-07 example per class, J-08 look-up of its problem and both models'
    results (S-15), P-16 previews."""
    ex_ = ev.example_per_class(ev.paired(_evals(spark, sf_dir), "A", "B"))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("task/"), F.col("doc_id").cast("string")).alias("task_id"), "text")
    outcomes = _evals(spark, sf_dir).withColumn("completion", F.concat(
        F.lit("def f(x):\n    # "), "label", F.lit("\n    return '"), "task_id", F.lit("'\n")))
    j = ev.with_both_results(ex_, outcomes, docs, "A", "B").where(F.col("text").isNotNull())
    return j.select("cls", "task_id", F.md5(tx.preview("text", 200)).alias("preview_md5"),
                    "a_passed", F.md5(tx.preview("a_completion", 200)).alias("a_md5"),
                    "b_passed", F.md5(tx.preview("b_completion", 200)).alias("b_md5"))


@query("a17_passed_sets")
def a17_passed_sets(spark, sf_dir):
    """A-17 passed ids from outcomes to bitmaps and back: every passed task
    of every model with its number."""
    e = _evals(spark, sf_dir)
    tasks = pset.task_numbers(e)
    return pset.members_of(pset.passed_sets(e, tasks), tasks).select(
        "label", "axis", "task_id", "task_no")


@query("u02_set_counts")
def u02_set_counts(spark, sf_dir):
    """U-02 .. U-06 class counts by set algebra on bitmaps, the sets of two
    partial runs united first."""
    e = _evals(spark, sf_dir)
    tasks = pset.task_numbers(e)
    first = F.pmod(F.xxhash64("task_id"), F.lit(2)) == 0
    sets = pset.union(pset.passed_sets(e.where(first), tasks),
                      pset.passed_sets(e.where(~first), tasks))
    return pset.class_counts(sets, "A", "B")


@query("s07_results_lines")
def s07_results_lines(spark, sf_dir):
    """S-07, S-08, S-09: result lines written twice (the second time as a
    restart) and read back, one row per solved task."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    for _ in range(2):
        rs.append_results(_evals(spark, sf_dir), path, restart=True)
    return rs.read_results(spark, path).select("label", "axis", r6("pass_at_1"), "n", "task_id")


@query("j10_membership")
def j10_membership(spark, sf_dir):
    """J-10 semi / anti membership of A's solved set in B's."""
    e = _evals(spark, sf_dir)
    semi = ev.members(e, "A", "B", True).withColumn("kind", F.lit("both"))
    anti = ev.members(e, "A", "B", False).withColumn("kind", F.lit("a_not_b"))
    return semi.unionByName(anti)


@query("t02_split")
def t02_split(spark, sf_dir):
    """T-01 seeded shuffle, T-02 range split, F-01 named-only filter after it."""
    raw = _tasks(spark, sf_dir).select("task_id", F.col("prompt").alias("text"), "test_list")
    rows = sp.shuffled_row_numbers(tl.mbpp_full(raw), "task_id", seed=0)
    s = sp.named_only(sp.range_split(rows, 20, 10))
    return s.select("task_id", "row_idx", "split")


@query("a22_split_sizes")
def a22_split_sizes(spark, sf_dir):
    """A-22 split sizes (T-01, T-02, F-01 upstream)."""
    return t02_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("t03_capped_split")
def t03_capped_split(spark, sf_dir):
    """T-03 source-order split with the train cap, U-01 concatenation, T-04 limit."""
    raw = _tasks(spark, sf_dir)
    rows = sp.source_row_numbers(raw, "task_id")
    n = raw.count()
    s = sp.capped_split(rows, n, 150, 10)
    parts = [(name, s.filter(F.col("split") == name).drop("split")) for name in ("train", "eval")]
    u = sp.concat_splits(*parts)
    return u.select("task_id", "row_idx", "split", sp.within(5).alias("in_first5"))


@query("f10_draw")
def f10_draw(spark, sf_dir):
    """F-10 one task per step, J-05 G copies, J-01 turn rows joined to their
    task, P-07 prompt."""
    tasks = tl.mbpp_sanitized(_tasks(spark, sf_dir)).withColumn(
        "_no", F.substring_index("task_id", "/", -1).cast("long"))
    tasks = sp.source_row_numbers(tasks, "_no")
    n = tasks.count()
    # written once: steps and turns are two readings of it
    turns = cut_lineage(fx.rollouts(spark, sf_dir).select("run_id", "step", "g", "turn"))
    steps = turns.select("run_id", "step").distinct()
    drawn = sp.draw_per_step(steps, tasks.select("row_idx", "task_id"), n, seed=42)
    cfg = run_config(spark).select("run_id", "group_size")
    per_traj = ep.copies(join_dim(drawn.select("run_id", "step", "task_id"), cfg, "run_id"),
                         "group_size")                                              # J-05
    j = turns.join(per_traj.select("run_id", "step", "g", "task_id"), ["run_id", "step", "g"])
    j = join_dim(j, tasks.select("task_id", "entry_point", "prompt"), "task_id")
    return j.select("run_id", "step", "g", "turn", "task_id",
                    F.md5(tx.first_turn_prompt("entry_point", "prompt")).alias("prompt_md5"))


@query("w07_revision")
def w07_revision(spark, sf_dir):
    """W-10 turn index, W-07 previous attempt + feedback, P-08 revision prompt:
    assistant messages are attempts, the user message after one is its feedback."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    # conversations are not bounded by max_turns: scans over sampled ranges, one layout for all
    cv = ps.by_part(ps.laid_out(cv, [F.col("conv_id").asc(), F.col("turn").asc()]))
    cv = ps.scan(cv, ["conv_id"], "turn", following={"next_text": F.col("text")})
    att = (cv.filter(F.col("role") == "assistant")
           .select("_part", "_place", F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
                   F.col("text").alias("action"),
                   F.coalesce("next_text", F.lit("")).alias("feedback")))
    att = ep.attempts(att, ["run_id"], "seq")
    prompt = tx.revision_prompt(F.lit("f"), F.lit("Return x doubled."), "prev_action", "prev_feedback")
    return att.select(F.col("run_id").alias("conv_id"), "turn", F.length(prompt).alias("prompt_len"),
                      F.md5(prompt).alias("prompt_md5"))


@query("r12_sort_rewards")
def r12_sort_rewards(spark, sf_dir):
    """R-10, R-11, R-12, J-06, W-02: sort rewards of trials against their
    prompt and the four delta modes."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    ints = lambda a: F.transform(a, lambda x: F.floor(F.abs(x) * 10).cast("int"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    prompts = e.groupBy(F.col("label").alias("prompt_id")).agg(
        F.min_by(ints(F.slice("embedding", F.lit(1), half)), "vec_id").alias("prompt"))
    trials = e.select(F.col("label").alias("prompt_id"), "vec_id",
                      ints(F.slice("embedding", half + 1, half)).alias("response"))
    j = toy.reward_matrix(prompts, trials, rw.sort_inclusion_ordering).withColumn(
        "r_dist", F.when(F.col("equal_len"), rw.sort_distance("prompt", "response")))
    d = toy.all_deltas(j, "prompt_id")
    return d.select("prompt_id", "vec_id", r6("r_dist"), r6("reward", "r_incl"),
                    r6("d_rewards"), r6("d_centered_rewards"), r6("d_normalized_rewards"),
                    r6("d_max_rewards"))


@query("x07_verify")
def x07_verify(spark, sf_dir):
    """X-06 + X-07 + A-01 + P-14: run each benchmark task's asserts against
    three completions per task (fixed templates, generated here, so the
    executed code is ours); each distinct program runs once."""
    raw = _tasks(spark, sf_dir)
    tasks = raw.select(F.concat(F.lit("bench/"), F.col("task_id").cast("string")).alias("task_id"),
                       F.col("test_list").alias("tests"))
    comps = fx.completions_for_tasks(raw)
    v = ex.execution_verdicts(comps, tasks, timeout=10.0, allow_exec=True)
    return v.select("completion_id", "kind", "syntax_ok", "n_passed", "n_total", "all_passed",
                    r6("fraction_passed"), (F.length("feedback") > 0).alias("has_feedback"))


@query("r08_setup_reward")
def r08_setup_reward(spark, sf_dir):
    """P-03, P-02, S-03 setup code, R-08, R-09, X-05: the batch reward of
    message-list completions, null ones too, for every benchmark task."""
    raw = _tasks(spark, sf_dir)
    tasks = raw.select(F.concat(F.lit("setup/"), F.col("task_id").cast("string")).alias("task_id"),
                       F.col("test_list").alias("tests"),
                       F.concat(F.lit("K = "), (F.col("task_id") % 7 + 1).cast("string"))
                       .alias("test_setup"))
    named = raw.select(F.col("task_id").cast("string").alias("task_id"))
    comps = fx.setup_completions(named).withColumn(
        "task_id", F.concat(F.lit("setup/"), F.col("task_id")))
    v = ex.execution_reward(comps, tasks, allow_exec=True, messages=True, name="setup_reward")
    return v.select("completion_id", "kind", "n_passed", "n_total", r6("setup_reward"))


@query("a18_eval_accuracy")
def a18_eval_accuracy(spark, sf_dir):
    """A-18 accuracy per (run, eval step) with the F-06 cadence: every event
    of an evaluation hour is one held-out task, passed when value > 250."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    rows = (e.select(F.lit("events").alias("run_id"), hour.alias("step"),
                     F.col("event_id").cast("string").alias("task_id"),
                     (F.col("value") > 250).alias("passed"))
            .filter(mt.cadence(F.col("step"), 24)))
    p = ev.pass_at_1(rows, ("run_id", "step"))
    return p.select("run_id", "step", r6("pass_at_1"), "n", "n_passed")


@query("s11_long_metrics")
def s11_long_metrics(spark, sf_dir):
    """S-11 wide -> long form of the step metrics (one row per metric)."""
    m = a16_step_metrics(spark, sf_dir)
    vals = ["reward_mean", "reward_std", "solve_rate", "mean_turns", "pg_loss", "temperature"]
    return mt.long_form(m, ["run_id", "step"], vals)


@query("x01_episode_twin")
def x01_episode_twin(spark, sf_dir):
    """X-01 in batch form (equal to the keyed stream, see tests): W-08 trim,
    done flag and the next prompt (P-07 / P-08) after every kept turn."""
    from rewardlake.streaming.episodes import episode_batch_twin
    t = episode_batch_twin(ep.by_group(fx.scored_turns(spark, sf_dir, run_config(spark))))
    return t.select("run_id", "step", "g", "turn", r6("reward"), "solved", "done",
                    F.md5("next_prompt").alias("next_prompt_md5"))


@query("x02_group_twin")
def x02_group_twin(spark, sf_dir):
    """X-02 in batch form over the finished trajectories of the rollouts."""
    from rewardlake.streaming.episodes import group_barrier_twin
    cfg = run_config(spark).select("run_id", "group_size", "max_turns", "reward_mode")
    t = ep.trim_episodes(ep.by_group(join_dim(fx.rollouts(spark, sf_dir), cfg, "run_id")))
    traj = ep.trajectories(t, keys=(*ep.TRAJ_KEYS, "group_size", "reward_mode"))
    traj = traj.withColumn("reward", ep.credit("reward_mode"))
    out = group_barrier_twin(traj)
    return out.select("run_id", "step", "g", r6("reward"), r6("advantage"), "complete")


def _streamed(spark, turns: DataFrame, start, schema: str, **kw) -> DataFrame:
    """The rows that a stream of ``turns`` leaves in its sink, all input taken."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    turns.write.parquet(f"{base}/in")
    q = start(spark, f"{base}/in", f"{base}/out", name=None, checkpoint=f"{base}/state",
              max_files=10_000, **kw)
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("x01_stream")
def x01_stream(spark, sf_dir):
    """X-01 as the keyed stream itself, over all scored turns: the same rows
    as its batch twin."""
    from rewardlake.streaming import episodes as se
    from rewardlake.streaming.run import start_episode_stream
    t = fx.scored_turns(spark, sf_dir, run_config(spark))
    out = _streamed(spark, t, start_episode_stream, se.STEP_OUT, delay="3650 days")
    return out.select("run_id", "step", "g", "turn", r6("reward"), "solved", "done",
                      F.md5("next_prompt").alias("next_prompt_md5"))


@query("x02_stream")
def x02_stream(spark, sf_dir):
    """X-01 into X-02 as one streaming query: advantages of the groups whose
    trajectories have all finished."""
    from rewardlake.streaming import episodes as se
    from rewardlake.streaming.run import start_training_stream
    cfg = run_config(spark).select("run_id", "reward_mode", "group_size")
    t = join_dim(fx.scored_turns(spark, sf_dir, run_config(spark)), cfg, "run_id")
    out = _streamed(spark, t, start_training_stream, se.GROUP_OUT, delay="3650 days")
    return out.where("complete").select("run_id", "step", "g", r6("reward"), r6("advantage"),
                                        "complete")
