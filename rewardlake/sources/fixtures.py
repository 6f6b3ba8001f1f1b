"""Stand-in inputs built from the test tables (FIXTURES.md part C).

Each function only reshapes a test table into the schema an operator
expects (renames, a row number, a literal mapping). None does an
operator's work; the operators run on whatever rows these give.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlake.sources.tables import read_table

# The five code states of the synthetic commit log (index =
# turn mod 5). Number 2 does not parse.
COMMIT_CODES = (
    "import os",
    "def f(x):\n    return x",
    "def f(x) return x",
    "import os\ndef f(x):\n    return x",
    "import os\nimport sys\n\nclass Runner:\n    pass\n\n"
    "def run(values):\n    total = sum(values)\n    return total * 2\n",
)

# The short literal group added to the n-gram texts.
SHORT_TEXT_GROUP = ("short", "too short here")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of multi-turn episodes: one events row per turn.

    ``run_id`` by user parity, twelve consecutive events of a user form one
    GRPO group (4 trajectories x 3 turns), reward from ``value``.
    """
    from rewardlake.operators.splits import keyed_row_numbers

    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "value", "ts")
    ev = keyed_row_numbers(ev, ["user_id"], "event_id")
    reward = F.least(F.floor(F.col("value") / 50), F.lit(3)).cast("double") / 3.0
    return ev.select(
        F.when(F.col("user_id") % 2 == 0, "base").otherwise("variant").alias("run_id"),
        (F.col("user_id") * 1000 + F.floor(F.col("rn") / 12)).cast("long").alias("step"),
        F.floor((F.col("rn") % 12) / 3).cast("int").alias("g"),
        (F.col("rn") % 3).cast("int").alias("turn"),
        reward.alias("reward"),
        (reward >= 1.0).alias("solved"),
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-test outcomes: completion = order key, pass = quantity > 25."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return li.select(F.col("l_orderkey").alias("completion_id"),
                     F.col("l_linenumber").alias("test_idx"),
                     (F.col("l_quantity") > 25).alias("passed"))


def completions_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completion per order: status 'P' = did not parse, priority
    '1-URGENT' = raw text carried a fence."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("completion_id"),
                    (F.col("o_orderstatus") != "P").alias("syntax_ok"),
                    (F.col("o_orderpriority") == "1-URGENT").alias("has_fence"))


def logprob_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three logged per-token log-prob tables keyed by ``vec_id``: policy
    (``grp, adv, lp``), old (``old_lp``) and reference (``ref_lp``). The
    policy row of ``vec_id`` is the row's own embedding; old and reference
    are the embeddings one and two ids further on (modulo the row count),
    i.e. each table is the same scan with its key shifted."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    lp = F.transform("embedding", lambda x: -30.0 * F.abs(x.cast("double")))
    n = emb.select(F.count("*")).scalar()
    policy = emb.select("vec_id", F.col("label").alias("grp"),
                        ((F.col("vec_id") % 5 - 2) / 2.0).alias("adv"), lp.alias("lp"))
    old = emb.select(F.pmod(F.col("vec_id") - 1, n).alias("vec_id"), lp.alias("old_lp"))
    ref = emb.select(F.pmod(F.col("vec_id") - 2, n).alias("vec_id"), lp.alias("ref_lp"))
    return policy, old, ref


def tokens(docs: DataFrame) -> DataFrame:
    """Token sequences: the whitespace words of each document
    (``documents(doc_id, text)``)."""
    d = docs
    return d.select("doc_id", F.split(F.col("text"), r"\s+").alias("raw")).select(
        "doc_id", F.filter("raw", lambda x: x != "").alias("ids"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion texts per group: documents by source, assistant turns by
    conversation, plus one literal group shorter than four words."""
    d = read_table(spark, sf_dir, "documents", "source", "text").select(
        F.col("source").alias("grp"), "text")
    c = (read_table(spark, sf_dir, "conversations", "conv_id", "role", "text")
         .filter(F.col("role") == "assistant")
         .select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("grp"), "text"))
    lit = spark.createDataFrame([SHORT_TEXT_GROUP], "grp string, text string")
    return d.unionByName(c).unionByName(lit)


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy eval outcomes of three models over the labelled documents."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    outcomes = F.array(
        F.struct(F.lit("base").alias("label"), (F.col("quality") == 1).alias("passed")),
        F.struct(F.lit("A").alias("label"), (F.col("toxic") == 0).alias("passed")),
        F.struct(F.lit("B").alias("label"), (F.col("doc_id") % 3 != 0).alias("passed")))
    return lab.select(
        F.concat(F.lit("task/"), F.col("doc_id").cast("string")).alias("task_id"),
        F.when(F.col("doc_id") % 2 == 0, "in_dist").otherwise("transfer").alias("axis"),
        F.inline(outcomes)).select("label", "axis", "task_id", "passed")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense per-step values: one step per hour of events (one run), plus a
    short literal run of ten points."""
    ev = read_table(spark, sf_dir, "events", "ts", "value", "event_type")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    dense = ev.select(F.lit("events").alias("run_id"), hour.alias("step"), "value")
    short = spark.range(10).select(F.lit("short").alias("run_id"), F.col("id").alias("step"),
                                   (F.col("id") * 1.5).alias("value"))
    return dense.unionByName(short)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit histories: one trajectory per conversation, one code state
    per turn picked from five literals by ``turn mod 5``."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn")
    codes = F.array(*[F.lit(c) for c in COMMIT_CODES])
    return cv.select(F.col("conv_id").alias("traj_id"), F.col("turn").cast("int").alias("pos"),
                     F.element_at(codes, (F.col("turn") % 5 + 1).cast("int")).alias("code"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw benchmark task rows (MBPP-shaped): prompt text plus two asserts
    calling ``f<item_id>``."""
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    name = F.concat(F.lit("f"), F.col("item_id").cast("string"))
    return b.select(
        F.col("item_id").alias("task_id"),
        F.col("text").alias("prompt"),
        F.array(F.concat(F.lit("assert "), name, F.lit("(1) == 1")),
                F.concat(F.lit("assert "), name, F.lit("(2) == 2"))).alias("test_list"),
        F.when(F.col("item_id") % 2 == 0, "mbpp").otherwise("humaneval").alias("source"))


# Completion templates for the execution check (name = the
# function the task's asserts call): right but fenced, wrong, unparsable.
COMPLETION_TEMPLATES = (
    ("right", "```python\ndef {name}(x):\n    return x\n```"),
    ("wrong", "def {name}(x):\n    return x + 1"),
    ("syntax", "def {name}(x) return x"),
)


def completions_for_tasks(tasks_df: DataFrame) -> DataFrame:
    """Three completions per task from ``COMPLETION_TEMPLATES``."""
    name = F.concat(F.lit("f"), F.col("task_id").cast("string"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"),
                              F.concat(*[part if i % 2 else F.lit(part)
                                         for i, part in enumerate(_split_name(t, name))]).alias("completion"))
                     for k, t in COMPLETION_TEMPLATES])
    return tasks_df.select(F.col("task_id"), F.inline(rows)).select(
        F.concat(F.lit("bench/"), F.col("task_id").cast("string"), F.lit("/"), F.col("kind"))
        .alias("completion_id"),
        F.concat(F.lit("bench/"), F.col("task_id").cast("string")).alias("task_id"),
        "kind", "completion")


def _split_name(template: str, name):
    head, tail = template.split("{name}")
    return [head, name, tail]


def setup_completions(tasks_df: DataFrame) -> DataFrame:
    """Message-list completions for tasks with setup code: one that uses the
    setup's constant, one that is wrong, one that is null."""
    name = F.concat(F.lit("f"), F.col("task_id").cast("string"))
    kind = "array<struct<role:string,content:string>>"
    said = lambda *parts: F.array(F.struct(F.lit("assistant").alias("role"),       # noqa: E731
                                           F.concat(*parts).alias("content"))).cast(kind)
    rows = F.array(
        F.struct(F.lit("right").alias("kind"), said(
            F.lit("Here:\n```python\ndef "), name, F.lit("(x):\n    return x + K - K\n```"))
            .alias("completion")),
        F.struct(F.lit("wrong").alias("kind"), said(
            F.lit("def "), name, F.lit("(x):\n    return x + K")).alias("completion")),
        F.struct(F.lit("null").alias("kind"), F.lit(None).cast(kind).alias("completion")))
    return tasks_df.select("task_id", F.inline(rows)).select(
        F.concat(F.col("task_id"), F.lit("/"), F.col("kind")).alias("completion_id"),
        "task_id", "kind", "completion")


# Attempt text and feedback of the stand-in scored turns.
ATTEMPT_PREFIX = "def f(x):\n    return "
FAILED_FEEDBACK = "Your code failed this test:\nassert f(1) == 1"


def scored_turns(spark: SparkSession, sf_dir: str, run_config: DataFrame) -> DataFrame:
    """Scored turns as the episode operator receives them: the rollout
    turns plus an attempt text, its feedback ('' when solved), the run's
    ``max_turns`` and the task's name and prompt."""
    r = rollouts(spark, sf_dir)
    cfg = run_config.select("run_id", "max_turns")
    from rewardlake.operators.joins import join_dim

    return join_dim(r, cfg, "run_id").select(
        "run_id", "step", "g", "turn", "reward", "solved",
        F.concat(F.lit(ATTEMPT_PREFIX), F.col("event_id").cast("string")).alias("action"),
        F.when(F.col("solved"), F.lit("")).otherwise(F.lit(FAILED_FEEDBACK)).alias("feedback"),
        "max_turns", F.lit("f").alias("entry_point"), F.lit("Return x doubled.").alias("prompt"), "ts")


def turn_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout turns with logged tokens and log-probs: those of the embedding
    whose number is the event's modulo their count, none (an empty
    completion) for every eleventh event."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = emb.select(F.count("*")).scalar()
    r = rollouts(spark, sf_dir).withColumn("vec_id", F.pmod("event_id", n))
    x = F.when(F.col("event_id") % 11 == 0, F.array().cast("array<double>")).otherwise(
        F.col("embedding").cast("array<double>"))
    return r.join(emb, "vec_id").select(
        "run_id", "step", "g", "turn", "reward", "solved",
        F.transform(x, lambda v: F.floor(F.abs(v) * 30).cast("int")).alias("comp_ids"),
        (F.col("event_id") % 3 == 0).alias("truncated"),
        F.transform(x, lambda v: -30.0 * F.abs(v)).alias("lp"),
        F.transform(x, lambda v: -29.5 * F.abs(v)).alias("old_lp"),
        F.transform(x, lambda v: -31.0 * F.abs(v)).alias("ref_lp"),
        ((F.col("step") % 7) / 7.0).alias("grad_norm"))
