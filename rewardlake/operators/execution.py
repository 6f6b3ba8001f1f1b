"""Distributed syntax checks and test execution (P-06, X-06, X-07,
R-07 .. R-09).

Both jobs work on *distinct* inputs: programs are keyed by a SHA-256 of
their text, spread by that key and deduplicated in one exchange, evaluated once
in Arrow batches, written to the shared checkpoint folder (so a retried or
reused plan never runs code twice, H-7) and joined back. With a memo, verdicts
outlive the job and programs already run are not run again.

X-07 runs stored code on executors. It is opt-in (``allow_exec=True``);
each program runs in its own isolated interpreter with an empty
environment, a throw-away working directory and a wall-clock limit; its
process group is killed in any case. CPU, memory and file-size limits are
optional. This is not a security boundary.
"""
from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlake.functions import text as tx
from rewardlake.operators import memo as memos
from rewardlake.operators import positions
from rewardlake.operators.joins import bounded_broadcast, join_dim
from rewardlake.session import cut_lineage, ship_package

EXEC_SCHEMA = T.StructType([
    T.StructField("program_id", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("returncode", T.IntegerType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("timed_out", T.BooleanType()),
    T.StructField("limit_hit", T.StringType()),
])

# What a program is taken to cost before any was measured (the start of an interpreter), what a
# task should cost, and from what cost on a program gets a task of its own.
DEFAULT_SECONDS = 0.15
TASK_SECONDS = 30.0
SLOW_SECONDS = 2.0

# Characters kept of a program's error output (its end); feedback uses the last 400.
KEEP_ERROR_CHARS = 65_536


@F.pandas_udf(T.StringType())
def parse_problem(code: pd.Series) -> pd.Series:
    """P-06: '' when the code parses as Python, else the name of what the
    parser raised (too deep code raises RecursionError or MemoryError)."""
    import ast
    import warnings

    def problem(s):
        if s is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(s)
            return ""
        except Exception as e:  # any failure of the parser is a result
            return type(e).__name__
    return code.map(problem)


def parses(code) -> Column:
    """P-06: True when the code parses as Python, null for null."""
    return parse_problem(code) == ""


def syntax_check(df: DataFrame, code: str = "code", name: str = "syntax_ok",
                 reason: str | None = None) -> DataFrame:
    """X-06: parse each distinct code once, materialise, join back.
    ``reason`` names a column for what the parser raised ('' if nothing)."""
    ship_package(df.sparkSession)
    keyed = df.withColumn("_cid", F.sha2(F.col(code), 256))
    distinct = keyed.select("_cid", code).dropDuplicates(["_cid"])
    checked = cut_lineage(distinct.select("_cid", parse_problem(F.col(code)).alias("_problem")))
    out = join_dim(keyed, checked, "_cid", "left").withColumn(name, F.col("_problem") == "")
    if reason:
        out = out.withColumn(reason, F.col("_problem"))
    return out.drop("_cid", "_problem")


# Runs prog.py as if given with ``-c``: compiled under the name "<string>" and
# executed in the real ``__main__``, with the bootstrap's own names and frame
# left out, so that pickling, unittest.main() and error texts work as usual.
_BOOTSTRAP = (
    "def _boot():\n"
    "    import linecache, sys, traceback\n"
    "    del globals()['_boot']\n"
    "    def hook(t, v, tb):\n"
    "        traceback.print_exception(t, v, tb.tb_next if tb is not None else None)\n"
    "    sys.excepthook = hook\n"
    "    with open('prog.py', encoding='utf-8') as f:\n"
    "        src = f.read()\n"
    "    linecache.cache['<string>'] = (len(src), None, src.splitlines(True), '<string>')\n"
    "    try:\n"
    "        return compile(src, '<string>', 'exec')\n"
    "    except SyntaxError as e:\n"
    "        traceback.print_exception(type(e), e, None)\n"
    "        sys.exit(1)\n"
    "exec(_boot(), globals())\n"
)


def _run_one(prog: str, timeout: float, cpu_s: int | None, mem_mb: int | None,
             file_mb: int | None) -> tuple:
    """(ok, returncode, stderr, timed_out, limit_hit) of one program; never raises."""
    import codecs
    import os
    import resource
    import shutil
    import signal
    import subprocess
    import sys
    import tempfile
    import threading
    import time

    def limits():
        for kind, value in ((resource.RLIMIT_CPU, cpu_s),
                            (resource.RLIMIT_AS, mem_mb and mem_mb << 20),
                            (resource.RLIMIT_FSIZE, file_mb and file_mb << 20)):
            if value:
                resource.setrlimit(kind, (value, value))

    def drain(pipe, keep: int, into: dict):
        # strict decoding as the reference does; only the end of the text is kept
        dec, text = codecs.getincrementaldecoder("utf-8")(), ""
        try:
            while chunk := pipe.read1(1 << 16):
                if "bad" not in into:
                    try:
                        text = (text + dec.decode(chunk))[-keep:] if keep else dec.decode(chunk)[:0]
                    except UnicodeDecodeError as e:
                        into["bad"] = repr(e)
            if "bad" not in into:
                dec.decode(b"", True)
        except UnicodeDecodeError as e:
            into["bad"] = repr(e)
        except (OSError, ValueError):
            pass
        into["text"] = text

    work, p = None, None
    try:
        work = tempfile.mkdtemp(prefix="rl-exec-")
        with open(os.path.join(work, "prog.py"), "w", encoding="utf-8", newline="") as fh:
            fh.write(prog)
        p = subprocess.Popen([sys.executable, "-I", "-c", _BOOTSTRAP], cwd=work, env={},
                             stdin=subprocess.DEVNULL, stdout=subprocess.PIPE,
                             stderr=subprocess.PIPE, start_new_session=True,
                             preexec_fn=limits if cpu_s or mem_mb or file_mb else None)
        out, err = {}, {}
        readers = [threading.Thread(target=drain, args=a, daemon=True)
                   for a in ((p.stdout, 0, out), (p.stderr, KEEP_ERROR_CHARS, err))]
        for r in readers:
            r.start()
        end = time.monotonic() + timeout
        try:
            rc = p.wait(timeout)
            for r in readers:                    # a child may still hold the pipes
                r.join(max(0.0, end - time.monotonic()))
            late = any(r.is_alive() for r in readers)
        except subprocess.TimeoutExpired:
            late = True
        if late:
            return False, -1, f"TimeoutExpired after {timeout}s", True, None
        bad = out.get("bad") or err.get("bad")
        if bad:
            return False, -1, bad, False, None
        hit = ("cpu" if cpu_s and rc == -signal.SIGXCPU
               else "file" if file_mb and (rc == -signal.SIGXFSZ or "Errno 27" in err["text"])
               else "memory" if mem_mb and "MemoryError" in err["text"] else None)
        return rc == 0, rc, err["text"], False, hit
    except Exception as e:  # a failure is a result
        return False, -1, repr(e), False, None
    finally:
        if p is not None:
            try:                                 # what the program left running
                os.killpg(p.pid, signal.SIGKILL)
            except (ProcessLookupError, PermissionError):
                pass
            try:
                p.wait(10)
            except subprocess.TimeoutExpired:
                pass
        if work:
            shutil.rmtree(work, ignore_errors=True)


def _run_batch(batches, timeout: float, limits: dict):
    import time
    for pdf in batches:
        out = []
        for pid, prog, cost_key in zip(pdf["program_id"], pdf["program"], pdf["cost_key"]):
            begin = time.monotonic()
            result = _run_one(prog, timeout, limits.get("cpu_s"), limits.get("mem_mb"),
                              limits.get("file_mb"))
            out.append((pid, cost_key, *result, time.monotonic() - begin))
        yield pd.DataFrame(out, columns=["program_id", "cost_key", *memos.VERDICT_FIELDS])


def _in_tasks(programs: DataFrame, todo: DataFrame, spread: int | None) -> DataFrame:
    """The ``programs`` (``program_id, program, cost_key``) named in ``todo`` (``program_id, cost``),
    each once, cut into tasks by cost: those expected to be slow alone, the others by hash into
    tasks of about ``TASK_SECONDS``. Their text is shuffled once."""
    slow = F.col("cost") >= SLOW_SECONDS
    sums = todo.agg(F.sum(F.when(~slow, F.col("cost"))).alias("cost"), F.count(F.when(~slow, 1))
                    .alias("fast"), F.count(F.when(slow, 1)).alias("slow")).first()
    cores = programs.sparkSession.sparkContext.defaultParallelism
    n = spread or max(1, min(sums["fast"], max(4 * cores, math.ceil((sums["cost"] or 0)
                                                                    / TASK_SECONDS))))
    # one exchange: the semi-join and the dedupe keep the partitioning by program
    fast = (programs.repartition(n, "program_id")
            .join(todo.where(~slow).select("program_id"), "program_id", "left_semi")
            .dropDuplicates(["program_id"]))
    if not sums["slow"]:
        return fast
    at = positions.numbered(todo.where(slow).select("program_id"), [F.col("program_id").asc()], "at")
    alone = (programs.join(bounded_broadcast(at), "program_id").dropDuplicates(["program_id"])
             .repartitionById(sums["slow"], F.col("at").cast("int")).drop("at"))
    return fast.unionByName(alone)


def run_programs(df: DataFrame, program: str = "program", timeout: float = 5.0,
                 allow_exec: bool = False, limits: dict | None = None,
                 spread: int | None = None, memo: str | None = None,
                 cost_key: str | None = None) -> DataFrame:
    """X-07: run every distinct program once and attach ok / returncode /
    stderr / timed_out / limit_hit. Exit code 0 is a pass (H-12); output
    that is no UTF-8 is a failure. A null program is not run.

    ``limits`` may hold ``cpu_s``, ``mem_mb`` and ``file_mb``. They are off
    by default, as they can change verdicts; ``limit_hit`` names the one
    that ended a program ('cpu', 'memory', 'file').

    ``memo`` names a stored table of verdicts (:mod:`memo`): programs it holds under the same limits
    are not run again, what is run is added to it, and ``from_memo`` tells the two apart. Its run
    times cut the tasks: a program whose ``cost_key`` (a column; say its test) has been slow gets a
    task of its own."""
    if not allow_exec:
        raise PermissionError("test execution is opt-in: pass allow_exec=True")
    spark = df.sparkSession
    ship_package(spark)
    keyed = df.withColumn("program_id", F.sha2(F.col(program), 256))
    key = F.col(cost_key).cast("string") if cost_key else F.lit(None).cast("string")
    programs = keyed.where(F.col(program).isNotNull()).select(
        "program_id", F.col(program).alias("program"), key.alias("cost_key"))
    ids = programs.groupBy("program_id").agg(F.min("cost_key").alias("cost_key"))
    setting, run = memos.setting_of(timeout, limits), uuid.uuid4().hex
    if memo is None:
        todo = ids.withColumn("cost", F.lit(DEFAULT_SECONDS))
    else:
        before = memos.read(spark, memo)
        todo = join_dim(memos.unknown(ids, before, setting), memos.costs(before), "cost_key",
                        "left").withColumn("cost", F.coalesce("cost", F.lit(DEFAULT_SECONDS)))
    todo = cut_lineage(todo.select("program_id", "cost"))
    given = dict(limits or {})
    ran = _in_tasks(programs, todo, spread).mapInPandas(
        lambda it: _run_batch(it, timeout, given),
        f"program_id string, cost_key string, {memos.VERDICT}")
    names = [f.name for f in EXEC_SCHEMA.fields]
    if memo is None:
        return keyed.join(cut_lineage(ran).select(*names), "program_id", "left")
    if not todo.isEmpty():
        memos.append(ran, memo, setting, run)
    found = (memos.known(memos.read(spark, memo), setting).dropDuplicates(["program_id"])
             .select(*names, (F.col("run") != run).alias("from_memo")))
    return keyed.join(found, "program_id", "left")


def prepare(completions: DataFrame, completion: str = "completion", fence: str = "strip",
            messages: bool = False) -> DataFrame:
    """Clean the completion into ``code`` (P-03 for message lists, then
    P-01 ``strip`` or P-02 ``extract``) and check its syntax once (X-06)."""
    text = tx.messages_to_text(completion) if messages else F.col(completion)
    clean = tx.strip_fences(text) if fence == "strip" else tx.extract_code(text)
    return syntax_check(completions.withColumn("code", clean), "code")


def test_rows(checked: DataFrame, tasks: DataFrame, key=("completion_id",), style: str = "env",
              timeout: float = 5.0, allow_exec: bool = False,
              limits: dict | None = None, memo: str | None = None) -> DataFrame:
    """Fan out one program per (completion, test) (P-13), run it (X-07),
    and return ``key + test_idx, test, passed, error``.

    ``style='env'``: ``code + '\\n\\n' + test``, code that does not parse is
    not run and every test fails with 'SyntaxError'. ``style='setup'``:
    ``setup + code + test``, run regardless of syntax (R-08). ``'check'`` /
    ``'prompt_check'``: benchmark harness ``code + test + check(entry)``,
    the second with the prompt in front (P-13 forms 3 and 4)."""
    opt = [c for c in ("test_setup", "entry_point", "prompt") if c in tasks.columns]
    tcols = ["task_id", "tests"] + opt
    j = join_dim(checked.select(*key, "task_id", "code", "syntax_ok"), tasks.select(*tcols),
                 "task_id", "left")
    extra = opt
    per = j.select(*key, "code", "syntax_ok", *extra, F.posexplode("tests").alias("test_idx", "test"))
    if style == "env":
        prog = tx.test_program("env", "code", "test")
        to_run = per.filter(F.col("syntax_ok"))
        syntax = "syntax_ok"
    elif style == "setup":
        prog = tx.test_program("setup", "code", "test", setup=tx.setup_or_empty("test_setup")
                               if "test_setup" in extra else F.lit(""))
        to_run = per
        syntax = None
    elif style in ("check", "prompt_check"):
        # benchmark harness: the test defines check(); the program calls it
        prog = tx.test_program(style, "code", "test", entry_point="entry_point",
                               prompt="prompt" if style == "prompt_check" else None)
        to_run = per
        syntax = None
    else:
        raise ValueError(f"unknown style {style!r}")
    # programs of one test cost alike
    ran = run_programs(to_run.withColumns({"program": prog, "_test_id": F.md5("test")}), "program",
                       timeout, allow_exec, limits, memo=memo, cost_key="_test_id")
    ran = ran.select(*key, "test_idx", "ok", "stderr")
    out = per.join(ran, [*key, "test_idx"], "left")
    passed = F.coalesce(F.col("ok"), F.lit(False))
    return out.select(*key, "test_idx", "test", passed.alias("passed"),
                      tx.test_error(passed, "stderr", syntax).alias("error"))


def execution_verdicts(completions: DataFrame, tasks: DataFrame, key=("completion_id",),
                       completion: str = "completion", style: str = "env", fence: str = "strip",
                       timeout: float = 5.0, allow_exec: bool = False,
                       messages: bool = False, limits: dict | None = None,
                       memo: str | None = None) -> DataFrame:
    """R-07 (env style, fences stripped) / R-08 (setup style, first fence
    extracted): verdict per completion with feedback (A-01, P-14). A
    completion whose task has no tests keeps its row with 0 of 0."""
    from rewardlake.operators.verdicts import verdicts, with_feedback
    checked = prepare(completions, completion, fence, messages)
    per = test_rows(checked, tasks, key, style, timeout, allow_exec, limits, memo)
    v = verdicts(checked, per, key, "syntax_ok" if style == "env" else None)
    return with_feedback(v)



def execution_reward(completions: DataFrame, tasks: DataFrame, key=("completion_id",),
                     completion: str = "completion", timeout: float = 10.0,
                     allow_exec: bool = False, messages: bool = False,
                     name: str = "execution_reward", limits: dict | None = None,
                     memo: str | None = None) -> DataFrame:
    """R-09 / X-05: the batch reward of the RFT variant (P-03, P-02, setup
    style, 10 s); the output column is named after the reward."""
    v = execution_verdicts(completions, tasks, key, completion, "setup", "extract", timeout,
                           allow_exec, messages, limits, memo)
    return v.withColumnRenamed("fraction_passed", name)
