"""Per-step training metrics and their series (A-16, S-10 .. S-12, S-14,
W-09, J-07, F-06).

A run's series has one row per step, so the per-run windows here see
``#steps`` rows, never the raw turn rows (those are aggregated first).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardlake.operators.joins import join_dim
from rewardlake.operators.positions import by_part, laid_out, scan
from rewardlake.session import cut_lineage

SMOOTH_WIDTH = 15  # fixed value: moving-average width


def cadence(step: Column, every) -> Column:
    """F-06: ``(step + 1) % every == 0``."""
    e = F.lit(every) if isinstance(every, int) else every
    return F.pmod(step + 1, e) == 0


def smooth(series: DataFrame, value: str, key: str = "run_id", order: str = "step",
           width: int = SMOOTH_WIDTH, name: str | None = None) -> DataFrame:
    """W-09: trailing mean over ``width`` points, 'valid' mode (the first
    width-1 points have none); only runs with more than ``width`` points."""
    w = Window.partitionBy(key).orderBy(order)
    name = name or f"{value}_smooth"
    return (series.withColumn("_rn", F.row_number().over(w))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
            .withColumn(name, F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
            .filter((F.col("_n") > width) & (F.col("_rn") >= width))
            .drop("_rn", "_n"))


def smooth_blocks(series: DataFrame, value: str, key: str = "run_id", order: str = "step",
                  width: int = SMOOTH_WIDTH, name: str | None = None, block: int = 100_000
                  ) -> DataFrame:
    """:func:`smooth` for runs of any length: points are numbered by a scan over sampled ranges and
    cut into blocks of ``block`` points, each of which also gets the last ``width - 1`` points of
    the block before (its halo). One long run so spreads over many tasks."""
    if block < width:
        raise ValueError("a block must be at least as long as the window")
    name = name or f"{value}_smooth"
    laid = by_part(laid_out(series, [F.col(key).asc(), F.col(order).asc()]))
    rows = scan(laid, [key], order, counts={"_rn": F.lit(True)}).drop("_part", "_place")
    long_enough = rows.groupBy(key).agg(F.max("_rn").alias("_last")).where(F.col("_last") >= width)
    own = F.floor(F.col("_rn") / block)
    halo = F.pmod("_rn", F.lit(block)) >= block - (width - 1)
    cells = F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumn("_own", own).withColumn("_block", F.explode(cells))
    w = Window.partitionBy(key, "_block").orderBy("_rn").rowsBetween(-(width - 1), 0)
    out = cut.withColumn(name, F.avg(value).over(w)).where(
        (F.col("_block") == F.col("_own")) & (F.col("_rn") >= width - 1))
    return join_dim(out, long_enough, key).drop("_rn", "_own", "_block", "_last")


def with_eval_points(dense: DataFrame, points: DataFrame, base: DataFrame,
                     keys=("run_id", "step")) -> DataFrame:
    """J-07: the dense series left-joined to sparse eval points, with the
    base point at step 0, prepended as a row of its own where the series
    has none. An evaluation after ``step`` is logged at ``step + 1``."""
    keys = list(keys)
    run, step = keys
    pts = points.withColumn(step, F.col(step) + 1).unionByName(base)
    alone = base.join(dense.select(*keys).distinct(), keys, "left_anti")
    return dense.join(pts, keys, "left").unionByName(alone, allowMissingColumns=True)


def rows_from_columnar(log: DataFrame, dense: list[str], key: str = "run_id") -> DataFrame:
    """S-11: a columnar log (one row per run, parallel arrays) to rows."""
    zipped = F.arrays_zip(*[F.col(c) for c in dense])
    return log.select(key, F.inline(zipped))


def long_form(df: DataFrame, keys, values) -> DataFrame:
    """S-11 wide -> long (one row per metric)."""
    return df.unpivot(list(keys), list(values), "metric", "value")


def write_series(df: DataFrame, path: str, mode: str = "overwrite", partition: str = "run_id"):
    """S-10: the step-metrics / eval-points sink, partitioned by run."""
    df.write.mode(mode).partitionBy(partition).parquet(path)


SERIES_STEPS = 10_000       # steps of a run in one partition of the stored series


def upsert_series(df: DataFrame, path: str, kind: str = "dense", steps: int = SERIES_STEPS,
                  keys=("run_id", "step")) -> None:
    """S-10: ``df`` into the stored series of ``kind`` (``dense`` step rows, ``eval`` points), each
    (run, step) once: rows of a step that is there already are replaced, other steps stay. Only the
    (run, step range) partitions that ``df`` touches are written, so a job that is run again, or
    that died half-way, leaves one copy."""
    spark = df.sparkSession
    run, step = keys
    new = cut_lineage(df.withColumns({"kind": F.lit(kind),
                                      "steps": F.floor(F.col(step) / steps).cast("long")}))
    touched = new.select(run, "steps").distinct()
    empty = spark.createDataFrame([], new.schema)
    empty.write.mode("append").partitionBy("kind", run, "steps").parquet(path)
    old = (spark.read.schema(new.schema).parquet(path).where(F.col("kind") == kind)
           .join(touched, [run, "steps"], "left_semi").join(new.select(*keys), list(keys), "left_anti"))
    # written aside first: a folder cannot be read and replaced at once
    whole = cut_lineage(old.select(*new.columns).unionByName(new))
    (whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("kind", run, "steps").parquet(path))


def read_series(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The stored rows of one kind; ``schema`` are the columns without ``kind`` and ``steps``."""
    full = spark.read.schema(f"{schema}, kind string, steps long").parquet(path)
    names = [c.split()[0] for c in schema.split(",")]
    return full.where(F.col("kind") == kind).select(*names)


def text_log(df: DataFrame, epoch: str = "epoch", step: str = "step") -> DataFrame:
    """S-14: one formatted line per record, detail rows only on
    ``epoch % 10 == 0 and step % 5 == 0``."""
    head = F.format_string("epoch = %d, step = %d, loss = %.3f, reward = %.3f",
                           F.col(epoch), F.col(step), F.col("loss"), F.col("mean_reward"))
    return df.select(epoch, step, head.alias("line"),
                     ((F.pmod(F.col(epoch), F.lit(10)) == 0) & (F.pmod(F.col(step), F.lit(5)) == 0))
                     .alias("detail"))


def fmt_array(x) -> Column:
    """S-14 ``tstr``: '[a, b]' with three decimals."""
    c = F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.format_string("%.3f", v)),
                                             ", "), F.lit("]"))


def fmt_ints(x) -> Column:
    """A list of whole numbers as Python prints it."""
    c = F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


LINE_ORDER = ("epoch", "step", "batch", "trial")


def text_lines(heads: DataFrame, details: DataFrame) -> DataFrame:
    """S-14: ``epoch, step, batch, trial, line``: the head line of every record (batch and trial
    -1) and, where its detail is due, a line for each prompt (trial -1) and each response.

    ``details`` has ``epoch, step, batch, trial, prompt, response, log_probs, reward, delta``."""
    log = text_log(heads)
    none = F.lit(-1)
    due = details.join(log.where("detail").select("epoch", "step"), ["epoch", "step"], "left_semi")
    prompt = due.groupBy("epoch", "step", "batch").agg(F.min_by("prompt", "trial").alias("prompt"))
    response = F.concat(F.lit("  response = "), fmt_ints("response"), F.lit(", log_probs = "),
                        fmt_array("log_probs"), F.format_string(
                            ", reward = %.3f, delta = %.3f", F.col("reward"), F.col("delta")))
    parts = (
        log.select("epoch", "step", none.alias("batch"), none.alias("trial"), "line"),
        prompt.select("epoch", "step", "batch", none.alias("trial"),
                      F.concat(F.lit("  prompt = "), fmt_ints("prompt")).alias("line")),
        due.select("epoch", "step", "batch", "trial", response.alias("line")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_text_log(lines: DataFrame, path: str, files: int | None = None) -> None:
    """S-14 writer: the lines in order; file after file (by name) is the whole log."""
    order = [F.col(c).asc() for c in LINE_ORDER]
    ranged = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("line").write.text(path)


def records(df: DataFrame, steps_per_epoch: int, epoch: str = "epoch", step: str = "step") -> DataFrame:
    """S-12: record rows with the global step ``epoch * steps_per_epoch + step``."""
    return df.select(epoch, (F.col(epoch) * steps_per_epoch + F.col(step)).alias("step"),
                     "loss", "mean_reward")


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S-13: skip the work when the output already exists (``ignore`` mode)."""
    df.write.mode("ignore").format(fmt).save(path)
