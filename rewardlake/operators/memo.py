"""Stored verdicts of programs (X-07), so that a program runs once and not once a job.

The memo is a parquet table on shared storage, one folder per bucket (the first two digits of
the program's hash), to which each job appends what it ran; readers prune to the buckets they ask
for. A verdict holds for the limits it was found under (``setting``). Two jobs that ran one program at
the same time leave two rows, of which one is read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = ("ok boolean, returncode int, stderr string, timed_out boolean, limit_hit string, "
           "seconds double")
MEMO_SCHEMA = f"program_id string, cost_key string, {VERDICT}, setting string, run string, bucket string"
VERDICT_FIELDS = tuple(c.split()[0] for c in VERDICT.split(", "))


def setting_of(timeout: float, limits: dict | None) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted({"timeout": timeout, **(limits or {})}.items())
                    if v is not None)


def bucket_of(program_id: str = "program_id") -> Column:
    return F.substring(program_id, 1, 2)


def append(ran: DataFrame, path: str, setting: str, run: str) -> None:
    """Adds the verdicts of one job."""
    (ran.withColumns({"setting": F.lit(setting), "run": F.lit(run), "bucket": bucket_of()})
     .write.mode("append").partitionBy("bucket").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The memo; an empty one is made where there is none yet."""
    empty = spark.createDataFrame([], MEMO_SCHEMA)
    empty.write.mode("append").partitionBy("bucket").parquet(path)
    return spark.read.schema(MEMO_SCHEMA).parquet(path)


def known(memo: DataFrame, setting: str) -> DataFrame:
    return memo.where(F.col("setting") == setting)


def unknown(ids: DataFrame, memo: DataFrame, setting: str) -> DataFrame:
    """The ``program_id`` rows of ``ids`` without a verdict under ``setting``."""
    have = known(memo, setting).select("bucket", "program_id")
    return ids.withColumn("bucket", bucket_of()).join(
        have, ["bucket", "program_id"], "left_anti").drop("bucket")


def costs(memo: DataFrame) -> DataFrame:
    """``cost_key, cost``: mean seconds of the programs with that key, under any setting."""
    return memo.groupBy("cost_key").agg(F.avg("seconds").alias("cost"))
