"""Readers for logged rollouts and tasks with declared schemas.

Real logs arrive as parquet or JSON lines written by the rollout workers;
nothing is inferred. Parquet inputs are read with the declared schema so a
missing optional column reads as null instead of failing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rewardlake.schemas import COMMITS, COMPLETIONS, TASKS


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    return spark.read.schema(schema).format(fmt).load(path)


def read_completions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Completions keyed by ``(run_id, step, g, turn)`` (COMPLETIONS schema)."""
    return _read(spark, path, COMPLETIONS, fmt)


def read_tasks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Tasks in the normalised shape (TASKS schema)."""
    return _read(spark, path, TASKS, fmt)


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Commit histories ``(traj_id, pos, code)``."""
    return _read(spark, path, COMMITS, fmt)
